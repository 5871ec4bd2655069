"""Exact n-gram Jaccard join (operator 10).

The incidence matrix of documents and word n-grams is multiplied with its transpose in column blocks. How many blocks the
columns are cut into follows from the sizes: two sets of a and b n-grams that reach the threshold differ in at most d
elements, d a bound of a + b; with more than d blocks they agree in at least one whole block. So a document is entered
once per block, under a digest of its part of that block, and only pairs that agree in a block get an entry of the
product: their overlap is then accumulated over all blocks and compared with the least overlap that their sizes allow.
A common passage does not bring pairs together: it fills no block alone.

* Equal sets are one node from the start (exact copies and reordered repeats cost nothing more).
* Each document is first compared with one pivot, that of most blocks in common. Only documents that this leaves in
  different components are compared with each other, block by block. So a group of near copies costs a few comparisons for each document, and no link between
  components is lost.
* A block is empty for both documents, and no use, only if a set occupies at most d blocks; such (small) sets are also
  entered under each element of their prefix, which any two similar sets share.

Sets are held as 64-bit hashes of n-grams and recomputed from the texts that have a candidate; a class of equal sets is
known by 128 bits.

Defined results. NULL or blank text: an empty set, linked with nothing. Fewer words than n: one element, the whole sequence.
Repeated rows and equal sets: linked. NULL doc_id: linked like any other; a component of only such rows has a NULL
component_id. Empty table: no rows. Extra columns: ignored by ``components_of``, kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorekit.llm.arrow import bounded_batches, bytes_of, give_back
from scorekit.llm.components import components
from scorekit.llm.text import FILE, ROW, with_locator, words
from scorekit.skew import broadcast_if_small, join_counted
from scorekit.workspace import materialise

#: Pairs of one pivot that one task compares, and parts of a pivot for which its text is read once.
PAIRS_PER_PART = 256
ROLES_PER_READ = 1000

#: There are more blocks than a pair may have differences, in this proportion. The more, the fewer pairs that agree by
#: chance pass the count of blocks in common; and the more entries.
SLACK = (5, 4)
#: The last bits of an entry: its level, or all set for an element of a prefix.
PREFIX = 127

#: Documents of one side of a tile.
TILE = 512

#: Bits of the bitmaps that sort out entries before a shuffle: so many for each key, which are counted, and at most (64 MB in
#: each worker). Beyond that they sort out less, and the joins do the rest.
BITS_PER_KEY, MOST_BITS = 16, 1 << 29
#: Pieces in which a bitmap comes to the driver; each is a job.
PIECES = 8

#: Bytes of a table of places that is broadcast, and of one role or tile in its lists.
BROADCAST_BYTES, LISTED_BYTES = 32 << 20, 16

#: Words whose hashes a task remembers; then it starts anew. Memory only, never a result.
CACHE = 250_000

PLACE = [FILE, ROW]

_U = np.uint64
_STEP, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    with np.errstate(over="ignore"):
        x = x + _U(seed) * _STEP
        x = (x ^ (x >> _U(30))) * _MIX1
        x = (x ^ (x >> _U(27))) * _MIX2
        return x ^ (x >> _U(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def _hashes() -> _WordHashes:
    return _WordHashes()


def shingles(text: bytes, n: int) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text."""
    found = words(text)
    if not found:
        return np.empty(0, _U)
    row = np.fromiter(map(_hashes().__getitem__, found), _U, len(found))
    width = min(n, len(row))
    with np.errstate(over="ignore"):
        rolled = row[: len(row) - width + 1].copy()
        for i in range(1, width):
            rolled = rolled * _STEP + row[i : len(row) - width + 1 + i]
    if len(row) < n:
        rolled = rolled + _U(len(row))
    return np.unique(_mixed(rolled, 1))


def least_overlap(total: int, percent: int) -> int:
    """The smallest overlap of two sets of ``total`` elements together with 100 * overlap >= percent * union."""
    return -(-percent * total // (100 + percent))


def _steps(limit: int) -> list[int]:
    """Numbers of blocks in use: 1, 2, 3, 4, 6, 8, 12, ..."""
    steps, power = [1], 2
    while steps[-1] < limit:
        steps += [power, power + power // 2]
        power *= 2
    return steps


_STEPS = np.array(_steps(1 << 40))


def level_of(differences: np.ndarray | int) -> np.ndarray:
    """Which number of blocks (a place in ``_STEPS``) serves pairs with at most so many differences: some more than these."""
    return np.searchsorted(_STEPS, -(-SLACK[0] * (np.asarray(differences) + 1) // SLACK[1]))


def levels(size: int, percent: int) -> list[tuple[int, int]]:
    """For a set of ``size``: the levels of all partners it may have, each with its bound of differences."""
    smallest, largest = -(-percent * size // 100), 100 * size // percent
    low, high = (size + other - 2 * least_overlap(size + other, percent) for other in (smallest, largest))
    # The bound does not fall when a partner grows by two, but may by one when it grows by one.
    low, high = max(low - 1, 0), high + 1
    first, last = int(level_of(low)), int(level_of(high))
    return [(level, min(high, int(_STEPS[level]) * SLACK[1] // SLACK[0] - 1)) for level in range(first, last + 1)]


def signatures(elements: np.ndarray, percent: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the blocks of a set, the level in their last bits, and beside each the number of blocks in use there."""
    size, parts, filled = len(elements), [], []
    if not size:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    weights = _mixed(elements, 2) if weights is None else weights
    with np.errstate(over="ignore"):
        for level, differences in levels(size, percent):
            blocks = int(_STEPS[level])
            block = (elements >> _U(32)) * _U(blocks) >> _U(32)
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            sums = np.add.reduceat(weights, starts)
            digests = _mixed(sums ^ _mixed(block[starts] + _U(blocks << 20), 3), 4)
            parts.append(digests & ~_U(PREFIX) | _U(level))
            filled.append(np.full(len(starts), len(starts), np.int32))
            if len(starts) <= differences:
                prefix = elements[: size - -(-percent * size // 100) + 1]
                parts.append(_mixed(prefix + _U(blocks), 5) | _U(PREFIX))
                filled.append(np.zeros(len(prefix), np.int32))
    return np.concatenate(parts).view(np.int64), np.concatenate(filled)


def _prints(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, place, number of n-grams, 128-bit digest of the set (c1, c2), and block digests of each row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, c1, c2, sigs, fills = [], [], [], [], []
            for text in bytes_of(batch, "text"):
                elements = shingles(text, n)
                sizes.append(len(elements))
                weights = _mixed(elements, 2)
                c1.append(weights.sum(dtype=_U))
                c2.append((weights * (weights >> _U(31) | _U(1))).sum(dtype=_U))
                digests, filled = signatures(elements, percent, weights)
                sigs.append(digests)
                fills.append(filled)
            lengths = np.fromiter(map(len, sigs), np.int64, len(sigs))
            flat = np.concatenate([np.empty(0, np.int64), *sigs])
            filled = np.concatenate([np.empty(0, np.int32), *fills])
            offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
            keep = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            columns = [
                pa.array(sizes, pa.int64()),
                pa.array(np.array(c1, _U).view(np.int64)),
                pa.array(np.array(c2, _U).view(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(flat)),
                pa.ListArray.from_arrays(offsets, pa.array(filled)),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + columns,
                names=[batch.schema.names[i] for i in keep] + ["n_shingles", "c1", "c2", "sigs", "fills"],
            )
        give_back(_hashes())

    schema = f"doc_id long, `{FILE}` string, `{ROW}` long, n_shingles long, c1 long, c2 long, sigs array<long>, fills array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *PLACE, "text").mapInArrow(run, schema)


def _overlaps(docs: DataFrame, prints: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) that reach the threshold, by the sets of their texts.

    Each b meets its partners in parts of about ``PAIRS_PER_PART``. A text is read, and its set made, once for up to
    ``ROLES_PER_READ`` of the places where it is needed, and sets travel to these places once.
    """
    counts = pairs.groupBy("b").agg(F.count("*").alias("n"))
    counts = materialise(counts.withColumn("parts", F.ceil(F.col("n") / PAIRS_PER_PART).cast("int")), "ngram-pivots")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    part = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
    members = join_counted(pairs, counts, ["b"], F.col("n"), total).select(F.col("a").alias("uid"), "b", part.alias("part"))
    pivots = counts.select(F.col("b").alias("uid"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    reads = F.pmod(F.xxhash64("b"), F.lit(64)).cast("int")
    roles = (
        members.withColumn("read", reads)
        .unionByName(pivots.withColumn("read", F.floor(F.col("part") / ROLES_PER_READ).cast("int")))
        .groupBy("uid", "read")
        .agg(F.collect_list(F.struct("b", "part")).alias("roles"))
    )
    roles = materialise(prints.select("uid", *PLACE).join(roles, "uid").drop("read"), "ngram-roles")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(text, n).tobytes() for text in bytes_of(batch, "text")]
            at = [batch.schema.get_field_index(c) for c in ("uid", "roles")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in at), pa.array(found, pa.binary())], names=["uid", "roles", "elements"]
            )

    def compare(table: pa.Table) -> pa.Table:
        uid, b = table.column("uid").to_numpy(), table.column("b")[0].as_py()
        elements = [np.frombuffer(e, _U) for e in table.column("elements").to_pylist()]
        pivot = elements[int(np.flatnonzero(uid == b)[0])]
        passed = [
            a
            for a, x in zip(uid.tolist(), elements, strict=True)
            if a != b and len(np.intersect1d(x, pivot, assume_unique=True)) >= least_overlap(len(x) + len(pivot), percent)
        ]
        return pa.table({"a": pa.array(passed, pa.int64()), "b": pa.array([b] * len(passed), pa.int64())})

    texts = docs.select(*PLACE, "text").join(_small_enough(roles, "roles"), PLACE).select("uid", "roles", "text")
    placed = texts.mapInArrow(sets, "uid long, roles array<struct<b: long, part: int>>, elements binary")
    placed = placed.select("uid", "elements", F.inline("roles"))
    return materialise(placed.groupBy("b", "part").applyInArrow(compare, "a long, b long"), "ngram-links")


def _small_enough(places: DataFrame, listed: str) -> DataFrame:
    """Rows of places with a list each, with a broadcast hint if their counted bytes allow it."""
    paths = F.sum(F.octet_length(FILE) + 64 + LISTED_BYTES * F.size(listed))
    size = places.agg(F.coalesce(paths, F.lit(0))).first()[0]
    return F.broadcast(places) if size <= BROADCAST_BYTES else places


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap with the bit at the first digits of every ``key`` set, sized by the counted number of keys."""
    wanted, bits = BITS_PER_KEY * keys.count(), 1 << 15
    while bits < wanted and bits < MOST_BITS:
        bits *= 2
    place = F.shiftrightunsigned("key", 64 - bits.bit_length() + 1)
    chunks = keys.select(place.alias("place")).groupBy(F.shiftright("place", 15).alias("chunk")).agg(
        F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(32767))).alias("bits")
    )
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in chunks.coalesce(PIECES).toLocalIterator():
        bitmap[r["chunk"] * 4096 : (r["chunk"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bitmap


def _held(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys.view(_U) >> _U(64 - (len(bitmap) * 8).bit_length() + 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _entries(prints: DataFrame, rows: Broadcast, shared: Broadcast | None = None) -> DataFrame:
    """Entries (c1, sig, fill) of the rows that ``rows`` holds and, with ``shared``, of the digests that it holds.

    Bitmaps sort out most of what is not wanted before the shuffle; what they let through is sorted out behind it. Without
    ``shared`` only sig is given.
    """
    hashed = prints.select(F.xxhash64("uid").alias("key"), "c1", "sigs", "fills")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_held(rows.value, batch.column(0).to_numpy())))
            sigs, fills = batch.column(2), batch.column(3)
            flat = sigs.flatten().to_numpy()
            if shared is None:
                yield pa.RecordBatch.from_arrays([pa.array(flat)], names=["sig"])
                continue
            may = _held(shared.value, flat)
            owner = np.repeat(batch.column(1).to_numpy(), sigs.value_lengths().to_numpy())
            columns = [owner[may], flat[may], fills.flatten().to_numpy()[may]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["c1", "sig", "fill"])

    return hashed.mapInArrow(run, "sig long" if shared is None else "c1 long, sig long, fill int")


def _candidates(open_: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that agree in as many blocks as their sizes ask for, by tiles.

    Documents are laid out in strips of about ``TILE``: those that ``near`` (node, component) holds together side by side.
    A tile is two strips that meet in some block; it multiplies the incidence of its documents and blocks. Result, one row
    per tile with candidates: tile, nodes, and the pairs as places in ``nodes`` (a, b).
    """
    nodes = open_.select("node").distinct().join(near, "node", "left").select("node", F.coalesce("component", "node").alias("place"))
    nodes = materialise(nodes, "ngram-places")
    places = nodes.groupBy("place").agg(F.count("*").alias("n"))
    n_nodes = nodes.count()
    strips = F.ceil(F.col("n") / TILE)
    strip = F.when(strips > 1, F.xxhash64("place", F.pmod(F.xxhash64("node"), strips))).otherwise(
        F.pmod(F.xxhash64("place"), F.lit(-(-n_nodes // TILE)))
    )
    nodes = join_counted(nodes, places, ["place"], F.col("n"), n_nodes).select("node", strip.alias("strip"))
    entry = F.struct("node", "size", "component", "fill")
    lists = open_.join(nodes, "node").groupBy("sig", "strip").agg(
        F.collect_list(entry).alias("x"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    lists = materialise(lists, "ngram-lists")
    other = lists.select("sig", *[F.col(c).alias(f"{c}_2") for c in ("strip", "x", "low", "high")])
    mixed = F.least("low", "low_2") < F.greatest("high", "high_2")
    met = lists.join(other, "sig").filter((F.col("strip") <= F.col("strip_2")) & mixed)
    met = met.select("strip", "strip_2", "sig", "x", F.when(F.col("strip") < F.col("strip_2"), F.col("x_2")).alias("y"))

    def sides(column: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
        """Of each entry: row of the table, node, size, component, fill."""
        column = column.combine_chunks()
        row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = column.flatten()
        return row, *(flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))

    def run(table: pa.Table) -> pa.Table:
        left = sides(table.column("x"))
        same = table.column("strip")[0].as_py() == table.column("strip_2")[0].as_py()
        right = left if same else sides(table.column("y"))
        marks = table.column("sig").to_numpy() & PREFIX
        (i_nodes, i_first, i_at), (j_nodes, j_first, j_at) = (
            np.unique(side[1], return_index=True, return_inverse=True) for side in (left, right)
        )
        i_size, j_size, i_part, j_part = left[2][i_first], right[2][j_first], left[3][i_first], right[3][j_first]
        total = i_size[:, None] + j_size[None, :]
        differences = total - 2 * (-(-percent * total // (100 + percent)))
        level = level_of(differences)
        counted = np.zeros(total.shape, np.int32)
        asked = np.ones(total.shape, np.int64)
        forced = np.zeros(total.shape, bool)
        i_cut = np.searchsorted(left[0], np.arange(len(marks) + 1))
        j_cut = np.searchsorted(right[0], np.arange(len(marks) + 1))
        for r, mark in enumerate(marks.tolist()):
            own, its = slice(i_cut[r], i_cut[r + 1]), slice(j_cut[r], j_cut[r + 1])
            cell = np.ix_(i_at[own], j_at[its])
            if mark == PREFIX:
                forced[cell] = True
            else:
                fits = level[cell] == mark
                counted[cell] += fits
                asked[cell] = np.where(fits, left[4][own][:, None] - differences[cell], asked[cell])
        small, large = np.minimum(i_size[:, None], j_size[None, :]), np.maximum(i_size[:, None], j_size[None, :])
        good = ((counted >= np.maximum(asked, 1)) | forced) & (100 * small >= percent * large)
        good &= (i_part[:, None] != j_part[None, :]) & (i_nodes[:, None] != j_nodes[None, :])
        a, b = np.nonzero(np.triu(good) if same else good)
        if not len(a):
            return pa.table({"tile": pa.array([], pa.int64()), **{c: pa.array([], pa.list_(pa.int64())) for c in ("nodes", "a", "b")}})
        every, where = np.unique(np.r_[i_nodes[a], j_nodes[b]], return_inverse=True)
        lists_ = {"nodes": every, "a": where[: len(a)], "b": where[len(a) :]}
        return pa.table({"tile": pa.array([0]), **{c: pa.array([v.tolist()], pa.list_(pa.int64())) for c, v in lists_.items()}})

    schema = "tile long, nodes array<long>, a array<long>, b array<long>"
    found = met.groupBy("strip", "strip_2").applyInArrow(run, schema)
    return found.withColumn("tile", F.monotonically_increasing_id())


def _tile_links(docs: DataFrame, prints: DataFrame, tiles: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) among the candidates of each tile, by the sets of their texts; enough of them to hold together what they
    connect, the others are not tried."""
    asked = materialise(tiles.select("tile", F.explode("nodes").alias("uid")), "ngram-asked")
    reads = asked.groupBy("uid").agg(F.count("*").alias("n")).withColumn("reads", F.ceil(F.col("n") / ROLES_PER_READ))
    read = F.pmod(F.xxhash64("tile"), F.col("reads")).alias("read")
    wanted = join_counted(asked, reads, ["uid"], F.col("n"), asked.count()).select("uid", "tile", read)
    wanted = wanted.groupBy("uid", "read").agg(F.collect_list("tile").alias("tiles")).drop("read")
    wanted = materialise(prints.select("uid", *PLACE).join(wanted, "uid"), "ngram-wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(text, n).tobytes() for text in bytes_of(batch, "text")]
            at = [batch.schema.get_field_index(c) for c in ("uid", "tiles")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in at), pa.array(found, pa.binary())], names=["uid", "tiles", "elements"]
            )

    def compare(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        pairs = next(r for r in rows if r["a"] is not None)
        of = {r["uid"]: np.frombuffer(r["elements"], _U) for r in rows if r["a"] is None}
        elements = [of[node] for node in pairs["nodes"]]
        root = list(range(len(elements)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        links = []
        for a, b in zip(pairs["a"], pairs["b"], strict=True):
            i, j = find(a), find(b)
            if i != j:
                x, y = elements[a], elements[b]
                if len(np.intersect1d(x, y, assume_unique=True)) >= least_overlap(len(x) + len(y), percent):
                    root[i] = j
                    links.append((pairs["nodes"][a], pairs["nodes"][b]))
        return pa.table({c: pa.array([link[i] for link in links], pa.int64()) for i, c in enumerate("ab")})

    texts = docs.select(*PLACE, "text").join(_small_enough(wanted, "tiles"), PLACE).select("uid", "tiles", "text")
    own = texts.mapInArrow(sets, "uid long, tiles array<long>, elements binary")
    lists = ("nodes", "a", "b")
    own = own.select(F.explode("tiles").alias("tile"), "uid", "elements", *[F.lit(None).cast("array<long>").alias(c) for c in lists])
    pairs = tiles.select("tile", F.lit(-1).cast("long").alias("uid"), F.lit(b"").alias("elements"), *lists)
    return materialise(own.unionByName(pairs).groupBy("tile").applyInArrow(compare, "a long, b long"), "ngram-links")


def _grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, place, n_shingles, component (a number; NULL: no set), component_id of each row; ``docs`` has places."""
    prints = _prints(docs, n, percent).withColumn("uid", F.monotonically_increasing_id())
    all_prints = materialise(prints, "ngram-prints")
    prints = all_prints.filter("n_shingles > 0")
    classes = prints.groupBy("c1", "c2").agg(
        F.min("uid").alias("node"), F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("size"), F.count("*").alias("n_rows")
    )
    classes = materialise(classes, "ngram-classes")
    names = classes.select("c1", "node", "size")

    # Block digests that more than one class has, and the classes that have them. Of equal sets one row goes on.
    spark = docs.sparkSession
    rows = spark.sparkContext.broadcast(_bitmap(classes.select(F.xxhash64("node").alias("key"))))
    shared = _entries(prints, rows).groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialise(shared, "ngram-blocks")
    known = spark.sparkContext.broadcast(_bitmap(shared.select(F.col("sig").alias("key"))))
    n_entries = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = join_counted(_entries(prints, rows, known), shared, ["sig"], F.col("n"), n_entries)
    members = materialise(members.select("sig", "c1", "fill").distinct(), "ngram-members")
    rows.destroy()
    known.destroy()
    pivots = members.groupBy("sig").agg(F.min("c1").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    pivoted = join_counted(members, materialise(pivots, "ngram-first"), ["sig"], F.col("n"), n_entries)

    # First each class with the one pivot that it has most blocks in common with.
    common = pivoted.filter("c1 <> pivot").groupBy("c1", "pivot").agg(F.count("*").alias("blocks"))
    most = common.groupBy("c1").agg(F.max_by("pivot", F.struct("blocks", "pivot")).alias("pivot"))
    a = names.select("c1", F.col("node").alias("a"), F.col("size").alias("size_a"))
    b = names.select(F.col("c1").alias("pivot"), F.col("node").alias("b"), F.col("size").alias("size_b"))
    pairs = most.join(a, "c1").join(b, "pivot").filter(_near("size_a", "size_b", percent)).select("a", "b")
    pairs = materialise(pairs, "ngram-pairs")
    links = _overlaps(docs, prints, pairs, n, percent)
    labels = components(links)

    # Then the classes of blocks that are not in one component yet.
    placed = members.select("sig", "c1", "fill").join(names, "c1").join(labels, "node", "left")
    placed = placed.select("sig", "node", "size", "fill", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    open_ = materialise(placed.join(mixed.select("sig"), "sig"), "ngram-open")
    if not open_.isEmpty():
        tiles = materialise(_candidates(open_, components(pairs), percent), "ngram-tiles")
        labels = components(links.unionByName(_tile_links(docs, prints, tiles, n, percent)))

    labelled = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n_classes"))
    labelled = join_counted(labelled, ids, ["component"], F.col("n_classes"), classes.count())
    labelled = materialise(labelled.select("c1", "c2", "n_rows", "component", "component_id"), "ngram-labels")
    rows = join_counted(prints.drop("sigs", "fills", "uid"), labelled, ["c1", "c2"], F.col("n_rows"), prints.count())
    empty = all_prints.filter("n_shingles = 0").drop("sigs", "fills", "uid")
    empty = empty.withColumns({"n_rows": F.lit(1), "component": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    return rows.unionByName(empty)


def _near(a: str, b: str, percent: int) -> Column:
    """Sizes that allow the threshold at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def components_of(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable over links)."""
    return _grouped(with_locator(docs), n, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The row of smallest doc_id of each component, and all rows without a set, with all columns of ``docs``."""
    placed = with_locator(docs)
    grouped = _grouped(placed, n, percent).filter("component is not null").select("doc_id", *PLACE, "component")
    grouped = materialise(grouped, "ngram-groups")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *PLACE)
    first = grouped.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("n_rows"))
    first = first.filter("n_rows > 1").select(
        "component", "n_rows", F.col(f"first.{FILE}").alias("kept_file"), F.col(f"first.{ROW}").alias("kept_row")
    )
    first = materialise(first, "ngram-first")
    stays = (F.col(FILE) == F.col("kept_file")) & (F.col(ROW) == F.col("kept_row"))
    gone = join_counted(grouped, first, ["component"], F.col("n_rows"), grouped.count()).filter(~stays).select(*PLACE)
    gone = materialise(gone, "ngram-dropped")
    return placed.join(broadcast_if_small(gone, gone.count()), PLACE, "left_anti").select(*docs.columns)
