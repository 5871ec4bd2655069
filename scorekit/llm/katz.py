"""Katz backoff language model (operator 1).

An n-gram seen r times after its context has the probability d(r) * r / c(context), d being Good-Turing's discount for
r <= 5 and 1 above; any other word has the context's backoff weight times its probability after the shorter context. The
weight of a context is what the discounts leave, divided by what the shorter context gives to the words not seen after the
longer one, so the probabilities after every context sum to 1. Words are the training words, the end of a text, and one
class of all unknown words, which gets what the discounts of single words leave.

How the corpus is handled. Tasks read documents into groups of a bounded number of tokens and reduce each group to its
distinct n-grams, with training counts, before anything is shuffled. Level by level, groups send their n-grams to buckets
of n-gram hashes, which add the counts up and send them back; sums over contexts travel the same way in buckets of context
hashes. So no context or word, however frequent, meets in one task: a bucket gets one entry per group at most for each
n-gram. What each bucket has added up is the model, stored in tables partitioned by level and bucket: counts with
lower-order probabilities, and contexts with their denominators and backoff weights. Scores are found recursively: the
probability of an n-gram comes from its own count or from its context's weight and the n-gram one word shorter.

n-grams are known by 64-bit hashes.

Defined results. NULL or empty text: only the end. NULL doc_id: its text for the split is empty (training). Repeated rows:
each is trained on and scored. No training rows: every word is unknown, with probability 1. Empty table: no rows. Extra
columns: ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorekit.llm.arrow import bounded_batches, bytes_of
from scorekit.llm.text import words
from scorekit.workspace import fresh_path, release, write_compact

#: Discounts apply to n-grams seen up to so often.
DISCOUNTED = 5
#: Tokens of one group; the bound of what a task holds.
GROUP_TOKENS = 2_500_000
#: Entries that one bucket gets.
BUCKET_ENTRIES = 1_000_000
#: Words whose hashes a task remembers; then it starts anew. Memory only, never a result.
CACHE = 500_000

_U = np.uint64
_STEP, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
#: No word holds white space, so these are no word's hashes but by chance.
_END, _START = _U(xxhash.xxh64_intdigest(b" end")), _U(xxhash.xxh64_intdigest(b" start"))

def _compress(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _decompress(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


#: What the distinct n-grams of a group are worked out from.
SEQUENCE = ("held", "lens", "words", "seq")
PARCELS = "bucket int, gid long, a binary, b binary, c binary, d binary"
_FIELDS = ["bucket", "gid", "a", "b", "c", "d"]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def _hashes() -> _WordHashes:
    return _WordHashes()


def _follow(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context that goes on with a word."""
    with np.errstate(over="ignore"):
        x = (context ^ (context >> _U(29))) * _MIX1 + word * _STEP
        x = (x ^ (x >> _U(30))) * _MIX2
        return x ^ (x >> _U(31))


def _pack(values: np.ndarray) -> bytes:
    """Numbers as bytes, the n-th bytes of all side by side and compressed: they cross shuffles and lie in tables so."""
    if values.dtype.kind == "f" or not len(values):  # floats here repeat as a whole
        return _compress(values.tobytes())
    return _compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(_decompress(data), np.uint8)
    if np.dtype(kind).kind == "f":
        return raw.view(kind)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=_U(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, _U), dtype=_U)


def _unpack_all(rows: list[dict], name: str, kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(_unpack(r[name], kind) for r in rows)])


def _parcels(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_FIELDS)


def _slices(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The slices of sorted hashes that go to each bucket."""
    bucket = (keys >> _U(32)) * _U(buckets) >> _U(32)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else []
    for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
        yield int(bucket[start]), slice(start, end)


# ---- groups of documents -----------------------------------------------------------------------------------------------


GROUP = "gid long, doc_ids binary, held binary, lens binary, words binary, seq binary, n_words long, n_tokens long"


def _group(gid: int, docs: list[tuple[int | None, bool, np.ndarray]]) -> dict:
    """Some documents as one sequence of places (``seq``) in the list of their distinct words (sorted hashes)."""
    stream = np.concatenate([part for _, _, t in docs for part in (t, [_END])]).astype(_U)
    words, seq = np.unique(stream, return_inverse=True)
    return {
        "gid": gid,
        "doc_ids": _pack(np.array([-1 if i is None else i for i, _, _ in docs], np.int64)),
        "held": _pack(np.array([held + 2 * (i is None) for i, held, _ in docs], np.int8)),
        "lens": _pack(np.array([len(t) + 1 for _, _, t in docs], np.int64)),
        "words": _pack_sorted(words),
        "seq": _pack(seq.astype("<u4")),
        "n_words": len(words),
        "n_tokens": len(stream),
    }


class _Lists:
    """The distinct n-grams of a group at level k, worked out from its sequence whenever they are needed.

    ``keys``: their hashes (of single words: sorted). ``ctx``: the place of each one's context among ``contexts``, which are
    the n-grams of the level below and the start of a text. ``lower``: the place, in the level below, of the n-gram without
    its first word. ``last``: the place of the n-gram that ends at each token. ``counts``: in training documents.
    """

    def __init__(self, row: dict, k: int):
        self.lens, held = _unpack(row["lens"], np.int64), _unpack(row["held"], np.int8)
        self.held, self.no_id, self.starts = held % 2 == 1, held >= 2, np.cumsum(np.r_[0, self.lens[:-1]])
        self.keys = word = _unpack_sorted(row["words"])
        self.seq = _unpack(row["seq"], "<u4")
        self.last, self.contexts = self.seq.astype(np.int64), np.empty(0, _U)
        self.ctx = self.lower = np.empty(0, np.int64)
        for j in range(2, k + 1):
            size = len(self.keys)
            code = np.r_[size, self.last[:-1]]
            code[self.starts] = size
            code *= size
            code += self.last
            pairs, self.last = np.unique(code, return_inverse=True)
            self.ctx, self.lower = pairs // size, pairs % size
            word = word[self.lower]
            self.contexts = np.r_[self.keys, _START ^ _U(j)]
            self.keys = _follow(self.contexts[self.ctx], word)
        train = np.repeat(~self.held, self.lens)
        self.counts = np.bincount(self.last, weights=train, minlength=len(self.keys)).astype("<u4")


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def groups_of(docs: DataFrame, group_tokens: int) -> DataFrame:
    """One row per group of documents; see ``_group``."""
    bounded_batches(docs.sparkSession)
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in GROUP.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, waiting, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for doc_id, text in zip(ids, bytes_of(batch, "text"), strict=True):
                found = words(text)
                waiting.append((doc_id, held_out(doc_id), np.fromiter(map(_hashes().__getitem__, found), _U, len(found))))
                size += len(found) + 1
                if size >= group_tokens:
                    yield pa.RecordBatch.from_pylist([_group(part << 32 | number, waiting)], schema=schema)
                    number, waiting, size = number + 1, [], 0
        if waiting:
            yield pa.RecordBatch.from_pylist([_group(part << 32 | number, waiting)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, GROUP)


# ---- buckets -----------------------------------------------------------------------------------------------------------


def _requests(groups: DataFrame, k: int, buckets: int) -> DataFrame:
    """What groups send to the buckets of level k: hashes and training counts of their n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = _Lists(r, k)
                order = np.argsort(own.keys)
                keys, counts = own.keys[order], own.counts[order]
                yield _parcels([(b, r["gid"], _pack_sorted(keys[s]), _pack(counts[s]), b"", b"") for b, s in _slices(keys, buckets)])

    return groups.select("gid", *SEQUENCE).mapInArrow(run, PARCELS)


def _add_up(requests: DataFrame) -> DataFrame:
    """Per bucket: to each group twice its n-grams' counts, plus one where this group is to answer for the n-gram; and with
    gid -1 the table of n-grams that were seen in training."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket = rows[0]["bucket"]
        sent = [_unpack_sorted(r["a"]) for r in rows]
        every, first, where = np.unique(np.concatenate(sent), return_index=True, return_inverse=True)
        counts = _unpack_all(rows, "b", np.uint32)
        totals = np.bincount(where, weights=counts, minlength=len(every)).astype(np.int64)
        answers = 2 * totals[where]
        answers[first] += 1
        out, at = [], 0
        for r, keys in zip(rows, sent, strict=True):
            out.append((bucket, r["gid"], _pack(answers[at : at + len(keys)]), b"", b"", b""))
            at += len(keys)
        seen = totals > 0
        out.append((bucket, -1, _pack_sorted(every[seen]), _pack(totals[seen]), b"", b""))
        return pa.Table.from_batches([_parcels(out)])

    return requests.groupBy("bucket").applyInArrow(run, PARCELS)


def _statistics(added: DataFrame) -> dict[int, int]:
    """How many n-grams were seen r times, for r up to one more than is discounted; all at -1, their tokens at -2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                counts = _unpack(b, np.int64)
                few = np.bincount(counts[counts <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)
                found = {-1: len(counts), -2: int(counts.sum())} | {r: int(few[r]) for r in range(1, DISCOUNTED + 2)}
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["r", "n"])

    rows = added.filter("model").select("b").mapInArrow(run, "r long, n long").groupBy("r").agg(F.sum("n").alias("n")).collect()
    return {r["r"]: r["n"] for r in rows}


def discounts(seen: dict[int, int]) -> np.ndarray:
    """Good-Turing's discounts as Katz uses them, for r = 0 .. DISCOUNTED + 1 (the last stands for all above).

    Counts of counts that give none between 0 and 1 (small or odd corpora) have those of Good-Turing replaced by r / (r + 0.5).
    """
    result = np.ones(DISCOUNTED + 2)
    once = seen.get(1, 0)
    common = (DISCOUNTED + 1) * seen.get(DISCOUNTED + 1, 0) / once if once else 1.0
    for r in range(1, DISCOUNTED + 1):
        turing = (r + 1) * seen.get(r + 1, 0) / (r * seen[r]) if seen.get(r) else 0.0
        d = (turing - common) / (1 - common) if common < 1 else 0.0
        result[r] = d if 0.02 < d < 0.999 else r / (r + 0.5)
    return result


def _discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * d[np.minimum(counts, DISCOUNTED + 1)]


class _Joined:
    """What a group knows at level k: its own lists, and answers, scores one level lower and contexts' weights by kind."""

    def __init__(self, own: pa.Table, table: pa.Table, k: int, d: np.ndarray):
        self.rows: dict[int, list[dict]] = {}
        for r in table.to_pylist():
            self.rows.setdefault(r["kind"], []).append(r)
        for of_kind in self.rows.values():
            of_kind.sort(key=lambda r: r["bucket"])
        (self.own,), self.d = own.to_pylist(), d
        self.gid, self.lists = self.own["gid"], _Lists(self.own, k)
        order, by_context = np.argsort(self.lists.keys), np.argsort(self.lists.contexts)
        self.contexts = self.lists.contexts[by_context]
        answers = np.empty(len(order), np.int64)
        answers[order] = self.column(0, "a", np.int64)
        self.counts, self.answers_for = answers >> 1, (answers & 1).astype(bool)
        if k > 1:
            self.shorter = self.column(1, "a", np.float64)[self.lists.lower]
            # Places of contexts in the order of their hashes, in which they are asked for and answered.
            place = np.empty(len(self.contexts), np.int64)
            place[by_context] = np.arange(len(self.contexts))
            self.ctx = place[self.lists.ctx]

    def column(self, kind: int, name: str, dtype) -> np.ndarray:
        return _unpack_all(self.rows[kind], name, dtype)

    def scores(self) -> np.ndarray:
        """Log probabilities of the n-grams: their own, or backed off."""
        total, weight = self.column(2, "a", np.float64)[self.ctx], self.column(2, "b", np.float64)[self.ctx]
        own = np.log(_discounted(np.maximum(self.counts, 1), self.d) / total)
        return np.where(self.counts > 0, own, weight + self.shorter)


def _joined(groups: DataFrame, columns: list[str], *kinds: DataFrame):
    """Each group's row with the rows of several kinds for it. Groups are stored in buckets of gid, so they do not move."""
    rows = None
    for kind, frame in enumerate(kinds):
        missing = {c: F.lit(b"") for c in "abcd" if c not in frame.columns}
        if "bucket" not in frame.columns:
            missing["bucket"] = F.lit(0)
        frame = frame.withColumns(missing).select(F.lit(kind).alias("kind"), *_FIELDS)
        rows = frame if rows is None else rows.unionByName(frame)
    return groups.select("gid", *SEQUENCE, *columns).groupBy("gid").cogroup(rows.groupBy("gid"))


def _answers(added: DataFrame, before: DataFrame, contexts: DataFrame | None = None) -> list[DataFrame]:
    """The kinds of rows that ``_Joined`` reads: 0 answers, 1 scores one level lower, 2 weights of contexts."""
    weights = added.filter("false") if contexts is None else contexts.filter("not model")
    return [added.filter("not model"), before.select("gid", F.col("scores").alias("a")), weights]


def _contexts(groups: DataFrame, added: DataFrame, before: DataFrame, k: int, d: np.ndarray, buckets: int) -> DataFrame:
    """Per bucket of contexts: to each group its contexts' denominators and log backoff weights; with gid -1 the table."""

    def sums(own: pa.Table, table: pa.Table) -> pa.Table:
        """The group's part of each context: sums over the n-grams that it answers for."""
        g = _Joined(own, table, k, d)
        mine = (g.counts > 0) & g.answers_for
        where, n = g.ctx[mine], len(g.contexts)
        total = np.bincount(where, weights=g.counts[mine], minlength=n)
        kept = np.bincount(where, weights=_discounted(g.counts[mine], d), minlength=n)
        low = np.bincount(where, weights=np.exp(g.shorter[mine]), minlength=n)
        parcels = [
            (b, g.gid, _pack_sorted(g.contexts[s]), _pack(total[s]), _pack(kept[s]), _pack(low[s]))
            for b, s in _slices(g.contexts, buckets)
        ]
        return pa.Table.from_batches([_parcels(parcels)])

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sent = [_unpack_sorted(r["a"]) for r in rows]
        every, where = np.unique(np.concatenate(sent), return_inverse=True)
        total, kept, low = (
            np.bincount(where, weights=_unpack_all(rows, c, np.float64), minlength=len(every))
            for c in "bcd"
        )
        # Where the discounts leave nothing, the denominator grows by one and the one is left. A context that training has
        # not seen knows nothing: all weight goes to the shorter one.
        seen = total > 0
        total = np.where(total - kept < 1e-9 * total, kept + 1, total)
        total[~seen] = 1
        weight = np.where(seen, np.log((total - kept) / total) - np.log(np.maximum(1 - low, 1e-12)), 0.0)
        out = [(rows[0]["bucket"], -1, _pack_sorted(every[seen]), _pack(total[seen]), _pack(weight[seen]), b"")]
        at = 0
        for r, keys in zip(rows, sent, strict=True):
            own = where[at : at + len(keys)]
            at += len(own)
            out.append((r["bucket"], r["gid"], _pack(total[own]), _pack(weight[own]), b"", b""))
        return pa.Table.from_batches([_parcels(out)])

    parts = _joined(groups, [], *_answers(added, before)).applyInArrow(sums, PARCELS)
    return parts.groupBy("bucket").applyInArrow(run, PARCELS)


# ---- scores ------------------------------------------------------------------------------------------------------------


def _first_scores(added: DataFrame, d: np.ndarray, whole: float, left: float) -> DataFrame:
    """Log probabilities of the groups' words. ``left``: the share of unknown words."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        counts = _unpack_all(rows, "a", np.int64) >> 1
        scores = np.log(np.where(counts > 0, _discounted(np.maximum(counts, 1), d) / whole, left))
        return pa.table({"gid": pa.array([rows[0]["gid"]], pa.int64()), "scores": pa.array([_pack(scores)], pa.binary())})

    return added.filter("not model").select("gid", "bucket", "a").groupBy("gid").applyInArrow(run, "gid long, scores binary")


def _next_scores(groups: DataFrame, k: int, answers: list[DataFrame], d: np.ndarray) -> DataFrame:
    """Log probabilities of the groups' n-grams of level k."""

    def run(own: pa.Table, table: pa.Table) -> pa.Table:
        g = _Joined(own, table, k, d)
        return pa.table({"gid": pa.array([g.gid], pa.int64()), "scores": pa.array([_pack(g.scores())], pa.binary())})

    return _joined(groups, [], *answers).applyInArrow(run, "gid long, scores binary")


def _documents(
    groups: DataFrame, order: int, answers: list[DataFrame], d: np.ndarray, first: DataFrame, tokens: int, types: int
) -> DataFrame:
    """One row per document: the scores of the last level, summed over its tokens."""

    def run(own: pa.Table, table: pa.Table) -> pa.Table:
        g = _Joined(own, table, order, d)
        lens, starts = g.lists.lens, g.lists.starts
        score = (g.scores() if order > 1 else g.column(1, "a", np.float64))[g.lists.last]
        counts = (g.column(3, "a", np.int64) >> 1)[g.lists.seq]
        base = np.log10((counts + 1) / (tokens + types + 1))
        n = len(lens)
        return pa.table(
            {
                "doc_id": pa.array(_unpack(g.own["doc_ids"], np.int64), mask=g.lists.no_id),
                "held_out": pa.array(g.lists.held),
                "n_tokens": pa.array(lens),
                "n_known": pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                "train_tokens": pa.array(np.full(n, tokens, np.int64)),
                "base_score": pa.array(np.add.reduceat(base, starts)),
                "score": pa.array(np.add.reduceat(score, starts) / math.log(10)),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    joined = _joined(groups, ["doc_ids"], *answers, first.filter("not model"))
    return joined.applyInArrow(run, schema)


def _bucketed(groups: DataFrame) -> DataFrame:
    """The groups as a table in buckets of gid, in the shared folder."""
    spark = groups.sparkSession
    path = fresh_path(spark, "katz-groups")
    name = "scorekit_" + path.rsplit("-", 1)[1]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = groups.write.bucketBy(buckets, "gid").option("compression", "zstd").option("path", path)
    writer.format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # its files stay, and the frame knows its buckets
    return table


def _stored(parcels: DataFrame, folder: str) -> DataFrame:
    parcels.withColumn("model", F.col("gid") == -1).write.option("compression", "zstd").partitionBy("model").parquet(folder)
    return parcels.sparkSession.read.schema(PARCELS + ", model boolean").parquet(folder)


def _forget(spark: SparkSession, folder: str) -> None:
    """Drop the answers of a stored level; its model rows stay."""
    answers = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/model=false")
    answers.getFileSystem(spark._jsc.hadoopConfiguration()).delete(answers, True)


def fit_and_score(
    docs: DataFrame,
    order: int = 2,
    group_tokens: int = GROUP_TOKENS,
    bucket_entries: int = BUCKET_ENTRIES,
    folder: str | None = None,
) -> DataFrame:
    """Train on the documents that are not held out and score all of them.

    The model stays in ``folder``: ``counts-<level>`` and ``weights-<level>``, the rows with ``model = true``.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "katz")
    groups = _bucketed(groups_of(docs, group_tokens))
    sizes = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_tokens")]).first()
    buckets = [max(1, -(-sizes["n_words" if k == 1 else "n_tokens"] // bucket_entries)) for k in range(1, order + 1)]
    tokens = types = 0
    answers: list[DataFrame] = []
    for k in range(1, order + 1):
        added = _stored(_add_up(_requests(groups, k, buckets[k - 1])), f"{folder}/counts-{k}")
        release(spark)
        seen = _statistics(added)
        d = discounts(seen)
        if k == 1:
            first, tokens, types = added, seen.get(-2, 0), seen.get(-1, 0)
            kept = tokens - sum(r * (1 - d[r]) * seen.get(r, 0) for r in range(1, DISCOUNTED + 1))
            whole = tokens if tokens - kept > 1e-9 * tokens else kept + 1
            before = write_compact(_first_scores(added, d, whole, (whole - kept) / whole), "katz-scores")
            answers = _answers(added, before)
        else:
            contexts = _stored(_contexts(groups, added, before, k, d, buckets[k - 2]), f"{folder}/weights-{k}")
            answers = _answers(added, before, contexts)
            if k < order:
                used, before = before, write_compact(_next_scores(groups, k, answers, d), "katz-scores")
                # The next level reads nothing of this one but its scores.
                release(spark, used)
                _forget(spark, f"{folder}/counts-{k}")
                _forget(spark, f"{folder}/weights-{k}")
        release(spark)
    return _documents(groups, order, answers, d, first, tokens, types)
