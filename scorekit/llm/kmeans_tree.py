"""Approximate nearest neighbours by a tree of k-means (operator 2).

The tree is fitted on a bounded, hash-chosen sample: each node is cut into ``BRANCHES`` clusters until its part of the
sample is small. Every vector of the table is then put in the leaf that it reaches from the root. A query visits leaves
best bin first: a priority queue holds the children not taken yet by their distance, so it turns to the next promising
bin wherever that lies. How many leaves are visited is calibrated: for a sample of vectors the exact neighbours in the
whole table are found block by block, and visits widen until the wanted share of them lies in the visited leaves.

Equal vectors are one entry that keeps the smallest k + 1 ids, which is all that any answer can need, and equal queries are
asked once; so a vector held by a third of all rows is no hot spot. Large leaves and leaves with many visitors are compared in parts.

Defined results. Vectors that are NULL or zero, hold NULL or non-finite parts, or are not of the most common length (ties:
the shorter) take no part; neither do rows without id. Ties in distance: the smaller id. Rows repeated with the same id: a
query never finds its own id, and an id is found once for each different vector. Fewer candidates than k: all of them.
Empty table, or no query: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorekit.skew import join_counted
from scorekit.workspace import materialise

#: Different vectors that the tree is fitted on, at most.
SAMPLE = 40_000
BRANCHES = 8
#: Vectors of the sample in a leaf, about.
LEAF = 40
#: Vectors whose exact neighbours calibrate the search, and the share of these that it has to find.
CALIBRATION = 200
RECALL = 0.97
#: Vectors, and visiting queries, of a leaf that are compared in one task.
VECTORS_PER_PART, QUERIES_PER_PART = 4000, 1000
#: Leaves visited in the first round, and how much farther each round goes. What a round has found bounds the next one, so
#: leaves give back only what can still matter.
FIRST_VISITS, WIDER = 8, 16


@dataclass
class Tree:
    """``centres`` of all nodes; ``first`` child and number of ``children`` (0: a leaf). Node 0 is the root."""

    centres: np.ndarray
    first: np.ndarray
    children: np.ndarray

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector reaches."""
        at = np.zeros(len(vectors), np.int64)
        while True:
            inner = np.flatnonzero(self.children[at] > 0)
            if not len(inner):
                return at
            for node in np.unique(at[inner]):
                rows = inner[at[inner] == node]
                kids = slice(self.first[node], self.first[node] + self.children[node])
                at[rows] = self.first[node] + _nearest(vectors[rows], self.centres[kids])

    def visits(self, query: np.ndarray, at_least: int, held: np.ndarray, wanted: int) -> list[int]:
        """Leaves best bin first: ``at_least`` of them, and more until they hold ``wanted`` vectors (``held`` by node)."""
        queue, out, found = [(0.0, 0)], [], 0
        while queue and (len(out) < at_least or found < wanted):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(node)
                found += int(held[node])
                continue
            kids = slice(self.first[node], self.first[node] + self.children[node])
            away = ((self.centres[kids] - query) ** 2).sum(1)
            for i, distance in enumerate(away.tolist()):
                heapq.heappush(queue, (distance, int(self.first[node]) + i))
        return out


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * vectors @ centres.T, axis=1)


def fit_tree(sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 11) -> Tree:
    """A tree over ``sample``. Clusters come from Lloyd's steps; a node that does not fall apart stays a leaf."""
    rng = np.random.default_rng(seed)
    centres = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])]
    first, children, open_ = [0], [0], [(0, np.arange(len(sample)))]
    while open_:
        node, rows = open_.pop()
        if len(rows) <= leaf:
            continue
        points = sample[rows]
        means = points[rng.choice(len(points), branches, replace=False)].copy()
        for _ in range(12):
            of = _nearest(points, means)
            for c in range(branches):
                if (of == c).any():
                    means[c] = points[of == c].mean(0)
        of = _nearest(points, means)
        parts = [c for c in range(branches) if (of == c).any()]
        if len(parts) < 2:
            continue
        first[node], children[node] = len(centres), len(parts)
        for c in parts:
            open_.append((len(centres), rows[of == c]))
            centres.append(means[c])
            first.append(0)
            children.append(0)
    return Tree(np.array(centres), np.array(first), np.array(children))


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and vec (doubles, without negative zeros) of the rows that take part."""
    value = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & fine & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("vec") == (sizes["d"] if sizes else 0))


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """Different vectors: hash, vec, and the k + 1 smallest ids. Tasks keep no more ids of a vector before the shuffle."""
    rows = rows.withColumn("hash", F.xxhash64("vec"))
    order = Window.partitionBy("hash", "vec").orderBy("vec_id")
    few = rows.withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= k + 1)
    return few.groupBy("hash", "vec").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(1))


def _best(away: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[float, int]]:
    """The k + 1 nearest ids of entries, ties to the smaller id."""
    near = np.flatnonzero(away <= np.partition(away, k)[k]) if len(away) > k + 1 else np.arange(len(away))
    return heapq.nsmallest(k + 1, ((float(away[i]), vec_id) for i in near for vec_id in ids[i]))


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1).drop("place")


FOUND = "query long, vec_id long, score double, leaf int"


def exact(index: DataFrame, queries: np.ndarray, numbers: np.ndarray, k: int) -> DataFrame:
    """The k + 1 nearest ids of a bounded set of queries among all entries of ``index``, block by block."""
    shared = index.sparkSession.sparkContext.broadcast((queries, numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, named = shared.value
        best: list[list[tuple[float, int, int]]] = [[] for _ in named]
        for batch in batches:
            vectors, ids, leaves = _matrix(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            leaf_of = {vec_id: leaf for own, leaf in zip(ids, leaves, strict=True) for vec_id in own}
            for i, query in enumerate(asked):
                new = [(d, vec_id, leaf_of[vec_id]) for d, vec_id in _best(_distances(vectors, query), ids, k)]
                best[i] = heapq.nsmallest(k + 1, best[i] + new)
        rows = [(int(q), vec_id, d, leaf) for q, own in zip(named, best, strict=True) for d, vec_id, leaf in own]
        yield _found(rows)

    return _top(index.select("vec", "ids", "leaf").mapInArrow(run, FOUND), k)


def _found(rows: list[tuple[int, int, float, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["query", "vec_id", "score", "leaf"]
    )


@dataclass
class Index:
    """``entries``: hash, vec, ids, leaf; ``held``: ids by node; ``visits``: calibrated number of leaves; ``recall`` there."""

    tree: Tree
    entries: DataFrame
    held: np.ndarray
    sizes: dict[int, int]
    visits: int
    recall: float


def build(
    rows: DataFrame, k: int, recall: float = RECALL, sample: int = SAMPLE, leaf: int = LEAF, calibration: int = CALIBRATION
) -> Index:
    """Fit the tree, index every row of ``rows`` (see ``usable``), and calibrate the search."""
    spark = rows.sparkSession
    entries = materialise(_entries(rows, k), "ann-entries")
    chosen = entries.orderBy(F.xxhash64("hash"), "vec").select("vec").limit(sample + calibration).toArrow()["vec"].combine_chunks()
    vectors = _matrix(chosen) if len(chosen) else np.empty((0, 1))
    # The trial takes vectors that the tree has not seen, where there are any.
    vectors, unseen = vectors[:sample], vectors[sample:]
    tree = fit_tree(vectors, leaf=leaf)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = shared.value.leaves_of(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.int32())], names=["hash", "vec", "ids", "leaf"])

    placed = entries.select("hash", "vec", "ids").mapInArrow(place, "hash long, vec array<double>, ids array<long>, leaf int")
    placed = materialise(placed, "ann-index")
    counts = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()
    held = np.zeros(len(tree.centres), np.int64)
    for r in counts:
        held[r["leaf"]] = r["ids"]
    index = Index(tree, placed, held, {r["leaf"]: r["n"] for r in counts}, 1, 1.0)
    trial = np.concatenate([unseen, vectors])[:calibration] if len(unseen) else vectors[:calibration]
    if not len(trial):
        return index
    ranks = []
    near: dict[int, list[int]] = {}
    hits = exact(placed, trial, np.arange(len(trial)), k).filter("score > 0")  # not the vector itself
    for r in hits.select("query", "leaf").collect():
        near.setdefault(r["query"], []).append(r["leaf"])
    for number, leaves in near.items():
        order = {leaf: i + 1 for i, leaf in enumerate(tree.visits(trial[number], len(tree.centres), held, 0))}
        ranks += [order[leaf] for leaf in leaves]
    # Visits widen until the share of neighbours in visited leaves is reached.
    ranks = np.array(ranks or [1])
    while (reached := float((ranks <= index.visits).mean())) < recall:
        index.visits += max(1, index.visits // 16)
    index.recall = reached
    return index


def _visit(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """The nearest ids in each visited leaf (query, vec, leaf, bound) that are no farther than the bound."""
    spark = asked.sparkSession
    visitors = {r["leaf"]: r["n"] for r in asked.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    parts = [
        (leaf, -(-n // VECTORS_PER_PART), -(-visitors[leaf] // QUERIES_PER_PART)) for leaf, n in index.sizes.items() if leaf in visitors
    ]
    cut = F.broadcast(spark.createDataFrame(parts, "leaf int, parts int, blocks int"))  # one row per leaf of the tree
    number = lambda hashed, of: F.pmod(F.xxhash64(hashed), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    none = F.lit(None)
    queries = asked.join(cut, "leaf").select(
        "leaf", every("parts").alias("part"), number("query", "blocks").alias("block"), "query", "vec", none.cast("array<long>").alias("ids"), "bound"
    )
    held = index.entries.join(cut, "leaf").select(
        "leaf", number("hash", "parts").alias("part"), every("blocks").alias("block"), none.cast("long").alias("query"), "vec", "ids",
        none.cast("double").alias("bound"),
    )

    def compare(table: pa.Table) -> pa.Table:
        is_query = table.column("query").combine_chunks().is_valid()
        own, entries = table.filter(is_query), table.filter(pc.invert(is_query))
        rows: list[tuple[int, int, float, int]] = []
        if entries.num_rows and own.num_rows:
            vectors, ids = _matrix(entries.column("vec").combine_chunks()), entries.column("ids").to_pylist()
            asking = zip(own.column("query").to_pylist(), _matrix(own.column("vec").combine_chunks()), own.column("bound").to_pylist(), strict=True)
            for query, vec, bound in asking:
                away = _distances(vectors, vec)
                if away.min() <= bound:
                    rows += [(query, vec_id, d, 0) for d, vec_id in _best(away, ids, k) if d <= bound]
        return pa.Table.from_batches([_found(rows)])

    return queries.unionByName(held).groupBy("leaf", "part", "block").applyInArrow(compare, FOUND)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """The nearest ids of ``queries`` (vec_id, vec): query_id, rank, vec_id, score, and the number of leaves visited."""
    spark = queries.sparkSession
    queries = materialise(queries.select("vec_id", "vec", F.xxhash64("vec").alias("hash")), "ann-queries")
    different = queries.groupBy("hash", "vec").agg(F.min("vec_id").alias("query"), F.count("*").alias("n"))
    different = materialise(different, "ann-different")
    shared = spark.sparkContext.broadcast((index.tree, index.held))
    at_least = index.visits

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held = shared.value
        for batch in batches:
            leaves = [tree.visits(v, at_least, held, k + 1) for v in _matrix(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaves, pa.list_(pa.int32()))], names=["query", "vec", "leaves"]
            )

    # Queries are few rows that become many visits: they are dealt over tasks first.
    tasks = max(1, min(different.count(), 2 * spark.sparkContext.defaultParallelism))
    walked = different.select("query", "vec").repartition(tasks, "query").mapInArrow(walk, "query long, vec array<double>, leaves array<int>")
    walked = materialise(walked, "ann-walks")
    longest = walked.agg(F.max(F.size("leaves"))).first()[0] or 0
    best, start, end = None, 0, FIRST_VISITS
    while best is None or start < longest:
        asked = walked.select("query", "vec", F.explode(F.slice("leaves", start + 1, end - start)).alias("leaf"))
        if best is None:
            asked = asked.withColumn("bound", F.lit(float("inf")))
        else:
            last = F.when(F.count("*") > k, F.max("score")).otherwise(float("inf"))
            asked = asked.join(best.groupBy("query").agg(last.alias("bound")), "query", "left").fillna(float("inf"), ["bound"])
        found = _visit(index, materialise(asked, "ann-visits"), k).drop("leaf")
        best = materialise(_top(found if best is None else best.unionByName(found), k), "ann-best")
        start, end = end, end * WIDER
    answers = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    answers = materialise(different.join(answers, "query").select("hash", "vec", "n", "near"), "ann-answers")
    joined = join_counted(queries, answers, ["hash", "vec"], F.col("n"), queries.count())
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    return joined.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )


def neighbours(table: DataFrame, is_query: Column, k: int = 10, **settings) -> DataFrame:
    """The k nearest found for every row that ``is_query`` chooses, among all rows of ``table`` (vec_id, embedding)."""
    rows = usable(table)
    index = build(rows, k, **settings)
    return search(index, rows.filter(is_query), k)
