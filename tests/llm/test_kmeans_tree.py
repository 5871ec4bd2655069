from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from scorekit.llm import kmeans_tree
from tests.llm.helpers import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def _exact(rows: list[tuple], k: int, query: int) -> list[tuple[int, float]]:
    own = next(np.array(v, float) for i, v in rows if i == query)
    away = sorted((float(np.sqrt(((np.array(v, float) - own) ** 2).sum())), i) for i, v in rows if i != query)
    return [(i, d) for d, i in away[:k]]


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)


def test_recall_and_scores_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(i % 5, 1, 16).astype(np.float32).tolist()) for i in range(1500)]
    got = rows_of(kmeans_tree.neighbours(_table(spark, rows), F.col("vec_id") % 20 == 0, k=10, leaf=25))
    found = wanted = 0
    for query in range(0, 1500, 20):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == query)
        exact = dict(_exact(rows, 10, query))
        assert [r for r, *_ in own] == list(range(1, 11))
        assert [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        found, wanted = found + len({i for _, i, _ in own} & set(exact)), wanted + 10
        for _, i, s in own:
            assert s == np.sqrt(((np.array(rows[i][1]) - np.array(rows[query][1])) ** 2).sum()) or abs(s - exact.get(i, s)) < 1e-12
    assert found / wanted >= 0.9


def test_one_vector_held_by_most_rows(spark):
    rows = [(i, [1.0, 0.0] if i % 4 else [float(i % 7), 1.0]) for i in range(2000)]
    got = rows_of(kmeans_tree.neighbours(_table(spark, rows), F.col("vec_id") % 100 == 50, k=10))
    same = [i for i in range(2000) if i % 4]
    for query in (50, 150, 1950):
        own = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == query]
        assert own == [i for i in same if i != query][:10]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 1.0]), (3, None), (4, [0.0, -0.0]), (5, [nan, 1.0]), (6, [inf, 1.0])]
    rows += [(7, [None, 1.0]), (8, [1.0]), (9, []), (None, [1.0, 2.0]), (2, [2.0, 1.0])]
    got = rows_of(kmeans_tree.neighbours(_table(spark, rows), F.lit(True), k=10).orderBy("query_id", "rank"))
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] < 2] == [
        (0, 1, 1, 0.0), (0, 2, 2, 1.0), (1, 1, 0, 0.0), (1, 2, 2, 1.0)]
    assert {r["query_id"] for r in got} == {0, 1, 2}
    assert rows_of(kmeans_tree.neighbours(_table(spark, []), F.lit(True))) == []


def test_leaves_and_visitors_in_parts(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "VECTORS_PER_PART", 7)
    monkeypatch.setattr(kmeans_tree, "QUERIES_PER_PART", 3)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(300)]
    got = rows_of(kmeans_tree.neighbours(_table(spark, rows), F.col("vec_id") % 10 == 0, k=5, leaf=60))
    found = 0
    for query in range(0, 300, 10):
        exact = dict(_exact(rows, 5, query))
        found += sum(r["vec_id"] in exact for r in got if r["query_id"] == query)
    assert len(got) == 150 and found >= 135


def test_the_trial_is_of_vectors_that_the_tree_has_not_seen(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(600)]
    index = kmeans_tree.build(kmeans_tree.usable(_table(spark, rows)), 5, sample=200, leaf=10, calibration=50)
    assert index.recall >= kmeans_tree.RECALL and sum(index.sizes.values()) == 600
