from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorekit.llm import mixing
from tests.llm.helpers import docs_of, odd_rows, rows_of


def targets(sizes, weights, total, max_epochs=3):
    """Share by weight; what lies above the limit is shared again, until nothing does."""
    caps, capped = [max_epochs * size for size in sizes], set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in capped and weights[i] > 0]
        weight = sum(weights[i] for i in rest)
        level = (total - sum(caps[i] for i in capped)) / weight if rest else 0.0
        above = {i for i in rest if level * weights[i] > caps[i]}
        if not above:
            return [float(caps[i]) if i in capped else level * weights[i] for i in range(len(sizes))]
        capped |= above


def cycle(n):
    return [float(i % 3 + 1) for i in range(n)]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 4)), min_size=1, max_size=8), st.sampled_from([1.0, 0.5, 2.0]))
def test_targets_share_and_reshare(spark, sources, share):
    table = spark.createDataFrame([(i, size, float(weight)) for i, (size, weight) in enumerate(sources)], "i int, size long, weight double")
    got = [r["target"] for r in mixing.with_targets(table, share, 3).orderBy("i").collect()]
    sizes = [size for size, _ in sources]
    assert got == pytest.approx(targets(sizes, [w for _, w in sources], int(share * sum(sizes))))


def test_two_hundred_thousand_sources(spark):
    docs = spark.range(200_500).select(
        F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lpad(F.col("id").cast("string"), 7, "0").alias("source"), F.lit("en").alias("lang")
    )
    got = mixing.takes(docs).agg(F.sum("taken"), F.count("*"), F.count_if((F.col("doc_id") % 3 == 0) & (F.abs(F.col("target") - 1) < 1e-4))).first()
    assert got[1] == 200_500 and got[0] == pytest.approx(401_000, rel=0.2) and got[2] == pytest.approx(200_500 / 3, abs=1)


def test_an_id_that_a_third_of_all_rows_share(spark, tmp_path):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "w " * (i % 9 + i % 2), "en", "s" if i % 2 else "t") for i in range(900)]
    docs_of(spark, rows).repartition(5).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    got = mixing.takes(docs, rows_per_range=10)
    for s in ("s", "t"):
        size = sum(i % 9 + i % 2 for i in range(900) if (i % 2 == 1) == (s == "s"))
        mine = rows_of(got.filter(F.col("source_size") == size))
        target = mine[0]["target"]
        assert sum(r["taken"] for r in mine) == int(target + 0.5)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
        cut = [r for r in mine if r["size"] and r["taken"] % r["size"]]
        assert len(cut) <= 1
    assert got.count() == 900
    placed = mixing._placed(mixing.with_locator(docs), mixing.cycle_weights, 1.0, 3, 10)
    largest = placed.groupBy("s", "range", "c", "hot", "sub").count().agg(F.max("count")).first()[0]
    assert largest <= 150  # six hundred rows have one of two ids
    again = mixing.takes(docs, rows_per_range=10)
    assert sorted(map(str, rows_of(got))) == sorted(map(str, rows_of(again)))


def test_takes_are_those_of_one_sorted_list(spark):
    rng = random.Random(3)
    docs = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    docs += [(1000 + i, "a b c", "en", None) for i in range(5)]
    got = {r["doc_id"]: r for r in rows_of(mixing.takes(docs_of(spark, docs), rows_per_range=7))}
    of = defaultdict(list)
    for i, text, _, source in docs:
        of[source].append((hashlib.md5(str(i).encode()).hexdigest(), i, len(text.split())))
    names = sorted((s for s in of if s is not None)) + [None]
    sizes = [sum(n for *_, n in of[s]) for s in names]
    for name, size, target in zip(names, sizes, targets(sizes, cycle(len(names)), sum(sizes)), strict=True):
        budget, start = int(target + 0.5), 0
        for _, i, n in sorted(of[name]):
            r = got[i]
            assert (r["size"], r["source_size"], r["target"]) == (n, size, target)
            assert r["taken"] == budget // size * n + max(0, min(n, budget % size - start)) <= 3 * n
            start += n
        assert sum(got[i]["taken"] for _, i, _ in of[name]) == budget


def test_mix_repeats_whole_rows(spark):
    docs = docs_of(spark, [(i, "a b c d", "en", "abc"[i % 3]) for i in range(300)])
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = {r["source"]: 4 * r["n"] for r in rows_of(mixed.groupBy("source").agg(F.count("*").alias("n")))}
    assert words["a"] == pytest.approx(200, abs=4) and words["b"] == pytest.approx(400, abs=4) and words["c"] == pytest.approx(600, abs=4)


def test_odd_rows(spark):
    docs = docs_of(spark, odd_rows())
    got = rows_of(mixing.takes(docs))
    assert len(got) == len(odd_rows()) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) == pytest.approx(sum(r["size"] for r in got), abs=4)
    assert mixing.mix(docs).columns == docs.columns
    assert rows_of(mixing.takes(docs_of(spark, []))) == [] and rows_of(mixing.mix(docs_of(spark, []))) == []
