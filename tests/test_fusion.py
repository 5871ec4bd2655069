"""Thresholds, votes and blends over a long store of scores."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from scorekit.operators import blending, ranking
from scorekit.plans import folds, fusion, stacking

SCHEMA = "ID long, model string, fold int, label int, score double"


def _store(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=30))
def test_best_threshold_by_trying_all(spark, rows):
    store = _store(spark, [(i, "m", 0, y, s / 8) for i, (y, s) in enumerate(rows)])
    (found,) = fusion.fit_fusion(store).collect()
    positives = sum(y for y, _ in rows)

    def f1(t):
        hit = sum(y for y, s in rows if s / 8 >= t)
        return 2 * hit / (sum(s / 8 >= t for _, s in rows) + positives) if positives or hit else 0.0

    best = max((f1(s / 8), s / 8) for _, s in rows)
    assert (found["f1"], found["threshold"]) == pytest.approx(best)


def test_given_thresholds_and_metrics_equal_the_wide_form(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    wide = [(i, int(a), float(round(rng.random() * 0.6 + 0.4 * a, 2)), float(round(rng.random(), 1))) for i, a in enumerate(y)]
    rows = [(i, m, 0, a, s) for i, a, p, q in wide for m, s in (("p", p), ("q", q))]
    df = spark.createDataFrame(wide, "ID long, label int, p double, q double")
    fitted = {r["model"]: r for r in fusion.fit_fusion(_store(spark, rows), 0.5).collect()}
    for r in ranking.ranking_metrics(df, "label", ["p", "q"]).collect():
        got = fitted[r["model"]]
        assert got["threshold"] == 0.5 and [got[c] for c in ("ks", "auc", "f1")] == pytest.approx([r[c] for c in ("ks", "auc", "f1")])
    fused = fusion.fuse(_store(spark, rows), fusion.fit_fusion(_store(spark, rows), 0.5))
    weights = blending.fit_blend_weights(df, "label", ["p", "q"], "auc")
    wanted = {r["ID"]: (r["v"], r["blend"]) for r in blending.weighted_blend(df, weights).withColumn("v", blending.hard_vote(["p", "q"])).collect()}
    for r in fused.collect():
        assert (r["vote"], r["blend_auc"]) == (wanted[r["ID"]][0], pytest.approx(wanted[r["ID"]][1]))


def test_missing_scores_and_models_without_labels(spark):
    rows = [(i, m, 0, i % 2, (i % 2) * 0.5 + 0.1 * k) for i, (k, m) in itertools.product(range(8), enumerate("abc"))]
    rows += [(100, "a", None, None, 0.9), (100, "b", None, None, None), (100, "c", None, None, float("nan"))]
    rows += [(101, "a", None, None, 0.9), (101, "b", None, None, 0.9), (101, "c", None, None, 0.0), (1, "dark", None, None, 0.3)]
    store = _store(spark, rows)
    fitted = fusion.fit_fusion(store)
    assert {r["model"] for r in fitted.collect()} == {"a", "b", "c"}
    got = {r["ID"]: r for r in fusion.fuse(store, fitted).collect()}
    assert got[100]["vote"] == 0 and got[100]["blend_ks"] == 0.9 and got[101]["vote"] == 1
    assert got[101]["blend_auc"] == pytest.approx(0.6)
    order = [r["ID"] for r in fusion.ranked(fusion.fuse(store, fitted), "blend_ks").collect()]
    assert order[0] == 100 and len(order) == 10
    votes = {r["votes"]: r["rows"] for r in fusion.unanimity(store, fitted).collect()}
    assert sum(votes.values()) == 10 and votes[1] == 1


def test_seven_models(spark):
    df = spark.range(400).select(
        F.col("id").alias("ID"),
        (F.col("id") % 20).cast("double").alias("a"),
        (F.col("id") % 7).cast("double").alias("b"),
        ((F.col("id") % 20 + F.col("id") % 3) > 14).cast("int").alias("label"),
    )
    learners = {n: stacking.newton(rounds=2, depth=d) for n, d in (("first", 1), ("variant", 2), ("second", 3))}
    train, test = df.filter("ID < 300"), df.filter("ID >= 300").drop("label")
    scores, base = fusion.seven_models(train, test, ["a", "b"], learners, stacking.newton(rounds=2, depth=1), stacking.logistic_meta(maxIter=5), k=3)
    assert len(scores) == 7 and set(base.models) == {"first", "variant", "second"}
    store = fusion.score_store(scores)
    assert store.count() == 7 * 400 and store.filter("label is not null").count() == 7 * 300
    assert store.filter("score is null or score < 0 or score > 1").count() == 0
    means = store.filter("model in ('m5_first', 'm7_second')").groupBy("ID").agg(F.avg("score").alias("mean"))
    voted = store.filter("model = 'm6_vote_both'").join(means, "ID")
    assert voted.filter("abs(score - mean) > 1e-12").count() == 0 and voted.count() == 400
    fitted = fusion.fit_fusion(store)
    fused = fusion.fuse(store.filter("label is null"), fitted)
    assert fused.count() == 100 and fused.filter("blend_f1 is null or vote is null").count() == 0
    assert isinstance(base, folds.FoldedScores)
