import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import column
from scorekit.operators import binning, collinearity, drift, ranking, reports


def scored(spark, rows):
    return spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(rows)], "id long, y int, p double")


def test_bins(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 5.0, 10.0, None])], "i int, x double")
    assert column(binning.bin_by_width(df, "x", 2), "bin", "i") == [1, 1, 2, None]
    assert column(binning.bin_by_width(df, "x", 2, missing_bin=True), "bin", "i") == [1, 1, 2, -1]
    assert column(binning.bin_by_edges(df, "x", [1.0, 5.0, 9.0]), "bin", "i") == [None, 1, None, None]
    assert column(binning.bin_by_edges(df, "x", [1.0, 5.0, 9.0], outside="open"), "bin", "i") == [1, 1, 2, None]
    steps = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 1.0, 5.0, 5.1, 12.0])], "i int, x double")
    assert column(binning.bin_by_step(steps, "x", 5.0), "bin", "i") == [0, 1, 1, 2, 3]
    constant = spark.createDataFrame([(0, 3.0), (1, 3.0)], "i int, x double")
    assert column(binning.bin_by_width(constant, "x", 4), "bin", "i") == [1, 1]
    assert column(binning.bin_by_quantiles(steps, "x", 2), "bin", "i") == [1, 1, 1, 2, 2]


def _sides(spark, expected, actual):
    rows = [(float(v), False) for v in expected] + [(float(v), True) for v in actual]
    return spark.createDataFrame(rows, "x double, a boolean")


def test_psi(spark):
    same = _sides(spark, range(20), range(20))
    assert column(drift.psi(same, "x", F.col("a"), bins=5), "psi")[0] == pytest.approx(0)
    # Two bins with the shares (.5, .5) and (.25, .75).
    moved = _sides(spark, [1, 2, 3, 4], [1, 3, 4, 4])
    assert column(drift.psi(moved, "x", F.col("a"), bins=2), "psi")[0] == pytest.approx(0.274653, abs=1e-6)
    emptied = drift.psi_table(_sides(spark, [1, 2, 3, 4, 5], [5, 5, 5, 5]), ["x"], F.col("a"), bins=5)
    parts = [r["psi"] for r in emptied.collect() if r["actual"] == 0]
    assert parts and all(p == pytest.approx(2.441202, abs=1e-4) for p in parts if p < 3)


def test_psi_outside(spark):
    df = _sides(spark, [1, 2, 3, 4], [1, 2, 3, 4, 100])
    assert column(drift.psi(df, "x", F.col("a"), bins=2), "psi")[0] == pytest.approx(0)
    assert column(drift.psi(df, "x", F.col("a"), bins=2, outside="open"), "psi")[0] > 0


def test_psi_has_a_row_for_every_feature(spark):
    df = spark.createDataFrame([(1.0, None, False), (2.0, None, False), (1.5, 3.0, True)], "x double, z double, a boolean")
    found = {r["feature"]: r["psi"] for r in drift.psi_by_feature(df, ["x", "z"], F.col("a"), bins=2).collect()}
    assert set(found) == {"x", "z"} and found["z"] is None and found["x"] is not None
    assert [r["psi"] for r in drift.psi_by_feature(df, ["z"], F.col("a")).collect()] == [None]


def test_information_value(spark):
    # Bad shares (.25, .75), good shares (.75, .25) in two bins.
    rows = [(0.0, 1), (0.0, 0), (0.0, 0), (0.0, 0), (1.0, 1), (1.0, 1), (1.0, 1), (1.0, 0)]
    df = spark.createDataFrame(rows, "x double, y int")
    assert column(drift.information_value(df, ["x"], "y", bins=2), "iv")[0] == pytest.approx(1.098612, abs=1e-6)
    gap = df.unionByName(spark.createDataFrame([(None, 1), (None, 0)], "x double, y int"))
    woe = {r["bin"]: r for r in drift.woe_table(gap, ["x"], "y", bins=2).collect()}
    assert set(woe) == {-1, 1, 2} and woe[-1]["total"] == 2 and woe[-1]["woe"] == pytest.approx(0)


def test_vif(spark):
    cross = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (None, 5.0)], "a double, b double")
    assert column(collinearity.vif(cross, ["a", "b"]), "vif") == pytest.approx([1, 1])
    rng = np.random.default_rng(1)
    x = rng.normal(3, 1, (200, 3))
    x[:, 2] += x[:, 0]
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double").repartition(3)
    for centered in (False, True):
        z = x - x.mean(axis=0) if centered else x
        gram = z.T @ z
        want = np.diag(gram) * np.diag(np.linalg.inv(gram))
        found = column(collinearity.vif(df, ["a", "b", "c"], centered=centered), "vif")
        assert found == pytest.approx(want.tolist(), rel=1e-6)


def test_vif_of_large_values_that_vary_little(spark):
    df = spark.range(5000).select((F.col("id") % 1000 + 10**12).alias("a"), (F.col("id") % 7).alias("b"), F.lit(3).alias("k"))
    found = {r["feature"]: r for r in collinearity.vif(df, ["a", "b", "k"], centered=True).collect()}
    assert found["a"]["vif"] == pytest.approx(1, abs=1e-3) and not found["a"]["constant"]
    assert found["k"]["constant"] and found["k"]["vif"] is None


def test_vif_of_dependent_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0, 1.0), (2.0, 4.0, 7.0, 0.0), (3.0, 6.0, 7.0, 5.0)], "a double, b double, k double, z double")
    found = {r["feature"]: r for r in collinearity.vif(df, ["a", "b", "k", "z"]).collect()}
    assert found["a"]["vif"] == math.inf and found["b"]["vif"] == math.inf
    assert found["k"]["constant"] and not found["a"]["constant"]
    assert {r["feature"]: r["vif"] for r in collinearity.vif(df, ["k", "z"], centered=True).collect()}["k"] is None


def test_ks_and_auc(spark):
    rising = scored(spark, [(0, 0.1), (0, 0.2), (1, 0.3), (1, 0.4)])
    flat = scored(spark, [(0, 0.5), (0, 0.5), (1, 0.5), (1, 0.5)])
    assert column(ranking.ks(rising, "y", "p"), "ks") == [1.0]
    assert column(ranking.ks(flat, "y", "p"), "ks") == [0.0]
    assert column(ranking.auc(rising, "y", "p"), "auc") == [1.0]
    assert column(ranking.auc(flat, "y", "p"), "auc") == [0.5]
    assert column(ranking.average_precision(flat, "y", "p"), "avg_precision") == [0.5]
    one_class = scored(spark, [(1, 0.5)])
    assert column(ranking.auc(one_class, "y", "p"), "auc") == [None]


@pytest.mark.parametrize("rows_per_range", [1, 50, 10**6])
def test_ranking_metrics_against_direct_counting(spark, rows_per_range):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    # A third of the rows share one score.
    p = np.where(np.arange(400) % 3 == 0, 0.5, np.round(rng.random(400) * 0.8 + y * 0.2, 2))
    df = spark.createDataFrame([(int(a), float(b), float(b) ** 3) for a, b in zip(y, p)], "y int, p double, q double")
    found = {r["model"]: r for r in ranking.ranking_metrics(df, "y", ["p", "q"], rows_per_range=rows_per_range).collect()}
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    ks = max(abs((pos >= t).mean() - (neg >= t).mean()) for t in p)
    assert found["p"]["auc"] == pytest.approx(auc) and found["p"]["ks"] == pytest.approx(ks)
    # A monotone map changes neither.
    assert found["q"]["auc"] == pytest.approx(auc) and found["q"]["ks"] == pytest.approx(ks)


def test_ranking_against_ml_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(0, 500).select(
        (F.col("id") % 3 == 0).cast("int").alias("y"), ((F.col("id") * 37 % 101) / 101.0).alias("p")
    )
    want = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0).evaluate(df)
    assert column(ranking.auc(df, "y", "p"), "auc")[0] == pytest.approx(want)


def test_topn_report(spark):
    df = scored(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)])
    row = reports.topn_report(df, "y", "p", "id", [2]).first()
    assert (row["boundary"], row["tp"], row["fp"], row["n_rows"], row["positives"]) == (0.8, 1, 1, 4, 2)
    assert (row["precision"], row["recall"], row["f1"], row["lift"]) == (0.5, 0.5, 0.5, 1.0)


@pytest.mark.parametrize("small_enough", [1, 10**6])
def test_topn_report_with_ties_and_beyond_the_table(spark, small_enough):
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(0, 2)), 0.5 if i % 3 == 0 else float(np.round(rng.random(), 2))) for i in range(300)]
    df = scored(spark, rows).repartition(4)
    tops = [1, 10, 150, 160, 170, 300, 1000]
    found = reports.topn_report(df, "y", "p", "id", tops, small_enough).collect()
    ranked = sorted(range(300), key=lambda i: (-rows[i][1], i))
    assert [r["topn"] for r in found] == [1, 10, 150, 160, 170, 300, 300]
    for r in found:
        assert r["tp"] == sum(rows[i][0] for i in ranked[: r["topn"]])
        assert r["boundary"] == rows[ranked[r["topn"] - 1]][1]


def test_topn_report_with_repeated_keys_still_counts_n_rows(spark):
    df = spark.createDataFrame([(7, 1, 0.5), (7, 0, 0.5), (7, 1, 0.5), (1, 0, 0.9)], "id long, y int, p double")
    rows = reports.topn_report(df, "y", "p", "id", [2, 3]).collect()
    assert [(r["tp"], r["fp"]) for r in rows] == [(1, 1), (2, 1)]


def test_topn_report_with_text_keys_and_empty_table(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.5), ("c", 0, None)], "id string, y int, p double")
    assert reports.topn_report(df, "y", "p", "id", [1]).first()["tp"] == 1
    assert reports.topn_report(df.limit(0), "y", "p", "id", [1]).count() == 0


def test_threshold_report(spark):
    df = scored(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)])
    hit, empty = reports.threshold_report(df, "y", "p", [0.7, 0.95]).orderBy("threshold").collect()
    assert (hit["n"], hit["tp"], hit["fp"], hit["recall"]) == (3, 2, 1, 1.0)
    assert hit["precision"] == pytest.approx(2 / 3) and hit["f1"] == pytest.approx(0.8)
    assert hit["lift"] == pytest.approx(4 / 3) and hit["share"] == 0.75
    assert [empty[c] for c in ("n", "tp", "fp", "precision", "recall", "f1", "lift")] == [0] * 7


def test_titles_and_percent_text(spark):
    df = scored(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)])
    report = reports.with_titles(
        reports.with_percent_text(reports.topn_report(df, "y", "p", "id", [2])), reports.TOPN_TITLES
    )
    assert report.columns[:3] == ["TopN", "边界阈值", "TopN样本占比"]
    assert report.first()["TopN样本占比"] == "50.00%"


def test_score_bands(spark):
    df = scored(spark, [(1, 0.0), (0, 1.0), (1, 5.0), (0, 5.1), (1, 22.0)])
    rows = reports.score_bands(df, "p", "y", 5.0).orderBy("band").collect()
    assert [r["total"] for r in rows] == [1, 2, 1, 0, 0, 1]
    assert [r["cum_bad"] for r in rows] == [1, 2, 2, 2, 2, 3]
    assert sum(r["total"] for r in rows) == 5 and rows[-1]["cum_total_rate"] == 1.0
    assert rows[-1]["lift"] == 1.0 and rows[2]["low"] == 5.0 and rows[2]["high"] == 10.0
    assert rows[1]["recall"] == pytest.approx(2 / 3) and rows[1]["precision"] == pytest.approx(2 / 3)


def test_confusion_and_counts(spark):
    df = scored(spark, [(1, 0.9), (0, 0.8), (1, 0.2), (0, 0.1), (1, None)])
    row = reports.confusion(df, "y", "p").first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (1, 1, 1, 1) and row["accuracy"] == 0.5
    shares = {r["value"]: r["share"] for r in reports.value_shares(df, "p").collect()}
    assert len(shares) == 4 and sum(shares.values()) == 1.0
    assert reports.distinct_values(df, ["y", "p"]).first().asDict() == {"y": 2, "p": 4}


def test_importance_report(spark):
    rows = [("a", 0, 3.0), ("a", 1, 5.0), ("b", 0, 1.0), ("b", 1, 1.0), ("c", 0, 0.5), ("c", 1, 0.5)]
    df = spark.createDataFrame(rows, "feature string, fold int, importance double")
    found = reports.importance_report(df, top=2).collect()
    assert [(r["feature"], r["importance"], r["percentage"]) for r in found] == [("a", 4.0, 80.0), ("b", 1.0, 20.0)]


def test_nan_is_a_missing_score(spark):
    df = scored(spark, [(1, 0.9), (0, 0.2), (1, float("nan"))])
    assert reports.threshold_report(df, "y", "p", [0.5]).first()["n"] == 1
    assert reports.confusion(df, "y", "p").first()["tp"] == 1
    assert reports.topn_report(df, "y", "p", "id", [1]).first()["boundary"] == 0.9
    assert column(ranking.auc(df, "y", "p"), "auc") == [1.0]
    assert sum(column(reports.score_bands(df, "p", "y", 0.5), "total")) == 2
    assert column(binning.bin_by_width(df, "p", 2), "bin", "id") == [2, 1, None]
    assert column(binning.bin_by_edges(df, "p", [0.0, 0.5, 1.0], outside="open"), "bin", "id") == [2, 1, None]


def test_bands_beyond_a_report_are_refused(spark):
    df = scored(spark, [(0, 0.0), (1, 1.0)])
    with pytest.raises(ValueError, match="at most"):
        reports.score_bands(df, "p", "y", 1 / (2 * reports.MAX_BANDS))
    assert reports.score_bands(df, "p", "y", 0.001).count() == 1001
