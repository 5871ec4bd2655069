import math

import pytest
from pyspark.sql import functions as F

from conftest import column
from scorekit.functions import losses
from scorekit.functions.numbers import clip
from scorekit.functions.scorecard import risk_score, willingness_score
from scorekit.operators import blending, reports


def one(spark, col, **values):
    schema = ", ".join(f"{n} {'int' if isinstance(v, int) else 'double'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("v")).first()["v"]


def test_risk_score(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.5, 2 / 3, 0.0, 1.0, None])], "i int, p double")
    found = column(df.withColumn("s", risk_score(F.col("p"))), "s", "i")
    assert found[:2] == pytest.approx([500, 480]) and found[2:4] == [math.inf, -math.inf] and found[4] is None


def test_willingness_score(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([5 / 6, 10 / 11, 0.5, 0.0, 1.0, None])], "i int, p double")
    assert column(df.withColumn("s", willingness_score(F.col("p"))), "s", "i") == [600, 620, 554, 300, 700, None]


def test_scores_are_monotone(spark):
    df = spark.range(1, 100).select((F.col("id") / 100).alias("p"))
    scores = df.select("p", risk_score(F.col("p")).alias("r"), willingness_score(F.col("p")).alias("w")).orderBy("p")
    rows = scores.collect()
    assert all(a["r"] > b["r"] and a["w"] <= b["w"] for a, b in zip(rows, rows[1:], strict=False))


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(1, -1.0), (2, None), (3, 9.0)], "i int, x double")
    assert column(df.withColumn("x", clip(F.col("x"), 0.0, 1.0)), "x", "i") == [0.0, None, 1.0]


@pytest.mark.parametrize(
    ("loss", "y", "gradient", "hessian"),
    [
        (losses.weighted_log_loss, 1, -5.0, 2.5),
        (losses.weighted_log_loss, 0, 0.5, 0.25),
        (losses.focal_loss, 1, -0.03125, 0.03125),
        (losses.focal_loss, 0, 0.09375, 0.09375),
        (losses.focal_loss_scaled, 1, -0.1125, 0.01125),
        (losses.focal_loss_scaled, 0, 0.0125, 0.00125),
    ],
)
def test_derivatives_at_zero_margin(spark, loss, y, gradient, hessian):
    g, h = loss(F.col("y"), F.col("f"))
    assert one(spark, g, y=y, f=0.0) == pytest.approx(gradient)
    assert one(spark, h, y=y, f=0.0) == pytest.approx(hessian)


def test_gradient_is_the_slope_of_the_loss(spark):
    step = 1e-5
    value = losses.weighted_log_loss_value(F.col("y"), F.col("f"))
    for y in (0, 1):
        slope = (one(spark, value, y=y, f=0.3 + step) - one(spark, value, y=y, f=0.3 - step)) / (2 * step)
        assert one(spark, losses.weighted_log_loss(F.col("y"), F.col("f")).gradient, y=y, f=0.3) == pytest.approx(slope, abs=1e-6)


def test_weighted_loss_on_probabilities(spark):
    g, h = losses.weighted_log_loss(F.col("y"), F.col("p"), on="prob")
    assert one(spark, g, y=1, p=0.5) == -5.0 and one(spark, h, y=1, p=0.5) == 2.5
    with pytest.raises(ValueError):
        losses.weighted_log_loss(F.col("y"), F.col("p"), on="odds")


def test_hinge(spark):
    df = spark.createDataFrame([(1, 0.5), (-1, 0.5)], "y int, f double")
    assert df.agg(F.avg(losses.weighted_hinge(F.col("y"), F.col("f")))).first()[0] == 2.0


def test_votes(spark):
    names = [f"p{i}" for i in range(7)]
    df = spark.createDataFrame([(1, *[0.9] * 4, *[0.1] * 3), (2, *[0.9] * 3, *[0.1] * 4)], "i int, " + ", ".join(f"{n} double" for n in names))
    assert column(df.withColumn("v", blending.hard_vote(names)), "v", "i") == [1, 0]
    assert column(df.withColumn("v", blending.hard_vote(names[2:6])), "v", "i") == [0, 0]
    assert column(df.withColumn("v", blending.soft_vote(names)), "v", "i")[0] == pytest.approx(3.9 / 7)


@pytest.mark.parametrize("by", blending.WEIGHT_METRICS)
def test_weighted_blend(spark, by):
    rows = [(i, i % 2, 0.6 + 0.1 * (i % 2), 0.5 if i % 4 else 0.9) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, y int, a double, b double")
    weights = blending.fit_blend_weights(df, "y", ["a", "b"], by)
    assert sum(weights.values()) == pytest.approx(1) and weights["a"] >= weights["b"]
    blended = column(blending.weighted_blend(df, weights), "blend")
    assert blended == sorted(blended, reverse=True)


def test_scores_of_nan_and_bands_of_infinite_scores(spark):
    df = spark.createDataFrame([(float("nan"), 0), (0.5, 1), (0.0, 0), (1.0, 1), (None, 1)], "p double, y int")
    assert [r[0] for r in df.select(willingness_score(F.col("p"))).collect()] == [None, 554, 300, 700, None]
    scored = df.select(risk_score(F.col("p")).alias("s"), "y")
    bands = {r["band"]: r for r in reports.score_bands(scored, "s", "y", 20.0).collect()}
    assert set(bands) == {-1, 0, 1} and bands[-1]["total"] == bands[0]["total"] == bands[1]["total"] == 1
    assert bands[-1]["high"] == float("-inf") and bands[1]["high"] == float("inf") and bands[1]["cum_total"] == 3
    with pytest.raises(ValueError, match="bands"):
        reports.score_bands(spark.createDataFrame([(0.0, 1), (1e18, 0)], "s double, y int"), "s", "y", 1.0)


def test_thresholds_and_topn_count_the_same_rows(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).cast("int").alias("y"), F.when(F.col("id") < 40, F.col("id") / 100.0).alias("p"))
    top = reports.topn_report(df, "y", "p", "id", [10]).first()
    threshold = reports.threshold_report(df, "y", "p", [0.3]).first()
    assert top["n_rows"] == threshold["n_rows"] == 40 and top["positive_rate"] == threshold["positive_rate"]
