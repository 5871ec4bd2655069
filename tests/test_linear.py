"""Training on the weighted hinge loss."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorekit.functions.losses import weighted_hinge
from scorekit.operators import ranking
from scorekit.plans import linear


def _in_numpy(x, y, pos_weight, gap, l2, rounds, step=1.0):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / np.where(scale > 0, scale, 1.0)
    weight = np.where(y == 1, pos_weight, 1.0)

    def at(w):
        short = gap - y * (z @ w[:-1] + w[-1])
        pull = np.where(short > 0, -y * weight, 0.0)
        slope = np.append(pull @ z / len(y) + l2 * w[:-1], pull.mean())
        return (np.maximum(short, 0) * weight).mean() + l2 / 2 * (w[:-1] ** 2).sum(), slope

    w = np.zeros(x.shape[1] + 1)
    loss, slope = at(w)
    losses = [loss]
    for _ in range(rounds):
        tried = [w - step * 0.5**k * slope for k in range(linear.STEPS)]
        found = [at(t) for t in tried]
        best = min(range(len(tried)), key=lambda k: found[k][0])
        if not found[best][0] < losses[-1]:
            break
        w, slope, step = tried[best], found[best][1], 2 * step * 0.5**best
        losses.append(found[best][0])
    return w[:-1] / np.where(scale > 0, scale, 1.0), losses


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(5, 2, 300), rng.normal(size=300), np.full(300, 4.0)])
    y = np.where(x[:, 0] + x[:, 1] + rng.normal(size=300) > 6.5, 1, -1)
    rows = [(i, int(a == 1), *map(float, r)) for i, (r, a) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "ID long, label int, a double, b double, c double").repartition(4)


def test_weights_equal_numpy_and_the_loss_falls(spark, data):
    x, y, df = data
    model = linear.fit_hinge(df, ["a", "b", "c"], rounds=8)
    weights, losses = _in_numpy(x, y, 5.0, 1.0, 1e-3, 8)
    assert np.allclose(model.weights, weights, rtol=1e-9) and np.allclose(model.losses, losses, rtol=1e-9)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:])) and len(model.losses) > 4
    scored = model.score(df, ["ID", "label"])
    sign = F.col("label") * 2 - 1
    mean = scored.agg(F.avg(weighted_hinge(sign, F.col("margin")))).first()[0]
    deviations = x.std(axis=0)
    assert mean + 1e-3 / 2 * ((np.array(model.weights) * deviations) ** 2).sum() == pytest.approx(model.losses[-1])
    (quality,) = ranking.auc(scored, "label", "margin").collect()
    assert quality["auc"] > 0.9


def test_missing_values_labels_and_rows(spark, data):
    _, _, df = data
    gaps = df.withColumn("a", F.when(F.col("ID") % 7 != 0, F.col("a"))).withColumn("label", F.when(F.col("ID") % 11 != 0, F.col("label")))
    model = linear.fit_hinge(gaps, ["a", "b"], rounds=3)
    assert model.score(gaps, ["ID"]).filter("margin is null").count() == 0
    empty = linear.fit_hinge(df.limit(0), ["a"], rounds=3)
    assert empty.weights == (0.0,) and empty.losses == ()
