"""A linear model trained on the weighted hinge loss, by subgradients summed over the rows.

Each scan tries several steps along the last subgradient at once and sums, for each, the loss and its subgradient; the best
step is taken if it lowers the loss, so the loss falls in every round, and training ends when no step lowers it. Rows
are stored once, standardised by their means and deviations. What reaches the driver has the size of the weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from scorekit.functions.numbers import present
from scorekit.workspace import materialise, release

#: Steps that one scan tries, each half of the one before; the next scan begins with twice the step that was taken.
STEPS = 8


@dataclass(frozen=True)
class HingeModel:
    """``weights`` for the features as they are, ``losses`` of the rounds: mean weighted hinge and penalty."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float
    losses: tuple[float, ...]
    missing: tuple[float, ...]

    def margin(self) -> Column:
        """The margin of a row; a missing feature has its mean in the training rows."""
        total = F.lit(self.intercept)
        for name, weight, mean in zip(self.features, self.weights, self.missing, strict=True):
            total = total + F.coalesce(present(F.col(f"`{name}`").cast("double")), F.lit(mean)) * weight
        return total

    def score(self, df: DataFrame, keep: Sequence[str], to: str = "margin") -> DataFrame:
        return df.select(*keep, self.margin().alias(to))


def fit_hinge(
    train: DataFrame,
    features: Sequence[str],
    label: str = "label",
    pos_weight: float = 5.0,
    gap: float = 1.0,
    l2: float = 1e-3,
    rounds: int = 50,
    step: float = 1.0,
) -> HingeModel:
    """Labels are 0 and 1 (or -1 and 1); positive rows count ``pos_weight`` times. No rows: all weights are 0."""
    d = len(features)
    values = [present(F.col(f"`{f}`").cast("double")) for f in features]
    labelled = train.filter(F.col(label).isNotNull())
    facts = labelled.agg(
        F.count(F.lit(1)).alias("n"), *[f(v).alias(f"{f.__name__}{i}") for i, v in enumerate(values) for f in (F.avg, F.stddev_pop)]
    ).first()
    mean = np.array([facts[f"avg{i}"] or 0.0 for i in range(d)])
    wide = np.array([facts[f"stddev_pop{i}"] or 0.0 for i in range(d)])
    scale = np.where(wide > 0, wide, 1.0)
    if not facts["n"]:
        return HingeModel(tuple(features), (0.0,) * d, 0.0, (), tuple(mean))
    x = F.array(*[(F.coalesce(v, F.lit(float(m))) - float(m)) / float(s) for v, m, s in zip(values, mean, scale, strict=True)])
    y = F.when(F.col(label) == 1, 1.0).otherwise(-1.0)
    rows = materialise(labelled.select(y.alias("y"), x.alias("x")), "hinge")

    weights, losses = np.zeros(d + 1), []
    loss, slope = _losses(rows, weights[None, :], d, pos_weight, gap, l2)
    losses.append(float(loss[0]))
    slope = slope[0]
    for _ in range(rounds):
        tried = weights - np.outer(step * 0.5 ** np.arange(STEPS), slope)
        loss, slopes = _losses(rows, tried, d, pos_weight, gap, l2)
        best = int(loss.argmin())
        if not loss[best] < losses[-1]:
            break
        weights, slope, step = tried[best], slopes[best], 2 * step * 0.5**best
        losses.append(float(loss[best]))
    release(train.sparkSession, rows)
    plain = weights[:d] / scale
    return HingeModel(tuple(features), tuple(map(float, plain)), float(weights[d] - plain @ mean), tuple(losses), tuple(map(float, mean)))


def _losses(rows: DataFrame, tried: np.ndarray, d: int, pos_weight: float, gap: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss and subgradient at each row of ``tried`` (weights, then intercept), in one scan."""
    k = len(tried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, d + 3))
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = pc.list_flatten(batch.column(1)).to_numpy().reshape(len(y), d)
            weight = np.where(y == 1, pos_weight, 1.0)
            short = gap - y[:, None] * (x @ tried[:, :d].T + tried[:, d])
            pull = np.where(short > 0, (weight * -y)[:, None], 0.0)
            total[:, 0] += (np.maximum(short, 0) * weight[:, None]).sum(axis=0)
            total[:, 1] += len(y)
            total[:, 2 : 2 + d] += pull.T @ x
            total[:, 2 + d] += pull.sum(axis=0)
        flat = total.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["at", "value"])

    found = rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(k * (d + 3))
    for r in found:
        total[r["at"]] = r["value"]
    total = total.reshape(k, d + 3)
    n = total[:, 1]
    penalty = l2 / 2 * (tried[:, :d] ** 2).sum(axis=1)
    slopes = total[:, 2:] / n[:, None]
    slopes[:, :d] += l2 * tried[:, :d]
    return total[:, 0] / n + penalty, slopes
