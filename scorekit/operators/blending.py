"""Combining the scores of several models: hard vote, soft vote, weighted blend."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scorekit.functions.numbers import present
from scorekit.operators.ranking import ranking_metrics

WEIGHT_METRICS = ("ks", "auc", "f1")


def _total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def hard_vote(scores: Sequence[str], thresholds: float | Sequence[float] = 0.5) -> Column:
    """1 if more than half of the scores reach their threshold; a tie, or a missing score, is no vote for 1."""
    limits = [thresholds] * len(scores) if isinstance(thresholds, (int, float)) else list(thresholds)
    votes = [F.when(present(F.col(s)) >= t, 1).otherwise(0) for s, t in zip(scores, limits, strict=True)]
    return (_total(votes) * 2 > len(scores)).cast("int")


def soft_vote(scores: Sequence[str]) -> Column:
    """Mean of the scores."""
    return _total([F.col(s) for s in scores]) / len(scores)


def fit_blend_weights(df: DataFrame, label: str, scores: Sequence[str], by: str = "ks") -> dict[str, float]:
    """Weights that sum to one, proportional to each model's ``ks``, ``auc`` or ``f1``; one number per model."""
    if by not in WEIGHT_METRICS:
        raise ValueError(f"by must be one of {WEIGHT_METRICS}")
    found = {r["model"]: r[by] or 0.0 for r in ranking_metrics(df, label, scores).select("model", by).collect()}
    total = sum(found.values())
    return {s: found.get(s, 0.0) / total if total else 1.0 / len(scores) for s in scores}


def weighted_blend(
    df: DataFrame, weights: dict[str, float], to: str = "blend", sort: bool = True
) -> DataFrame:
    """Weighted mean of the scores, highest first."""
    blended = df.withColumn(to, _total([F.col(s) * w for s, w in weights.items()]))
    return blended.orderBy(F.desc(to)) if sort else blended
