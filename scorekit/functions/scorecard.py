"""Probability-to-score mappings."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from scorekit.functions.numbers import clip, present


def risk_score(prob: Column, base_score: float = 500.0, pdo: float = 20.0) -> Column:
    """Score that falls as the probability rises; 0 gives +inf, 1 gives -inf, outside [0, 1] NaN."""
    per_log_odds = pdo / math.log(2)
    inside = (prob > 0) & (prob < 1)  # NaN is not
    odds = F.when(inside, prob / F.when(inside, 1 - prob))
    return (
        F.when(prob.isNull(), F.lit(None).cast("double"))
        .when(inside, base_score - per_log_odds * F.ln(odds))
        .when(prob == 0, F.lit(float("inf")))
        .when(prob == 1, F.lit(float("-inf")))
        .otherwise(F.lit(float("nan")))
    )


def willingness_score(
    prob: Column,
    base_score: float = 600.0,
    pdo: float = 20.0,
    target_odds: float = 5.0,
    low: float = 300.0,
    high: float = 700.0,
    eps: float = 1e-10,
) -> Column:
    """Whole-number score that rises with the probability, limited to ``[low, high]``; ties round to even. NaN: NULL."""
    safe = clip(present(prob), eps, 1 - eps)
    per_log_odds = pdo / math.log(2)
    offset = base_score - per_log_odds * math.log(target_odds)
    return F.rint(clip(offset + per_log_odds * F.ln(safe / (1 - safe)), low, high)).cast("int")
