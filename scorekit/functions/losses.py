"""Losses for imbalanced labels as columns: gradient, hessian and, where defined, the loss itself."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

from scorekit.functions.numbers import clip


class Derivatives(NamedTuple):
    gradient: Column
    hessian: Column


def sigmoid(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def _probability(pred: Column, on: str) -> Column:
    if on not in ("margin", "prob"):
        raise ValueError("on must be 'margin' or 'prob'")
    return sigmoid(pred) if on == "margin" else pred


def weighted_log_loss(y: Column, pred: Column, pos_weight: float = 10.0, on: str = "margin") -> Derivatives:
    """Log loss whose positive rows count ``pos_weight`` times; ``pred`` is a margin or a probability."""
    p = _probability(pred, on)
    weight = y * pos_weight + (1 - y)
    return Derivatives((p - y) * weight, p * (1 - p) * weight)


def weighted_log_loss_value(
    y: Column, pred: Column, pos_weight: float = 10.0, on: str = "margin", eps: float = 1e-15
) -> Column:
    p = clip(_probability(pred, on), eps, 1 - eps)
    return -(pos_weight * y * F.ln(p) + (1 - y) * F.ln(1 - p))


def focal_loss(y: Column, margin: Column, alpha: float = 0.25, gamma: float = 2.0, eps: float = 1e-15) -> Derivatives:
    """Focal loss with class balance ``alpha`` and the simplified derivatives of the scorecard practice."""
    p = clip(sigmoid(margin), eps, 1 - eps)
    p_true = y * p + (1 - y) * (1 - p)
    scale = (y * alpha + (1 - y) * (1 - alpha)) * F.pow(1 - p_true, F.lit(gamma))
    return Derivatives(scale * (p - y), scale * p * (1 - p) * (gamma * p_true + 1))


def focal_loss_scaled(
    y: Column, margin: Column, alpha: float = 0.9, gamma: float = 2.0, curvature: float = 0.1
) -> Derivatives:
    """Focal gradient with a hessian proportional to its size, so every Newton step has the length 1/curvature."""
    p = sigmoid(margin)
    focus = alpha * y * F.pow(1 - p, F.lit(gamma)) + (1 - alpha) * (1 - y) * F.pow(p, F.lit(gamma))
    gradient = (p - y) * focus
    return Derivatives(gradient, F.abs(gradient) * curvature)


def weighted_hinge(y: Column, margin: Column, pos_weight: float = 5.0, gap: float = 1.0) -> Column:
    """Hinge loss of one row for labels +1/-1; positive rows count ``pos_weight`` times."""
    short = F.greatest(F.lit(0.0), gap - y * margin)
    return F.when(y.isNull() | margin.isNull(), None).when(y == 1, short * pos_weight).otherwise(short)
