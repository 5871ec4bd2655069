"""Stacking and voting over out-of-fold scores."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import DataFrame, functions as F

from scorekit.operators.blending import soft_vote
from scorekit.plans.boosting import NewtonBooster
from scorekit.plans.folds import FoldedScores, assemble, fit_folds, score_folds, score_mean
from scorekit.workspace import materialise


def newton(**params) -> NewtonBooster:
    """Newton boosting on the plain log loss with small defaults."""
    return NewtonBooster(**{"rounds": 20, "depth": 5, "lossParams": '{"pos_weight": 1.0}', **params})


def booster(**params) -> GBTClassifier:
    """Gradient-boosted trees with small defaults."""
    return GBTClassifier(featuresCol="features", labelCol="label", **{"maxIter": 20, "maxDepth": 5, "seed": 1, **params})


def variants(
    base: Mapping[str, object], make: Callable[..., Estimator] = booster, **lists: Sequence[object]
) -> dict[str, Estimator]:
    """Variants of one learner: the n-th variant takes the n-th value of every list."""
    size = max(len(v) for v in lists.values())
    return {
        f"v{i}": make(**{**base, **{name: values[i % len(values)] for name, values in lists.items()}})
        for i in range(size)
    }


def logistic_meta(**params) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", **params)


def stack(
    scores: FoldedScores,
    learners: Sequence[str],
    key: str = "ID",
    meta: Estimator | None = None,
    to: str = "stacked",
    pos_weight: float = 1.0,
) -> FoldedScores:
    """Cross-fit the meta model on the learners' out-of-fold scores, in the folds of the base models.

    The meta model of a fold is fitted without it, so no train row is scored by a meta model that saw it. Test rows get
    the mean of the meta models.
    """
    meta = meta if meta is not None else logistic_meta()
    rows = scores.train.withColumn("weight", F.when(F.col("label") == 1, float(pos_weight)).otherwise(1.0))
    data = materialise(assemble(rows, learners, [key, "label", "fold", "weight"]), "stack")
    models = fit_folds(data, {to: meta}, len(scores.models[learners[0]]), pos_weight != 1.0)
    train = score_folds(data, models, key)
    test = score_mean(assemble(scores.test, learners, [key]), models, key) if scores.test is not None else None
    return FoldedScores(train, test, models, tuple(learners))


def vote(scores: DataFrame, learners: Sequence[str], to: str = "voted") -> DataFrame:
    """Mean of the learners' probabilities."""
    return scores.withColumn(to, soft_vote(learners)).drop(*learners)
