"""Newton boosting with losses for imbalanced labels, as an estimator of Spark ML."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasWeightCol
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession, functions as F

from scorekit.plans.folds import assemble
from scorekit.plans.histograms import NO_FOLD, Ensemble, Growth, Tree, add_trees, grow_together
from scorekit.shipping import ship
from scorekit.workspace import materialise, release


class _Settings(HasFeaturesCol, HasLabelCol, HasWeightCol):
    """Settings that estimator and model share."""

    loss = Param(Params._dummy(), "loss", "name of the loss", TypeConverters.toString)
    lossParams = Param(Params._dummy(), "lossParams", "settings of the loss, as JSON", TypeConverters.toString)
    rounds = Param(Params._dummy(), "rounds", "trees", TypeConverters.toInt)
    step = Param(Params._dummy(), "step", "share of a Newton step that each tree takes", TypeConverters.toFloat)
    depth = Param(Params._dummy(), "depth", "levels of a tree", TypeConverters.toInt)
    bins = Param(Params._dummy(), "bins", "bins of a feature", TypeConverters.toInt)
    l2 = Param(Params._dummy(), "l2", "added to the hessian of a node", TypeConverters.toFloat)
    start = Param(Params._dummy(), "start", "first margin", TypeConverters.toFloat)
    leastRows = Param(Params._dummy(), "leastRows", "rows of a node at least", TypeConverters.toInt)

    def growth(self) -> Growth:
        of = self.getOrDefault
        return Growth(
            of("loss"), json.loads(of("lossParams")), of("rounds"), of("step"), of("depth"), of("bins"), of("l2"), of("start"), of("leastRows")
        )


class NewtonBooster(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees whose leaves are Newton steps of a loss (``histograms.LOSSES``).

    Rows without a label or features are left out; a missing weight counts 1. Labels are 0 and 1.
    """

    @keyword_only
    def __init__(
        self,
        *,
        featuresCol="features",
        labelCol="label",
        weightCol=None,
        loss="weighted_log_loss",
        lossParams="{}",
        rounds=20,
        step=0.1,
        depth=3,
        bins=32,
        l2=1.0,
        start=0.0,
        leastRows=1,
    ):
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._setDefault(
            loss="weighted_log_loss", lossParams="{}", rounds=20, step=0.1, depth=3, bins=32, l2=1.0, start=0.0, leastRows=1
        )
        self._set(**given)

    def setWeightCol(self, value: str) -> NewtonBooster:
        return self._set(weightCol=value)

    def _fit(self, dataset: DataFrame) -> NewtonBoosterModel:
        """``dataset`` is computed once: what the fit reads of it is written first."""
        read = [self.getFeaturesCol(), self.getLabelCol(), *([self.getWeightCol()] if self.isDefined("weightCol") else [])]
        rows = materialise(dataset.select(*read), "boost-rows")
        model = self.fit_folds(rows, 1, None)[0]
        release(dataset.sparkSession, rows)
        return model

    def fit_folds(self, dataset: DataFrame, k: int, fold: str | None) -> list[NewtonBoosterModel]:
        """One model per fold 0..k-1, each without the rows of its fold; all grown by the same scans."""
        return self.fit_together([self], dataset, k, fold)[0]

    def scan_key(self) -> tuple:
        """Learners with the same key can be grown together."""
        weight = self.getWeightCol() if self.isDefined("weightCol") else None
        return self.getOrDefault("bins"), self.getFeaturesCol(), self.getLabelCol(), weight

    @staticmethod
    def fit_together(
        learners: Sequence[NewtonBooster], dataset: DataFrame, k: int, fold: str | None
    ) -> list[list[NewtonBoosterModel]]:
        """What ``fit_folds`` gives for each of some learners with the same ``scan_key``, by the same scans."""
        first = learners[0]
        weight = F.coalesce(F.col(first.getWeightCol()).cast("double"), F.lit(1.0)) if first.isDefined("weightCol") else F.lit(1.0)
        rows = dataset.select(
            F.col(first.getLabelCol()).cast("double").alias("y"),
            weight.alias("weight"),
            (F.col(fold) if fold else F.lit(NO_FOLD)).cast("int").alias("fold"),
            vector_to_array(first.getFeaturesCol()).alias("x"),
        ).filter("y is not null and x is not null")
        growths = [learner.growth() for learner in learners]
        one = rows.select(F.size("x").alias("n")).first()
        grown = grow_together(rows, "x", one["n"], growths, k) if one else [[Ensemble([], [], g.start) for _ in range(k)] for g in growths]
        return [[learner._copyValues(NewtonBoosterModel(e)) for e in of] for learner, of in zip(learners, grown, strict=True)]


class NewtonBoosterModel(Model, _Settings, MLReadable, MLWritable):
    """Adds rawPrediction (minus and plus the margin), probability and prediction."""

    def __init__(self, ensemble: Ensemble | None = None):
        super().__init__()
        self._setDefault(
            loss="weighted_log_loss", lossParams="{}", rounds=20, step=0.1, depth=3, bins=32, l2=1.0, start=0.0, leastRows=1
        )
        self.ensemble = ensemble

    @property
    def trees(self) -> list[Tree]:
        return self.ensemble.trees

    @property
    def featureImportances(self) -> DenseVector:
        """Gain of each feature's cuts, summing to 1."""
        gains = self.ensemble.gains()
        return Vectors.dense(gains / gains.sum() if gains.sum() else gains)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship(dataset.sparkSession)
        margin = margin_of(self.ensemble)(vector_to_array(self.getFeaturesCol()))
        p = 1 / (1 + F.exp(-F.col("__margin")))
        return (
            dataset.withColumn("__margin", margin)
            .withColumn("rawPrediction", array_to_vector(F.array(-F.col("__margin"), F.col("__margin"))))
            .withColumn("probability", array_to_vector(F.array(1 - p, p)))
            .withColumn("prediction", (F.col("__margin") >= 0).cast("double"))
            .drop("__margin")
        )

    @staticmethod
    def fold_probability(models: Sequence[NewtonBoosterModel]) -> Callable:
        """A column function from features and fold to the score of that fold's model; fold -1: the mean of all models."""
        spark = SparkSession.getActiveSession()
        ship(spark)
        shared = spark.sparkContext.broadcast([m.ensemble for m in models])

        @F.pandas_udf("double")
        def probability(features: pd.Series, fold: pd.Series) -> pd.Series:
            out = np.zeros(len(features))
            if not len(out):
                return pd.Series(out)
            values, folds, held = np.stack(features.to_numpy()), fold.to_numpy(), shared.value
            columns = held[0].columns(values)
            for n, e in enumerate(held):
                at = np.flatnonzero((folds == n) | (folds == NO_FOLD))
                p = 1 / (1 + np.exp(-add_trees(np.full(len(at), e.start), e.trees, columns[:, at])))
                out[at] += np.where(folds[at] == NO_FOLD, p / len(held), p)
            return pd.Series(out)

        return probability

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


def margin_of(ensemble: Ensemble) -> Callable:
    """A column function from arrays of features to margins; the ensemble is sent once to each executor."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(ensemble)

    @F.pandas_udf("double")
    def margin(features: pd.Series) -> pd.Series:
        held = shared.value
        if not len(features) or not held.trees:
            return pd.Series(np.full(len(features), held.start))
        return pd.Series(held.margins(np.stack(features.to_numpy())))

    return margin


class _Writer(MLWriter):
    def __init__(self, model: NewtonBoosterModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        e = self.model.ensemble
        rows = [(-1, json.dumps([e.start, [x.tolist() for x in e.edges]]))]
        rows += [(n, json.dumps(t.as_lists())) for n, t in enumerate(e.trees)]
        self.sparkSession.createDataFrame(rows, "n int, body string").coalesce(1).write.parquet(f"{path}/data")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> NewtonBoosterModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        bodies = {r["n"]: json.loads(r["body"]) for r in self.sparkSession.read.parquet(f"{path}/data").collect()}
        start, edges = bodies.pop(-1)
        trees = [Tree.from_lists(bodies[n]) for n in sorted(bodies)]
        model = self.cls(Ensemble([np.array(x, float) for x in edges], trees, start))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


@dataclass(frozen=True)
class NewtonModel:
    """A fitted booster with the names of its features."""

    model: NewtonBoosterModel
    features: tuple[str, ...]

    @property
    def trees(self) -> list[Tree]:
        return self.model.trees

    def score(self, df: DataFrame, keep: Sequence[str], to: str = "score") -> DataFrame:
        """(keep..., margin, probability) of every row."""
        scored = self.model.transform(assemble(df, self.features, list(keep)))
        return scored.select(*keep, vector_to_array("rawPrediction")[1].alias("margin"), vector_to_array("probability")[1].alias(to))


def newton_boost(
    train: DataFrame,
    features: Sequence[str],
    label: str = "label",
    loss: str | Callable = "weighted_log_loss",
    rounds: int = 10,
    step: float = 0.1,
    depth: int = 3,
    start: float = 0.0,
    bins: int = 32,
    l2: float = 1.0,
    loss_params: dict | None = None,
) -> NewtonModel:
    """Fit a booster on named columns. ``loss``: a name, or the function of ``functions/losses.py`` of that name."""
    name = loss if isinstance(loss, str) else loss.__name__
    booster = NewtonBooster(
        loss=name, lossParams=json.dumps(loss_params or {}), rounds=rounds, step=step, depth=depth, start=float(start), bins=bins, l2=float(l2)
    )
    labelled = train.filter(F.col(label).isNotNull()).withColumnRenamed(label, "label")
    return NewtonModel(booster.fit(assemble(labelled, features, ["label"])), tuple(features))

