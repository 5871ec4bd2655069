"""A store of fitted models: written under a temporary name, described by a manifest, and committed by renaming.

A model's folder appears below ``<base>/models/<name>`` only when it is complete; a reader never meets half a model. The manifest
names the class, the features in their order, and what the caller adds (fold, settings). Loading checks the features.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession

from scorekit.plans.folds import FoldedScores, assemble, score_folds, score_mean
from scorekit.sources.tables import result_path


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def save_model(spark: SparkSession, model: Model, base: str, name: str, features: Sequence[str], **facts) -> str:
    """Write ``model`` with its manifest and return its folder. A model of that name gives way only to a complete one."""
    path = result_path(base, "models", name)
    unfinished = f"{path}.{uuid.uuid4().hex}"
    model.write().save(f"{unfinished}/model")
    kind = type(model)
    manifest = {"class": f"{kind.__module__}.{kind.__qualname__}", "features": list(features), **facts}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{unfinished}/manifest")
    files, place = _files(spark, path)
    files.delete(place, True)
    if not files.rename(_files(spark, unfinished)[1], place):
        raise OSError(f"{unfinished} could not be renamed to {path}")
    return path


def read_manifest(spark: SparkSession, base: str, name: str) -> dict:
    return json.loads(spark.read.text(f"{result_path(base, 'models', name)}/manifest").first()[0])


def load_model(spark: SparkSession, base: str, name: str, features: Sequence[str]) -> Model:
    """The model of that name, if it was fitted on exactly these features in this order."""
    manifest = read_manifest(spark, base, name)
    if manifest["features"] != list(features):
        missing = [f for f in manifest["features"] if f not in features]
        more = [f for f in features if f not in manifest["features"]]
        raise ValueError(f"model {name} has other features: {missing} are missing, {more} are unknown, or their order differs")
    module, _, kind = manifest["class"].rpartition(".")
    return getattr(importlib.import_module(module), kind).load(f"{result_path(base, 'models', name)}/model")


def list_models(spark: SparkSession, base: str) -> list[str]:
    """Names of the complete models."""
    files, place = _files(spark, result_path(base, "models", ""))
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return sorted(n for n in names if "." not in n)


@dataclass(frozen=True)
class FoldModels:
    """The models of each learner, one per fold."""

    models: dict[str, list[Model]]
    features: tuple[str, ...]

    def score(self, like: FoldedScores) -> FoldedScores:
        """Scores of the rows that ``like`` was made from, by these models."""
        if like.vectors is None:
            raise ValueError("these scores hold no vectors")
        data, test, key = like.vectors
        return FoldedScores(score_folds(data, self.models, key), score_mean(test, self.models, key) if test is not None else None, self.models, self.features)

    def score_new(self, df: DataFrame, key: str) -> DataFrame:
        """(key, one score per learner) of new rows: the mean over the folds."""
        return score_mean(assemble(df, self.features, [key]), self.models, key)


def save_folds(scores: FoldedScores, base: str, name: str) -> None:
    """Every fold's model of every learner, each with a manifest that names learner and fold."""
    spark = scores.train.sparkSession
    for learner, of in scores.models.items():
        for fold, model in enumerate(of):
            save_model(spark, model, base, f"{name}_{learner}_{fold}", scores.features, learner=learner, fold=fold, folds=len(of))


def load_folds(spark: SparkSession, base: str, name: str, features: Sequence[str]) -> FoldModels:
    found: dict[str, dict[int, Model]] = {}
    for model in list_models(spark, base):
        manifest = read_manifest(spark, base, model)
        if model == f"{name}_{manifest.get('learner')}_{manifest.get('fold')}":
            found.setdefault(manifest["learner"], {})[manifest["fold"]] = load_model(spark, base, model, features)
            folds = manifest["folds"]
            if manifest["fold"] == 0:
                found[manifest["learner"]][-1] = folds
    models = {}
    for learner, of in found.items():
        folds = of.pop(-1, None)
        if folds is None or sorted(of) != list(range(folds)):
            raise ValueError(f"{name}: folds {sorted(of)} of learner {learner} are there, not all")
        models[learner] = [of[fold] for fold in range(folds)]
    if not models:
        raise ValueError(f"no model of {name} in {base}")
    return FoldModels(models, tuple(features))
