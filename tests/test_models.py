"""The store of fitted models."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from scorekit.plans import folds, stacking
from scorekit.plans.boosting import NewtonBoosterModel
from scorekit.sources import models


@pytest.fixture(scope="module")
def scores(spark):
    df = spark.range(300).select(
        F.col("id").alias("ID"),
        (F.col("id") % 20).cast("double").alias("a"),
        (F.col("id") % 7).cast("double").alias("b"),
        ((F.col("id") % 20 + F.col("id") % 3) > 14).cast("int").alias("label"),
    )
    learners = {"n": stacking.newton(rounds=2, depth=2), "lr": stacking.logistic_meta(maxIter=3)}
    return folds.out_of_fold(df, ["a", "b"], learners, k=2, test=df.drop("label"))


def _rows(df):
    return np.array(sorted(tuple(r) for r in df.collect()), float)


def test_every_fold_comes_back_with_equal_scores(spark, scores, tmp_path):
    models.save_folds(scores, str(tmp_path), "cv")
    assert models.list_models(spark, str(tmp_path)) == ["cv_lr_0", "cv_lr_1", "cv_n_0", "cv_n_1"]
    loaded = models.load_folds(spark, str(tmp_path), "cv", scores.features)
    assert {type(m) for of in loaded.models.values() for m in of} == {NewtonBoosterModel, LogisticRegressionModel}
    again = loaded.score(scores)
    for got, want in ((again.train, scores.train), (again.test, scores.test)):
        assert _rows(got.select(*want.columns)) == pytest.approx(_rows(want))
    new = loaded.score_new(scores.train.select("ID", (F.col("ID") % 20).alias("a"), (F.col("ID") % 7).alias("b")), "ID")
    assert _rows(new.select(*scores.test.columns)) == pytest.approx(_rows(scores.test))


def test_manifest_and_features(spark, scores, tmp_path):
    base = str(tmp_path)
    path = models.save_model(spark, scores.models["n"][0], base, "one", ["a", "b"], fold=0, note="x")
    assert path.endswith("/models/one")
    manifest = models.read_manifest(spark, base, "one")
    assert manifest == {"class": "scorekit.plans.boosting.NewtonBoosterModel", "features": ["a", "b"], "fold": 0, "note": "x"}
    for wrong in (["b", "a"], ["a"], ["a", "b", "c"]):
        with pytest.raises(ValueError, match="other features"):
            models.load_model(spark, base, "one", wrong)
    models.save_model(spark, scores.models["n"][1], base, "one", ["a", "b"])  # takes the place of the first
    loaded = models.load_model(spark, base, "one", ["a", "b"])
    assert [t.as_lists() for t in loaded.trees] == [t.as_lists() for t in scores.models["n"][1].trees]


def test_half_written_models_do_not_show(spark, scores, tmp_path, monkeypatch):
    base = str(tmp_path)
    models.save_model(spark, scores.models["n"][0], base, "one", ["a", "b"])

    def broken(*_):
        raise OSError("executor lost")

    with monkeypatch.context() as patch:
        patch.setattr(models, "_files", broken)
        with pytest.raises(OSError):
            models.save_model(spark, scores.models["n"][1], base, "one", ["a", "b"])
        with pytest.raises(OSError):
            models.save_model(spark, scores.models["n"][1], base, "two", ["a", "b"])
    assert models.list_models(spark, base) == ["one"]
    loaded = models.load_model(spark, base, "one", ["a", "b"])
    assert [t.as_lists() for t in loaded.trees] == [t.as_lists() for t in scores.models["n"][0].trees]


def test_missing_folds_are_an_error(spark, scores, tmp_path):
    base = str(tmp_path)
    with pytest.raises(ValueError, match="no model"):
        models.load_folds(spark, base, "cv", ["a", "b"])
    models.save_model(spark, scores.models["n"][0], base, "cv_n_0", ["a", "b"], learner="n", fold=0, folds=2)
    with pytest.raises(ValueError, match="not all"):
        models.load_folds(spark, base, "cv", ["a", "b"])
