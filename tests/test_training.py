from typing import ClassVar

import pytest
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from conftest import column
from scorekit.functions import losses
from scorekit.operators import ranking, reports
from scorekit.plans import boosting, folds, stacking
from scorekit.sources import tables

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def samples(spark):
    df = spark.range(0, 400).select(
        F.col("id").alias("ID"),
        (F.col("id") % 20).cast("double").alias("a"),
        F.when(F.col("id") % 9 != 0, F.col("id") % 7).alias("b"),
        ((F.col("id") % 20 + F.col("id") % 3) > 14).cast("int").alias("label"),
    )
    return df.filter("ID < 320").cache(), df.filter("ID >= 320").drop("label").cache()


def test_folds_depend_on_the_key_alone(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "k")
    for fold in (folds.fold_by_arithmetic(F.col("k"), 10), folds.fold_by_hash(F.col("k"), 10)):
        once = df.withColumn("f", fold)
        sizes = column(once.groupBy("f").count(), "count")
        assert len(sizes) == 10 and min(sizes) > 120
        again = df.repartition(7).withColumn("f", fold)
        assert once.exceptAll(again).count() == 0
    assert spark.range(1).select(folds.fold_by_arithmetic(F.lit(2**62), 10)).first()[0] in range(10)


@pytest.mark.parametrize("rows_per_range", [10, folds.ROWS_PER_RANGE])
@pytest.mark.parametrize("arithmetic", [False, True])
def test_stratified_folds_are_even_per_class(spark, monkeypatch, arithmetic, rows_per_range):
    df = spark.range(0, 1003).select("id", F.when(F.col("id") % 3 != 0, (F.col("id") % 10 == 0).cast("int")).alias("y"))
    whole = folds.assign_folds(df, "id", 7, stratify="y", arithmetic=arithmetic)
    monkeypatch.setattr(folds, "ROWS_PER_RANGE", rows_per_range)
    dealt = folds.assign_folds(df, "id", 7, stratify="y", arithmetic=arithmetic)
    assert dealt.count() == 1003 and dealt.exceptAll(whole).count() == 0
    for y in (0, 1, None):
        sizes = column(dealt.filter(F.col("y").eqNullSafe(F.lit(y))).groupBy("fold").count(), "count")
        assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1


@pytest.fixture(scope="module")
def folded(samples):
    train, test = samples
    learners = {"a": stacking.booster(maxIter=2, maxDepth=3), "b": stacking.booster(maxIter=2, maxDepth=2)}
    return folds.out_of_fold(train, FEATURES, learners, k=3, test=test, pos_weight=2.0)


def test_out_of_fold_scores_cover_every_row_once(samples, folded):
    train, test = samples
    assert folded.train.columns == ["ID", "label", "fold", "a", "b"]
    assert sorted(column(folded.train, "ID")) == sorted(column(train, "ID"))
    assert sorted(column(folded.test, "ID")) == sorted(column(test, "ID"))
    assert column(ranking.auc(folded.train, "label", "a"), "auc")[0] > 0.9
    assert [len(m) for m in folded.models.values()] == [3, 3]


def test_fold_models_did_not_see_their_fold(folded):
    counts = folded.train.groupBy("fold").count().collect()
    assert len(counts) == 3 and sum(r["count"] for r in counts) == 320


@pytest.mark.parametrize("make, settings", [(None, {}), (stacking.booster, {"maxIter": 2, "maxDepth": 2}), (stacking.newton, {"rounds": 3})])
def test_stack(folded, make, settings):
    stacked = stacking.stack(folded, ["a", "b"], meta=make and make(**settings))
    assert len(stacked.models["stacked"]) == 3 and stacked.train.count() == 320 and stacked.test.count() == 80
    low, high = stacked.test.agg(F.min("stacked"), F.max("stacked")).first()
    assert 0 <= low < high <= 1


class Memory(Estimator):
    """Remembers the labels of the rows it was fitted on, and gives 0.5 to all others."""

    weighted: ClassVar[list[str | None]] = []

    def setWeightCol(self, name):
        Memory.weighted.append(name)
        return self

    def _fit(self, dataset):
        return Remembered(dataset.select("features", F.col("label").alias("known")).distinct())


class Remembered(Model):
    def __init__(self, known):
        super().__init__()
        self.known = known

    def _transform(self, dataset):
        p = F.coalesce(F.col("known").cast("double"), F.lit(0.5))
        return dataset.join(self.known, "features", "left").withColumn("probability", array_to_vector(F.array(1 - p, p))).drop("known")


def test_no_train_row_is_scored_by_a_meta_model_that_saw_it(folded):
    """Base scores are made different for each row, so a meta model knows a row only if it was fitted on it."""
    train = folded.train.withColumn("a", F.col("ID").cast("double"))
    base = folds.FoldedScores(train, None, folded.models, folded.features)
    stacked = stacking.stack(base, ["a", "b"], meta=Memory(), pos_weight=3.0).train
    assert stacked.count() == 320 and stacked.filter("stacked <> 0.5").count() == 0
    assert Memory.weighted == ["weight"]


def test_vote(folded):
    voted = stacking.vote(folded.test, ["a", "b"]).join(folded.test, "ID").collect()
    assert all(r["voted"] == pytest.approx((r["a"] + r["b"]) / 2) for r in voted)


def test_importances(folded):
    report = reports.importance_report(folds.fold_importances(folded, "a"))
    rows = report.collect()
    assert {r["feature"] for r in rows} == {"a", "b"} and rows[0]["feature"] == "a"
    assert sum(r["percentage"] for r in rows) == pytest.approx(100, abs=0.02)


def test_variants():
    made = stacking.variants({"maxIter": 3}, maxDepth=[2, 4], seed=[1, 2])
    assert [m.getMaxDepth() for m in made.values()] == [2, 4]


@pytest.mark.parametrize("loss", [losses.weighted_log_loss, losses.focal_loss, losses.focal_loss_scaled])
def test_newton_boosting_learns(samples, loss):
    train, _ = samples
    model = boosting.newton_boost(train, FEATURES, loss=loss, rounds=3, step=0.1)
    scored = model.score(train, ["ID", "label"])
    assert column(ranking.auc(scored, "label", "score"), "auc")[0] > 0.85


def test_one_round_is_the_newton_step_of_each_leaf(samples):
    train, _ = samples
    model = boosting.newton_boost(train, FEATURES, rounds=1, step=1.0, depth=1, l2=0.0)
    g, h = losses.weighted_log_loss(F.col("label"), F.lit(0.0))
    leaves = model.score(train, ["label"]).groupBy("margin").agg((-F.sum(g) / F.sum(h)).alias("newton")).collect()
    assert len(leaves) == 2 and all(r["margin"] == pytest.approx(r["newton"]) for r in leaves)


def test_results_are_sorted_into_folders(spark, folded, tmp_path):
    path = tables.write_result(folded.test, str(tmp_path), "sub", "scores", fmt="csv")
    assert path.endswith("/sub/scores")
    back = tables.read_table(spark, path, "csv", folded.test.schema, header="true")
    assert back.count() == folded.test.count()
    assert tables.write_model(folded.models["a"][0], str(tmp_path), "a0").endswith("/models/a0")
    with pytest.raises(ValueError):
        tables.write_result(folded.test, str(tmp_path), "other", "x")
