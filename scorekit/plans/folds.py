"""Fold assignment and out-of-fold training."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from scorekit.plans.running_totals import numbered_within
from scorekit.workspace import materialise, write_table

# Multiplier and width of the multiplicative hash.
HASH_MULTIPLIER = 2654435761
HASH_BITS = 32
MISSING_FEATURE = -1.0
#: Rows that one task numbers, about.
ROWS_PER_RANGE = 100_000


def fold_by_arithmetic(key: Column, k: int) -> Column:
    """Fold 0..k-1 from an integer key by multiplicative hashing; reproducible in any SQL engine."""
    return F.floor(mixed_key(key) * F.lit(k) / F.lit(2.0**HASH_BITS)).cast("int")


def fold_by_hash(key: Column, k: int) -> Column:
    """Fold 0..k-1 from a key of any type."""
    return F.pmod(F.xxhash64(key), F.lit(k)).cast("int")


def mixed_key(key: Column) -> Column:
    """An integer key, mixed by multiplicative hashing: 0 to 2^32 - 1."""
    return F.pmod(F.pmod(key.cast("bigint"), F.lit(2**31)) * F.lit(HASH_MULTIPLIER), F.lit(2**HASH_BITS))


def assign_folds(
    df: DataFrame, key: str, k: int = 10, stratify: str | None = None, to: str = "fold", arithmetic: bool = False
) -> DataFrame:
    """Add a fold number. It depends on the key alone, so it needs no shuffle and survives any recomputation.

    ``stratify`` deals the rows of each class round-robin over the folds in the order of their mixed key, so that fold sizes
    per class differ by one at most. Rows are numbered inside ranges of the mixed key, as many as the counted rows ask for,
    and shifted by the ranges before; no task numbers a whole class. ``arithmetic`` mixes an integer key in a way that any SQL
    engine can repeat.
    """
    if stratify is None:
        return df.withColumn(to, fold_by_arithmetic(F.col(key), k) if arithmetic else fold_by_hash(F.col(key), k))
    mixed = mixed_key(F.col(key)) if arithmetic else F.pmod(F.xxhash64(F.col(key), F.lit(k)), F.lit(2**HASH_BITS))
    ranges = max(1, -(-df.count() // ROWS_PER_RANGE))
    cut = df.withColumn("_mixed", mixed).withColumn("_range", F.floor(F.col("_mixed") * F.lit(ranges) / F.lit(2.0**HASH_BITS)))
    numbered = numbered_within(cut, stratify, "_range", [F.col("_mixed"), F.col(key)], "_number")
    return numbered.select(*df.columns, F.pmod(F.col("_number") - 1, F.lit(k)).cast("int").alias(to))


@dataclass(frozen=True)
class FoldedScores:
    """``train``: key, label, fold and one out-of-fold score per learner; ``test``: key and mean scores."""

    train: DataFrame
    test: DataFrame | None
    models: dict[str, list[Model]] = field(default_factory=dict)
    features: tuple[str, ...] = ()
    #: Assembled train rows with their folds, assembled test rows, and the key: what other models can score.
    vectors: tuple[DataFrame, DataFrame | None, str] | None = None


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str], missing: float = MISSING_FEATURE) -> DataFrame:
    """(keep..., features vector); a missing feature has the value ``missing``."""
    filled = df.select(
        *keep, *[F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), F.lit(missing)).alias(f"_x_{i}")
                 for i, c in enumerate(features)]
    )
    assembler = VectorAssembler(inputCols=[f"_x_{i}" for i in range(len(features))], outputCol="features")
    return assembler.transform(filled).select(*keep, "features")


def probability() -> Column:
    return vector_to_array("probability")[1]


def score_with(model: Model, df: DataFrame, to: str) -> DataFrame:
    """Add the probability of class 1."""
    return model.transform(df).withColumn(to, probability()).drop("rawPrediction", "probability", "prediction")


def fit_folds(data: DataFrame, learners: Mapping[str, Estimator], k: int, weighted: bool = False) -> dict[str, list[Model]]:
    """k models per learner, each fitted without the rows of one fold (column ``fold``).

    Learners that offer ``fit_together`` grow their k models side by side, all those with the same ``scan_key`` at once; others
    are fitted one after another.
    """
    models: dict[str, list[Model]] = {}
    together: dict[tuple, dict[str, Estimator]] = {}
    for name, learner in learners.items():
        if weighted:
            learner = learner.copy().setWeightCol("weight")
        if hasattr(learner, "fit_together"):
            together.setdefault((type(learner), learner.scan_key()), {})[name] = learner
        else:
            models[name] = [learner.fit(data.filter(F.col("fold") != fold)) for fold in range(k)]
    for (kind, _), of in together.items():
        models.update(zip(of, kind.fit_together(list(of.values()), data, k, "fold"), strict=True))
    return {name: models[name] for name in learners}


def _in_one_pass(models: Mapping[str, list[Model]]) -> bool:
    return all(hasattr(m[0], "fold_probability") for m in models.values())


def score_folds(data: DataFrame, models: Mapping[str, list[Model]], key: str) -> DataFrame:
    """(key, label, fold, one score per learner) of every row, by the models that did not see its fold; written once."""
    shown = [key, F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold")]
    if _in_one_pass(models):
        scores = [m[0].fold_probability(m)(vector_to_array("features"), F.col("fold").cast("int")).alias(n) for n, m in models.items()]
        return materialise(data.select(*shown, *scores), "out-of-fold")
    parts = []
    for fold in range(len(next(iter(models.values())))):
        part = data.filter(F.col("fold") == fold)
        for name in models:
            part = score_with(models[name][fold], part, name)
        parts.append(part.select(*shown, *models))
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    return materialise(scored, "out-of-fold")


def score_mean(data: DataFrame, models: Mapping[str, list[Model]], key: str) -> DataFrame:
    """(key, one score per learner): the mean of the learner's models."""
    if _in_one_pass(models):
        scores = [m[0].fold_probability(m)(vector_to_array("features"), F.lit(-1)).alias(n) for n, m in models.items()]
        return data.select(key, *scores)
    for name, of in models.items():
        for fold, model in enumerate(of):
            data = score_with(model, data, f"_{name}_{fold}")
    return data.select(
        key, *[(sum(F.col(f"_{name}_{fold}") for fold in range(len(of))) / len(of)).alias(name) for name, of in models.items()]
    )


def out_of_fold(
    train: DataFrame,
    features: Sequence[str],
    learners: Mapping[str, Estimator],
    label: str = "label",
    key: str = "ID",
    k: int = 10,
    test: DataFrame | None = None,
    stratify: bool = False,
    pos_weight: float = 1.0,
    arithmetic_folds: bool = False,
) -> FoldedScores:
    """Train every learner k times, each time without one fold, and score that fold; score test by the k models' mean.

    The assembled rows are written once, one directory per fold: training reads the other folds, scoring its own, and
    nothing is filtered row by row. ``arithmetic_folds`` takes folds that any SQL engine can repeat, from an integer key. Learners read ``features``, ``label`` and, if ``pos_weight`` is not 1, ``weight``.
    """
    labelled = train.filter(F.col(label).isNotNull()).withColumn("_label", F.col(label).cast("double"))
    vectors = assemble(labelled, features, [key, "_label"]).withColumnRenamed("_label", "label")
    vectors = vectors.withColumn("weight", F.when(F.col("label") == 1, float(pos_weight)).otherwise(1.0))
    folded = assign_folds(vectors, key, k, "label" if stratify else None, arithmetic=arithmetic_folds)
    path = write_table(folded, "folds", ["fold"])
    data = train.sparkSession.read.parquet(path)

    models = fit_folds(data, learners, k, pos_weight != 1.0)
    scored = score_folds(data, models, key)

    others = assemble(test, features, [key]) if test is not None else None
    mean = score_mean(others, models, key) if others is not None else None
    return FoldedScores(scored, mean, models, tuple(features), (data, others, key))


def fold_importances(result: FoldedScores, learner: str) -> DataFrame:
    """(feature, fold, importance) of a tree learner, as numbers per fold model."""
    spark = result.train.sparkSession
    rows = [
        (feature, fold, float(value))
        for fold, model in enumerate(result.models[learner])
        for feature, value in zip(result.features, model.featureImportances.toArray(), strict=True)
    ]
    return spark.createDataFrame(rows, "feature string, fold int, importance double")
