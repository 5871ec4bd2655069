"""From the scores of several models to one result, over a long store of scores.

The store has one row per key and model: (key, model, fold, label, score). Train rows hold out-of-fold scores with their
label, test rows neither label nor fold. Thresholds and weights are read off the train rows of all models in one pass, and
one grouping by key makes the vote and the blends of every row; the number of models is not fixed anywhere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, Window, functions as F

from scorekit.functions.numbers import present
from scorekit.operators.blending import WEIGHT_METRICS
from scorekit.operators.ranking import curve_of, metrics_of
from scorekit.plans.folds import FoldedScores, out_of_fold
from scorekit.plans.stacking import logistic_meta, newton, stack, vote
from scorekit.workspace import materialise


def score_store(scores: Mapping[str, tuple[FoldedScores, str]], key: str = "ID") -> DataFrame:
    """The long store of named models; each is a pair of scores and the column that holds its own. Written once."""
    parts = []
    for name, (of, column) in scores.items():
        shown = [F.col(key), F.lit(name).alias("model")]
        parts.append(of.train.select(*shown, F.col("fold").cast("int").alias("fold"), F.col("label").cast("int").alias("label"), F.col(column).alias("score")))
        if of.test is not None:
            none = F.lit(None).cast("int")
            parts.append(of.test.select(*shown, none.alias("fold"), none.alias("label"), F.col(column).alias("score")))
    store = parts[0]
    for part in parts[1:]:
        store = store.unionByName(part)
    return materialise(store, "score-store")


def fit_fusion(store: DataFrame, threshold: float | None = None) -> DataFrame:
    """(model, threshold, ks, auc, f1): one row per model, from its labelled rows.

    Without a given ``threshold`` a model gets the score that gives the best F1 when it and all above count as 1; the
    greatest one on ties. ``f1`` is that of the threshold. Models without labels of both classes have NULL metrics.
    """
    curve = materialise(curve_of(store.filter(F.col("label").isNotNull())), "score-curve")
    metrics = metrics_of(curve).select("model", "ks", "auc")
    tp = F.col("total_pos") - F.col("before_pos")
    fp = F.col("total_neg") - F.col("before_neg")
    f1 = F.try_divide(2 * tp, tp + fp + F.col("total_pos"))
    if threshold is None:
        best = F.max(F.struct(f1.alias("f1"), F.col("score").alias("threshold"))).alias("best")
        cut = curve.groupBy("model").agg(best).select("model", "best.threshold", "best.f1")
    else:
        # The smallest score that reaches the threshold stands for all rows that do.
        reached = F.min(F.when(F.col("score") >= threshold, F.struct("score", f1.alias("f1")))).alias("reached")
        at = curve.groupBy("model").agg(reached)
        cut = at.select("model", F.lit(float(threshold)).alias("threshold"), F.coalesce("reached.f1", F.lit(0.0)).alias("f1"))
    return metrics.join(cut, "model").select("model", "threshold", "ks", "auc", "f1")


def fuse(store: DataFrame, fitted: DataFrame, key: str = "ID", by: Sequence[str] = WEIGHT_METRICS) -> DataFrame:
    """(key, vote, blend_<metric>...) of every row of the store.

    ``vote`` is 1 if more than half of the models reach their threshold; a missing score is no vote for 1. A blend is the mean of
    the scores, weighted by the metric of their models; models without a score of the row are left out of it.
    """
    models = fitted.count()
    met = store.join(F.broadcast(fitted), "model").withColumn("_p", present(F.col("score")))
    votes = (2 * F.sum(F.when(F.col("_p") >= F.col("threshold"), 1).otherwise(0)) > models).cast("int")
    blends = []
    for metric in by:
        weight = F.when(F.col("_p").isNotNull(), F.coalesce(F.col(metric), F.lit(0.0)))
        blends.append(F.try_divide(F.sum(weight * F.col("_p")), F.sum(weight)).alias(f"blend_{metric}"))
    return met.groupBy(key).agg(votes.alias("vote"), *blends)


def ranked(fused: DataFrame, blend: str, key: str = "ID") -> DataFrame:
    """The rows by falling blend, as they are submitted; Spark sorts them in ranges."""
    return fused.orderBy(F.desc(blend), key)


def unanimity(store: DataFrame, fitted: DataFrame, key: str = "ID") -> DataFrame:
    """(votes, rows, share): how many rows have how many votes for 1."""
    voted = store.join(F.broadcast(fitted), "model").withColumn("_vote", (present(F.col("score")) >= F.col("threshold")).cast("int"))
    counts = voted.groupBy(key).agg(F.coalesce(F.sum("_vote"), F.lit(0)).alias("votes")).groupBy("votes").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))


def base_learners() -> dict[str, Estimator]:
    """Two variants of one booster and a second one."""
    return {"first": newton(depth=3), "variant": newton(depth=4, step=0.2), "second": newton(depth=5, step=0.3)}


def seven_models(
    train: DataFrame,
    test: DataFrame | None,
    features: Sequence[str],
    learners: Mapping[str, Estimator] | None = None,
    meta: Estimator | None = None,
    linear: Estimator | None = None,
    key: str = "ID",
    label: str = "label",
    k: int = 10,
    **options,
) -> tuple[dict[str, tuple[FoldedScores, str]], FoldedScores]:
    """The seven models of the practice from one training of three base learners, and the base scores.

    1 stacking of both boosters under a logistic model, 2 under trees; 3 stacking of one booster's variants; 4 vote of these;
    5 the first booster by cross-validation; 6 vote of both boosters; 7 the second booster by cross-validation.
    """
    learners = learners or base_learners()
    meta = meta if meta is not None else newton(depth=2)
    linear = linear if linear is not None else logistic_meta()
    base = out_of_fold(train, features, learners, label, key, k, test, **options)
    if base.test is not None:
        base = FoldedScores(base.train, materialise(base.test, "base-scores"), base.models, base.features, base.vectors)
    both, variants = ["first", "second"], ["first", "variant"]

    def voted(names: list[str]) -> FoldedScores:
        return FoldedScores(vote(base.train, names, "voted"), vote(base.test, names, "voted") if base.test is not None else None)

    return {
        "m1_stack_linear": (stack(base, both, key, linear), "stacked"),
        "m2_stack_trees": (stack(base, both, key, meta), "stacked"),
        "m3_stack_variants": (stack(base, variants, key, meta), "stacked"),
        "m4_vote_variants": (voted(variants), "voted"),
        "m5_first": (base, "first"),
        "m6_vote_both": (voted(both), "voted"),
        "m7_second": (base, "second"),
    }, base
