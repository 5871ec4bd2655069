"""Ranking quality of scores: KS, AUC, average precision, for one or many score columns at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from scorekit.functions.numbers import present
from scorekit.plans.running_totals import ROWS_PER_RANGE, running_totals


def score_curve(df: DataFrame, label: str, scores: Sequence[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per (model, score) with its positives and negatives, those below it, and the model's totals.

    Rows with equal scores share a threshold. They are counted before anything is ordered, so a score that a large
    part of the rows share is one row here. Rows without score or label are left out.
    """
    cells = F.inline(
        F.array(*[F.struct(F.lit(s).alias("model"), present(F.col(f"`{s}`")).alias("score")) for s in scores])
    )
    return curve_of(df.select(F.col(label).alias("label"), cells), rows_per_range)


def curve_of(long: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """As ``score_curve``, of rows (model, label, score)."""
    counted = (
        long.select("model", F.col("label").alias("_y"), present(F.col("score")).alias("score"))
        .filter("score is not null and _y is not null")
        .groupBy("model", "score")
        .agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") != 1).alias("neg"))
    )
    return running_totals(counted, "model", "score", ["pos", "neg"], rows_per_range=rows_per_range)


def ranking_metrics(
    df: DataFrame, label: str, scores: Sequence[str], threshold: float = 0.5, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """(model, ks, auc, avg_precision, f1, precision, recall, accuracy), all from one counted table."""
    return metrics_of(score_curve(df, label, scores, rows_per_range), threshold)


def metrics_of(curve: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The metrics of each model of a score curve.

    The last four take scores from ``threshold`` up as positive. A metric that divides by zero is NULL.
    """
    pos, neg, p_all, n_all = F.col("pos"), F.col("neg"), F.col("total_pos"), F.col("total_neg")
    p_below, n_below = F.col("before_pos"), F.col("before_neg")
    up_pos, up_neg = p_all - p_below, n_all - n_below
    hit = F.sum(F.when(F.col("score") >= threshold, pos).otherwise(0))
    false = F.sum(F.when(F.col("score") >= threshold, neg).otherwise(0))
    sums = (
        curve.groupBy("model")
        .agg(
            F.max(p_all).alias("p"),
            F.max(n_all).alias("n"),
            F.max(F.abs(F.try_divide(up_pos, p_all) - F.try_divide(up_neg, n_all))).alias("ks"),
            F.sum(pos * (n_below + neg / 2)).alias("_pairs"),
            F.sum(pos * F.try_divide(up_pos, up_pos + up_neg)).alias("_precisions"),
            hit.alias("tp"),
            false.alias("fp"),
        )
    )
    tp, fp, p, n = F.col("tp"), F.col("fp"), F.col("p"), F.col("n")
    return sums.select(
        "model",
        "ks",
        F.try_divide(F.col("_pairs"), p.cast("double") * n).alias("auc"),
        F.try_divide(F.col("_precisions"), p).alias("avg_precision"),
        F.try_divide(2 * tp, tp + fp + p).alias("f1"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, p).alias("recall"),
        F.try_divide(tp + n - fp, p + n).alias("accuracy"),
    )


def ks(df: DataFrame, label: str, score: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    return ranking_metrics(df, label, [score], rows_per_range=rows_per_range).select("ks")


def auc(df: DataFrame, label: str, score: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    return ranking_metrics(df, label, [score], rows_per_range=rows_per_range).select("auc")


def average_precision(df: DataFrame, label: str, score: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    return ranking_metrics(df, label, [score], rows_per_range=rows_per_range).select("avg_precision")
