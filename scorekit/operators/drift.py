"""Drift and predictive strength of features: PSI, WoE and IV, for many features in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from scorekit.functions.intervals import MISSING_BIN, by_edges, equal_width, own_bin_for_missing
from scorekit.operators.binning import fit_quantile_edges, fit_ranges

EMPTY_SHARE = 1e-6
WOE_OFFSET = 1e-10


def _long(df: DataFrame, bins: dict[str, Column], keep: dict[str, Column]) -> DataFrame:
    """One (feature, bin) row per feature and input row; only bin numbers travel, not values."""
    if not bins:
        return df.select(*[c.alias(k) for k, c in keep.items()]).limit(0).select(
            "*", F.lit(None).cast("string").alias("feature"), F.lit(None).cast("int").alias("bin")
        )
    cells = F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), b.cast("int").alias("bin")) for n, b in bins.items()]))
    return df.select(*[c.alias(k) for k, c in keep.items()], cells)


def psi_table(
    df: DataFrame,
    names: Sequence[str],
    is_actual: Column,
    bins: int = 10,
    outside: str = "drop",
    approx: bool = False,
) -> DataFrame:
    """(feature, bin, expected, actual, psi): shares of both sides per quantile bin of the expected side.

    With ``outside='drop'`` values beyond the expected range count in neither side; ``'open'`` adds them to the
    outermost bins. NULLs count in neither side.
    """
    expected = df.filter(~is_actual)
    edges = fit_quantile_edges(expected, {n: F.col(n) for n in names}, bins, approx)
    numbers = {n: by_edges(F.col(n), edges[n], outside) for n in names if edges[n]}
    counts = (
        _long(df, numbers, {"_actual": is_actual})
        .filter("bin is not null")
        .groupBy("feature", "bin")
        .agg(F.count_if(~F.col("_actual")).alias("e"), F.count_if(F.col("_actual")).alias("a"))
    )
    whole = Window.partitionBy("feature")
    shares = counts.select(
        "feature",
        "bin",
        F.try_divide(F.col("e"), F.sum("e").over(whole)).alias("expected"),
        F.try_divide(F.col("a"), F.sum("a").over(whole)).alias("actual"),
    )
    e = F.when(F.coalesce("expected", F.lit(0.0)) == 0, EMPTY_SHARE).otherwise(F.col("expected"))
    a = F.when(F.coalesce("actual", F.lit(0.0)) == 0, EMPTY_SHARE).otherwise(F.col("actual"))
    return shares.withColumn("psi", (a - e) * F.ln(a / e))


def psi_by_feature(df: DataFrame, names: Sequence[str], is_actual: Column, **options) -> DataFrame:
    """One row per feature; NULL for a feature without expected values."""
    sums = psi_table(df, names, is_actual, **options).groupBy("feature").agg(F.sum("psi").alias("psi"))
    every = df.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "feature string")
    return every.join(sums, "feature", "left")


def psi(df: DataFrame, name: str, is_actual: Column, **options) -> DataFrame:
    """One row with the stability index of one feature."""
    return psi_by_feature(df, [name], is_actual, **options).select("psi")


def woe_table(
    df: DataFrame, names: Sequence[str], target: str, bins: int = 10, by: str = "width", approx: bool = False
) -> DataFrame:
    """(feature, bin, total, bad, good, bad_share, good_share, woe, iv); missing values are bin -1.

    ``by='width'`` cuts each feature into bins of equal width, ``'quantile'`` into bins of equal size.
    """
    columns = {n: F.col(n).cast("double") for n in names}
    if by == "width":
        ranges = fit_ranges(df, columns)
        numbers = {
            n: equal_width(c, F.lit(ranges[n].low).cast("double"), F.lit(ranges[n].high).cast("double"), bins)
            for n, c in columns.items()
        }
    elif by == "quantile":
        edges = fit_quantile_edges(df, columns, bins, approx)
        numbers = {n: by_edges(c, edges[n]) if edges[n] else F.lit(MISSING_BIN) for n, c in columns.items()}
    else:
        raise ValueError("by must be 'width' or 'quantile'")
    counts = (
        _long(df, {n: own_bin_for_missing(b) for n, b in numbers.items()}, {"_y": F.col(target)})
        .groupBy("feature", "bin")
        .agg(F.count("_y").alias("total"), F.sum("_y").cast("bigint").alias("bad"))
        .filter("total > 0")
        .withColumn("good", F.col("total") - F.col("bad"))
    )
    whole = Window.partitionBy("feature")
    shares = counts.withColumns(
        {
            "bad_share": F.try_divide(F.col("bad"), F.sum("bad").over(whole)),
            "good_share": F.try_divide(F.col("good"), F.sum("good").over(whole)),
        }
    )
    woe = F.ln((F.col("bad_share") + WOE_OFFSET) / (F.col("good_share") + WOE_OFFSET))
    return shares.withColumn("woe", woe).withColumn("iv", (F.col("bad_share") - F.col("good_share")) * F.col("woe"))


def information_value(df: DataFrame, names: Sequence[str], target: str, **options) -> DataFrame:
    return woe_table(df, names, target, **options).groupBy("feature").agg(F.sum("iv").alias("iv"))
