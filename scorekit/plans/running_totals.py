"""Running totals over a large ordered table without a one-partition window, as a tree of prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scorekit.skew import broadcast_if_small
from scorekit.workspace import materialise

#: Parts that one level cuts a range into, and rows of the last level's ranges, about.
FAN = 256
ROWS_PER_RANGE = 1_000_000


def running_totals(
    table: DataFrame,
    series: str,
    order: str,
    measures: list[str],
    rows_per_range: int = ROWS_PER_RANGE,
    fan: int = FAN,
) -> DataFrame:
    """For each measure add ``before_<m>`` (sum over smaller ``order``) and ``total_<m>`` within the series.

    ``table`` holds one row per (series, order); ``series`` is a column or model name, so there are few. Its rows are
    counted first. A table of more than ``rows_per_range`` rows is cut into ``fan`` ranges by sketched quantiles of ``order``,
    each of these again, until the ranges are small enough. On each level the sums of the ranges are accumulated inside the range above, so a window sees at most ``fan`` sums, and the last one, over rows, one
    range. Sketches only set the balance: any ends give the same totals.
    """
    cut = materialise(table, "running-totals")
    rows, levels = cut.count(), 0
    while rows > rows_per_range * fan**levels:
        levels += 1
        cut = _cut_once(cut, [series, *_names(levels - 1)], order, fan, f"_b{levels}", fan**levels)
    before = {m: F.lit(0) for m in measures}
    for level in range(1, levels + 1):
        above = [series, *_names(level - 1)]
        sums = cut.groupBy(*above, f"_b{level}").agg(*[F.sum(m).alias(m) for m in measures])
        earlier = Window.partitionBy(*above).orderBy(f"_b{level}").rowsBetween(Window.unboundedPreceding, -1)
        shifts = sums.select(
            *above, f"_b{level}", *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_off{level}_{m}") for m in measures]
        )
        cut = cut.join(_side(shifts, level, fan), [*above, f"_b{level}"])
        before = {m: before[m] + F.col(f"_off{level}_{m}") for m in measures}
    within = Window.partitionBy(series, *_names(levels)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = cut.groupBy(series).agg(*[F.sum(m).alias(f"total_{m}") for m in measures])
    summed = cut.withColumns({f"before_{m}": before[m] + F.coalesce(F.sum(m).over(within), F.lit(0)) for m in measures})
    return summed.join(F.broadcast(whole), series).select(
        *table.columns, *[f"total_{m}" for m in measures], *[f"before_{m}" for m in measures]
    )


def _names(levels: int) -> list[str]:
    return [f"_b{level}" for level in range(1, levels + 1)]


def _side(table: DataFrame, level: int, fan: int) -> DataFrame:
    """A table of one row per range: small on the first levels, whatever the number of rows."""
    return broadcast_if_small(table, fan**level)


def _cut_once(table: DataFrame, keys: list[str], order: str, fan: int, to: str, ranges: int) -> DataFrame:
    """Add ``to``, the number of the range of ``order`` within ``keys`` that a row falls into."""
    shares = [i / fan for i in range(1, fan)]
    ends = table.groupBy(*keys).agg(F.percentile_approx(order, shares, 20 * fan).alias("_ends"))
    x, step = F.col(order), max(2, int(fan**0.5))
    placed = table.join(broadcast_if_small(ends, ranges), keys)
    coarse = F.size(F.filter(F.filter("_ends", lambda e, i: (i + 1) % step == 0), lambda e: e < x)) * step
    placed = placed.withColumn("_coarse", coarse)
    rest = F.size(F.filter(F.slice("_ends", F.col("_coarse") + 1, step - 1), lambda e: e < x))
    return placed.withColumn(to, F.col("_coarse") + rest).drop("_ends", "_coarse")


def numbered_within(df: DataFrame, group: str, ranged: str, order: list[Column], to: str) -> DataFrame:
    """Number the rows of each group from 1 on, in ``order``, of which the column ``ranged`` is a rising function.

    Rows are numbered inside their range; the ranges are counted, and the counts before each are summed as above. NULL is a
    group like any other.
    """
    named = df.withColumn("_group", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    counts = named.groupBy("_group", ranged).agg(F.count(F.lit(1)).alias("_n"))
    shifts = running_totals(counts, "_group", ranged, ["_n"]).select("_group", ranged, F.col("before__n").alias("_shift"))
    number = F.row_number().over(Window.partitionBy("_group", ranged).orderBy(*order))
    return (
        named.withColumn(to, number)
        .join(shifts, ["_group", ranged])
        .withColumn(to, F.col(to) + F.col("_shift"))
        .drop("_group", "_shift")
    )
