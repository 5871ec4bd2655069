"""Feature engineering: time parts, crosses, distinct counts, counts, shares, label join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scorekit.functions.text import as_text, cross_text
from scorekit.functions.timeparts import day_of, day_segment, hour_of
from scorekit.plans.key_stats import (
    KeyStats,
    Lookup,
    Output,
    attach,
    cross_name,
    fit_approx_key_stats,
    fit_key_stats,
    row_count,
    row_count_with_missing,
    stored_text,
)

TEST_LABEL = -1


def join_key(df: DataFrame, name: str) -> Column:
    return stored_text(as_text(df, name))


def add_time_parts(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns({"day": day_of(df, date), "hour": hour_of(df, date)})


def add_time_segment(df: DataFrame, hour: str = "hour", to: str = "segment") -> DataFrame:
    return df.withColumn(to, day_segment(F.col(hour)))


def cross_pairs(first: Sequence[str], second: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for a in first for b in second]


def add_crosses(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``cross_X_and_Y`` = text of X, underscore, text of Y."""
    return df.withColumns({cross_name(a, b): cross_text(df, a, b) for a, b in pairs})


def both_ways(key: str, others: Sequence[str]) -> list[tuple[str, str]]:
    return [p for other in others for p in ((key, other), (other, key))]


def distinct_name(key: str, other: str) -> str:
    return f"{key}_{other}_nuq_num"


def add_distinct_counts(df: DataFrame, key: str, others: Sequence[str], approx: bool = False, **options) -> DataFrame:
    """Distinct ``other`` per ``key`` and the reverse. NULLs are not counted; a NULL key has NULL.

    ``approx`` replaces the exact pair counts by one sketch per key value.
    """
    wanted = both_ways(key, others)
    names = list(dict.fromkeys([key, *others]))
    fit = fit_approx_key_stats if approx else fit_key_stats
    stats = fit(df, {n: as_text(df, n) for n in names}, distinct=wanted, **options)
    return attach_distinct(df, stats, wanted)


def attach_distinct(df: DataFrame, stats: KeyStats, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    lookups = [
        Lookup(key, join_key(df, key), {distinct_name(k, o): stats.distinct(k, o) for k, o in wanted if k == key})
        for key in dict.fromkeys(k for k, _ in wanted)
    ]
    return attach(df, stats, lookups).select(*df.columns, *[distinct_name(*p) for p in wanted])


def _composite_text(df: DataFrame, names: Sequence[str]) -> Column:
    """Text of several columns together, NULL if any is NULL; lengths keep the parts apart."""
    if len(names) == 1:
        return as_text(df, names[0])
    parts = []
    for n in names:
        parts += [F.char_length(as_text(df, n)).cast("string"), F.lit(":"), as_text(df, n)]
    return F.concat(*parts)


def count_name(names: Sequence[str]) -> str:
    return f"count_{'_'.join(names)}"


def add_group_count(df: DataFrame, names: Sequence[str], **options) -> DataFrame:
    """Size of the group a row belongs to; an older column of the same name is replaced; NULL key, NULL count."""
    target = count_name(names)
    df = df.drop(target)
    text = _composite_text(df, names)
    stats = fit_key_stats(df, {target: text}, counted=[target], **options)
    return attach(df, stats, [Lookup(target, stored_text(text), {target: row_count})])


def add_cross_counts(
    df: DataFrame, pairs: Sequence[tuple[str, str]], more_than: int = 5, **options
) -> DataFrame:
    """Row count of each cross that has more than ``more_than`` different values (decided by one small action)."""
    names = list(dict.fromkeys(n for p in pairs for n in p))
    stats = fit_key_stats(df, {n: as_text(df, n) for n in names}, crosses=pairs, **options)
    return attach(df, stats, cross_lookups(df, stats, pairs, more_than))


def cross_lookups(
    df: DataFrame, stats: KeyStats, pairs: Sequence[tuple[str, str]], more_than: int = 5
) -> list[Lookup]:
    rich = [p for p in pairs if (s := stats.sizes.get(cross_name(*p))) and s.values > more_than]
    return [
        Lookup(cross_name(a, b), cross_text(df, a, b), {count_name([cross_name(a, b)]): row_count_with_missing})
        for a, b in rich
    ]


def share_name(name: str) -> str:
    return f"ratio_click_of_{name}"


def share_of(stats: KeyStats, counted: Output = row_count) -> Output:
    """Share of all rows in whole percent, cut off."""
    return lambda get: F.floor(counted(get) / F.lit(float(stats.rows)) * 100).cast("int")


def add_shares(df: DataFrame, names: Sequence[str], **options) -> DataFrame:
    stats = fit_key_stats(df, {n: as_text(df, n) for n in names}, counted=names, **options)
    return attach(df, stats, [Lookup(n, join_key(df, n), {share_name(n): share_of(stats)}) for n in names])


def label_and_union(train: DataFrame, test: DataFrame, labels: DataFrame, key: str = "ID", label: str = "label"):
    """Labels joined to train, test appended with label -1; ``is_test`` marks the side, the label does not have to."""
    marked = train.drop(label).join(labels.select(key, label), key, "left").withColumn("is_test", F.lit(False))
    unmarked = test.withColumn(label, F.lit(TEST_LABEL).cast(labels.schema[label].dataType)).withColumn(
        "is_test", F.lit(True)
    )
    return marked.unionByName(unmarked, allowMissingColumns=True)
