"""The whole feature table: label join, time parts, crosses, distinct counts, codes, counts and shares."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from scorekit.functions.text import as_text
from scorekit.operators.cleaning import split_by_mark
from scorekit.operators.features import (
    add_time_parts,
    both_ways,
    cross_lookups,
    cross_pairs,
    distinct_name,
    join_key,
    label_and_union,
    share_name,
    share_of,
)
from scorekit.plans.key_stats import (
    KeyStats,
    Lookup,
    Output,
    attach,
    class_count,
    code,
    fit_key_stats,
    row_count,
)

# The columns of the anonymous credit-marketing table and how they are used.
CATEGORIES = (
    "A1", "A2", "A3", "B1", "B2", "B3", "C1", "C2", "C3", "E2", "E3", "E5", "E7", "E9", "E10", "E13", "E16", "E17",
    "E19", "E21", "E22",
)
CROSS_FIRST = ("B2", "B3")
CROSS_SECOND = ("C1", "C2", "C3", "D1", "A1", "A2", "A3")
DISTINCT_SETS = (("A2", ("hour", "E1", "E14", "B2", "B3")), ("hour", ("E1", "E14")))
OPTIONAL_DISTINCT_SET = ("A1", ("B2", "B3"))
SHARES = ("A2", "A3", "hour")
NOT_FEATURES = ("ID", "day", "date", "label", "D2")


@dataclass(frozen=True)
class FeatureSpec:
    categories: tuple[str, ...] = CATEGORIES
    cross_first: tuple[str, ...] = CROSS_FIRST
    cross_second: tuple[str, ...] = CROSS_SECOND
    distinct_sets: tuple[tuple[str, tuple[str, ...]], ...] = DISTINCT_SETS
    shares: tuple[str, ...] = SHARES
    not_features: tuple[str, ...] = NOT_FEATURES
    cross_more_than: int = 5
    key: str = "ID"
    date: str = "date"
    label: str = "label"

    def limited_to(self, columns: Iterable[str]) -> FeatureSpec:
        """The same specification without columns the table does not have."""
        have = {*columns, "day", "hour"}
        return replace(
            self,
            categories=tuple(c for c in self.categories if c in have),
            cross_first=tuple(c for c in self.cross_first if c in have),
            cross_second=tuple(c for c in self.cross_second if c in have),
            distinct_sets=tuple((k, tuple(o for o in os if o in have)) for k, os in self.distinct_sets if k in have),
            shares=tuple(c for c in self.shares if c in have),
        )

    @property
    def crosses(self) -> list[tuple[str, str]]:
        return cross_pairs(self.cross_first, self.cross_second)

    @property
    def distinct(self) -> list[tuple[str, str]]:
        return [p for key, others in self.distinct_sets for p in both_ways(key, others)]


class FeatureTables(NamedTuple):
    """``train`` and ``test`` keep the key (and train the label) beside the features listed in ``features``."""

    train: DataFrame
    test: DataFrame
    features: list[str]


def fit_feature_stats(data: DataFrame, spec: FeatureSpec, **options) -> KeyStats:
    """All per-key statistics of the table, from one scan. ``data`` already has its time parts."""
    names = [*spec.categories, *spec.shares, *[n for p in spec.distinct + spec.crosses for n in p]]
    return fit_key_stats(
        data,
        {n: as_text(data, n) for n in dict.fromkeys(names)},
        distinct=spec.distinct,
        counted=spec.shares,
        crosses=spec.crosses,
        coded=spec.categories,
        **options,
    )


def apply_feature_stats(data: DataFrame, stats: KeyStats, spec: FeatureSpec) -> tuple[DataFrame, list[str]]:
    """Add the features to ``data``; returns the table and the names of its feature columns.

    Everything known about one key comes back in a single join: codes, distinct counts and share together.
    """
    by_key: dict[str, dict[str, Output]] = {}
    for key in spec.categories:
        by_key.setdefault(key, {})[f"_code_{key}"] = code
    for key, other in spec.distinct:
        by_key.setdefault(key, {})[distinct_name(key, other)] = stats.distinct(key, other)
    for key in spec.shares:
        counted = class_count if key in spec.categories else row_count
        by_key.setdefault(key, {})[share_name(key)] = share_of(stats, counted)

    crosses = cross_lookups(data, stats, spec.crosses, spec.cross_more_than)
    lookups = [Lookup(key, join_key(data, key), outputs) for key, outputs in by_key.items()]
    table = attach(data, stats, lookups + crosses)

    added = (
        [distinct_name(*p) for p in spec.distinct]
        + [n for x in crosses for n in x.outputs]
        + [share_name(c) for c in spec.shares]
    )
    columns = [F.col(f"_code_{c}").alias(c) if c in spec.categories else F.col(c) for c in data.columns]
    features = [c for c in [*data.columns, *added] if c not in spec.not_features and c != "is_test"]
    return table.select(*columns, *added), features


def build_feature_table(
    train: DataFrame,
    test: DataFrame,
    labels: DataFrame,
    spec: FeatureSpec | None = None,
    fit_on: str = "all",
    **options,
) -> FeatureTables:
    """Features of train and test rows.

    ``fit_on='all'`` takes codes, counts and shares from train and test together; ``'train'`` from train alone, and
    values not seen there have NULL.
    """
    spec = (spec or FeatureSpec()).limited_to(train.columns)
    data = add_time_parts(label_and_union(train, test, labels, spec.key, spec.label), spec.date)
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on must be 'all' or 'train'")
    source = data if fit_on == "all" else data.filter(~F.col("is_test"))
    stats = fit_feature_stats(source, spec, **options)
    table, features = apply_feature_stats(data, stats, spec)
    train_part, test_part = split_by_mark(table)
    return FeatureTables(
        train_part.select(spec.key, spec.label, *features), test_part.select(spec.key, *features), features
    )
