"""Bins: fitting the bounds of a column and numbering its values."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from scorekit.functions.intervals import by_edges, equal_width, fixed_step, own_bin_for_missing
from scorekit.functions.numbers import present
from scorekit.plans.order_stats import approximate_quantiles, exact_quantiles


class Range(NamedTuple):
    low: float | None
    high: float | None


def fit_quantile_edges(
    df: DataFrame, columns: dict[str, Column], bins: int, approx: bool = False
) -> dict[str, list[float]]:
    """Ascending edges at 0, 1/bins, ..., 1 of each column, repeated ones dropped."""
    quantiles = approximate_quantiles if approx else exact_quantiles
    found = quantiles(df, columns, [i / bins for i in range(bins + 1)])
    return {n: sorted({v for v in q if v is not None}) for n, q in found.items()}


def fit_ranges(df: DataFrame, columns: dict[str, Column]) -> dict[str, Range]:
    """Smallest and largest value of each column, in one pass."""
    row = df.agg(*[f(present(c)).alias(f"{k}{n}") for n, c in columns.items() for k, f in (("lo", F.min), ("hi", F.max))]).first()
    return {n: Range(row[f"lo{n}"], row[f"hi{n}"]) for n in columns}


def bin_by_quantiles(df: DataFrame, name: str, bins: int, to: str = "bin", approx: bool = False) -> DataFrame:
    edges = fit_quantile_edges(df, {name: F.col(name)}, bins, approx)[name]
    return bin_by_edges(df, name, edges, to)


def bin_by_edges(
    df: DataFrame, name: str, edges: Sequence[float], to: str = "bin", outside: str = "drop", missing_bin: bool = False
) -> DataFrame:
    """Right-closed bins between the given edges; ``missing_bin`` gives what has no bin number -1."""
    number = by_edges(F.col(name), list(edges), outside) if edges else F.lit(None).cast("int")
    return df.withColumn(to, own_bin_for_missing(number) if missing_bin else number)


def bin_by_width(df: DataFrame, name: str, bins: int, to: str = "bin", missing_bin: bool = False) -> DataFrame:
    """Bins of equal width between the smallest and the largest value."""
    low, high = fit_ranges(df, {name: F.col(name).cast("double")})[name]
    number = equal_width(F.col(name).cast("double"), F.lit(low).cast("double"), F.lit(high).cast("double"), bins)
    return df.withColumn(to, own_bin_for_missing(number) if missing_bin else number)


def bin_by_step(df: DataFrame, name: str, step: float, to: str = "bin") -> DataFrame:
    """Bins of width ``step`` from the smallest value up; bin 0 is the smallest value itself."""
    low = fit_ranges(df, {name: F.col(name).cast("double")})[name].low
    return df.withColumn(to, fixed_step(F.col(name).cast("double"), F.lit(low).cast("double"), step))
