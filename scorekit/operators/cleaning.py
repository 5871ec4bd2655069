"""Cleaning: type inference, outlier capping, sentinel filling, type narrowing, splitting and selection.

Everything that looks at the data is split into a ``fit_*`` step, which returns a few numbers per column from shared
passes over the table, and an ``apply_*`` step, which is a plain projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from scorekit.functions.numbers import clip, present
from scorekit.functions.text import parses_as_integer, parses_as_number
from scorekit.plans.order_stats import approximate_quantiles, exact_quantiles

SENTINEL = -1111


def _ref(name: str) -> Column:
    return F.col(f"`{name}`")


def _columns_of(df: DataFrame, kinds: tuple[type[T.DataType], ...], only: Sequence[str] | None = None) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and (only is None or f.name in only)]


# --- strings to numbers -----------------------------------------------------------------------------------------------


def fit_numeric_types(df: DataFrame) -> dict[str, str]:
    """Target type of every string column whose values are all numbers; columns without any value are left out."""
    names = _columns_of(df, (T.StringType,))
    if not names:
        return {}
    checks = []
    for i, n in enumerate(names):
        checks += [
            F.count(_ref(n)).alias(f"seen{i}"),
            F.count_if(_ref(n) != "").alias(f"filled{i}"),
            F.bool_and(parses_as_number(_ref(n))).alias(f"number{i}"),
            F.bool_and(parses_as_integer(_ref(n))).alias(f"whole{i}"),
        ]
    row = df.agg(*checks).first()
    types = {}
    for i, n in enumerate(names):
        if row[f"seen{i}"] and row[f"number{i}"]:
            types[n] = "bigint" if row[f"whole{i}"] and row[f"filled{i}"] else "double"
    return types


def apply_numeric_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({n: F.when(_ref(n) != "", _ref(n)).try_cast(t) for n, t in types.items()}) if types else df


def strings_to_numbers(df: DataFrame) -> DataFrame:
    return apply_numeric_types(df, fit_numeric_types(df))


# --- capping ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Caps:
    bounds: dict[str, tuple[float, float]]


def fit_caps(
    df: DataFrame, names: Sequence[str], lower: float = 0.01, upper: float = 0.99, approx: bool = False, digits: int = 4
) -> Caps:
    """Lower and upper quantile of each column, rounded half-even. ``approx`` trades exactness for a single pass."""
    quantiles = approximate_quantiles if approx else exact_quantiles
    found = quantiles(df, {n: _ref(n) for n in names}, [lower, upper])
    return Caps({n: (round(lo, digits), round(hi, digits)) for n, (lo, hi) in found.items() if lo is not None})


def apply_caps(df: DataFrame, caps: Caps) -> DataFrame:
    return df.withColumns({n: clip(_ref(n).cast("double"), lo, hi) for n, (lo, hi) in caps.bounds.items()})


def cap_outliers(
    df: DataFrame, names: Sequence[str], lower: float = 0.01, upper: float = 0.99, approx: bool = False
) -> DataFrame:
    return apply_caps(df, fit_caps(df, names, lower, upper, approx))


# --- sentinel ---------------------------------------------------------------------------------------------------------


def fit_sentinel_medians(
    df: DataFrame,
    sentinel: float = SENTINEL,
    positive_only: bool = False,
    at_least: int | None = None,
    only: Sequence[str] | None = None,
) -> dict[str, float | None]:
    """Median of the other values of each bigint/double column that holds the sentinel.

    ``positive_only`` takes the median of the values above zero, 0 where there are none, and by default asks for more
    than one sentinel. A column of sentinels only gives ``None``.
    """
    names = _columns_of(df, (T.LongType, T.DoubleType), only)
    if not names:
        return {}
    need = at_least if at_least is not None else (2 if positive_only else 1)
    row = df.agg(*[F.count_if(_ref(n) == sentinel).alias(n) for n in names]).first()
    marked = [n for n in names if row[n] >= need]
    if not marked:
        return {}
    others = {n: F.when(_ref(n) > 0 if positive_only else _ref(n) != sentinel, _ref(n)) for n in marked}
    medians = {n: q[0] for n, q in exact_quantiles(df, others, [0.5]).items()}
    if positive_only:
        medians = {n: 0.0 if m is None else m for n, m in medians.items()}
    return medians


def apply_sentinel_medians(df: DataFrame, medians: dict[str, float | None], sentinel: float = SENTINEL) -> DataFrame:
    if not medians:
        return df
    return df.withColumns(
        {
            n: F.when(_ref(n) == sentinel, F.lit(m).cast("double")).otherwise(_ref(n).cast("double"))
            for n, m in medians.items()
        }
    )


def fill_sentinel(
    df: DataFrame, sentinel: float = SENTINEL, positive_only: bool = False, only: Sequence[str] | None = None
) -> DataFrame:
    """Replace the sentinel by the column's median; true NULLs are not filled."""
    return apply_sentinel_medians(df, fit_sentinel_medians(df, sentinel, positive_only, only=only), sentinel)


# --- narrowing --------------------------------------------------------------------------------------------------------

_NARROW_INTEGERS = [("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31)]


def fit_narrow_types(df: DataFrame, names: Sequence[str] | None = None, tolerance: float = 5e-4) -> dict[str, str]:
    """Smallest type that holds each column: a small integer if all values are whole, float if rounding stays small.

    NaN and infinities are no whole numbers; float holds them as they are.
    """
    whole_kinds = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    real_kinds = (T.FloatType, T.DoubleType)
    names = _columns_of(df, whole_kinds + real_kinds, names)
    if not names:
        return {}
    checks = []
    for i, n in enumerate(names):
        col = _ref(n)
        real = isinstance(df.schema[n].dataType, real_kinds)
        checks += [F.min(present(col) if real else col).alias(f"lo{i}"), F.max(present(col) if real else col).alias(f"hi{i}")]
        if real:
            value = present(col)
            endless = F.abs(value) == float("inf")
            lost = F.when(endless, 0.0).otherwise(F.abs(value - value.cast("float").cast("double")))
            checks += [
                F.bool_and(~F.isnan(col) & ~endless & (value == F.rint(value))).alias(f"whole{i}"),
                F.max(lost).alias(f"error{i}"),
            ]
    row = df.agg(*checks).first()
    types = {}
    for i, n in enumerate(names):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is None:
            continue
        real = isinstance(df.schema[n].dataType, real_kinds)
        now = df.schema[n].dataType.simpleString()
        if not real or row[f"whole{i}"]:
            fits = [t for t, limit in _NARROW_INTEGERS if -limit <= lo and hi < limit]
            if fits:
                types[n] = fits[0]
                continue
        if real and now == "double" and row[f"error{i}"] <= tolerance:
            types[n] = "float"
    return {n: t for n, t in types.items() if t != df.schema[n].dataType.simpleString()}


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({n: _ref(n).cast(t) for n, t in types.items()}) if types else df


def narrow_types(df: DataFrame, names: Sequence[str] | None = None, tolerance: float = 5e-4) -> DataFrame:
    return apply_types(df, fit_narrow_types(df, names, tolerance))


# --- split and select -------------------------------------------------------------------------------------------------


def split_by_mark(df: DataFrame, mark: str = "is_test") -> tuple[DataFrame, DataFrame]:
    """Train and test rows. The mark decides, not the label, so unlabelled train rows stay in train."""
    return df.filter(~_ref(mark)), df.filter(_ref(mark))


def without_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)
