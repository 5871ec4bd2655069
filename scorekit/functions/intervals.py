"""Bin numbers as expressions. Bins are right-closed; the number of a bin is its order. NULL and NaN have none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from scorekit.functions.numbers import present

MISSING_BIN = -1


def by_edges(x: Column, edges: Sequence[float], outside: str = "drop") -> Column:
    """Bin 1..k for ascending ``edges`` e0..ek, the lowest edge included.

    Values outside are NULL with ``outside='drop'`` and join the outermost bins with ``outside='open'``.
    """
    if outside not in ("drop", "open"):
        raise ValueError("outside must be 'drop' or 'open'")
    x = present(x)
    if len(edges) < 2:
        return F.when(x == edges[0], 1) if edges and outside == "drop" else F.when(x.isNotNull(), 1)
    last = len(edges) - 1
    number = F.when(x.isNull(), None)
    if outside == "drop":
        number = number.when(x < F.lit(edges[0]), None)
    for i in range(1, last):
        number = number.when(x <= F.lit(edges[i]), i)
    return number.otherwise(F.lit(last)) if outside == "open" else number.when(x <= F.lit(edges[last]), last)


def equal_width(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin 1..bins of equal width from ``low`` to ``high``; a constant column is all in bin 1."""
    x = present(x)
    position = F.ceil(F.try_divide(x - low, (high - low) / bins))
    return F.when(x.isNotNull(), F.coalesce(F.least(F.greatest(position, F.lit(1)), F.lit(bins)), F.lit(1))).cast("int")


def fixed_step(x: Column, low: Column, step: float) -> Column:
    """Bin 0 holds the minimum itself, bin k the values in ``(low+(k-1)*step, low+k*step]``."""
    return F.ceil((present(x) - low) / F.lit(step)).cast("bigint")


def own_bin_for_missing(number: Column) -> Column:
    return F.coalesce(number, F.lit(MISSING_BIN))
