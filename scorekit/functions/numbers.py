"""Number rules shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def present(col: Column) -> Column:
    """The value as a double, with NaN as NULL. Spark orders NaN above every number, so it would pass any threshold."""
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def clip(col: Column, low: float, high: float) -> Column:
    """Clip to ``[low, high]``; NULL and NaN stay as they are (``greatest``/``least`` would turn NULL into a bound)."""
    return F.when(F.isnan(col), col).when(col < low, F.lit(low)).when(col > high, F.lit(high)).otherwise(col)
