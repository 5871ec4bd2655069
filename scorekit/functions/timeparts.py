"""Parts of a timestamp that is kept as text, and segments of the day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def day_of(df: DataFrame, name: str) -> Column:
    """Day of month; from text by position (characters 9-10), NULL where these are not a number."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.substring(col, 9, 2).try_cast("int")
    return F.dayofmonth(col)


def hour_of(df: DataFrame, name: str) -> Column:
    """Hour of day; from text by position (characters 12-13), NULL where these are not a number."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.substring(col, 12, 2).try_cast("int")
    return F.hour(col)


def day_segment(hour: Column) -> Column:
    """1 for the night (19-23 and 0-3), 2 for 4-12, 3 for 13-18; anything between or outside is NULL."""
    return (
        F.when(hour.between(0, 3) | hour.between(19, 23), 1)
        .when(hour.between(4, 12), 2)
        .when(hour.between(13, 18), 3)
    )
