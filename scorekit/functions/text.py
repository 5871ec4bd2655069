"""Text rules that decide how values become category keys and how strings become numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The text that stands for a missing value once a column has been turned into text.
MISSING_TEXT = "nan"

# Strings accepted as numbers: optional sign, digits with optional fraction and exponent, or infinity.
NUMBER_PATTERN = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"


def as_text(df: DataFrame, name: str) -> Column:
    """Text of a column; NULL and NaN both give NULL."""
    kind = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        plain = (
            F.when(F.isnan(col), None)
            .when(col == float("inf"), "inf")
            .when(col == float("-inf"), "-inf")
        )
        return plain.otherwise(F.when(col == 0, "0.0").otherwise(col.cast("string")))
    if isinstance(kind, T.BooleanType):
        return F.initcap(col.cast("string"))
    return col.cast("string")


def category_text(df: DataFrame, name: str) -> Column:
    """Text of a column with the missing value spelt out, the form in which categories are crossed and coded."""
    return F.coalesce(as_text(df, name), F.lit(MISSING_TEXT))


def cross_text(df: DataFrame, left: str, right: str) -> Column:
    """``left_right`` as one string; a missing side is spelt out (``concat_ws`` would skip it)."""
    return F.concat(category_text(df, left), F.lit("_"), category_text(df, right))


def parses_as_number(col: Column) -> Column:
    """True for NULL, the empty string and every string that is a number."""
    return F.coalesce((col == "") | col.rlike(NUMBER_PATTERN), F.lit(True))


def parses_as_integer(col: Column) -> Column:
    """True for NULL, the empty string and every string that is an integer within bigint."""
    whole = col.rlike(INTEGER_PATTERN) & col.try_cast("bigint").isNotNull()
    return F.coalesce((col == "") | whole, F.lit(True))
