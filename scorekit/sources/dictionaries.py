"""Dictionary files that map feature names to display names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_LINE = "_line"


def _with_line_order(df: DataFrame) -> DataFrame:
    """Add the position of each line, so that the last of several lines with one key can win."""
    return df.withColumn(
        _LINE,
        F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        ),
    )


def _last_line_wins(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, _LINE).alias(value))


def read_headed_dictionary(spark: SparkSession, path: str, key: str = "English", value: str = "Chinese") -> DataFrame:
    """CSV with a header line; columns are found by name, others are left out; one row per key."""
    raw = spark.read.option("header", True).csv(path)
    absent = [c for c in (key, value) if c not in raw.columns]
    if absent:
        raise ValueError(f"{path} has no column {absent}; its columns are {raw.columns}")
    return _last_line_wins(_with_line_order(raw).select(F.col(f"`{key}`"), F.col(f"`{value}`"), _LINE), key, value)


def read_plain_dictionary(spark: SparkSession, path: str, key: str = "Eng_name", value: str = "Cha_name") -> DataFrame:
    """CSV without a header line; the column names are given here; one row per key."""
    raw = spark.read.schema(f"`{key}` string, `{value}` string").csv(path)
    return _last_line_wins(_with_line_order(raw), key, value)
