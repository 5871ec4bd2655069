"""Feature-table input and result output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

# The folders that results are sorted into.
RESULT_KINDS = ("sub", "result", "chart_output", "models")


def read_table(
    spark: SparkSession,
    location: str,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    spread: bool = False,
    **options: str,
) -> DataFrame:
    """Read a feature table from files (``fmt`` parquet, csv, json, orc) or, with ``fmt='table'``, from the catalog.

    ``spread`` deals the rows of a table stored in fewer pieces than there are cores over all cores; a table in many
    pieces is left as it is. Worth it before work that is heavy per row.
    """
    if fmt == "table":
        df = spark.table(location)
    else:
        reader = spark.read.format(fmt).options(**options)
        df = (reader.schema(schema) if schema is not None else reader).load(location)
    return spread_over_cores(df) if spread else df


def spread_over_cores(scan: DataFrame) -> DataFrame:
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def result_path(base: str, kind: str, name: str) -> str:
    if kind not in RESULT_KINDS:
        raise ValueError(f"kind must be one of {RESULT_KINDS}")
    return f"{base.rstrip('/')}/{kind}/{name}"


def write_result(df: DataFrame, base: str, kind: str, name: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write a result below ``base/kind/name`` and return that path; every task writes its own file."""
    path = result_path(base, kind, name)
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def write_model(model, base: str, name: str) -> str:
    """Save a fitted Spark ML model below ``base/models/name`` and return that path."""
    path = result_path(base, "models", name)
    model.write().overwrite().save(path)
    return path
