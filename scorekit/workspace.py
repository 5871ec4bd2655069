"""Shared scratch storage for intermediate tables.

Small fitted tables are written to the folder the cluster names in ``spark.checkpoint.dir`` and read back. That cuts
lineage, survives the loss of executors, and gives Catalyst the true size of the table when it picks a join strategy.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local session that has none."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="scorekit-")
    spark.conf.set(SETTING, folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody has used yet."""
    return f"{shared_dir(spark)}/scorekit/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None, **options: str) -> str:
    """Write ``df`` as Parquet to the shared folder and return the path. ``options`` go to the writer.

    With ``partition_by`` the rows are rebalanced on these columns first: few files per small directory, and large
    directories are still written by many tasks.
    """
    path = fresh_path(df.sparkSession, name)
    if partition_by:
        df.hint("rebalance", *partition_by).write.options(**options).partitionBy(*partition_by).parquet(path)
    else:
        df.write.options(**options).parquet(path)
    return path


def materialise(df: DataFrame, name: str, cluster_by: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` once and read it back, so that later steps neither recompute it nor drag its lineage along.

    With ``cluster_by`` equal values lie together in each file, and a filter on that column skips the other pages.
    """
    ordered = df.sortWithinPartitions(cluster_by) if cluster_by else df
    return df.sparkSession.read.schema(df.schema).parquet(write_table(ordered, name, **options))


def write_compact(df: DataFrame, name: str) -> DataFrame:
    """As ``materialise``, with Zstandard: for large tables of packed numbers that are read once or twice."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more, and let Spark's cleaner drop the shuffle files of finished jobs.

    Only folders directly below this package's own in the shared folder are deleted.
    """
    own = f"{shared_dir(spark)}/scorekit/".split(":")[-1].replace("//", "/")
    for df in tables:
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            parent, _, name = folder.split(":")[-1].replace("//", "/").rpartition("/")
            if name and f"{parent}/".endswith(own):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()
