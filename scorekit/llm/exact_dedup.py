"""Exact deduplication as a stateful stream (operator 8).

The stream groups fingerprints by digest in a RocksDB state store that never expires a key. For each digest it retains a
count, the identifier of the row that stays, and a content locator (file and row). Spark sums up each task's rows before
the shuffle, so a digest shared by a third of all rows reaches its state as one row per task. A digest that was seen
before is only a hit: the full normalised bytes of every hit are then compared with those of the row that stays.

Defined results. NULL text: empty; all empty texts are equal. NULL doc_id: a row like any other, behind every id on ties.
Rows repeated with the same id and text: one stays. Ties on length and id: the smallest locator stays. Empty table: no
rows. Extra columns: ignored by ``decisions``, kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorekit.llm.text import FILE, ROW, SPACE, or_empty, with_locator
from scorekit.skew import broadcast_if_small, join_counted
from scorekit.workspace import fresh_path, materialise, write_table

#: Disk-backed state. Stores are closed as soon as a task has committed: an open one holds preallocated files.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
}

#: Copies that are compared with one replica of the row that stays; larger groups get more replicas.
COPIES_PER_REPLICA = 1000

PLACE = [FILE, ROW]


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(or_empty(text), SPACE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fingerprints(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, digest, sha256, length and locator of each row; works on streams as well. ``docs`` needs locators."""
    return docs.select("doc_id", normalised().alias("__norm"), F.length(or_empty()).alias("n"), *PLACE).select(
        "doc_id", digest(F.col("__norm")).alias("digest"), sha256(F.col("__norm")).alias("sha256"), "n", *PLACE
    )


def _best() -> Column:
    """The row that stays: longest text, then smallest id, then first place."""
    return F.min(
        F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", *PLACE)
    )


def dedup_stream(prints: DataFrame) -> DataFrame:
    """The stateful operator: a streaming DataFrame of fingerprints to one growing row per digest."""
    return prints.groupBy("digest").agg(F.count("*").alias("size"), _best().alias("best"))


def run_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """Stream the fingerprint files of ``folder`` through the state and return the state: digest, size, best.

    With the ``checkpoint`` of an earlier run only files that are new since then are read; the state goes on from there.
    """
    checkpoint = checkpoint or fresh_path(spark, "dedup-state")
    schema = spark.read.parquet(folder).schema
    source = spark.readStream.schema(schema)
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        query = (
            dedup_stream(source.parquet(folder))
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    state = spark.read.format("statestore").load(checkpoint)
    # The buffer of an aggregate holds its parts in the order in which they were written: the count, then the best row.
    count, best = (F.col(f"value.{name}") for name in state.schema["value"].dataType.names)
    return state.select(
        F.col("key.digest").alias("digest"),
        count.alias("size"),
        best["doc_id"].alias("keep_id"),
        best[FILE].alias("keep_file"),
        best[ROW].alias("keep_row"),
    )


def _hits(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Compare the full normalised bytes of each row in a group with those of the row that stays: place, text, same."""
    copies = rows.filter("size > 1").select(*PLACE, "keep_file", "keep_row", "size")
    copies = materialise(copies, "dedup-hits")
    texts = docs.select(*PLACE, normalised().alias("text")).join(broadcast_if_small(copies, copies.count()), PLACE)
    replicas = F.ceil(F.col("size") / COPIES_PER_REPLICA).cast("int")
    stays = (F.col(FILE) == F.col("keep_file")) & (F.col(ROW) == F.col("keep_row"))
    kept = texts.filter(stays).select(
        "keep_file", "keep_row", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), replicas - 1)).alias("part")
    )
    return (
        texts.withColumn("part", F.pmod(F.xxhash64(*PLACE), replicas).cast("int"))
        .join(kept, ["keep_file", "keep_row", "part"])
        .select(*PLACE, "text", (F.col("text") == F.col("kept_text")).alias("same"))
    )


def _regroup(docs: DataFrame, rows: DataFrame, other: DataFrame) -> DataFrame:
    """Rows whose digest was that of another text: grouped by their whole normalised text instead."""
    marked = rows.join(other.select(*PLACE, F.lit(True).alias("other")), PLACE, "left")
    fine = marked.filter("other is null").drop("other", "size")
    sizes = fine.groupBy("digest").agg(F.count("*").alias("size"))
    fine = fine.join(sizes, "digest")
    texts = docs.select(*PLACE, normalised().alias("text"))
    odd = marked.filter("other").drop("other", "size", "keep_id", "keep_file", "keep_row").join(texts, PLACE)
    groups = odd.groupBy("text").agg(F.count("*").alias("size"), _best().alias("best"))
    odd = odd.join(groups, "text").select(
        "*",
        F.col("best.doc_id").alias("keep_id"),
        F.col(f"best.{FILE}").alias("keep_file"),
        F.col(f"best.{ROW}").alias("keep_row"),
    )
    return fine.unionByName(odd.select(*fine.columns))


def _decide(docs: DataFrame, digest: Callable[[Column], Column], files_per_trigger: int | None) -> DataFrame:
    """As ``decisions``, for rows that carry their places already."""
    spark = docs.sparkSession
    folder = write_table(fingerprints(docs, digest), "fingerprints")
    prints = spark.read.parquet(folder)
    groups = materialise(run_stream(spark, folder, files_per_trigger), "dedup-groups")
    rows = join_counted(prints, groups, ["digest"], F.col("size"), prints.count())
    other = materialise(_hits(docs, rows).filter("not same").select(*PLACE), "dedup-other")
    if not other.isEmpty():
        rows = _regroup(docs, rows, other)
    stays = (F.col(FILE) == F.col("keep_file")) & (F.col(ROW) == F.col("keep_row"))
    return rows.select(
        "doc_id", "keep_id", F.col("size").alias("group_size"), stays.alias("kept"), F.col("sha256").alias("text_sha256"), *PLACE
    )


def decisions(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_trigger: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and the place of the row."""
    return _decide(with_locator(docs), digest, files_per_trigger)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    placed = with_locator(docs)
    gone = materialise(_decide(placed, sha256, None).filter("not kept").select(*PLACE), "dedup-dropped")
    return placed.join(broadcast_if_small(gone, gone.count()), PLACE, "left_anti").select(*docs.columns)
