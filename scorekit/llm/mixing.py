"""Mixing sources to target weights (operator 3).

Each document gets a hash-random key. Keys are spread evenly over their range, so a source is cut into key ranges of
about equally many documents, as many as it needs: ranges of one large source go to many tasks. The words of each
range are summed first; the running sum of these few numbers gives each range its offset, and only inside a range are
documents ordered. A key that very many documents share (an id that repeats, or none) is cut out of its range and into
parts by the place of its rows. The source is then cut at its budget to the word: every document is taken
``budget // source_size`` times whole, and those in front of the cut once more.

Sources are numbered and their targets found in Spark, by running sums over the order in which they reach their limit; so
there may be any number of them.

Defined results. NULL text: no words. NULL source: a source of its own, behind all others. NULL doc_id: ordered like an empty
one, behind it. Repeated rows: each is a document of its own. Sources without words: target 0. Empty table: no rows. Extra
columns: ignored by ``takes``, kept by ``mix``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorekit.llm.text import FILE, ROW, with_locator, word_count
from scorekit.plans.running_totals import running_totals
from scorekit.skew import BROADCAST_ROWS, broadcast_if_small, join_counted
from scorekit.workspace import materialise

#: Documents of one source that one task orders, at least; of n documents in all, the root of n if that is more, so that
#: neither the ranges nor the list of their sums grow with n.
ROWS_PER_RANGE = 1000
#: A range with so many times the documents that it should have is looked through for keys that many share.
CROWDED = 4
#: Sources that one task numbers.
SOURCES_PER_RANGE = 100_000

PLACE = [FILE, ROW]
Weights = Callable[[Column], Column]


def cycle_weights(number: Column) -> Column:
    """Weights 1, 2, 3, repeating, for sources numbered from 0 in code point order."""
    return (number % 3 + 1).cast("double")


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key and place of each document, written once."""
    narrow = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("src"), word_count().alias("size"), *PLACE
    )
    return materialise(narrow.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mix-sizes")


def _numbered(sources: DataFrame, n: int) -> DataFrame:
    """``sources`` with ``s``, their number from 0 in code point order, the source without a name last."""
    order = [F.col("src") == "", F.col("src")]
    ranges = max(1, -(-n // SOURCES_PER_RANGE))
    ranged = sources.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "mix-sources")  # with its range, so that every reader sees the same cut
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    shifts = ranged.groupBy("part").agg(F.count("*").alias("k")).select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("shift"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("s", within - 1).join(F.broadcast(shifts), "part").withColumn("s", F.col("s") + F.col("shift")).drop("part", "shift")


def with_targets(sources: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """``sources`` (size, weight, ...) with ``target``.

    ``share`` of all sizes is dealt by weight; what lies above ``max_epochs`` times a source's size is dealt among the others.
    In the order of limit per weight, sources in front of a level are full at it; the level is the first that its source bears.
    """
    capped = sources.withColumn("cap", max_epochs * F.col("size"))
    total = capped.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ratios = capped.filter("weight > 0").withColumn("ratio", F.col("cap") / F.col("weight")).groupBy("ratio")
    ratios = ratios.agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).withColumn("all", F.lit(""))
    run = running_totals(ratios, "all", "ratio", ["cap", "weight"])
    level = (F.lit(int(share * total)) - F.col("before_cap")) / (F.col("total_weight") - F.col("before_weight"))
    borne = run.withColumn("level", level).filter(F.col("level") <= F.col("ratio")).agg(F.min_by("level", "ratio")).first()[0]
    wanted = F.lit(borne).cast("double") * F.col("weight")
    target = F.when(F.col("weight") <= 0, 0.0).when(wanted <= F.col("cap"), wanted).otherwise(F.col("cap").cast("double"))
    return capped.withColumn("target", target).drop("cap")


def _budgets(rows: DataFrame, weights: Weights, share: float, max_epochs: int, per_range: int) -> tuple[DataFrame, int]:
    """One row per source: its size, target, whole epochs, words of the last epoch, and number of key ranges."""
    found = materialise(rows.groupBy("src").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "mix-found")
    sources = found.count()
    numbered = _numbered(found, sources).withColumn("weight", weights(F.col("s")).cast("double"))
    targeted = with_targets(numbered, share, max_epochs)
    budget = F.least(F.floor(F.col("target") + 0.5), max_epochs * F.col("size"))
    held = F.col("size") > 0
    table = targeted.withColumn("budget", budget).select(
        "src",
        "s",
        F.col("size").alias("source_size"),
        "target",
        F.when(held, F.expr("budget div nullif(size, 0)")).otherwise(0).alias("epochs"),
        F.when(held, F.expr("budget % nullif(size, 0)")).otherwise(0).alias("rest"),
        F.ceil(F.col("n") / per_range).cast("int").alias("ranges"),
        F.col("n").alias("n_docs"),
    )
    return materialise(table, "mix-budgets"), sources


def _segmented(rows: DataFrame, per_range: int) -> DataFrame:
    """Cut each key range into segments: ``c`` keys that many share lie before, ``hot`` whether it is one, ``sub`` its part."""
    counts = rows.groupBy("s", "range").agg(F.count("*").alias("n"))
    crowded = materialise(counts.filter(F.col("n") > CROWDED * per_range).select("s", "range"), "mix-crowded")
    if crowded.isEmpty():
        return rows.withColumns({"c": F.lit(0), "hot": F.lit(False), "sub": F.lit(0)})
    # At most n / per_range keys and ranges are crowded.
    keys = rows.join(F.broadcast(crowded), ["s", "range"]).groupBy("s", "range", "key").agg(F.count("*").alias("n"))
    shared = keys.filter(F.col("n") > per_range).withColumn("parts", F.ceil(F.col("n") / per_range).cast("int"))
    shared = shared.groupBy("s", "range").agg(F.sort_array(F.collect_list(F.struct("key", "parts"))).alias("shared"))
    cut = rows.join(F.broadcast(materialise(shared, "mix-shared")), ["s", "range"], "left")
    before = F.coalesce(F.size(F.filter("shared", lambda x: x["key"] < F.col("key"))), F.lit(0))
    own = F.filter("shared", lambda x: x["key"] == F.col("key"))
    parts = F.try_element_at(own, F.lit(1))["parts"]
    return cut.withColumns(
        {
            "c": F.greatest(before, F.lit(0)),
            "hot": parts.isNotNull(),
            "sub": F.coalesce(F.pmod(F.xxhash64(*PLACE), parts).cast("int"), F.lit(0)),
        }
    ).drop("shared")


def _placed(docs: DataFrame, weights: Weights, share: float, max_epochs: int, per_range: int) -> DataFrame:
    """Each document with the number of its source's words in front of it."""
    rows = _sized(docs)
    total = rows.count()
    per_range = max(per_range, math.isqrt(total))
    budgets, sources = _budgets(rows, weights, share, max_epochs, per_range)
    if sources <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(budgets), "src")
    else:
        rows = join_counted(rows, budgets, ["src"], F.col("n_docs"), total)
    cut = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    rows = _segmented(rows.drop("src", "n_docs").withColumn("range", F.floor(cut * F.col("ranges")).cast("int")), per_range)
    segment = ["range", "c", "hot", "sub"]
    sums = rows.groupBy("s", *segment).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("s").orderBy(*segment).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("s", *segment, F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("s", *segment).orderBy("key", F.col("doc_id").asc_nulls_last(), "size", *PLACE)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("start", F.sum("size").over(inside) - F.col("size")).join(offsets, ["s", *segment]).withColumn(
        "start", F.col("start") + F.col("offset")
    )


def takes(
    docs: DataFrame,
    weights: Weights = cycle_weights,
    share: float = 1.0,
    max_epochs: int = 3,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), copies, and its place.

    ``weights`` gives the weight of a source from its number in code point order. ``taken`` cuts at the budget to the
    word; ``copies`` is the mix in whole documents: the one at the cut is taken if at least half of it lies in front.
    """
    return _takes(with_locator(docs), weights, share, max_epochs, rows_per_range)


def _takes(
    docs: DataFrame, weights: Weights, share: float, max_epochs: int, rows_per_range: int
) -> DataFrame:
    placed = _placed(docs, weights, share, max_epochs, rows_per_range)
    left = F.col("rest") - F.col("start")
    more = F.greatest(F.lit(0), F.least(F.col("size"), left))
    again = ((left > 0) & (2 * left >= F.col("size"))).cast("long")
    return placed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + more).alias("taken"),
        (F.col("epochs") + again).alias("copies"),
        *PLACE,
    )


def mix(
    docs: DataFrame,
    weights: Weights = cycle_weights,
    share: float = 1.0,
    max_epochs: int = 3,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """The mixed documents, whole, each as often as it is taken, with all columns of ``docs``."""
    placed = with_locator(docs)
    chosen = _takes(placed, weights, share, max_epochs, rows_per_range)
    chosen = materialise(chosen.filter("copies > 0").select(*PLACE, "copies"), "mix-copies")
    return (
        placed.join(broadcast_if_small(chosen, chosen.count()), PLACE)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(*docs.columns)
    )
