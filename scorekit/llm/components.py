"""Connected components of links by alternating stars; every step is a grouping and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorekit.skew import BROADCAST_ROWS, join_counted
from scorekit.workspace import materialise

#: Links of one task, where the session's number of shuffle partitions would make them fewer.
LINKS_PER_TASK = 100_000


def _in_few(rows: DataFrame, total: int) -> DataFrame:
    """About ``total`` rows in as many partitions as they need: every task of every round leaves its record on the driver."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // LINKS_PER_TASK)))


def _with_least(edges: DataFrame, of: DataFrame, total: int) -> DataFrame:
    """``edges`` (a, b) with the smallest neighbour of a in ``of`` (a, b), which has about ``total`` rows."""
    least = of.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("degree"))
    if total <= BROADCAST_ROWS:  # so there are at most as many nodes
        return edges.join(F.broadcast(_in_few(least, total)), "a")
    return join_counted(edges, least, ["a"], F.col("degree"), total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Connect the larger neighbours of each node with the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = _with_least(both.filter("b > a"), both, 2 * total)
    return _in_few(met.select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct(), total)


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Connect each node and its smaller neighbours with the smallest of them. ``edges``: a > b."""
    met = _with_least(edges, edges, total)
    own = F.struct(F.col("a"), F.col("least").alias("b"))
    below = F.struct(F.col("b").alias("a"), F.col("least").alias("b"))
    return _in_few(met.select(F.inline(F.array(own, below))).filter("a > b").distinct(), total)


def components(links: DataFrame) -> DataFrame:
    """``links``: a, b (long). Result: node, component (its smallest node), for all nodes but the components themselves.

    The stars never add links, so the counted number of links bounds all sides of a round.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = materialise(edges, "links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = tuple(state)
        edges = materialise(_large_star(edges, state[0]), "links")
        edges = materialise(_small_star(edges, state[0]), "links")
