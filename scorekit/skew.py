"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is frequent from this share of the rows on; so there are at most so many frequent keys, and they may be broadcast.
HOT_PARTS = 10_000

#: A side of a join is broadcast up to so many rows (narrow rows of ids and numbers: some tens of MB).
BROADCAST_ROWS = 200_000


def broadcast_if_small(side: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` with a broadcast hint if its counted ``rows`` allow it; else Spark shuffles both sides."""
    return F.broadcast(side) if rows <= limit else side


def join_counted(
    rows: DataFrame, table: DataFrame, keys: list[str], weight: Column, total: int, how: str = "inner"
) -> DataFrame:
    """Join ``rows`` with ``table``, which has one row per key and, in ``weight``, how many ``rows`` hold that key.

    Rows of frequent keys (at least ``total / HOT_PARTS`` rows) meet a broadcast of at most ``HOT_PARTS`` table rows and
    are never shuffled; only the rest is shuffled on the key. NULL keys match nothing. ``how``: inner or left.
    """
    hot = table.filter(weight * HOT_PARTS >= total)
    cold = table.filter(weight * HOT_PARTS < total)
    met = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return met.unionByName(rest)
