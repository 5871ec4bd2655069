"""Fitted statistics that outlive a session and add up over days.

What is kept are counts, not results: counted key pairs, sketches per key value, and counted values of number columns. All of
them add up, so the parts of several days together give exactly the statistics of all their rows at once: codes, counts, shares
and distinct counts of keys (E10, F4 to F9), and quantiles for caps, sentinels and drift bins (C2 to C4, M1).

A part is written under a temporary name and committed by renaming; a part of the same name is replaced, so a repeated day is not
counted twice. A manifest beside the parts says what is counted; parts of another specification are refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scorekit.functions.numbers import present
from scorekit.functions.text import as_text
from scorekit.plans.key_stats import (
    SKETCH_LG_K,
    KeyStats,
    Lookup,
    attach,
    count_pairs,
    key_pairs,
    merge_sketches,
    sketch_keys,
    stats_of_pairs,
    stats_of_sketches,
)
from scorekit.plans.running_totals import running_totals

#: Changes with the meaning of what is stored.
VERSION = 1
_VALUE_SCHEMA = "feature string, value double, n long"


@dataclass(frozen=True)
class StatsSpec:
    """What a store counts. ``sketched`` pairs (key, other) have estimated distinct counts; ``numbers`` have quantiles."""

    distinct: tuple[tuple[str, str], ...] = ()
    counted: tuple[str, ...] = ()
    crosses: tuple[tuple[str, str], ...] = ()
    coded: tuple[str, ...] = ()
    sketched: tuple[tuple[str, str], ...] = ()
    numbers: tuple[str, ...] = ()
    lg_k: int = SKETCH_LG_K

    @property
    def pairs(self) -> list[tuple[str, str | None]]:
        return key_pairs(self.distinct, self.counted, self.crosses, self.coded)

    def as_text(self) -> str:
        return json.dumps({"version": VERSION, **asdict(self)}, sort_keys=True)


class StatsStore:
    """The statistics of one specification below ``folder``, in parts."""

    def __init__(self, spark: SparkSession, folder: str, spec: StatsSpec):
        self.spark, self.folder, self.spec = spark, folder.rstrip("/"), spec
        path = self._path("specification")
        if self._files(path).exists(path):
            kept = spark.read.text(path.toString()).first()[0]
            if json.loads(kept) != json.loads(spec.as_text()):
                raise ValueError(f"{folder} holds statistics of another specification or version: {kept}")
        else:
            spark.createDataFrame([(spec.as_text(),)], "value string").coalesce(1).write.text(path.toString())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def parts(self) -> list[str]:
        path = self._path("parts")
        files = self._files(path)
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return sorted(n.removeprefix("part=") for n in names if n.startswith("part="))

    def add(self, df: DataFrame, part: str) -> None:
        """Count the rows of ``df`` as the part of that name, in place of an earlier one."""
        spec, texts = self.spec, {}
        for name in [n for p in [*spec.pairs, *spec.sketched] for n in p if n is not None]:
            texts[name] = as_text(df, name)
        tables = {}
        if spec.pairs:
            tables["pairs"] = count_pairs(df, texts, spec.pairs)
        if spec.sketched:
            tables["sketches"] = sketch_keys(df, texts, spec.sketched, spec.lg_k)
        if spec.numbers:
            cells = [F.struct(F.lit(n).alias("feature"), present(F.col(f"`{n}`").cast("double")).alias("value")) for n in spec.numbers]
            valued = df.select(F.inline(F.array(*cells))).filter("value is not null")
            tables["values"] = valued.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        self._commit(tables, part)

    def _commit(self, tables: dict[str, DataFrame], part: str) -> None:
        unfinished = f"unfinished/{uuid.uuid4().hex}"
        for name, table in tables.items():
            table.write.parquet(f"{self.folder}/{unfinished}/{name}")
        place, source = self._path(f"parts/part={part}"), self._path(unfinished)
        files = self._files(place)
        files.mkdirs(place.getParent())
        files.delete(place, True)
        if not files.rename(source, place):
            raise OSError(f"{source} could not be renamed to {place}")

    def _read(self, table: str, parts: Sequence[str] | None) -> DataFrame:
        chosen = self.parts() if parts is None else list(parts)
        unknown = sorted(set(chosen) - set(self.parts()))
        if unknown or not chosen:
            raise ValueError(f"no such parts: {unknown}" if unknown else "no parts")
        return self.spark.read.parquet(*[f"{self.folder}/parts/part={p}/{table}" for p in chosen])

    def merge(self, parts: Sequence[str], into: str) -> None:
        """Put several parts together as one and drop them."""
        tables = {}
        if self.spec.pairs:
            tables["pairs"] = self._read("pairs", parts).groupBy("pair", "a", "b").agg(F.sum("n").alias("n"))
        if self.spec.sketched:
            tables["sketches"] = merge_sketches(self._read("sketches", parts))
        if self.spec.numbers:
            tables["values"] = self._read("values", parts).groupBy("feature", "value").agg(F.sum("n").alias("n"))
        self._commit(tables, into)
        for part in parts:
            if part != into:
                place = self._path(f"parts/part={part}")
                self._files(place).delete(place, True)

    def key_stats(self, parts: Sequence[str] | None = None, **options) -> KeyStats:
        """Exact statistics of all rows of the parts (default: all parts)."""
        spec = self.spec
        counts = self._read("pairs", parts).groupBy("pair", "a", "b").agg(F.sum("n").alias("n"))
        return stats_of_pairs(counts, spec.pairs, spec.distinct, spec.crosses, spec.coded, **options)

    def approx_key_stats(self, parts: Sequence[str] | None = None, **options) -> KeyStats:
        """Statistics with estimated distinct counts."""
        return stats_of_sketches(merge_sketches(self._read("sketches", parts)), self.spec.sketched, **options)

    def quantiles(self, probs: Sequence[float], parts: Sequence[str] | None = None) -> dict[str, list[float | None]]:
        """Exact quantiles of every number column, with linear interpolation; None without values."""
        counts = self._read("values", parts).groupBy("feature", "value").agg(F.sum("n").alias("n"))
        placed = running_totals(counts, "feature", "value", ["n"])
        wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("total_n") - 1)).alias("at")) for i, p in enumerate(probs)])
        runs = placed.select("feature", "value", "before_n", (F.col("before_n") + F.col("n")).alias("after"), F.inline(wanted))
        low, high = F.floor("at"), F.ceil("at")
        holds = lambda rank: (F.col("before_n") <= rank) & (rank < F.col("after"))
        found = runs.groupBy("feature", "i").agg(
            F.max(F.when(holds(low), F.col("value"))).alias("low"),
            F.max(F.when(holds(high), F.col("value"))).alias("high"),
            F.max(F.col("at") - low).alias("weight"),
        )
        out: dict[str, list[float | None]] = {n: [None] * len(probs) for n in self.spec.numbers}
        for r in found.collect():
            out[r["feature"]][r["i"]] = r["low"] + (r["high"] - r["low"]) * r["weight"] if r["weight"] else r["low"]
        return out


def attach_or(df: DataFrame, stats: KeyStats, lookups: Sequence[Lookup], unseen: int | None = None) -> DataFrame:
    """As ``attach``; a key that the statistics have not seen gets ``unseen`` in all its outputs (default: NULL)."""
    marked = [Lookup(x.key, x.text, {**x.outputs, f"__seen_{i}": lambda get: get("n")}) for i, x in enumerate(lookups)]
    found = attach(df, stats, marked)
    if unseen is None:
        return found.drop(*[f"__seen_{i}" for i in range(len(lookups))])

    def filled(name: str, i: int) -> Column:
        return F.when(F.col(f"__seen_{i}").isNull(), F.lit(unseen)).otherwise(F.col(f"`{name}`")).alias(name)

    return found.select(*df.columns, *[filled(n, i) for i, x in enumerate(lookups) for n in x.outputs])
