"""Per-key statistics (row counts, distinct counts, ordered codes) and the join that brings them back to the rows.

One scan serves every statistic. The rows are turned into (pair, left, right) keys, counted with map-side combine, and
written once; counts per key, distinct counts in both directions, cross counts and category codes are all sums over
that much smaller table. The join back depends on proven sizes: statistics within a byte budget are broadcast; larger
ones are shuffled, with frequent keys taken out first (they are few by counting, hence broadcast) and their rows spread.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from scorekit.functions.text import MISSING_TEXT
from scorekit.workspace import materialise

#: Stands for a missing key. A real text that begins with this character gets it once more, so none is taken for it.
NO_VALUE = "\u0000"
BROADCAST_BUDGET = 256 << 20
ROW_OVERHEAD = 96
#: A key is frequent from this share of the rows on: at most so many frequent keys are broadcast for a large column.
HOT_PARTS = 10_000
#: Longer keys meet by their SHA-256 there, so that frequent keys of any length stay small.
LONG_KEY = 1024
CODES_PER_BUCKET = 1_000_000
LITERAL_VALUES = 16
LITERAL_BYTES = 4096
SKETCH_LG_K = 14
#: Joins that Spark may put into one generated method; the JVM interprets methods beyond 8000 bytes, at a fraction of the speed.
JOINS_AT_ONCE = 4
#: More partitions than any table has: ``coalesce`` to so many moves no row, and generated code ends there.
ALL_PARTITIONS = 1 << 20

# An output is an expression over the statistics of a key, whichever way these are reached.
Getter = Callable[[str], Column]
Output = Callable[[Getter], Column]


@dataclass(frozen=True)
class KeySize:
    values: int
    text_bytes: int


@dataclass(frozen=True)
class KeyStats:
    table: DataFrame
    rows: int
    sizes: dict[str, KeySize]
    slots: dict[tuple[str, str], str]
    in_budget: frozenset[str]
    hot_parts: int
    codes: DataFrame | None = None
    coded: frozenset[str] = frozenset()

    literals: dict[str, list[Row]] = field(default_factory=dict)

    def of(self, key: str, outputs: dict[str, Output]) -> DataFrame:
        """(value, n, outputs...) of one key; only that key's part of the table is read."""
        source = self.codes if key in self.coded else self.table
        mine = source.filter(F.col("feature") == key)
        return mine.select("value", F.col("n").alias("_n"), *[o(F.col).alias(n) for n, o in outputs.items()])

    def distinct(self, key: str, other: str) -> Output:
        """Number of distinct ``other`` per ``key``; no number for the missing key."""
        slot = self.slots[key, other]
        return lambda get: F.when(get("value") != NO_VALUE, get(slot))


def stored_text(text: Column) -> Column:
    """The form in which a key's text is counted and looked up; missing ones are ``NO_VALUE``, and only they."""
    marked = F.when(text.startswith(NO_VALUE), F.concat(F.lit(NO_VALUE), text)).otherwise(text)
    return F.coalesce(marked, F.lit(NO_VALUE))


def spelt_text(value: Column) -> Column:
    """The text that ``stored_text`` was made of, the missing one spelt out."""
    plain = F.when(value.startswith(NO_VALUE), F.substring(value, 2, 2**31 - 1)).otherwise(value)
    return F.when(value == NO_VALUE, MISSING_TEXT).otherwise(plain)


def row_count(get: Getter) -> Column:
    """Rows per key; no number for the missing key."""
    return F.when(get("value") != NO_VALUE, get("n"))


def row_count_with_missing(get: Getter) -> Column:
    return get("n")


def class_count(get: Getter) -> Column:
    """Rows of a coded key's class, where the missing value and the text that spells it are one class."""
    return get("class_n")


def code(get: Getter) -> Column:
    return get("code")


def cross_name(left: str, right: str) -> str:
    return f"cross_{left}_and_{right}"


def fit_key_stats(
    df: DataFrame,
    keys: dict[str, Column],
    distinct: Sequence[tuple[str, str]] = (),
    counted: Sequence[str] = (),
    crosses: Sequence[tuple[str, str]] = (),
    coded: Sequence[str] = (),
    broadcast_budget: int = BROADCAST_BUDGET,
    hot_parts: int = HOT_PARTS,
    codes_per_bucket: int = CODES_PER_BUCKET,
    literal_values: int = LITERAL_VALUES,
) -> KeyStats:
    """Collect the statistics of ``df``.

    ``keys`` names the text form of each key column (NULL = missing). ``distinct`` lists (key, other) with the number
    of distinct ``other`` per key; ``counted`` keys get row counts; ``crosses`` count the joined text of two keys;
    ``coded`` keys get dense codes in text order.
    """
    pairs = key_pairs(distinct, counted, crosses, coded)
    return stats_of_pairs(
        count_pairs(df, keys, pairs), pairs, distinct, crosses, coded, broadcast_budget, hot_parts, codes_per_bucket, literal_values
    )


def stats_of_pairs(
    counts: DataFrame,
    pairs: list[tuple[str, str | None]],
    distinct: Sequence[tuple[str, str]] = (),
    crosses: Sequence[tuple[str, str]] = (),
    coded: Sequence[str] = (),
    broadcast_budget: int = BROADCAST_BUDGET,
    hot_parts: int = HOT_PARTS,
    codes_per_bucket: int = CODES_PER_BUCKET,
    literal_values: int = LITERAL_VALUES,
) -> KeyStats:
    """The statistics that counted pairs (pair, a, b, n) add up to; every statistic is a sum over them."""
    slots = _slots(distinct)
    table = _sum_keys(counts, pairs, slots, set(crosses))
    table = materialise(table, "key-counts", "feature")
    sizes, rows = _measure(table)
    codes = None
    if coded:
        codes = materialise(_codes(table, list(coded), sizes, codes_per_bucket), "key-codes", "feature")
    in_budget = _within_budget(sizes, broadcast_budget)
    literals = _literals(table, codes, coded, sizes, literal_values)
    return KeyStats(table, rows, sizes, slots, in_budget, hot_parts, codes, frozenset(coded), literals)


def sketch_keys(df: DataFrame, keys: dict[str, Column], distinct: Sequence[tuple[str, str]], lg_k: int = SKETCH_LG_K) -> DataFrame:
    """(feature, value, n, d0, d1, ...): rows of each key value, and for each (key, other) a sketch of the others seen with it.

    Sketches merge, so tables of several days can be put together by ``merge_sketches``. NULLs are in no sketch.
    """
    slots = _slots(distinct)
    columns = sorted(set(slots.values()))
    view = df.select(*[c.alias(k) for k, c in keys.items()])
    parts = []
    for key in dict.fromkeys(k for k, _ in distinct):
        sketches = {slots[k, o]: F.hll_sketch_agg(o, F.lit(lg_k)) for k, o in distinct if k == key}
        parts.append(
            view.groupBy(stored_text(F.col(key)).alias("value")).agg(
                F.first(F.lit(key)).alias("feature"),
                F.count(F.lit(1)).alias("n"),
                *[sketches.get(c, F.first(F.lit(None).cast("binary"))).alias(c) for c in columns],
            )
        )
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.select("feature", "value", "n", *columns)


def merge_sketches(table: DataFrame) -> DataFrame:
    """Sketches of several tables as one row per key value."""
    columns = [c for c in table.columns if c not in ("feature", "value", "n")]
    merged = [F.hll_union_agg(c, F.lit(True)).alias(c) for c in columns]
    return table.groupBy("feature", "value").agg(F.sum("n").alias("n"), *merged)


def stats_of_sketches(
    sketches: DataFrame,
    distinct: Sequence[tuple[str, str]],
    broadcast_budget: int = BROADCAST_BUDGET,
    hot_parts: int = HOT_PARTS,
) -> KeyStats:
    """Statistics with the distinct counts that the sketches estimate."""
    slots = _slots(distinct)
    estimates = [F.hll_sketch_estimate(c).alias(c) for c in sorted(set(slots.values()))]
    table = materialise(sketches.select("feature", "value", "n", *estimates), "key-sketches", "feature")
    sizes, rows = _measure(table)
    return KeyStats(table, rows, sizes, slots, _within_budget(sizes, broadcast_budget), hot_parts)


def fit_approx_key_stats(
    df: DataFrame,
    keys: dict[str, Column],
    distinct: Sequence[tuple[str, str]],
    broadcast_budget: int = BROADCAST_BUDGET,
    hot_parts: int = HOT_PARTS,
    lg_k: int = SKETCH_LG_K,
) -> KeyStats:
    """Distinct counts from one sketch per key value, so that no pair is stored.

    The standard error of an estimate is about 1.04 / sqrt(2^lg_k): 0.8 % with 14.
    """
    return stats_of_sketches(sketch_keys(df, keys, distinct, lg_k), distinct, broadcast_budget, hot_parts)


def _literals(
    table: DataFrame, codes: DataFrame | None, coded: Sequence[str], sizes: dict[str, KeySize], most: int
) -> dict[str, list[Row]]:
    """Statistics of the keys with at most ``most`` values, frequent values first. They become literals of the plan."""
    small = [k for k, s in sizes.items() if s.values <= most and s.text_bytes <= LITERAL_BYTES]
    plain = [k for k in small if k not in coded]
    rows = table.filter(F.col("feature").isin(plain))
    if codes is not None:
        chosen = codes.filter(F.col("feature").isin([k for k in small if k in coded]))
        rows = rows.unionByName(chosen, allowMissingColumns=True)
    found: dict[str, list[Row]] = {k: [] for k in small}
    for row in rows.collect() if small else []:
        found[row["feature"]].append(row)
    return {k: sorted(v, key=lambda r: -r["n"]) for k, v in found.items()}


def _measure(table: DataFrame) -> tuple[dict[str, KeySize], int]:
    """Values and bytes of each key, and the number of rows; one row per key reaches the driver."""
    facts = (
        table.groupBy("feature")
        .agg(F.count(F.lit(1)).alias("v"), F.sum(F.octet_length("value")).alias("b"), F.sum("n").alias("n"))
        .collect()
    )
    return {r["feature"]: KeySize(r["v"], r["b"]) for r in facts}, max((r["n"] for r in facts), default=0)


def key_pairs(distinct, counted, crosses, coded) -> list[tuple[str, str | None]]:
    """The key pairs to count; a single key rides on a pair that holds it anyway."""
    found: list[tuple[str, str | None]] = []
    for left, right in [*crosses, *distinct]:
        if (left, right) not in found and (right, left) not in found:
            found.append((left, right))
    held = {k for p in found for k in p}
    for key in [*counted, *coded]:
        if key not in held:
            found.append((key, None))
            held.add(key)
    return found


def _slots(distinct: Sequence[tuple[str, str]]) -> dict[tuple[str, str], str]:
    """A generic distinct-count column for each (key, other); the numbering restarts with every key."""
    used: dict[str, int] = {}
    slots = {}
    for key, other in distinct:
        slots[key, other] = f"d{used.get(key, 0)}"
        used[key] = used.get(key, 0) + 1
    return slots


def count_pairs(df: DataFrame, keys: dict[str, Column], pairs: list[tuple[str, str | None]]) -> DataFrame:
    needed = list(dict.fromkeys(k for p in pairs for k in p if k is not None))
    slim = df.select(*[stored_text(keys[k]).alias(k) for k in needed])
    entries = [
        F.struct(
            F.lit(i).alias("pair"),
            F.col(f"`{a}`").alias("a"),
            (F.col(f"`{b}`") if b is not None else F.lit(NO_VALUE)).alias("b"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return slim.select(F.inline(F.array(*entries))).groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def _sum_keys(
    counts: DataFrame,
    pairs: list[tuple[str, str | None]],
    slots: dict[tuple[str, str], str],
    crosses: set[tuple[str, str]],
) -> DataFrame:
    """Sum the pair counts up to one row per (feature, value).

    Each pair feeds several features: its two keys and up to two crosses. Which ones, from which side, and whether the
    pair also supplies their row counts is a small literal array indexed by the pair number.
    """
    columns = sorted(set(slots.values()))
    recipes = F.from_json(
        F.lit(json.dumps(_recipes(pairs, slots, crosses))),
        "array<array<struct<feature: string, side: string, counted: boolean, slot: string>>>",
    )
    fed = counts.select("a", "b", "n", F.inline(F.element_at(recipes, F.col("pair") + 1)))

    def crossed(first: str, second: str) -> Column:
        return stored_text(F.concat(spelt_text(F.col(first)), F.lit("_"), spelt_text(F.col(second))))

    side = F.col("side")
    value = (
        F.when(side == "a", F.col("a"))
        .when(side == "b", F.col("b"))
        .when(side == "ab", crossed("a", "b"))
        .otherwise(crossed("b", "a"))
    )
    other = F.when(side == "a", F.col("b")).otherwise(F.col("a"))
    return (
        fed.select("feature", value.alias("value"), "n", "counted", "slot", (other != NO_VALUE).alias("seen"))
        .groupBy("feature", "value")
        .agg(
            F.sum(F.when(F.col("counted"), F.col("n")).otherwise(0)).alias("n"),
            *[F.count_if(F.col("seen") & (F.col("slot") == c)).alias(c) for c in columns],
        )
    )


def _recipes(
    pairs: list[tuple[str, str | None]], slots: dict[tuple[str, str], str], crosses: set[tuple[str, str]]
) -> list[list[dict]]:
    supplier: dict[str, int] = {}
    for i, pair in enumerate(pairs):
        for key in pair:
            if key is not None:
                supplier.setdefault(key, i)
    recipes = []
    for i, (a, b) in enumerate(pairs):
        steps = []
        for key, other, side in ((a, b, "a"), (b, a, "b")):
            slot, counted = slots.get((key, other)), supplier.get(key) == i
            if slot or counted:
                steps.append({"feature": key, "side": side, "counted": counted, "slot": slot})
        for cross, side in (((a, b), "ab"), ((b, a), "ba")):
            if cross in crosses:
                steps.append({"feature": cross_name(*cross), "side": side, "counted": True, "slot": None})
        recipes.append(steps)
    return recipes


def _within_budget(sizes: dict[str, KeySize], budget: int) -> frozenset[str]:
    """Keys whose statistics fit into the budget together, smallest first."""
    chosen, used = set(), 0
    for key, size in sorted(sizes.items(), key=lambda kv: kv[1].text_bytes + kv[1].values * ROW_OVERHEAD):
        used += size.text_bytes + size.values * ROW_OVERHEAD
        if used > budget:
            break
        chosen.add(key)
    return frozenset(chosen)


def _codes(table: DataFrame, coded: list[str], sizes: dict[str, KeySize], per_bucket: int) -> DataFrame:
    """The statistics of the coded keys with ``code``: 0..k-1 in text order within each key.

    Keys with many values are cut into text ranges first, by Spark's range partitioning; each range is ranked on its own
    and shifted by the number of codes before it, so no task orders more than about ``per_bucket`` values.
    """
    mine = table.filter(F.col("feature").isin(coded)).withColumn("_text", spelt_text(F.col("value")))
    most = max((sizes.get(key, KeySize(0, 0)).values for key in coded), default=0)
    if most > per_bucket:
        ranges = -(-sum(sizes.get(key, KeySize(0, 0)).values for key in coded) // per_bucket)
        # Written with its range, so that every reader sees the same cut. Equal texts never part.
        ranged = mine.repartitionByRange(ranges, "feature", "_text").withColumn("_bucket", F.spark_partition_id())
        mine = materialise(ranged, "key-ranges")
    else:
        mine = mine.withColumn("_bucket", F.lit(0))
    inside = Window.partitionBy("feature", "_bucket").orderBy("_text")
    ranked = mine.withColumn("_rank", F.dense_rank().over(inside).cast("bigint"))
    earlier = Window.partitionBy("feature").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        mine.groupBy("feature", "_bucket")
        .agg(F.count_distinct("_text").alias("_k"))
        .select("feature", "_bucket", F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_shift"))
    )
    # One row per range: a millionth of the values.
    codes = ranked.join(F.broadcast(shifts), ["feature", "_bucket"]).withColumn(
        "code", F.col("_rank") + F.col("_shift") - 1
    )
    same_text = Window.partitionBy("feature", "_bucket", "_text")
    return codes.withColumn("class_n", F.sum("n").over(same_text)).select(*table.columns, "code", "class_n")


class Lookup(NamedTuple):
    """What to bring back for one key; ``text`` is the key's text form over the rows, missing ones spelt NO_VALUE."""

    key: str
    text: Column
    outputs: dict[str, Output]


def attach(df: DataFrame, stats: KeyStats, lookups: Sequence[Lookup]) -> DataFrame:
    """Add the outputs of all lookups to the rows, NULL where a key was not seen.

    A key with a handful of values is looked up in a literal of the plan: no join. The others are left joins whose right
    side is one struct, which keeps the generated code of many joins in a row small.
    """
    large = [x for x in lookups if x.key not in stats.literals and x.key not in stats.in_budget]
    found, texts, outputs = {}, {}, {}
    for i, x in enumerate(lookups):
        if x.key in stats.literals:
            found[f"_found{i}"] = F.try_element_at(_literal_map(stats.literals[x.key]), x.text)
            outputs.update({n: o(_field_of(f"_found{i}")) for n, o in x.outputs.items()})
        elif x.key in stats.in_budget:
            texts[f"_key{i}"] = x.text
            outputs.update({n: F.col(f"_found{i}")[n] for n in x.outputs})
    rows = df.withColumns({**found, **texts}) if found or texts else df
    for done, (i, x) in enumerate((i, x) for i, x in enumerate(lookups) if f"_key{i}" in texts):
        side = stats.of(x.key, x.outputs)
        packed = side.select(F.col("value").alias(f"_key{i}"), F.struct(*x.outputs).alias(f"_found{i}"))
        rows = rows if done % JOINS_AT_ONCE else rows.coalesce(ALL_PARTITIONS)
        rows = rows.join(F.broadcast(packed), f"_key{i}", "left")
    rows = rows.coalesce(ALL_PARTITIONS) if texts else rows
    if outputs:
        rows = rows.withColumns(outputs)
    rows = rows.drop(*[f"_found{i}" for i in range(len(lookups))], *texts)
    rows = _attach_large(rows, large, stats) if large else rows
    return rows.select(*df.columns, *[n for x in lookups for n in x.outputs])


def _field_of(struct: str) -> Getter:
    return lambda name: F.col(struct)[name]


def _literal_map(rows: list[Row]) -> Column:
    fields = [c for c in (rows[0].asDict() if rows else {"value": ""}) if c != "feature"]
    entries = {r["value"]: {c: r[c] for c in fields if r[c] is not None} for r in rows}
    shape = ", ".join(f"{c}: {'string' if c == 'value' else 'bigint'}" for c in fields)
    return F.from_json(F.lit(json.dumps(entries)), f"map<string, struct<{shape}>>")


def _short(key: Column) -> Column:
    """A key, or the SHA-256 of a long one behind a mark that no stored text begins with."""
    return F.when(F.octet_length(key) > LONG_KEY, F.concat(F.lit(NO_VALUE + "s"), F.sha2(key.cast("binary"), 256))).otherwise(key)


class _Side(NamedTuple):
    """Statistics of a key too large to broadcast; ``hot``: those of its frequent values, None if there are none."""

    lookup: Lookup
    hot: DataFrame | None
    cold: DataFrame


def _side(x: Lookup, stats: KeyStats) -> _Side:
    """A value is frequent when it holds at least 1/hot_parts of the rows, so there are at most hot_parts of them."""
    side = stats.of(x.key, x.outputs).withColumn("_key", _short(F.col("value"))).drop("value")
    frequent = F.col("_n") >= stats.rows / stats.hot_parts
    hot, cold = side.filter(frequent).drop("_n"), side.filter(~frequent).drop("_n")
    return _Side(x, None, cold.unionByName(hot)) if hot.isEmpty() else _Side(x, hot, cold)


def _attach_large(rows: DataFrame, large: Sequence[Lookup], stats: KeyStats) -> DataFrame:
    """Join sides too large to broadcast, safe against frequent keys.

    Rows of frequent keys meet a broadcast and are never shuffled, however alike they are; only the others go to the shuffle
    join. Both halves read the rows, so these are written first. Where several keys have frequent values the rows are
    written once; what is carried from key to key is their place and the keys alone, and the outputs come back in one join.
    """
    sides = [_side(x, stats) for x in large]
    skewed = [s for s in sides if s.hot is not None]
    if len(skewed) < 2:
        for s in sides:
            keyed = rows.withColumn("_key", _short(s.lookup.text))
            rows = _looked_up(keyed if s.hot is None else materialise(keyed, "key-rows"), s).drop("_key")
        return rows
    keys = {f"_key{i}": _short(s.lookup.text) for i, s in enumerate(sides)}
    whole = materialise(rows.withColumns(keys), "key-rows")
    place = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    narrow = whole.select(*place, *keys)
    for i, s in enumerate(sides):
        found = _looked_up(narrow.withColumnRenamed(f"_key{i}", "_key"), s).drop("_key")
        narrow = materialise(found, "key-places")
    return whole.select(*rows.columns, *place).join(narrow, ["_file", "_row"]).drop("_file", "_row")


def _looked_up(rows: DataFrame, side: _Side) -> DataFrame:
    """``rows`` (with ``_key``) and the outputs of one side."""
    if side.hot is None:
        return rows.join(side.cold, "_key", "left")
    met = rows.join(F.broadcast(side.hot), "_key")
    rest = rows.join(F.broadcast(side.hot.select("_key")), "_key", "left_anti").join(side.cold, "_key", "left")
    return met.unionByName(rest)
