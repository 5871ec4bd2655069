"""Exact order statistics without sorting the table and without one task holding a column.

The built-in exact ``percentile`` keeps every distinct value of a column in one aggregation buffer. Here a mergeable
sketch proposes an interval around each wanted rank, one counting pass proves how many values lie below and inside it,
and the step repeats inside the interval until few values are left. Only those are grouped and ordered. All columns
and ranks share the passes, nothing but counts and interval ends reaches the driver, and the counts make the result
exact however rough the sketch was. Sketches compute in doubles; where they do not narrow an interval, integers are cut
by value in their own type, which ends because the values inside an interval grow closer with every round.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

SKETCH_ACCURACY = 10_000
SMALL_ENOUGH = 100_000
#: An interval of integers is cut by value into so many pieces in one pass.
PIECES = 16
#: Doubles hold integers up to this size; the ends of longs.
EXACT_IN_DOUBLE = 2**53
LEAST_LONG, GREATEST_LONG = -(2**63), 2**63 - 1

# Values by (column, rank).
_Found = dict[tuple[str, int], object]


@dataclass(frozen=True)
class _Interval:
    """Ranks of one column whose values lie strictly between ``low`` and ``high`` (None: no limit).

    ``below`` values come before the interval, ``size`` are inside. A ``stubborn`` interval is one that sketches around its
    ranks did not narrow; it is halved by value instead, which always ends.
    """

    name: str
    ranks: tuple[int, ...]
    below: int
    size: int
    low: object = None
    high: object = None
    stubborn: bool = False

    def inside(self, col: Column) -> Column:
        inside = col
        if self.low is not None and not _beyond_long(self.low):
            inside = F.when(col > F.lit(self.low), inside)
        return inside if self.high is None or _beyond_long(self.high) else F.when(col < F.lit(self.high), inside)


def _beyond_long(end: object) -> bool:
    """Whether an end lies next to the range of longs, where it shuts nothing out."""
    return isinstance(end, int) and not LEAST_LONG <= end <= GREATEST_LONG


def _usable(df: DataFrame, columns: dict[str, Column]) -> tuple[DataFrame, dict[str, T.DataType]]:
    """Project to the wanted columns, with NaN as NULL and decimals as doubles."""
    view = df.select(*[c.alias(n) for n, c in columns.items()])
    kinds = {f.name: f.dataType for f in view.schema.fields}
    fixed = []
    for name, kind in kinds.items():
        col = F.col(f"`{name}`")
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            col = F.when(~F.isnan(col), col)
        elif isinstance(kind, T.DecimalType):
            col = col.cast("double")
        fixed.append(col.alias(name))
    return view.select(*fixed), kinds


def count_values(df: DataFrame, columns: dict[str, Column]) -> dict[str, int]:
    """Number of values (neither NULL nor NaN) of each column, in one pass."""
    view, _ = _usable(df, columns)
    row = view.agg(*[F.count(F.col(f"`{n}`")).alias(n) for n in columns]).first()
    return {n: row[n] for n in columns}


def values_at_ranks(
    df: DataFrame,
    columns: dict[str, Column],
    ranks: dict[str, Sequence[int]],
    counts: dict[str, int],
    small_enough: int = SMALL_ENOUGH,
) -> dict[str, dict[int, object]]:
    """The value at each 0-based ascending rank of each column. ``counts`` are those of :func:`count_values`."""
    view, _ = _usable(df, columns)
    intervals = [
        _Interval(name, tuple(sorted(set(wanted))), 0, counts[name])
        for name, wanted in ranks.items()
        if wanted and counts[name]
    ]
    return _settle(view, intervals, small_enough)


def _settle(
    view: DataFrame, intervals: list[_Interval], small_enough: int, known: _Found | None = None
) -> dict[str, dict[int, object]]:
    result: dict[str, dict[int, object]] = defaultdict(dict)
    _note(result, known)
    while wide := [i for i in intervals if i.size > small_enough]:
        intervals = [i for i in intervals if i.size <= small_enough]
        for step, chosen in ((_sketch, [i for i in wide if not i.stubborn]), (_halve, [i for i in wide if i.stubborn])):
            if chosen:
                narrowed, known = step(view, chosen)
                _note(result, known)
                intervals += narrowed
    _note(result, _pick(view, intervals))
    return result


def _note(result: dict[str, dict[int, object]], found: _Found | None) -> None:
    for (name, rank), value in (found or {}).items():
        result[name][rank] = value


def _sketch(view: DataFrame, wide: list[_Interval]) -> tuple[list[_Interval], _Found]:
    return _prove(view, _propose(view, wide))


def _halve(view: DataFrame, wide: list[_Interval]) -> tuple[list[_Interval], _Found]:
    """Cut every interval by value: integers into pieces of their range, other numbers at about their median."""
    whole = [i for i in wide if isinstance(view.schema[i.name].dataType, T.IntegralType)]
    narrowed, found = [], {}
    for step, chosen in ((_cut_integers, whole), (_cut_at_median, [i for i in wide if i not in whole])):
        if chosen:
            pieces, known = step(view, chosen)
            narrowed += pieces
            found |= known
    return narrowed, found


def _smaller(piece: _Interval, of: _Interval) -> _Interval:
    """``piece``, which has to hold fewer values than ``of`` or a smaller range of them."""
    ends = (piece.low, piece.high, of.low, of.high)
    if piece.size < of.size or (None not in ends and piece.high - piece.low < of.high - of.low):
        return piece
    raise ArithmeticError(f"{of} was not narrowed")


def _cut_integers(view: DataFrame, wide: list[_Interval]) -> tuple[list[_Interval], _Found]:
    """Cut the range of values inside every interval into ``PIECES`` equal parts, in integer arithmetic.

    Each part is counted together with its least and greatest value, which are the ends of the next range; so a range is
    a sixteenth of the one before at most, and a part of one value is an answer.
    """
    wide = _with_ends(view, wide)
    cuts, tests = [], []
    for n, i in enumerate(wide):
        least, span = i.low + 1, i.high - i.low - 1
        pieces = min(PIECES, span)
        cuts.append([least + span * k // pieces for k in range(pieces + 1)])
        for k in range(pieces):
            x = F.col(f"`{i.name}`")
            x = F.when((x >= F.lit(cuts[n][k])) & (x <= F.lit(cuts[n][k + 1] - 1)), x)
            tests += [F.count(x).alias(f"n{n}_{k}"), F.min(x).alias(f"min{n}_{k}"), F.max(x).alias(f"max{n}_{k}")]
    facts = view.agg(*tests).first()
    narrowed, found = [], {}
    for n, i in enumerate(wide):
        below = i.below
        for k in range(len(cuts[n]) - 1):
            size, least, greatest = (facts[f"{fact}{n}_{k}"] for fact in ("n", "min", "max"))
            ranks = tuple(r for r in i.ranks if below <= r < below + size)
            if ranks and least == greatest:
                found.update({(i.name, r): least for r in ranks})
            elif ranks:
                piece = replace(i, ranks=ranks, below=below, size=size, low=least - 1, high=greatest + 1)
                narrowed.append(_smaller(piece, i))
            below += size
    return narrowed, found


def _with_ends(view: DataFrame, wide: list[_Interval]) -> list[_Interval]:
    """The intervals with both ends: next to the least and the greatest value inside, where there is none yet."""
    open_ = [i for i in wide if i.low is None or i.high is None]
    if not open_:
        return wide
    inside = [i.inside(F.col(f"`{i.name}`")) for i in open_]
    ends = view.agg(*[f(x).alias(f"{f.__name__}{n}") for n, x in enumerate(inside) for f in (F.min, F.max)]).first()
    closed = [replace(i, low=ends[f"min{n}"] - 1, high=ends[f"max{n}"] + 1) for n, i in enumerate(open_)]
    return [i for i in wide if i not in open_] + closed


def _cut_at_median(view: DataFrame, wide: list[_Interval]) -> tuple[list[_Interval], _Found]:
    """Cut every interval at about its median, a value of the column that lies in neither half."""
    inside = [i.inside(F.col(f"`{i.name}`")) for i in wide]
    cuts = view.agg(*[F.percentile_approx(x, 0.5, SKETCH_ACCURACY).alias(f"c{n}") for n, x in enumerate(inside)]).first()
    tests = []
    for n, x in enumerate(inside):
        tests += [F.count_if(x < F.lit(cuts[n])).alias(f"less{n}"), F.count_if(x == F.lit(cuts[n])).alias(f"same{n}")]
    counts = view.agg(*tests).first()
    narrowed, found = [], {}
    for n, i in enumerate(wide):
        less, same = counts[f"less{n}"], counts[f"same{n}"]
        first, after = i.below + less, i.below + less + same
        lower, upper = (tuple(r for r in i.ranks if test(r)) for test in (lambda r: r < first, lambda r: r >= after))
        found.update({(i.name, r): cuts[n] for r in i.ranks if first <= r < after})
        if lower:
            narrowed.append(_smaller(replace(i, ranks=lower, high=cuts[n], size=less), i))
        if upper:
            narrowed.append(_smaller(replace(i, ranks=upper, low=cuts[n], below=after, size=i.size - less - same), i))
    return narrowed, found


def _around(share: float) -> list[float]:
    slack = 2.0 / SKETCH_ACCURACY
    return [max(share - slack, 0.0), min(share + slack, 1.0)]


def _ends(low: object, high: object) -> dict[str, object]:
    """Ends of a proposal. Integers that the sketch has rounded are moved outward by what rounding may have cost."""
    if isinstance(low, int) and abs(low) >= EXACT_IN_DOUBLE:
        low = max(low - int(math.ulp(float(low))), LEAST_LONG)
    if isinstance(high, int) and abs(high) >= EXACT_IN_DOUBLE:
        high = min(high + int(math.ulp(float(high))), GREATEST_LONG)
    return {"low": low, "high": high}


def _propose(view: DataFrame, wide: list[_Interval]) -> list[tuple[_Interval, _Interval]]:
    """A sketched sub-interval around every rank, paired with the interval it was taken from."""
    sketches = []
    for n, i in enumerate(wide):
        shares = [s for rank in i.ranks for s in _around((rank - i.below) / i.size)]
        sketches.append(F.percentile_approx(i.inside(F.col(f"`{i.name}`")), shares, SKETCH_ACCURACY).alias(f"s{n}"))
    ends = view.agg(*sketches).first()
    return [
        (i, replace(i, ranks=(rank,), **_ends(ends[n][2 * k], ends[n][2 * k + 1])))
        for n, i in enumerate(wide)
        for k, rank in enumerate(i.ranks)
    ]


def _prove(view: DataFrame, proposals: list[tuple[_Interval, _Interval]]) -> tuple[list[_Interval], _Found]:
    """Count below, at the ends of and inside every proposed interval.

    A rank that falls on an end is answered; an end that a large part of the rows share thus never stays in an interval.
    A proposal that misses its rank gives way to the interval it came from.
    """
    distinct = list(dict.fromkeys((c.name, c.low, c.high) for _, c in proposals))
    tests = []
    for n, (name, low, high) in enumerate(distinct):
        col, lo, hi = F.col(f"`{name}`"), F.lit(low), F.lit(high)
        tests += [
            F.count_if(col < lo).alias(f"below{n}"),
            F.count_if(col == lo).alias(f"low{n}"),
            F.count_if((col > lo) & (col < hi)).alias(f"mid{n}"),
            F.count_if((col == hi) & (hi > lo)).alias(f"high{n}"),
        ]
    proof = view.agg(*tests).first()

    found: _Found = {}
    merged: dict[tuple, _Interval] = {}
    for parent, c in proposals:
        n, rank = distinct.index((c.name, c.low, c.high)), c.ranks[0]
        start = proof[f"below{n}"]
        inner = start + proof[f"low{n}"]
        after = inner + proof[f"mid{n}"]
        if start <= rank < inner:
            found[c.name, rank] = c.low
            continue
        if after <= rank < after + proof[f"high{n}"]:
            found[c.name, rank] = c.high
            continue
        if inner <= rank < after:
            kept = replace(c, below=inner, size=after - inner, stubborn=after - inner > parent.size // 2)
        else:
            kept = replace(parent, ranks=c.ranks, stubborn=True)
        key = (kept.name, kept.low, kept.high)
        if key in merged:
            kept = replace(kept, ranks=tuple(sorted({*merged[key].ranks, *kept.ranks})))
        merged[key] = kept
    return list(merged.values()), found


def _pick(view: DataFrame, intervals: list[_Interval]) -> _Found:
    """Order the few values left and read off the ranks. Equal values are counted before anything is ordered."""
    by_type: dict[str, list[_Interval]] = defaultdict(list)
    for i in intervals:
        by_type[view.schema[i.name].dataType.simpleString()].append(i)
    found: _Found = {}
    for group in by_type.values():
        entries = [
            F.struct(F.lit(n).alias("part"), i.inside(F.col(f"`{i.name}`")).alias("value"))
            for n, i in enumerate(group)
        ]
        runs = (
            view.select(F.inline(F.array(*entries)))
            .filter("value is not null")
            .groupBy("part", "value")
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy("value")))
        )
        wanted = [(n, i, r) for n, i in enumerate(group) for r in i.ranks]
        row = runs.agg(
            *[
                F.min(F.when((F.col("part") == n) & (F.col("upto") > r - i.below), F.col("value"))).alias(f"v{k}")
                for k, (n, i, r) in enumerate(wanted)
            ]
        ).first()
        found.update({(i.name, r): row[f"v{k}"] for k, (_, i, r) in enumerate(wanted)})
    return found


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probs: Sequence[float],
    small_enough: int = SMALL_ENOUGH,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between neighbours; a column without values gives ``None``.

    The first pass counts and sketches together, since the shares of the wanted ranks are known before the count is.
    """
    view, _ = _usable(df, columns)
    shares = [s for p in probs for s in _around(p)]
    first = []
    for n, name in enumerate(columns):
        col = F.col(f"`{name}`")
        first += [F.count(col).alias(f"n{n}"), F.percentile_approx(col, shares, SKETCH_ACCURACY).alias(f"s{n}")]
    facts = view.agg(*first).first()

    places: dict[str, list[tuple[int, int, float]]] = {}
    settled, proposals = [], []
    for n, name in enumerate(columns):
        count = facts[f"n{n}"]
        if not count:
            continue
        places[name] = [_place(p, count) for p in probs]
        whole = _Interval(name, tuple(sorted({r for lo, hi, _ in places[name] for r in (lo, hi)})), 0, count)
        if whole.size <= small_enough:
            settled.append(whole)
            continue
        for k, (lo, hi, _) in enumerate(places[name]):
            ends = _ends(facts[f"s{n}"][2 * k], facts[f"s{n}"][2 * k + 1])
            proposals += [(whole, replace(whole, ranks=(rank,), **ends)) for rank in {lo, hi}]
    narrowed, known = _prove(view, proposals) if proposals else ([], None)
    values = _settle(view, settled + narrowed, small_enough, known)
    return {
        name: [_between(values[name], place) for place in places[name]] if name in places else [None] * len(probs)
        for name in columns
    }


def _place(prob: float, count: int) -> tuple[int, int, float]:
    """The two neighbouring ranks of a quantile and the weight of the upper one."""
    at = prob * (count - 1)
    return int(at), min(int(at) + 1, count - 1), at - int(at)


def _between(values: dict[int, object], place: tuple[int, int, float]) -> float:
    low, high, weight = place
    if weight == 0:
        return float(values[low])
    return float(values[low]) + (float(values[high]) - float(values[low])) * weight


def approximate_quantiles(
    df: DataFrame, columns: dict[str, Column], probs: Sequence[float], accuracy: int = SKETCH_ACCURACY
) -> dict[str, list[float | None]]:
    """Quantiles from one mergeable sketch per column: one pass, rank error at most ``1/accuracy``."""
    view, _ = _usable(df, columns)
    row = view.agg(*[F.percentile_approx(F.col(f"`{n}`"), list(probs), accuracy).alias(n) for n in columns]).first()
    return {n: [float(v) for v in row[n]] if row[n] is not None else [None] * len(probs) for n in columns}
