"""Trees for Newton boosting, grown from histograms of gradients; many models share each scan.

Features are cut into bins once, and a row is kept as one byte per feature. Rows are stored in blocks, feature by feature, so
that a scan hands whole columns to NumPy. For each level of a tree one scan sums gradients, hessians and rows by (node,
feature, bin), Spark adds the tasks' sums, and the best cut of every node is read off running sums over the bins. Features
of few bins are counted together, and the sums of each are read off theirs. Of two siblings only the one with fewer rows is
summed; the other is what remains of the parent.

Gradients and hessians are rounded to whole units before they are summed, so the sums, and with them the trees, do not depend
on how rows are dealt over tasks, on retries or on the engine. The folds of a cross-validation are grown side by side:
each row counts in all models but the one of its own fold. Learners whose features have the same bins share these scans, too.

What reaches the driver is one histogram per open node, as large as features times bins, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from scorekit.shipping import bounded_batches, ship
from scorekit.workspace import materialise, release

#: Units of a gradient or hessian of 1. Sums stay inside 64 bits for 8e11 rows with weights up to 10.
UNIT = 1 << 20
#: Values (rows times features) of the sample that proposes bounds; the ranks at which bins are cut are counted over all rows.
SAMPLE_VALUES = 1 << 20
#: Bounds of a feature that one pass counts at, and values between two of them that one task puts in order.
BOUNDS = 1 << 10
ORDERED_VALUES = 1 << 20
#: Trees are folded into the stored margins after so many rounds.
CUT_EVERY = 5
#: Combinations of bins that a scan counts in; models beyond that are grown in another one.
CELLS_AT_ONCE = 4_000_000
#: Up to so many cells of all tasks together are added up by the driver; beyond that Spark adds them first.
ADDED_HERE = 500_000
#: Rows and bytes of a stored block at most, and rows that a scan sums at once.
BLOCK_ROWS = 1 << 14
BLOCK_BYTES = 1 << 20
CHUNK_ROWS = 1 << 15
#: Blocks of a row group. Spark's reader and writer hold a whole group in memory; by default its size, compressed at that, is
#: looked at every hundred rows only, and a hundred blocks may be more than an executor has.
GROUPS = {"parquet.block.row.count.limit": "8", "parquet.enable.dictionary": "false"}
#: Features are counted together up to so many combinations of their bins.
JOINT_CELLS = 1 << 11
#: Whole numbers below this are exact in doubles.
EXACT = 1 << 53
NO_FOLD = -1


# --- losses -----------------------------------------------------------------------------------------------------------


def _probability(margin: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-margin))


def weighted_log_loss(y: np.ndarray, margin: np.ndarray, pos_weight: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    p, weight = _probability(margin), y * pos_weight + (1 - y)
    return (p - y) * weight, p * (1 - p) * weight


def focal_loss(
    y: np.ndarray, margin: np.ndarray, alpha: float = 0.25, gamma: float = 2.0, eps: float = 1e-15
) -> tuple[np.ndarray, np.ndarray]:
    p = np.clip(_probability(margin), eps, 1 - eps)
    p_true = y * p + (1 - y) * (1 - p)
    scale = (y * alpha + (1 - y) * (1 - alpha)) * np.power(1 - p_true, gamma)
    return scale * (p - y), scale * p * (1 - p) * (gamma * p_true + 1)


def focal_loss_scaled(
    y: np.ndarray, margin: np.ndarray, alpha: float = 0.9, gamma: float = 2.0, curvature: float = 0.1
) -> tuple[np.ndarray, np.ndarray]:
    p = _probability(margin)
    focus = alpha * y * np.power(1 - p, gamma) + (1 - alpha) * (1 - y) * np.power(p, gamma)
    gradient = (p - y) * focus
    return gradient, np.abs(gradient) * curvature


#: The losses of ``functions/losses.py`` that have a gradient and a hessian, for arrays; a test holds both forms equal.
LOSSES = {f.__name__: f for f in (weighted_log_loss, focal_loss, focal_loss_scaled)}


# --- trees ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Growth:
    """Settings of a boosted ensemble."""

    loss: str = "weighted_log_loss"
    loss_params: dict = field(default_factory=dict)
    rounds: int = 10
    step: float = 0.1
    depth: int = 3
    bins: int = 32
    l2: float = 1.0
    start: float = 0.0
    least_rows: int = 1

    def __post_init__(self):
        if self.loss not in LOSSES:
            raise ValueError(f"loss must be one of {sorted(LOSSES)}")
        if not 2 <= self.bins <= 256:
            raise ValueError("bins must be between 2 and 256")

    def derivatives(self, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and hessians in whole units."""
        g, h = LOSSES[self.loss](y, margin, **self.loss_params)
        return np.floor(g * UNIT + 0.5), np.floor(h * UNIT + 0.5)

    def ridge(self, hessian):
        return np.maximum(hessian + self.l2 * UNIT, 1.0)


@dataclass
class Tree:
    """Nodes by number: the root is 1, the children of n are 2n (code at most ``bin``) and 2n + 1. ``feature`` -1: a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def bare(cls, depth: int) -> Tree:
        n = 1 << (depth + 1)
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n))

    def nodes(self, columns: np.ndarray) -> np.ndarray:
        """The node in which each row ends; ``columns`` holds the codes feature by feature."""
        kind = np.uint8 if len(self.feature) <= 256 else np.uint32

        def end(node: int) -> np.ndarray:
            f = self.feature[node]
            if f < 0:
                return kind(node)
            left, right = end(2 * node), end(2 * node + 1)
            # All bits are set where the row goes right.
            mask = (columns[f] > int(self.bin[node])).astype(kind)
            np.negative(mask, out=mask)
            mask &= left ^ right
            mask ^= left
            return mask

        ends = end(1)
        return ends if np.ndim(ends) else np.full(columns.shape[1], ends)

    def as_lists(self) -> list[list]:
        return [x.tolist() for x in (self.feature, self.bin, self.value, self.gain)]

    @classmethod
    def from_lists(cls, lists: list[list]) -> Tree:
        return cls(*[np.array(x) for x in lists])


@dataclass
class Ensemble:
    """Trees over codes; the code of a value is the number of ``edges`` of its feature that lie below it."""

    edges: list[np.ndarray]
    trees: list[Tree]
    start: float

    def columns(self, values: np.ndarray) -> np.ndarray:
        """The codes of values, feature by feature."""
        return np.ascontiguousarray(codes_of(values, self.edges).T)

    def margins(self, values: np.ndarray) -> np.ndarray:
        columns = self.columns(values)
        return add_trees(np.full(columns.shape[1], self.start), self.trees, columns)

    def gains(self) -> np.ndarray:
        """Sum of the gains of all cuts, by feature."""
        total = np.zeros(len(self.edges))
        for tree in self.trees:
            cut = tree.feature >= 0
            np.add.at(total, tree.feature[cut], tree.gain[cut])
        return total


def codes_of(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """One byte per feature."""
    out = np.empty(values.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.searchsorted(e, values[:, f], side="left")
    return out


def add_trees(margin: np.ndarray, trees: Sequence[Tree], columns: np.ndarray, use: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Margins of the rows ``use`` of ``columns`` with the trees added."""
    for tree in trees:
        margin = margin + tree.value.take(tree.nodes(columns)[use])
    return margin


def best_cut(cells: np.ndarray, growth: Growth) -> tuple[float, int, int, np.ndarray] | None:
    """(gain, feature, bin, sums of the left side) of the best cut of a node with ``cells`` (feature, bin, g/h/n).

    Ties go to the first feature, then to the first bin. None if no cut gains anything.
    """
    left = cells.cumsum(axis=1)
    total = left[0, -1]
    left = left[:, :-1]
    right = total - left
    score = lambda s: s[..., 0].astype(np.float64) ** 2 / growth.ridge(s[..., 1].astype(np.float64))
    gain = score(left) + score(right) - score(total)
    allowed = (left[..., 2] >= growth.least_rows) & (right[..., 2] >= growth.least_rows)
    gain = np.where(allowed, gain, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[f, b]), int(f), int(b), left[f, b]) if gain[f, b] > 0 else None


# --- bins -------------------------------------------------------------------------------------------------------------


def fit_edges(rows: DataFrame, column: str, features: int, bins: int, sample_values: int = SAMPLE_VALUES) -> list[np.ndarray]:
    """Edges of at most ``bins`` bins of each feature: the values at ranks i * n // bins, without the greatest value.

    ``column`` holds arrays of doubles. The ranks are those of all rows: about ``sample_values`` values, of rows chosen by their
    hash, only propose bounds. All rows are counted at and between them; a rank that falls on a bound is found, and the values
    between two bounds are put in order, or cut again where they are many. A feature with NaN has no edges.
    """
    n = rows.count()
    if not n:
        return [np.zeros(0) for _ in range(features)]
    ranks = np.unique(np.arange(1, bins) * n // bins)
    found: list[dict[int, int]] = [{} for _ in range(features)]
    bounds, top = _proposed(rows, column, features, min(1.0, sample_values / (n * features))), np.zeros(features, np.int64)
    while bounds:
        counted = _counted(rows, column, bounds)
        few: list[tuple[int, int, int, list[int]]] = []  # feature, open interval of keys, ranks inside
        firsts: list[int] = []
        more: dict[int, list[np.ndarray]] = {}
        for f, (cells, greatest) in counted.items():
            top[f] = greatest
            if greatest == _NAN:
                continue
            own, before = bounds[f], np.cumsum(cells)
            ends = np.concatenate([[_LEAST], own, [_GREATEST]])
            left = np.array([r for r in ranks if r not in found[f]], np.int64)
            at = np.searchsorted(before, left, side="right")
            for cell in np.unique(at):
                inside = left[at == cell]
                if cell % 2:
                    found[f].update(dict.fromkeys(inside.tolist(), int(own[cell // 2])))
                elif cells[cell] <= ORDERED_VALUES:
                    few.append((f, int(ends[cell // 2]), int(ends[cell // 2 + 1]), inside.tolist()))
                    firsts.append(int(before[cell] - cells[cell]))
                else:
                    more.setdefault(f, []).append(_between(int(ends[cell // 2]), int(ends[cell // 2 + 1])))
        for (f, _, _, inside), keys in zip(few, _ordered(rows, column, few, firsts), strict=True):
            found[f].update(zip(inside, keys, strict=True))
        bounds = {f: np.unique(np.concatenate(cuts)) for f, cuts in more.items()}
    at = [np.unique(np.array(list(of.values()), np.int64)) for of in found]
    return [_values_of(keys[keys < greatest]) for keys, greatest in zip(at, top, strict=True)]


#: Keys order doubles as whole numbers; NaN comes last.
_NAN = np.iinfo(np.int64).max
_LEAST, _GREATEST = -_NAN - 1, _NAN


def _keys_of(values: np.ndarray) -> np.ndarray:
    bits = (values + 0.0).view(np.int64)  # one zero only
    keys = bits ^ ((bits >> 63) & _NAN)
    return np.where(np.isnan(values), _NAN, keys)


def _values_of(keys: np.ndarray) -> np.ndarray:
    return (keys ^ ((keys >> 63) & _NAN)).view(np.float64)


def _between(low: int, high: int) -> np.ndarray:
    """Keys that cut the open interval into equal parts, and its ends."""
    parts = min(BOUNDS, high - low)
    return np.array([low + (high - low) * i // parts for i in range(parts + 1)], np.int64)


def _proposed(rows: DataFrame, column: str, features: int, share: float) -> dict[int, np.ndarray]:
    """At most BOUNDS keys of each feature from about ``share`` of the rows, evenly spaced by rank."""
    if share < 1:
        hashed = F.pmod(F.xxhash64(column, F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
        rows = rows.filter(hashed < share)

    def cut(table: pa.Table) -> pa.Table:
        keys = np.sort(_keys_of(table.column("x").to_numpy()))
        bounds = np.unique(keys)
        if len(bounds) > BOUNDS:
            bounds = np.unique(keys[np.arange(BOUNDS) * len(keys) // BOUNDS])
        return pa.table({"f": pa.array([table.column("f")[0].as_py()], pa.int32()), "bounds": pa.array([bounds.tolist()], pa.list_(pa.int64()))})

    single = rows.select(F.posexplode(column).alias("f", "x"))
    found = {r["f"]: np.array(r["bounds"], np.int64) for r in single.groupBy("f").applyInArrow(cut, "f int, bounds array<bigint>").collect()}
    return {f: found.get(f, np.zeros(1, np.int64)) for f in range(features)}


def _counted(rows: DataFrame, column: str, bounds: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, int]]:
    """For each feature the rows below its first bound, at it, between it and the next, ..., and the greatest key."""
    of = list(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, top = [np.zeros(2 * len(bounds[f]) + 1, np.int64) for f in of], [_LEAST] * len(of)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _matrix(batch.column(0), len(batch.column(0)[0]))
            for i, f in enumerate(of):
                own, keys = bounds[f], _keys_of(values[:, f])
                at = np.searchsorted(own, keys)
                cells[i] += np.bincount(2 * at + (own.take(at, mode="clip") == keys), minlength=len(cells[i]))
                top[i] = max(top[i], int(keys.max()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(of, pa.int32()), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array(top, pa.int64())], names=["f", "cells", "top"]
        )

    def add(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("cells"))
        top = pc.max(table.column("top")).as_py()
        return pa.table({"f": table.column("f")[:1].cast(pa.int32()), "cells": pa.array([whole.tobytes()], pa.binary()), "top": pa.array([top], pa.int64())})

    schema = "f int, cells binary, top bigint"
    parts = rows.select(column).mapInArrow(run, schema).groupBy("f").applyInArrow(add, schema).collect()
    return {r["f"]: (np.frombuffer(r["cells"], np.int64), r["top"]) for r in parts}


def _ordered(rows: DataFrame, column: str, few: list[tuple[int, int, int, list[int]]], firsts: list[int]) -> list[list[int]]:
    """The keys at the ranks of each interval. ``few``: feature, open interval of keys, ranks; ``firsts``: rows below each."""
    if not few:
        return []
    of: dict[int, list[int]] = {}
    for slot, (f, *_) in enumerate(few):
        of.setdefault(f, []).append(slot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _matrix(batch.column(0), len(batch.column(0)[0]))
            for f, slots in of.items():
                keys = _keys_of(values[:, f])
                for slot in slots:
                    _, low, high, _ = few[slot]
                    inside, n = np.unique(keys[(keys > low) & (keys < high)], return_counts=True)
                    if len(inside):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), slot, np.int32)), pa.array(inside), pa.array(n)], names=["slot", "key", "n"])

    def pick(table: pa.Table) -> pa.Table:
        slot = table.column("slot")[0].as_py()
        keys, n = table.column("key").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(keys, kind="stable")
        at = np.searchsorted(np.cumsum(n[order]), np.array(few[slot][3]) - firsts[slot], side="right")
        return pa.table({"slot": pa.array([slot], pa.int32()), "keys": pa.array([keys[order][at].tolist()], pa.list_(pa.int64()))})

    counts = rows.select(column).mapInArrow(run, "slot int, key bigint, n bigint")
    found = {r["slot"]: r["keys"] for r in counts.groupBy("slot").applyInArrow(pick, "slot int, keys array<bigint>").collect()}
    return [found[slot] for slot in range(len(few))]


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).reshape(-1, width)


BLOCK = ("n", "y", "weight", "fold", "codes", "margins")
_BLOCK_SCHEMA = "n int, y binary, weight binary, fold binary, codes binary, margins binary"
_KINDS = {"y": np.float64, "weight": np.float64, "fold": np.int32, "codes": np.uint8, "margins": np.float64}


def _block_batch(n: int, **arrays: np.ndarray) -> pa.RecordBatch:
    """One block of rows; ``codes`` (by feature) and ``margins`` (by model) have a row of the array for each."""
    packed = [pa.array([arrays[c].tobytes()], pa.binary()) for c in BLOCK[1:]]
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *packed], names=list(BLOCK))


def _blocks(batches: Iterator[pa.RecordBatch], features: int, models: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(rows, arrays) of each stored block."""
    deep = {"codes": features, "margins": models}
    for batch in batches:
        at = {c: batch.schema.get_field_index(c) for c in BLOCK}
        for i in range(batch.num_rows):
            n = batch.column(at["n"])[i].as_py()
            arrays = {c: np.frombuffer(batch.column(at[c])[i].as_buffer(), kind) for c, kind in _KINDS.items()}
            yield n, arrays | {c: arrays[c].reshape(width, n) for c, width in deep.items()}


def _chunks(batches: Iterator[pa.RecordBatch], features: int, models: int) -> Iterator[dict[str, np.ndarray]]:
    """The arrays of some blocks together: about CHUNK_ROWS rows."""
    waiting, rows = [], 0
    joined = lambda: {c: np.concatenate([x[c] for x in waiting], axis=-1) if len(waiting) > 1 else waiting[0][c] for c in _KINDS}
    for n, arrays in _blocks(batches, features, models):
        if waiting and rows + n > CHUNK_ROWS:
            yield joined()
            waiting, rows = [], 0
        waiting.append(arrays)
        rows += n
    if waiting:
        yield joined()


def code_rows(rows: DataFrame, column: str, edges: list[np.ndarray], models: int, start: float | Sequence[float]) -> DataFrame:
    """Blocks of ``rows`` with codes in place of the array ``column``, and the first margin of each model."""
    width, starts = len(edges), np.broadcast_to(np.asarray(start, float), (models,))
    bytes_of_row = width + sum(np.dtype(_KINDS[c]).itemsize for c in ("y", "weight", "fold")) + 8 * models
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // bytes_of_row))

    def block(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        whole = {c: np.concatenate([x[c] for x in held]) for c in ("y", "weight", "fold", "codes")}
        n = len(whole["y"])
        return _block_batch(n, **whole | {"codes": np.ascontiguousarray(whole["codes"].T), "margins": np.repeat(starts[:, None], n, axis=1)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, most):
                part = batch.slice(first, most)
                arrays = {c: part.column(c).to_numpy(zero_copy_only=False).astype(_KINDS[c]) for c in ("y", "weight", "fold")}
                arrays["codes"] = codes_of(_matrix(part.column(column), width), edges)
                if waiting and size + part.num_rows > most:
                    yield block(waiting)
                    waiting, size = [], 0
                waiting.append(arrays)
                size += part.num_rows
        if waiting:
            yield block(waiting)

    return rows.select("y", "weight", "fold", column).mapInArrow(run, _BLOCK_SCHEMA)


# --- growing ----------------------------------------------------------------------------------------------------------


def grow(rows: DataFrame, column: str, features: int, growth: Growth, models: int = 1, cut_every: int = CUT_EVERY) -> list[Ensemble]:
    """One ensemble per model. ``rows``: y, weight (doubles), fold (int) and ``column``, an array of doubles.

    A row counts in every model but the one numbered as its fold.
    """
    return grow_together(rows, column, features, [growth], models, cut_every)[0]


def grow_together(
    rows: DataFrame, column: str, features: int, growths: Sequence[Growth], folds: int = 1, cut_every: int = CUT_EVERY
) -> list[list[Ensemble]]:
    """What ``grow`` gives for each of ``growths``, all with as many bins, by the same scans."""
    if len({g.bins for g in growths}) != 1:
        raise ValueError("learners that are grown together need the same bins")
    ship(rows.sparkSession)
    bounded_batches(rows.sparkSession)  # one batch of all blocks of a task would be summed only when it is complete
    edges = fit_edges(rows, column, features, growths[0].bins)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    of = [g for g in growths for _ in range(folds)]  # the settings of each model
    starts, rounds = [float(g.start) for g in of], max(g.rounds for g in growths)
    # As many tasks as cores read it: each sends its own sums, however many row groups it has.
    table = materialise(code_rows(rows, column, edges, len(of), starts).repartition(cores), "boost", **GROUPS).coalesce(cores)
    trees: list[list[Tree]] = [[] for _ in of]
    folded = 0  # trees that the stored margins hold
    held = [len(e) + 1 for e in edges]
    cells = sum(math.prod(held[f] for f in own) for own in _joint(held))
    for done in range(rounds):
        since = [t[folded:] for t in trees]
        for chosen in _scans([m for m, g in enumerate(of) if done < g.rounds], of, cells):
            for m, tree in zip(chosen, _grow_trees(table, since, chosen, edges, of, folds), strict=True):
                trees[m].append(tree)
        if (done + 1 - folded) >= cut_every and done + 1 < rounds:
            before, table = table, materialise(_folded(table, [t[folded:] for t in trees], features), "boost", **GROUPS).coalesce(cores)
            release(rows.sparkSession, before)
            folded = done + 1
    release(rows.sparkSession, table)
    ensembles = [Ensemble(edges, t, start) for t, start in zip(trees, starts, strict=True)]
    return [ensembles[first : first + folds] for first in range(0, len(of), folds)]


def _scans(models: list[int], of: list[Growth], cells: int) -> list[list[int]]:
    """The models in groups that stay within CELLS_AT_ONCE, one model at least. ``cells``: what a node is counted in."""
    groups: list[list[int]] = []
    size = 0
    for m in models:
        own = cells << max(0, of[m].depth - 2)  # one node of two siblings is summed
        if not groups or size + own > CELLS_AT_ONCE:
            groups.append([])
            size = 0
        groups[-1].append(m)
        size += own
    return groups


def _folded(table: DataFrame, since: list[list[Tree]], features: int) -> DataFrame:
    """The table with the trees added to its margins."""
    models = len(since)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, arrays in _blocks(batches, features, models):
            added = np.stack([add_trees(arrays["margins"][m], since[m], arrays["codes"]) for m in range(models)])
            yield _block_batch(n, **arrays | {"margins": added})

    return table.mapInArrow(run, _BLOCK_SCHEMA)


def _grow_trees(
    table: DataFrame, since: list[list[Tree]], chosen: list[int], edges: list[np.ndarray], of: list[Growth], folds: int
) -> list[Tree]:
    """One more tree for each chosen model."""
    trees = {m: Tree.bare(of[m].depth) for m in chosen}
    cells: dict[tuple[int, int], np.ndarray] = {}
    open_ = [(m, 1, None) for m in chosen]  # model, node to sum, its sibling
    for level_done in range(1, max(of[m].depth for m in chosen) + 1):
        if not open_:
            break
        summed = _sums(table, since, trees, [(m, node) for m, node, _ in open_], [len(e) + 1 for e in edges], of, folds)
        level = {}
        for (m, node, sibling), found in zip(open_, summed, strict=True):
            level[m, node] = found
            if sibling is not None:
                level[m, sibling] = cells[m, node // 2] - found
        cells, open_ = level, []
        for (m, node), found in level.items():
            tree, growth, total = trees[m], of[m], found[0].sum(axis=0)
            cut = best_cut(found, growth)
            if node == 1:
                tree.value[1] = _leaf(total, growth)
            if cut is None:
                continue
            tree.gain[node], tree.feature[node], tree.bin[node], left = cut
            tree.value[2 * node], tree.value[2 * node + 1] = _leaf(left, growth), _leaf(total - left, growth)
            if level_done < growth.depth:
                small = 2 * node if 2 * left[2] <= total[2] else 2 * node + 1
                open_.append((m, small, small ^ 1))
    return [trees[m] for m in chosen]


def _leaf(sums: np.ndarray, growth: Growth) -> float:
    return float(-growth.step * float(sums[0]) / growth.ridge(float(sums[1])))


def _sums(
    table: DataFrame,
    since: list[list[Tree]],
    trees: dict[int, Tree],
    wanted: list[tuple[int, int]],
    held: list[int],
    of: list[Growth],
    folds: int,
) -> list[np.ndarray]:
    """Sums of gradient, hessian and rows by (feature, bin) for each wanted (model, node), in one scan.

    ``held``: how many bins of each feature hold values. ``of``: the settings of each model; models of a learner follow each
    other, one for each of ``folds``.
    """
    models, features, bins, tasks = len(since), len(held), of[0].bins, table.sparkSession.sparkContext.defaultParallelism
    joint = _joint(held)
    slots: dict[int, np.ndarray] = {}
    for slot, (m, node) in enumerate(wanted):
        slots.setdefault(m, np.full(2 << of[m].depth, -1))[node] = slot
    shape = (len(wanted), features, bins, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _no_cells(joint, held, len(wanted))
        for chunk in _chunks(batches, features, models):
            columns, y, weight, fold = (chunk[c] for c in ("codes", "y", "weight", "fold"))
            counted = [_numbers(columns, own, held) for own in joint]
            weighted = not (weight == 1).all()
            for m, slot_of in slots.items():
                low, high = slot_of[slot_of >= 0].min(), slot_of.max() + 1
                slot = slot_of.take(trees[m].nodes(columns))
                use = np.flatnonzero((slot >= 0) & (fold != m % folds))
                g, h = of[m].derivatives(y.take(use), add_trees(chunk["margins"][m].take(use), since[m], columns, use))
                if weighted:
                    g, h = np.floor(g * weight[use] + 0.5), np.floor(h * weight[use] + 0.5)
                _count([cells[:, low:high] for cells in kept], counted, slot.take(use) - low, use, g, h)
        total = np.zeros(shape, np.int64)
        _spread(total, kept, joint, held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], names=["slot", "cells"]
        )

    def add(rows: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("cells"))
        return pa.table({"slot": rows.column("slot")[:1].cast(pa.int32()), "cells": pa.array([whole.tobytes()], pa.binary())})

    parts = table.mapInArrow(run, "slot int, cells binary")
    if tasks * math.prod(shape[:3]) > ADDED_HERE:
        parts = parts.groupBy("slot").applyInArrow(add, "slot int, cells binary")
    found = parts.toArrow()
    out = np.zeros(shape, np.int64)
    for slot, cells in zip(found["slot"].to_pylist(), found["cells"], strict=True):
        out[slot] += np.frombuffer(cells.as_buffer(), np.int64).reshape(shape[1:])
    return list(out)


def _joint(held: list[int]) -> list[list[int]]:
    """The features in groups that are counted together; their bins, multiplied, stay within JOINT_CELLS."""
    groups: list[tuple[int, list[int]]] = []
    for f in sorted(range(len(held)), key=lambda f: -held[f]):
        for n, (cells, own) in enumerate(groups):
            if cells * held[f] <= JOINT_CELLS:
                groups[n] = (cells * held[f], [*own, f])
                break
        else:
            groups.append((held[f], [f]))
    return [own for _, own in groups]


def _numbers(columns: np.ndarray, own: list[int], held: list[int]) -> np.ndarray:
    """The combination of bins of the features ``own`` in each row, as one number."""
    at = columns[own[0]].astype(np.int64)
    for f in own[1:]:
        at *= held[f]
        at += columns[f]
    return at


def _no_cells(joint: list[list[int]], held: list[int], slots: int) -> list[np.ndarray]:
    """Sums by (g/h/n, slot, combination of bins) for each group of features."""
    return [np.zeros((3, slots, math.prod(held[f] for f in own)), np.int64) for own in joint]


def _add_cells(
    total: np.ndarray, counted: list[tuple[list[int], np.ndarray]], held: list[int], slot: np.ndarray, use: np.ndarray, g: np.ndarray, h: np.ndarray
) -> None:
    """Add gradients, hessians and rows of the rows ``use`` to ``total`` (slot, feature, bin, g/h/n)."""
    joint = [own for own, _ in counted]
    kept = _no_cells(joint, held, len(total))
    _count(kept, [at for _, at in counted], slot, use, g, h)
    _spread(total, kept, joint, held)


def _count(kept: list[np.ndarray], counted: list[np.ndarray], slot: np.ndarray, use: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
    """Add gradients, hessians and rows of the rows ``use`` to the combinations ``counted`` of each group of features."""
    n, slots = len(use), kept[0].shape[1]
    if not n:
        return
    # A hessian and a row of 1 are summed as one number, where both sums fit a double.
    bits = n.bit_length()
    together = h.min() >= 0 and float(h.max()) * n * (1 << bits) + n < EXACT
    sums = [g, h * (1 << bits) + 1] if together else [g, h, np.ones(n)]
    rows = len(counted[0])
    spread = slots == 1 and 2 * n > rows
    if spread:  # most rows count: the others count 0, and none are picked out
        for i, x in enumerate(sums):
            sums[i] = np.zeros(rows)
            sums[i][use] = x
    for cells, at in zip(kept, counted, strict=True):
        size = cells.shape[2]
        if not spread:
            at = at.take(use)
            if slots > 1:
                at += slot * size
        found = [np.bincount(at, x, slots * size).reshape(slots, size).astype(np.int64) for x in sums]
        if together:
            found = [found[0], found[1] >> bits, found[1] & ((1 << bits) - 1)]
        for k, x in enumerate(found):
            cells[k] += x


def _spread(total: np.ndarray, kept: list[np.ndarray], joint: list[list[int]], held: list[int]) -> None:
    """Add what was counted by combinations to ``total`` (slot, feature, bin, g/h/n)."""
    for own, cells in zip(joint, kept, strict=True):
        by = cells.reshape(*cells.shape[:2], *[held[f] for f in own])
        for i, f in enumerate(own):
            others = tuple(k + 2 for k in range(len(own)) if k != i)
            total[:, f, : held[f]] += np.moveaxis(by.sum(axis=others), 0, -1)
