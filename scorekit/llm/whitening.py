"""Embedding whitening with exact integer statistics (operator 12).

Vectors are quantised to whole numbers. Of equal ones a single copy enters the fit list; their sums and, after centring, their
scatter are summed as integers of any size, so neither the order of rows nor the number of tasks changes a digit. The
scatter's characteristic polynomial is exact (``char_poly``), its largest roots are isolated far beyond double precision,
and inverse iteration gives their vectors, even where two roots are very near. Each row is then projected in one pass.

What passes through the driver has the size of the scatter: dimension squared, whatever the number of rows. Time grows with
the fourth power of the dimension there, and primes are dealt over tasks; tens to a few hundred dimensions are meant.

Defined results. NULL vectors, empty ones, and those with NULL or non-finite entries: no rows. Of vectors of several lengths
those of the length that most different vectors have take part (the greater one on ties). Entries beyond a long are cut to its ends.
NULL id and repeated rows: a row like any other, its vector fitted once. Components with eigenvalue 0 (a single vector, fewer
directions than components) cannot be scaled and have no rows. Equal eigenvalues: any orthonormal vectors of their
space. ``deviation`` beyond 38 digits: NULL. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorekit.llm import char_poly
from scorekit.llm.arrow import bounded_batches
from scorekit.workspace import materialise

#: One unit of a vector in quantised units.
SCALE = 256
COMPONENTS = 4

#: Numbers are multiplied in limbs of so many bits, so many rows at a time: sums of products stay exact in doubles.
LIMB_BITS, LIMB_ROWS = 20, 1 << 13
LIMBS = 4
#: Sums travel in parts of so many bits.
PART_BITS, PARTS = 48, 4

_WIDTHS = (np.int16, np.int32, np.int64)


@dataclass(frozen=True)
class Whitening:
    """``vectors``: one unit component per row. ``roots``: eigenvalues of n * n * covariance; ``trace``: their sum."""

    n: int
    dimension: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    roots: tuple[Fraction, ...]
    trace: int

    @property
    def explained(self) -> list[float]:
        return [float(r / self.trace) for r in self.roots]

    @property
    def deviations(self) -> np.ndarray:
        """Square roots of the eigenvalues of the covariance."""
        with localcontext(prec=50):
            return np.array([float((Decimal(r.numerator) / r.denominator).sqrt() / self.n) for r in self.roots])


# --- quantised vectors ------------------------------------------------------------------------------------------------


def quantised(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the usable vectors of a list column, and those vectors in whole units."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(pc.list_flatten(vectors).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    usable = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    with np.errstate(over="ignore", invalid="ignore"):
        units = np.floor(values * SCALE)
        cut = np.clip(np.where(np.isnan(units), 0, units), -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    cut[units >= 2.0**63] = 2**63 - 1
    at = np.flatnonzero(usable)
    return at, [cut[ends[i] - sizes[i] : ends[i]] for i in at]


def _packed(vector: np.ndarray) -> bytes:
    """A vector in the narrowest whole numbers that hold it; equal vectors are equal bytes."""
    least, most = int(vector.min()), int(vector.max())
    kind = next(w for w in _WIDTHS if np.iinfo(w).min <= least and most <= np.iinfo(w).max)
    return bytes([np.dtype(kind).itemsize]) + vector.astype(f"<i{np.dtype(kind).itemsize}").tobytes()


def _unpacked(column: pa.Array, dimension: int) -> np.ndarray:
    rows = [np.frombuffer(v, f"<i{v[0]}", offset=1) for v in column.to_pylist()]
    return np.array(rows, np.int64) if rows else np.zeros((0, dimension), np.int64)


def _fit_list(table: DataFrame, vector: str) -> DataFrame:
    """(size, packed): each different usable vector once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, found = quantised(batch.column(0))
            columns = [pa.array([len(v) for v in found], pa.int32()), pa.array([_packed(v) for v in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["size", "packed"])

    return table.select(F.col(f"`{vector}`").alias("v")).mapInArrow(run, "size int, packed binary").distinct()


# --- exact sums -------------------------------------------------------------------------------------------------------


def _parts(value: int) -> list[int]:
    """A whole number in parts whose sums cannot leave 64 bits; the last one carries the sign."""
    low = [(value >> (PART_BITS * k)) & ((1 << PART_BITS) - 1) for k in range(PARTS - 1)]
    return [*low, value >> (PART_BITS * (PARTS - 1))]


def _summed(fit: DataFrame, add: Callable[[np.ndarray], np.ndarray], dimension: int) -> dict[int, int]:
    """Sums over all rows of what ``add`` makes of a block of vectors: Python integers by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            found = add(_unpacked(batch.column(0), dimension)) if batch.num_rows else None
            total = found if total is None else total + found if found is not None else total
        if total is not None:
            rows = [_parts(int(x)) for x in total.reshape(-1)]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(PARTS)]
            names = ["at", *[f"p{k}" for k in range(PARTS)]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), *columns], names=names)

    schema = "at int, " + ", ".join(f"p{k} long" for k in range(PARTS))
    sums = [F.sum(F.col(f"p{k}").cast("decimal(38,0)")).alias(f"p{k}") for k in range(PARTS)]
    rows = fit.select("packed").mapInArrow(run, schema).groupBy("at").agg(*sums).collect()
    return {r["at"]: sum(int(r[f"p{k}"]) << (PART_BITS * k) for k in range(PARTS)) for r in rows}


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as doubles of LIMB_BITS bits, the last one with the sign."""
    mask = (1 << LIMB_BITS) - 1
    return [((x >> (LIMB_BITS * k)) & mask).astype(np.float64) for k in range(LIMBS - 1)] + [
        (x >> (LIMB_BITS * (LIMBS - 1))).astype(np.float64)
    ]


def column_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the columns, as Python integers."""
    low = (x & 0xFFFFFFFF).sum(axis=0).astype(object)
    return low + (x >> 32).sum(axis=0).astype(object) * 2**32


def scatter(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Sum of (x - centre)(x - centre)' over the rows of ``x``, as Python integers. Both hold 64-bit integers."""
    total = np.zeros((x.shape[1],) * 2, object)
    reach = max(abs(int(x.max()) - int(centre.min())), abs(int(x.min()) - int(centre.max()))) if len(x) else 0
    for start in range(0, len(x), LIMB_ROWS):
        block = x[start : start + LIMB_ROWS]
        if reach < 1 << LIMB_BITS:
            near = (block - centre).astype(np.float64)
            total = total + (near.T @ near).astype(np.int64).astype(object)
            continue
        # Differences limb by limb: none leaves 64 bits, however far apart the numbers are.
        limbs = [a - b for a, b in zip(_limbs(block), _limbs(centre), strict=True)]
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total = total + ((a.T @ b).astype(np.int64).astype(object) << (LIMB_BITS * (i + j)))
    return total


# --- fitting and applying ---------------------------------------------------------------------------------------------


def fit(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the different vectors of ``table`` (None without any), and these vectors, packed."""
    bounded_batches(table.sparkSession)
    every = materialise(_fit_list(table, vector), "whitening-fit")
    sizes = every.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).head()
    if sizes is None:
        return None, every
    d, n = sizes["size"], sizes["n"]
    used = every.filter(F.col("size") == d)
    sums = _summed(used, column_sums, d)
    sums = [sums[i] for i in range(d)]
    centre = [s // n for s in sums]
    about = np.array(centre, np.int64)
    found = _summed(used, lambda x: scatter(x, about), d)
    # n * n * covariance, from the sums of the centred vectors.
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    matrix = [[n * found[i * d + j] - rest[i] * rest[j] for j in range(d)] for i in range(d)]
    trace = sum(matrix[i][i] for i in range(d))
    roots = char_poly.largest_roots(char_poly.characteristic(table.sparkSession, matrix), components) if trace else []
    vectors = [v for r in roots for v in char_poly.null_space(matrix, r)][:components]
    values = [r.middle for r in roots for _ in range(r.times)][:components]
    return Whitening(n, d, tuple(sums), np.array(vectors).reshape(-1, d), tuple(values), trace), used


def _projected(model: Whitening, x: np.ndarray) -> np.ndarray:
    """(x - mean) on each component, in its standard deviations. ``x``: whole units, one vector per row."""
    whole = [s // model.n for s in model.sums]
    rest = [float(Fraction(s - model.n * w, model.n)) for s, w in zip(model.sums, whole, strict=True)]
    about = np.array(whole, np.int64)
    if len(x) and max(abs(int(x.max())), abs(int(x.min())), *map(abs, whole)) >= 1 << 62:
        near = (x.astype(object) - about.astype(object)).astype(np.float64)
    else:
        near = (x - about).astype(np.float64)
    return (near - np.array(rest)) @ model.vectors.T / model.deviations


def _deviations(model: Whitening, x: np.ndarray) -> list[int]:
    """Sum over the dimensions of (n * x - S)^2 of each row, exactly."""
    n = model.n
    whole = np.array([s // n for s in model.sums], np.int64)
    rest = [s - n * int(w) for s, w in zip(model.sums, whole, strict=True)]
    most = max(abs(int(x.max()) - int(whole.min())), abs(int(x.min()) - int(whole.max()))) if len(x) else 0
    if model.dimension * most * max(most, n) < 1 << 62:
        near = x - whole
        squares, along = (near * near).sum(axis=1).astype(object), (near @ np.array(rest, np.int64)).astype(object)
    else:
        near = x.astype(object) - whole.astype(object)
        squares, along = (near * near).sum(axis=1), near @ np.array(rest, object)
    return list(n * n * squares - 2 * n * along + sum(r * r for r in rest))


def identity_error(model: Whitening, fitted: DataFrame) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured over the fit list."""
    d, k = model.dimension, len(model.vectors)

    def sums(of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1)
            for batch in batches:
                if batch.num_rows:
                    total = total + of(_projected(model, _unpacked(batch.column(0), d))).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["at", "x"])

        rows = fitted.select("packed").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        return np.array([r["x"] for r in sorted(rows, key=lambda r: r["at"])])

    mean = sums(lambda w: w.sum(axis=0)) / model.n
    covariance = sums(lambda w: (w - mean).T @ (w - mean)).reshape(k, k) / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def apply(table: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector and component: key, component (from 1), n, deviation (decimal), whitened, explained."""
    kind = table.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double"
    if model is None or not len(model.vectors):
        return table.sparkSession.createDataFrame([], schema)
    explained, k = np.array(model.explained), len(model.vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = quantised(batch.column(1))
            chosen = [i for i, v in enumerate(found) if len(v) == model.dimension]
            if not chosen:
                continue
            x, keys = np.array([found[i] for i in chosen]), batch.column(0).take(pa.array(at[chosen].repeat(k)))
            exact = [d if d < 10**38 else None for d in _deviations(model, x)]
            columns = [
                keys,
                pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(len(keys), model.n)),
                pa.array([d for d in exact for _ in range(k)], pa.decimal128(38, 0)),
                pa.array(_projected(model, x).reshape(-1)),
                pa.array(np.tile(explained, len(x))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained"])

    return table.select(F.col(f"`{key}`"), F.col(f"`{vector}`")).mapInArrow(run, schema)


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit, measure and apply: the rows of ``apply`` with ``identity_error``, one value for all."""
    model, fitted = fit(table, vector, components)
    error = identity_error(model, fitted) if model is not None and len(model.vectors) else None
    return apply(table, model, key, vector).withColumn("identity_error", F.lit(error).cast("double"))
