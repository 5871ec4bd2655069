"""Variance inflation factors from the matrix of column products."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from scorekit.functions.numbers import present


def product_sums(df: DataFrame, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of products of the deviations from the means, the means, and the row count, over rows without NULL or NaN.

    Deviations, not raw values, are multiplied: time stamps, ids and amounts vary little against their size. Every
    partition multiplies its batches out and the partial matrices are added up in Spark; k*k numbers reach the driver.
    """
    view = df.select(*[present(F.col(n)).alias(f"c{i}") for i, n in enumerate(names)]).na.drop()
    k = len(names)
    row = view.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)]).first()
    if not row["n"]:
        return np.zeros((k, k)), np.zeros(k), 0
    means = np.array([row[f"m{i}"] for i in range(k)])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            block = np.column_stack([np.ones(len(batch)), batch.to_numpy() - means])
            total += block.T @ block
        i, j = np.triu_indices(k + 1)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    cells = view.mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    full = np.zeros((k + 1, k + 1))
    for c in cells:
        full[c["i"], c["j"]] = full[c["j"], c["i"]] = c["v"]
    # What rounding has left of the means in the deviations is taken out as well.
    rest = full[0, 1:] / row["n"]
    return full[1:, 1:] - row["n"] * np.outer(rest, rest), means + rest, int(row["n"])


def _diagonal_of_inverse(matrix: np.ndarray) -> np.ndarray:
    """Diagonal of the inverse of a symmetric matrix with unit diagonal; inf where it is singular."""
    values, vectors = np.linalg.eigh(matrix)
    tiny = values < len(matrix) * np.finfo(float).eps * max(values.max(), 1.0)
    weights = vectors**2
    regular = (weights[:, ~tiny] / values[~tiny]).sum(axis=1)
    involved = (weights[:, tiny] > 1e-8).any(axis=1) if tiny.any() else np.zeros(len(matrix), bool)
    return np.where(involved, np.inf, regular)


def vif(df: DataFrame, names: Sequence[str], centered: bool = False) -> DataFrame:
    """(feature, vif, constant). By default without an intercept, as regressions on raw columns are; ``centered`` adds
    one. Columns in an exact linear relation have inf; a constant column is marked, and has NULL when centered."""
    covariance, means, n = product_sums(df, names)
    raw = covariance + n * np.outer(means, means)
    constant = np.diag(covariance) <= 1e-28 * np.maximum(np.diag(raw), 1e-300) if n else np.zeros(len(names), bool)
    gram = covariance if centered else raw
    usable = (np.diag(gram) > 0) & ~(constant if centered else np.zeros(len(names), bool))
    result = np.full(len(names), np.nan)
    if usable.any():
        part = gram[np.ix_(usable, usable)]
        scale = np.sqrt(np.diag(part))
        result[usable] = _diagonal_of_inverse(part / np.outer(scale, scale))
    rows = [
        (name, None if np.isnan(v) else float(v), bool(c)) for name, v, c in zip(names, result, constant, strict=True)
    ]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double, constant boolean")
