"""Characteristic polynomials of symmetric integer matrices, their largest roots and eigenvectors, without rounding.

The polynomial is found modulo many primes: each residue of the matrix is brought to Hessenberg form and read off by its
recurrence; the residues are put together by Chinese remaindering. The primes are independent of each other and are
dealt over Spark tasks. All roots of such a polynomial are real, and then Descartes' rule of signs is exact: the roots above a
are the changes of sign in the coefficients of p(x + a). Bisection with that count isolates each root to any precision.
Vectors of the null space come from inverse iteration in decimals that are longer than the roots are precise.
"""

from __future__ import annotations

import decimal
import random
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Binary digits to which a root is isolated. Roots that agree in so many are taken for one, with a space of vectors.
ROOT_BITS = 160
#: Decimal digits of inverse iteration, and its rounds.
DIGITS, ROUNDS = 120, 4
#: Residues below this: their products stay inside 64 bits.
LARGEST_PRIME = 2**31 - 1
#: Primes of one Spark task.
PRIMES_PER_TASK = 32


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number below 2^32."""
    if n < 2 or any(n % p == 0 and n != p for p in (2, 3, 5, 7)):
        return False
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if base % n and x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_above(bound: int) -> list[int]:
    """Large primes whose product passes ``bound``."""
    found, product, p = [], 1, LARGEST_PRIME
    while product <= bound:
        if is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def hessenberg(matrix: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``matrix`` modulo ``p``, with zeros below its subdiagonal."""
    a = matrix.copy()
    for k in range(1, len(a) - 1):
        pivots = np.flatnonzero(a[k:, k - 1])
        if not len(pivots):
            continue
        if pivot := int(pivots[0]):
            a[[k, k + pivot]] = a[[k + pivot, k]]
            a[:, [k, k + pivot]] = a[:, [k + pivot, k]]
        factors = a[k + 1 :, k - 1] * pow(int(a[k, k - 1]), -1, p) % p
        a[k + 1 :] = (a[k + 1 :] - factors[:, None] * a[k] % p) % p
        a[:, k] = (a[:, k] + (a[:, k + 1 :] * factors % p).sum(axis=1)) % p
    return a


def residue(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo ``p``, of rising powers. Entries of ``matrix``: 0 to p - 1."""
    h, d = hessenberg(matrix, p), len(matrix)
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        # The last column of the leading block times the subdiagonal products that lead to it.
        factors, product = np.empty(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            factors[i] = int(h[i, k]) * product % p
            product = product * int(h[i, i - 1]) % p if i else 0
        shifted = np.roll(polys[k], 1)
        polys[k + 1] = (shifted - (factors[:, None] * polys[: k + 1] % p).sum(axis=0)) % p
    return polys[d]


def largest_coefficient(matrix: list[list[int]]) -> int:
    """No coefficient of a matrix without negative eigenvalues is larger (Maclaurin's inequality on its trace)."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    return max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x - matrix), of rising powers, for a symmetric integer matrix without negative eigenvalues."""
    primes = primes_above(2 * largest_coefficient(matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            rows = [residue(np.array([[x % p for x in row] for row in matrix], np.int64), p) for p in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.int64()))], ["p", "c"])

    table = spark.createDataFrame([(p,) for p in primes], "p long").repartition(-(-len(primes) // PRIMES_PER_TASK))
    rows = table.mapInArrow(run, "p long, c array<long>").collect()
    return remainders([(r["p"], r["c"]) for r in rows])


def remainders(residues: list[tuple[int, list[int]]]) -> list[int]:
    """The numbers next to zero with the given residues."""
    product, found = 1, [0] * len(residues[0][1])
    for p, rest in residues:
        inverse = pow(product, -1, p)
        found = [x + product * ((r - x) * inverse % p) for x, r in zip(found, rest, strict=True)]
        product *= p
    return [x - product if 2 * x > product else x for x in found]


def roots_above(coefficients: list[int], at: int) -> int:
    """How many roots are greater than ``at``, for a polynomial whose roots are all real: changes of sign of p(x + at)."""
    c = list(coefficients)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


@dataclass(frozen=True)
class Root:
    """``times`` roots that lie in (``value`` - ``width``, ``value``]."""

    value: Fraction
    width: Fraction
    times: int

    @property
    def middle(self) -> Fraction:
        return self.value - self.width / 2


def largest_roots(coefficients: list[int], n: int, bits: int = ROOT_BITS) -> list[Root]:
    """The largest positive roots, falling, until they are ``n`` with their multiplicities (or all there are)."""
    zeros = next(k for k, x in enumerate(coefficients) if x)
    c = coefficients[zeros:]
    degree = len(c) - 1
    trace = -c[-2] if degree else 0
    found: list[Root] = []
    while (before := sum(r.times for r in found)) < min(n, degree):
        scale, low, high = 0, 0, trace  # roots are found as whole numbers of 1 / 2^scale
        while True:
            scaled = [x << (scale * (degree - k)) for k, x in enumerate(c)]
            while high - low > 1:
                middle = (low + high) // 2
                if roots_above(scaled, middle) > before:
                    low = middle
                else:
                    high = middle
            if (missing := bits - high.bit_length()) <= 0:
                break
            scale, low, high = scale + missing, low << missing, high << missing
        times = roots_above(scaled, low) - roots_above(scaled, high)
        found.append(Root(Fraction(high, 2**scale), Fraction(1, 2**scale), times))
    return found


def null_space(matrix: list[list[int]], root: Root) -> np.ndarray:
    """Unit vectors, ``root.times`` rows, that ``matrix`` only stretches by ``root``; the largest entry is positive."""
    with decimal.localcontext(decimal.Context(prec=DIGITS, Emin=-(10**9), Emax=10**9)):
        number = decimal.Decimal
        shift = number(root.middle.numerator) / number(root.middle.denominator)
        a = [[number(x) - shift if i == j else number(x) for j, x in enumerate(row)] for i, row in enumerate(matrix)]
        solve = _factored(a)
        rng = random.Random(1)
        vectors = [[number(rng.randint(-(10**6), 10**6)) for _ in matrix] for _ in range(root.times)]
        for _ in range(ROUNDS):
            vectors = _orthonormal([solve(v) for v in vectors])
        out = np.array([[float(x) for x in v] for v in vectors])
    signs = np.sign(out[np.arange(len(out)), np.abs(out).argmax(axis=1)])
    return out * signs[:, None]


def _factored(a: list[list[decimal.Decimal]]):
    """Gaussian elimination with row pivots; returns the function that solves for a right side."""
    d, steps = len(a), []
    least = max(max(abs(x) for x in row) for row in a).scaleb(-DIGITS) or decimal.Decimal(1).scaleb(-DIGITS)
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[pivot] = a[pivot], a[k]
        if abs(a[k][k]) < least:  # the root itself: any small number in its place leads to the null space
            a[k][k] = least
        factors = [a[i][k] / a[k][k] for i in range(k + 1, d)]
        steps.append((pivot, factors))
        row = a[k]
        for i, f in zip(range(k + 1, d), factors, strict=True):
            if f:
                a[i] = a[i][: k + 1] + [x - f * y for x, y in zip(a[i][k + 1 :], row[k + 1 :], strict=True)]

    def solve(b: list[decimal.Decimal]) -> list[decimal.Decimal]:
        b = list(b)
        for k, (pivot, factors) in enumerate(steps):
            b[k], b[pivot] = b[pivot], b[k]
            for i, f in enumerate(factors, k + 1):
                b[i] -= f * b[k]
        for k in range(d - 1, -1, -1):
            b[k] = (b[k] - sum(x * y for x, y in zip(a[k][k + 1 :], b[k + 1 :], strict=True))) / a[k][k]
        return b

    return solve


def _orthonormal(vectors: list[list[decimal.Decimal]]) -> list[list[decimal.Decimal]]:
    out: list[list[decimal.Decimal]] = []
    for v in vectors:
        for _ in range(2):
            for u in out:
                along = sum(x * y for x, y in zip(u, v, strict=True))
                v = [y - along * x for x, y in zip(u, v, strict=True)]
            length = sum(x * x for x in v).sqrt()
            v = [x / length for x in v]
        out.append(v)
    return out
