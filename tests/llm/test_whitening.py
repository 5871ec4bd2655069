from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorekit.llm import char_poly, whitening
from tests.llm.helpers import rows_of

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, "c", "n") for i, v in rows], SCHEMA)


def _determinant(matrix: list[list[Fraction]]) -> Fraction:
    a, out = [list(map(Fraction, r)) for r in matrix], Fraction(1)
    for k in range(len(a)):
        pivot = next((i for i in range(k, len(a)) if a[i][k]), None)
        if pivot is None:
            return Fraction(0)
        if pivot != k:
            a[k], a[pivot], out = a[pivot], a[k], -out
        out *= a[k][k]
        for i in range(k + 1, len(a)):
            f = a[i][k] / a[k][k]
            a[i] = [x - f * y for x, y in zip(a[i], a[k])]
    return out


def _gram(rows: list[list[int]]) -> list[list[int]]:
    return [[sum(r[i] * r[j] for r in rows) for j in range(len(rows[0]))] for i in range(len(rows[0]))]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6).flatmap(lambda d: st.lists(st.lists(st.integers(-3, 3), min_size=d, max_size=d), min_size=1, max_size=6)))
def test_residues_give_the_determinant(rows):
    matrix = _gram(rows)
    primes = char_poly.primes_above(2 * char_poly.largest_coefficient(matrix))
    found = [(p, char_poly.residue(np.array([[x % p for x in r] for r in matrix], np.int64), p).tolist()) for p in primes]
    c = char_poly.remainders(found)
    for at in (-2, 0, 1, 7):
        shifted = [[at * (i == j) - x for j, x in enumerate(r)] for i, r in enumerate(matrix)]
        assert sum(x * at**k for k, x in enumerate(c)) == _determinant(shifted)


def test_primes():
    assert [n for n in range(60) if char_poly.is_prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    assert char_poly.is_prime(2**31 - 1) and not char_poly.is_prime(2147483641) and not char_poly.is_prime(46337 * 46337)


def _polynomial(roots: list[int]) -> list[int]:
    c = [1]
    for r in roots:
        c = [(c[k - 1] if k else 0) - r * (c[k] if k < len(c) else 0) for k in range(len(c) + 1)]
    return c


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(1, 8))
def test_roots_with_their_multiplicity(roots, n):
    found = char_poly.largest_roots(_polynomial(roots), n)
    positive = sorted((r for r in roots if r), reverse=True)
    wanted = [(r, positive.count(r)) for r in sorted(set(positive), reverse=True)]
    assert [(round(r.middle), r.times) for r in found] == wanted[: len(found)]
    assert sum(r.times for r in found) >= min(n, len(positive))
    assert all(r.value - r.width < round(r.middle) <= r.value and r.width * 2**150 < r.value for r in found)


def test_vectors_of_roots_that_agree_in_thirty_digits(spark):
    big = 10**30
    matrix = [[big + 3, 1, 0], [1, big + 3, 0], [0, 0, 7]]  # roots: big + 4, big + 2, 7
    roots = char_poly.largest_roots(char_poly.characteristic(spark, matrix), 3)
    assert [round(r.middle) for r in roots] == [big + 4, big + 2, 7]
    half = 0.5**0.5
    for root, wanted in zip(roots, ([half, half, 0], [half, -half, 0], [0, 0, 1])):
        assert abs(char_poly.null_space(matrix, root)[0] @ np.array(wanted)) == pytest.approx(1, abs=1e-15)


@pytest.mark.parametrize("spread", [200, 2**25, 2**63 - 1])
def test_sums_are_exact(spread):
    rng = random.Random(1)
    x = np.array([[rng.randint(-spread, spread) for _ in range(3)] for _ in range(50)], np.int64)
    centre = np.array([rng.randint(-spread, spread) for _ in range(3)], np.int64)
    near = [[int(a) - int(b) for a, b in zip(r, centre)] for r in x]
    assert whitening.scatter(x, centre).tolist() == _gram(near)
    assert whitening.column_sums(x).tolist() == [sum(int(r[k]) for r in x) for k in range(3)]
    model = whitening.Whitening(3, 3, (spread, -7, 2), np.eye(3), (Fraction(1),) * 3, 3)
    wanted = [sum((3 * int(v) - s) ** 2 for v, s in zip(r, model.sums)) for r in x]
    assert whitening._deviations(model, x) == wanted
    for v in (0, -1, spread, -(spread**3)):
        assert sum(p << (whitening.PART_BITS * k) for k, p in enumerate(whitening._parts(v))) == v


def _reference(vectors: list[list[float]]):
    x = np.floor(np.array(vectors, np.float64) * 256)
    unique = np.unique(x, axis=0)
    near = unique - unique.mean(axis=0)
    values, axes = np.linalg.eigh(near.T @ near / len(unique))
    return x, unique, values[::-1], axes[:, ::-1]


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(2)
    base = (rng.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.3, 0.1]).astype(np.float32)
    rows = [(i, [float(v) for v in base[i % 200 if i >= 250 else i]]) for i in range(300)]
    rows += [(900, None), (901, [1.0] * 5 + [NAN]), (902, [INF] + [0.0] * 5), (903, [1.0] * 5 + [None]), (904, []), (905, [1.0])]
    rows += [(None, rows[0][1]), (7, rows[7][1])]
    got = rows_of(whitening.whiten(_table(spark, rows).repartition(4)))
    x, unique, values, axes = _reference([v for i, v in rows if v and len(v) == 6 and None not in v and np.isfinite(v).all()])
    assert len(got) == 4 * len(x) == 4 * 302 and {r["n"] for r in got} == {len(unique)}
    assert {r["component"] for r in got} == {1, 2, 3, 4} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-9
    n, sums = len(unique), [int(s) for s in unique.sum(axis=0)]
    of = {i: [int(v) for v in np.floor(np.array(vec, np.float64) * 256)] for i, vec in rows[:300]}
    for r in got:
        k = r["component"] - 1
        assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
        vector = of[r["vec_id"] if r["vec_id"] is not None else 0]
        assert int(r["deviation"]) == sum((n * v - s) ** 2 for v, s in zip(vector, sums))
        wanted = (np.array(vector) - unique.mean(axis=0)) @ axes[:, k] / values[k] ** 0.5
        assert abs(r["whitened"]) == pytest.approx(abs(wanted), rel=1e-7, abs=1e-9)


def test_few_directions_and_no_rows(spark):
    flat = [(i, [float(i % 3), 1.0, 2.0]) for i in range(30)]
    got = rows_of(whitening.whiten(_table(spark, flat)))
    assert len(got) == 30 and {(r["component"], r["n"], r["explained"]) for r in got} == {(1, 3, 1.0)}
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, [1.0, 2.0])] * 5, [(1, None)]):
        empty = whitening.whiten(_table(spark, rows))
        assert empty.columns == columns and empty.collect() == []


def test_equal_eigenvalues_and_huge_entries(spark):
    cross = [(i, v) for i, v in enumerate([[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]] * 3)]
    got = rows_of(whitening.whiten(_table(spark, cross)))
    assert len(got) == 24 and {r["explained"] for r in got} == {0.5} and got[0]["identity_error"] < 1e-12
    huge = [(1, [3e38, 1.0]), (2, [-3e38, 1.5]), (3, [0.0, -2.0])]
    got = rows_of(whitening.whiten(_table(spark, huge)))
    assert len(got) == 6 and all(np.isfinite(r["whitened"]) for r in got)
