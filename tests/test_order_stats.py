import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from scorekit.plans import order_stats
from scorekit.plans.order_stats import count_values, exact_quantiles, values_at_ranks
from scorekit.plans.running_totals import _cut_once, _names, running_totals

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("small_enough", [1, 50, 10**6])
def test_quantiles_equal_numpy_however_much_is_narrowed(spark, small_enough):
    rng = np.random.default_rng(3)
    smooth = rng.normal(size=6000)
    # A third of the rows share one value, another third a second one.
    lumpy = np.where(np.arange(6000) % 3 == 0, 5.0, np.where(np.arange(6000) % 3 == 1, 6.0, rng.normal(5.5, 2, 6000)))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(smooth, lumpy)], "a double, b double").repartition(5)
    found = exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, PROBS, small_enough)
    assert np.allclose(found["a"], np.quantile(smooth, PROBS), rtol=0, atol=1e-12)
    assert np.allclose(found["b"], np.quantile(lumpy, PROBS), rtol=0, atol=1e-12)


def test_missing_and_nan_do_not_count(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    assert exact_quantiles(df, {"x": F.col("x")}, [0.5]) == {"x": [2.0]}
    empty = df.filter("x is null")
    assert exact_quantiles(empty, {"x": F.col("x")}, [0.5]) == {"x": [None]}


@pytest.mark.parametrize("small_enough", [1, 10**6])
def test_ranks_of_large_integers_keep_every_digit(spark, small_enough):
    base = 2**60
    df = spark.range(0, 500).select((F.col("id") + base).alias("k")).repartition(3)
    counts = count_values(df, {"k": F.col("k")})
    found = values_at_ranks(df, {"k": F.col("k")}, {"k": [0, 123, 499]}, counts, small_enough)
    assert found["k"] == {0: base, 123: base + 123, 499: base + 499}


@settings(max_examples=8, deadline=None)
@given(
    values=st.lists(st.integers(-50, 50), min_size=1, max_size=60),
    rows_per_range=st.sampled_from([1, 3, 1000]),
    fan=st.sampled_from([2, 3, 16]),
)
def test_running_totals_equal_the_direct_form(spark, values, rows_per_range, fan):
    counts = {v: values.count(v) for v in values}
    rows = [(s, float(v), n, n * k) for s, k in (("m", 1), ("other", 7)) for v, n in counts.items()]
    table = spark.createDataFrame(rows, "s string, x double, n long, k long")
    rows = running_totals(table, "s", "x", ["n", "k"], rows_per_range, fan).collect()
    assert len(rows) == 2 * len(counts)
    for r in rows:
        times = 1 if r["s"] == "m" else 7
        assert r["before_n"] == sum(1 for v in values if v < r["x"]) and r["before_k"] == times * r["before_n"]
        assert r["total_n"] == len(values) and r["total_k"] == times * len(values)


def test_no_window_of_running_totals_grows_with_the_table(spark):
    table = spark.range(5000).select(F.lit("s").alias("s"), F.col("id").cast("double").alias("x"), F.lit(1).alias("n"))
    cut, levels, fan, rows_per_range = table, 0, 8, 100
    while 5000 > rows_per_range * fan**levels:
        levels += 1
        cut = _cut_once(cut, ["s", *_names(levels - 1)], "x", fan, f"_b{levels}", fan**levels)
    sizes = [r["count"] for r in cut.groupBy(*_names(levels)).count().collect()]
    assert levels == 2 and sum(sizes) == 5000 and max(sizes) <= 2 * rows_per_range
    assert cut.agg(F.max("_b1"), F.max("_b2")).first() == (fan - 1, fan - 1)


def test_ranks_that_sketches_miss_are_found_by_halving(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "_around", lambda share: [0.0, 0.0])
    df = spark.range(3000).select((F.pmod(F.col("id") * 7919, F.lit(3000)) / 2).alias("x"), F.lit(4.0).alias("same"))
    columns = {"x": F.col("x"), "same": F.col("same")}
    found = values_at_ranks(df, columns, {"x": [0, 1234, 2999], "same": [0, 2999]}, count_values(df, columns), 10)
    assert found["x"] == {0: 0.0, 1234: 617.0, 2999: 1499.5} and found["same"] == {0: 4.0, 2999: 4.0}


def _ranks(spark, df, ranks, small_enough):
    columns = {"k": F.col("k")}
    return values_at_ranks(df, columns, {"k": ranks}, count_values(df, columns), small_enough)["k"]


@pytest.mark.parametrize("small_enough", [1, order_stats.SMALL_ENOUGH])
def test_one_large_integer_in_every_row(spark, small_enough):
    df = spark.range(150_000).select(F.lit(2**60 + 1).alias("k"))
    assert _ranks(spark, df, [0, 75_000, 149_999], small_enough) == dict.fromkeys([0, 75_000, 149_999], 2**60 + 1)


@settings(max_examples=10, deadline=None)
@given(
    base=st.sampled_from([-(2**63), -(2**62) - 7, -(2**53), 0, 2**53, 2**60, 2**63 - 400]),
    step=st.integers(1, 3),
    sketched=st.booleans(),
)
def test_large_integers_are_cut_in_their_own_type(spark, base, step, sketched):
    values = [base + (n * step) % 397 for n in range(300)]
    df = spark.range(300).select((F.lit(base) + (F.col("id") * step) % 397).alias("k")).repartition(3)
    ranks = [0, 1, 150, 298, 299]
    with pytest.MonkeyPatch.context() as patch:
        if not sketched:
            patch.setattr(order_stats, "_around", lambda share: [0.0, 0.0])
        assert _ranks(spark, df, ranks, 1) == {r: sorted(values)[r] for r in ranks}


@pytest.mark.parametrize("small_enough", [1, 3, 9])
def test_the_whole_range_of_longs(spark, small_enough):
    values = [-(2**63), -(2**63) + 1, -1, 0, 1, 2**63 - 2, 2**63 - 1] * 3
    df = spark.createDataFrame([(v,) for v in values], "k long")
    assert _ranks(spark, df, range(21), small_enough) == dict(enumerate(sorted(values)))


def test_a_round_without_progress_is_an_error():
    whole = order_stats._Interval("k", (0,), 0, 10, 0, 100)
    with pytest.raises(ArithmeticError):
        order_stats._smaller(whole, whole)
