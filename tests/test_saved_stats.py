"""Statistics that are saved in parts and add up."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorekit.operators import encoding, features
from scorekit.plans.key_stats import Lookup, code, row_count
from scorekit.plans.order_stats import exact_quantiles
from scorekit.plans.saved_stats import StatsSpec, StatsStore, attach_or

SPEC = StatsSpec(
    distinct=(("k", "o"), ("o", "k")), counted=("k",), crosses=(("k", "o"),), coded=("o",), sketched=(("k", "o"),), numbers=("x", "y")
)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(900).select(
        "id",
        (F.col("id") % 4).alias("day"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.when(F.col("id") % 5 != 0, F.col("id") % 13).alias("o"),
        F.when(F.col("id") % 3 != 0, F.sqrt(F.col("id") % 50)).alias("x"),
        F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("id") % 6).alias("y"),
    ).cache()


def _outputs(stats):
    return {"n": row_count, "d": stats.distinct("k", "o")}


def _looked_up(df, stats):
    return attach_or(
        df, stats,
        [
            Lookup("k", features.join_key(df, "k"), _outputs(stats)),
            Lookup("o", features.join_key(df, "o"), {"code": code, "back": stats.distinct("o", "k")}),
            *features.cross_lookups(df, stats, [("k", "o")], 0),
        ],
    )


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("options", [{}, {"literal_values": 0}, {"literal_values": 0, "broadcast_budget": 0, "hot_parts": 3}])
def test_parts_together_equal_the_whole(spark, rows, tmp_path, options):
    store, whole = StatsStore(spark, f"{tmp_path}/days", SPEC), StatsStore(spark, f"{tmp_path}/whole", SPEC)
    whole.add(rows, "all")
    for day in range(4):
        store.add(rows.filter(F.col("day") == day), f"d{day}")
    store.add(rows.filter("day = 2"), "d2")  # a day that is run again counts once
    assert store.parts() == ["d0", "d1", "d2", "d3"]
    expected = _looked_up(rows, whole.key_stats(**options))
    assert _same(_looked_up(rows, store.key_stats(**options)), expected)
    store.merge(["d0", "d1", "d3"], "first")
    assert store.parts() == ["d2", "first"]
    again = StatsStore(spark, f"{tmp_path}/days", SPEC)  # as another session finds it
    assert _same(_looked_up(rows, again.key_stats(**options)), expected)
    direct = features.add_distinct_counts(rows.select("id", "k", "o"), "k", ["o"])
    wanted = {r["id"]: (r["k_o_nuq_num"], r["o_k_nuq_num"]) for r in direct.collect()}
    assert {r["id"]: (r["d"], r["back"]) for r in expected.collect()} == wanted
    codes = {r["id"]: r["o"] for r in encoding.label_encode(rows.select("id", "o"), ["o"]).collect()}
    assert {r["id"]: r["code"] for r in expected.collect()} == codes


def test_sketches_and_quantiles_add_up(spark, rows, tmp_path):
    store = StatsStore(spark, str(tmp_path), SPEC)
    for day in range(4):
        store.add(rows.filter(F.col("day") == day), f"d{day}")
    exact = {r["k"]: r["n"] for r in rows.groupBy("k").agg(F.count_distinct("o").alias("n")).collect()}
    stats = store.approx_key_stats()
    for r in stats.of("k", {"d": stats.distinct("k", "o")}).collect():
        if r["d"] is not None:
            assert r["d"] == pytest.approx(exact[r["value"]], rel=0.03)
    probs = [0.0, 0.01, 0.33, 0.5, 0.99, 1.0]
    wanted = exact_quantiles(rows, {"x": F.col("x"), "y": F.col("y")}, probs)
    got = store.quantiles(probs)
    assert np.allclose(got["x"], wanted["x"]) and np.allclose(got["y"], wanted["y"])
    half = exact_quantiles(rows.filter("day < 2"), {"x": F.col("x")}, probs)["x"]
    assert np.allclose(store.quantiles(probs, ["d0", "d1"])["x"], half)


def test_the_stated_error_of_estimates(spark, tmp_path):
    """Standard error 0.8 %: five times that is kept for every key, with sketches put together from parts."""
    spec = StatsSpec(sketched=(("k", "o"),))
    df = spark.range(400_000).select((F.col("id") % 8).alias("k"), (F.col("id") % 150_000).alias("o"), (F.col("id") % 3).alias("part"))
    store = StatsStore(spark, str(tmp_path), spec)
    for part in range(3):
        store.add(df.filter(F.col("part") == part), str(part))
    exact = {str(r["k"]): r["n"] for r in df.groupBy("k").agg(F.count_distinct("o").alias("n")).collect()}
    stats = store.approx_key_stats()
    found = {r["value"]: r["d"] for r in stats.of("k", {"d": stats.distinct("k", "o")}).collect()}
    assert found.keys() == exact.keys() and all(abs(found[k] / exact[k] - 1) < 0.04 for k in exact)


def test_unseen_keys(spark, rows, tmp_path):
    store = StatsStore(spark, str(tmp_path), SPEC)
    store.add(rows.filter("k <> 'k3' or k is null"), "d")
    stats = store.key_stats()
    lookups = [Lookup("k", features.join_key(rows, "k"), _outputs(stats))]
    plain = {(r["k"], r["n"] is None) for r in attach_or(rows, stats, lookups).collect()}
    assert ("k3", True) in plain and ("k1", False) in plain
    marked = attach_or(rows, stats, lookups, unseen=-1)
    assert marked.columns == [*rows.columns, "n", "d"]
    assert {(r["n"], r["d"]) for r in marked.filter("k = 'k3'").collect()} == {(-1, -1)}
    assert {(r["n"], r["d"]) for r in marked.filter("k is null").collect()} == {(None, None)}


def test_other_specifications_and_parts_are_refused(spark, rows, tmp_path):
    store = StatsStore(spark, str(tmp_path), SPEC)
    with pytest.raises(ValueError, match="no parts"):
        store.key_stats()
    store.add(rows, "d")
    with pytest.raises(ValueError, match="no such parts"):
        store.key_stats(["e"])
    with pytest.raises(ValueError, match="another specification"):
        StatsStore(spark, str(tmp_path), StatsSpec(counted=("k",)))
