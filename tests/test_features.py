import pytest
from pyspark.sql import functions as F

from conftest import column
from scorekit.functions.timeparts import day_segment
from scorekit.operators import encoding, features
from scorekit.plans import key_stats
from scorekit.plans.feature_table import FeatureSpec, build_feature_table

# The same results must come out whichever way the statistics are joined back.
WAYS = [
    {},
    {"literal_values": 0},
    {"literal_values": 0, "broadcast_budget": 0},
    {"literal_values": 0, "broadcast_budget": 0, "hot_parts": 3},
    {"literal_values": 0, "broadcast_budget": 0, "hot_parts": 10**9},
]


def test_time_parts(spark):
    df = spark.createDataFrame([("2023-04-05 06:07:08",), ("broken",), (None,)], "date string")
    assert [(r["day"], r["hour"]) for r in features.add_time_parts(df).collect()] == [(5, 6), (None, None), (None, None)]
    typed = df.limit(1).select(F.to_timestamp("date").alias("date"))
    assert [(r["day"], r["hour"]) for r in features.add_time_parts(typed).collect()] == [(5, 6)]


def test_day_segment(spark):
    hours = [0, 3, 4, 12, 13, 18, 19, 23, 24, 3.5]
    df = spark.createDataFrame([(i, float(h)) for i, h in enumerate(hours)], "i int, h double")
    found = column(df.withColumn("s", day_segment(F.col("h"))), "s", "i")
    assert found == [1, 1, 2, 2, 3, 3, 1, 1, None, None]


def test_cross_spells_missing_values(spark):
    df = spark.createDataFrame([(None, 1.0), ("b", float("nan"))], "x string, y double")
    assert column(features.add_crosses(df, [("x", "y")]), "cross_x_and_y") == ["nan_1.0", "b_nan"]


@pytest.mark.parametrize("options", WAYS)
def test_distinct_counts_both_ways(spark, options):
    rows = [(1, "a", 1), (2, "a", 2), (3, "b", 1), (4, None, 3), (5, "b", None)]
    df = spark.createDataFrame(rows, "id int, A2 string, E1 int")
    done = features.add_distinct_counts(df, "A2", ["E1"], **options)
    assert done.columns == ["id", "A2", "E1", "A2_E1_nuq_num", "E1_A2_nuq_num"]
    assert column(done, "A2_E1_nuq_num", "id") == [2, 2, 1, None, 1]
    assert column(done, "E1_A2_nuq_num", "id") == [2, 1, 2, 0, None]


def test_approximate_distinct_counts(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1), (4, None, 3)], "id int, A2 string, E1 int")
    done = features.add_distinct_counts(df, "A2", ["E1"], approx=True)
    assert column(done, "A2_E1_nuq_num", "id") == [2, 2, 1, None]


@pytest.mark.parametrize("options", WAYS)
def test_counts_and_shares(spark, options):
    df = spark.createDataFrame([(1, "x", 1), (2, "x", 1), (3, "y", 2), (4, "x", None)], "id int, k string, v int")
    counted = features.add_group_count(df, ["k", "v"], **options)
    assert column(counted, "count_k_v", "id") == [2, 2, 1, None]
    again = features.add_group_count(counted, ["k", "v"], **options)
    assert again.columns == counted.columns
    single = features.add_group_count(df, ["k"], **options)
    assert sum(column(single, "count_k")) == 3**2 + 1
    shares = features.add_shares(df.filter("id < 4"), ["k"], **options)
    assert column(shares, "ratio_click_of_k", "id") == [66, 66, 33]


def test_composite_keys_do_not_run_together(spark):
    df = spark.createDataFrame([(1, "a", "bc"), (2, "ab", "c")], "id int, x string, y string")
    assert column(features.add_group_count(df, ["x", "y"]), "count_x_y", "id") == [1, 1]


def test_cross_counts_only_for_rich_crosses(spark):
    rows = [(i, f"b{i % 3}", i % 3, i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, B2 string, C1 int, C2 int")
    done = features.add_cross_counts(df, [("B2", "C1"), ("B2", "C2")])
    assert done.columns == [*df.columns, "count_cross_B2_and_C2"]
    assert set(column(done, "count_cross_B2_and_C2")) == {5}


@pytest.mark.parametrize("options", [*WAYS, {"codes_per_bucket": 2}, {"codes_per_bucket": 1, "literal_values": 0}])
def test_label_codes_are_dense_in_text_order(spark, options):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "B", "10", "9", None, "中", "b"])], "i int, c string")
    assert column(encoding.label_encode(df, ["c"], **options), "c", "i") == [3, 2, 0, 1, 4, 5, 3]


def test_many_codes_in_several_ranges(spark):
    df = spark.range(0, 3000).select("id", (F.col("id") * 7919 % 3001).cast("string").alias("c"))
    coded = encoding.label_encode(df, ["c"], suffix="_code", codes_per_bucket=100).collect()
    order = sorted({r["c"] for r in coded})
    assert all(order[r["c_code"]] == r["c"] for r in coded)


def test_codes_fitted_elsewhere_leave_unseen_values_empty(spark):
    df = spark.createDataFrame([(1, "a"), (2, "z")], "i int, c string")
    seen = df.filter("i = 1")
    assert column(encoding.label_encode(df, ["c"], fit_on=seen), "c", "i") == [0, None]


def test_missing_value_and_its_spelling_are_one_class(spark):
    df = spark.createDataFrame([(1, None), (2, "nan"), (3, "a")], "i int, c string")
    assert column(encoding.label_encode(df, ["c"]), "c", "i") == [1, 1, 0]


def _tables(spark):
    rows = [
        (i, f"2024-01-{i % 9 + 1:02d} {i % 24:02d}:00:00", i % 4, "u0" if i % 3 == 0 else f"u{i % 11}", f"t{i % 5}",
         f"b{i % 6}", None if i % 10 == 0 else f"c{i % 7}", i % 2, i % 3, i % 13, None if i % 8 == 0 else i % 17)
        for i in range(200)
    ]
    df = spark.createDataFrame(
        rows, "ID int, date string, A1 int, A2 string, A3 string, B2 string, B3 string, C1 int, D1 int, E1 int, E14 int"
    )
    labels = df.filter("ID < 140 and ID % 7 <> 0").select("ID", (F.col("ID") % 2).alias("label"))
    return df.filter("ID < 150"), df.filter("ID >= 150"), labels


@pytest.mark.parametrize("options", WAYS)
def test_feature_table_is_the_same_however_it_is_joined(spark, options):
    train, test, labels = _tables(spark)
    plain = build_feature_table(train, test, labels)
    other = build_feature_table(train, test, labels, **options)
    assert other.features == plain.features
    for a, b in ((plain.train, other.train), (plain.test, other.test)):
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert plain.train.count() == 150 and plain.test.count() == 50


def test_feature_table_columns(spark):
    train, test, labels = _tables(spark)
    built = build_feature_table(train, test, labels)
    assert {"ID", "day", "date", "label", "D2", "is_test"}.isdisjoint(built.features)
    assert not any(c.startswith("cross_") for c in built.features)
    assert {"A2_hour_nuq_num", "hour_A2_nuq_num", "E14_hour_nuq_num", "ratio_click_of_A2"} <= set(built.features)
    assert "count_cross_B2_and_A2" in built.features and "count_cross_B2_and_C1" not in built.features[:1]
    assert built.train.filter("label is null").count() > 0
    assert built.train.columns == ["ID", "label", *built.features]


def test_feature_table_against_pandas(spark):
    train, test, labels = _tables(spark)
    built = build_feature_table(train, test, labels)
    got = built.train.toPandas().set_index("ID").sort_index()
    all_rows = train.unionByName(test).toPandas()
    all_rows["hour"] = all_rows["date"].str[11:13].astype(int)
    per_key = all_rows.groupby("A2")["E14"].nunique()
    rows = all_rows.set_index("ID").loc[got.index]
    assert (got["A2_E14_nuq_num"] == rows["A2"].map(per_key)).all()
    cross = all_rows["B3"].fillna("nan") + "_" + all_rows["A2"]
    counts = cross.map(cross.value_counts())
    assert (got["count_cross_B3_and_A2"].to_numpy() == counts.to_numpy()[: len(got)]).all()
    order = sorted(all_rows["B3"].fillna("nan").unique())
    assert (got["B3"] == rows["B3"].fillna("nan").map(order.index)).all()
    share = (all_rows["A2"].map(all_rows["A2"].value_counts()) / len(all_rows) * 100).astype(int)
    assert (got["ratio_click_of_A2"].to_numpy() == share.to_numpy()[: len(got)]).all()


def test_feature_table_fitted_on_train(spark):
    train, test, labels = _tables(spark)
    changed = test.withColumn("A3", F.lit("unseen"))
    built = build_feature_table(train, changed, labels, fit_on="train")
    assert built.test.filter("A3 is not null").count() == 0
    assert built.train.filter("A3 is null").count() == 0


def test_spec_is_limited_to_present_columns():
    spec = FeatureSpec().limited_to(["ID", "A1", "B2"])
    assert spec.categories == ("A1", "B2") and spec.crosses == [("B2", "A1")]
    assert spec.distinct_sets == (("hour", ()),) and spec.shares == ("hour",)


def test_long_chains_of_lookups_are_compiled_in_parts(spark):
    names = [f"k{i}" for i in range(11)]
    df = spark.range(400).select("id", *[(F.col("id") % (20 + i)).cast("string").alias(n) for i, n in enumerate(names)])
    stats = key_stats.fit_key_stats(df, {n: F.col(n) for n in names}, counted=names)
    lookups = [key_stats.Lookup(n, key_stats.stored_text(F.col(n)), {f"n_{n}": key_stats.row_count}) for n in names]
    found = key_stats.attach(df, stats, lookups)
    parts = found._jdf.queryExecution().executedPlan().toString().split("Coalesce")
    joins = [p.count("BroadcastHashJoin") for p in parts]
    assert sum(joins) == 11 and max(joins) <= key_stats.JOINS_AT_ONCE
    row = found.filter("id = 21").first()
    assert [row[f"n_{n}"] for n in names] == [sum(j % (20 + i) == 21 % (20 + i) for j in range(400)) for i in range(11)]
