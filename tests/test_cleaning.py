import pytest
from pyspark.sql import functions as F

from conftest import column
from scorekit.operators import cleaning


def test_strings_become_numbers_only_if_all_parse(spark):
    rows = [(" 12 ", "1e3", "", "nan", "0x10", "5", None), ("7", "inf", "3", "1", "1", "1_000", None), (None, ".5", "4", "2", "2", "6", None)]
    df = spark.createDataFrame(rows, "whole string, real string, gap string, nan string, hex string, sep string, empty string")
    types = cleaning.fit_numeric_types(df)
    assert types == {"whole": "bigint", "real": "double", "gap": "bigint"}
    done = cleaning.apply_numeric_types(df, types).collect()
    assert [r["whole"] for r in done] == [12, 7, None]
    assert [r["real"] for r in done] == [1000.0, float("inf"), 0.5]
    assert [r["gap"] for r in done] == [None, 3, 4]
    assert [r["nan"] for r in done] == ["nan", "1", "2"]


def test_integer_beyond_bigint_becomes_double(spark):
    df = spark.createDataFrame([("99999999999999999999",), ("1",)], "x string")
    assert cleaning.fit_numeric_types(df) == {"x": "double"}


def test_caps(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 10.0), (5, None)], "id int, x double")
    caps = cleaning.fit_caps(df, ["x"])
    assert caps.bounds["x"] == (1.03, 9.79)
    once = cleaning.apply_caps(df, caps)
    assert column(once, "x", "id") == [1.03, 2.0, 3.0, 9.79, None]
    assert column(cleaning.apply_caps(once, caps), "x", "id") == column(once, "x", "id")


def test_sentinel_median(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (3, -1111), (4, None)], "id int, x long")
    assert column(cleaning.fill_sentinel(df), "x", "id") == [1.0, 3.0, 2.0, None]
    only = spark.createDataFrame([(1, -1111)], "id int, x long")
    assert column(cleaning.fill_sentinel(only), "x") == [None]


def test_sentinel_median_of_positive_values(spark):
    df = spark.createDataFrame([(1, -5), (2, 0), (3, 4), (4, -1111), (5, -1111)], "id int, x long")
    assert column(cleaning.fill_sentinel(df, positive_only=True), "x", "id") == [-5.0, 0.0, 4.0, 4.0, 4.0]
    single = spark.createDataFrame([(1, 4), (2, -1111)], "id int, x long")
    assert column(cleaning.fill_sentinel(single, positive_only=True), "x", "id") == [4, -1111]
    none = spark.createDataFrame([(1, -4), (2, -1111), (3, -1111)], "id int, x long")
    assert column(cleaning.fill_sentinel(none, positive_only=True), "x", "id") == [-4.0, 0.0, 0.0]


def test_narrow_types(spark):
    df = spark.createDataFrame(
        [(1, 300, 2**40, 5.0, 1.123456789012, 1e300, 123456789.123), (None, -2, 0, 70000.0, 0.5, 1.0, 2.0)],
        "a long, b long, c long, d double, e double, f double, g double",
    )
    assert cleaning.fit_narrow_types(df) == {"a": "tinyint", "b": "smallint", "d": "int", "e": "float"}
    assert cleaning.narrow_types(df).schema["d"].dataType.simpleString() == "int"


def test_split_keeps_unlabelled_train_rows(spark):
    df = spark.createDataFrame([(1, None, False), (2, -1, True), (3, 1, False)], "id int, label int, is_test boolean")
    train, test = cleaning.split_by_mark(df)
    assert column(train, "id", "id") == [1, 3] and column(test, "id") == [2]
    assert cleaning.without_columns(df, ["label", "absent"]).columns == ["id", "is_test"]


@pytest.mark.parametrize("approx", [False, True])
def test_caps_from_sketch_are_close(spark, approx):
    df = spark.range(0, 5000).select((F.col("id") % 1000).cast("double").alias("x"))
    low, high = cleaning.fit_caps(df, ["x"], approx=approx).bounds["x"]
    assert abs(low - 9.99) <= 1 and abs(high - 989.01) <= 1


def test_nan_and_infinity_do_not_keep_a_column_wide(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.5, 1.0, inf), (nan, nan, 2.0)], "a double, b double, c double")
    assert cleaning.fit_narrow_types(df) == {"a": "float", "b": "float", "c": "float"}
