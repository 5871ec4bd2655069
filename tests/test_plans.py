"""What the plans look like, and the registered queries against SQL."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog.oracle import SQL
from catalog.queries import REGISTRY
from catalog.views import view
from scorekit.functions import losses
from scorekit.functions.scorecard import risk_score, willingness_score
from scorekit.operators import cleaning, encoding, features, ranking
from scorekit.plans.feature_table import build_feature_table
from scorekit.plans.key_stats import Lookup, attach, fit_key_stats
from scorekit.functions.text import as_text
from scorekit.workspace import shared_dir
from tools.compare import difference, engine

SMOKE = "/root/testdata/sf0.001"
#: Training queries of many trees. The same code is trained in cv_weighted, chart_files and rated_documents_cv here.
SLOW = {
    "seven_models", "newton_boost", "newton_boost_focal", "stack_gbt", "stack_lr", "stack_single", "vote_single", "vote_two",
    "cv_importance", "cv_focal", "cv_scores_a", "cv_scores_b",
}

def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_and_no_single_partition_on_rows(spark):
    scored = view(spark, SMOKE, "scored")
    metrics = plan_of(ranking.score_curve(scored, "y_true", ["y_prob"]))
    assert "Exchange SinglePartition" not in metrics
    for name in ("feature_table", "label_encode", "prob_to_score", "ranking_metrics", "psi_by_feature", "topn_report"):
        plan = plan_of(entry.queries()[name](spark, SMOKE))
        assert "Python" not in plan and "ArrowEval" not in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scans_read_only_what_is_needed(spark):
    plan = plan_of(ranking.ks(view(spark, SMOKE, "scored"), "y_true", "y_prob"))
    schemas = {line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema" in line}
    assert schemas and all("props" not in s and "user_id" not in s and "ts:" not in s for s in schemas)
    assert "PushedFilters: [" in plan


@pytest.mark.parametrize("hot", ["hot", "long" * 512])
def test_frequent_keys_do_not_meet_in_one_task(spark, hot):
    """Most rows are alike: none of them may go to the shuffle join under their key."""
    rare = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    df = spark.range(200_000).select(F.lit(hot).alias("k")).unionByName(rare)
    stats = fit_key_stats(df, {"k": as_text(df, "k")}, counted=["k"], literal_values=0, broadcast_budget=0, hot_parts=100)
    joined = attach(df, stats, [Lookup("k", features.join_key(df, "k"), {"n": lambda get: get("n")})])
    assert joined.filter("length(k) >= 3 and n = 200000").count() == 200_000 and joined.filter("n = 1").count() == 2000
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert max(r["count"] for r in sizes) < 100_000


def test_three_ways_to_look_up_give_one_result(spark):
    texts = ["\x00", "\x00\x00a", "a", "nan", None, "b" * 3000, "\x00s" + "a" * 64]
    df = spark.createDataFrame([(i, texts[i % 7], texts[i % 5]) for i in range(400)], "id long, k string, o string")
    results = []
    for options in ({}, {"literal_values": 0}, {"literal_values": 0, "broadcast_budget": 0, "hot_parts": 3}):
        counted = features.add_group_count(df, ["k"], **options)
        coded = encoding.label_encode(counted, ["o"], suffix="_code", codes_per_bucket=2, **options)
        crossed = features.add_cross_counts(coded, [("k", "o")], more_than=0, **options)
        results.append(sorted(tuple(r) for r in crossed.select("id", *sorted(set(crossed.columns) - {"id", "k", "o"})).collect()))
    assert results[0] == results[1] == results[2]
    assert all(r[0] % 7 == 4 or r is not None for r in results[0])
    plain = {r["id"]: r["count_k"] for r in features.add_group_count(df, ["k"]).collect()}
    assert plain[0] == sum(i % 7 == 0 for i in range(400)) and plain[4] is None
    codes = {r["o"]: r["o_code"] for r in encoding.label_encode(df, ["o"], suffix="_code").collect()}
    assert codes["\x00"] == 0 and codes["\x00\x00a"] == 1 and codes["a"] == 2 and codes["nan"] == codes[None] == 3


def test_frequent_keys_of_many_columns_write_the_wide_rows_once(spark):
    source = view(spark, SMOKE, "features")
    bare = source.drop("y", "is_test")
    parts = (bare.filter(source["is_test"] == 0), bare.filter(source["is_test"] == 1), source.select("ID", F.col("y").alias("label")))
    plain = build_feature_table(*parts)
    written = lambda: {p.name for p in Path(f"{shared_dir(spark)}/scorekit").glob("key-rows-*")}
    before = written()
    skewed = build_feature_table(*parts, literal_values=0, broadcast_budget=0, hot_parts=50)
    assert len(written() - before) == 1
    for a, b in ((plain.train, skewed.train), (plain.test, skewed.test)):
        assert a.count() == b.count() and a.exceptAll(b.select(*a.columns)).count() == 0


def test_codes_of_texts_that_differ_behind_a_long_prefix(spark):
    df = spark.range(3000).select(F.concat(F.lit("p" * 300), F.lpad(F.col("id").cast("string"), 5, "0")).alias("t"), "id")
    coded = encoding.label_encode(df, ["t"], suffix="_code", codes_per_bucket=200, broadcast_budget=0)
    assert coded.filter(F.col("t_code") != F.col("id")).count() == 0


def test_row_expressions_work_on_a_stream(spark):
    source = spark.read.parquet(f"{SMOKE}/events.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(SMOKE)
    base = stream.select(
        "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"), "value",
        (F.col("value") / (F.col("value") + 50)).alias("p"),
    )
    timed = features.add_time_segment(features.add_time_parts(base))
    coded = encoding.encode_codes(features.add_crosses(timed, [("event_type", "hour")]), "event_type", {"purchase": 1})
    capped = cleaning.apply_caps(coded, cleaning.Caps({"value": (1.0, 50.0)}))
    g, h = losses.weighted_log_loss(F.col("event_type"), F.col("p"), on="prob")
    done = capped.withColumns({"g": g, "h": h, "risk": risk_score(F.col("p")), "will": willingness_score(F.col("p"))})
    query = done.writeStream.format("memory").queryName("row_expressions").start()
    query.processAllAvailable()
    query.stop()
    out = spark.table("row_expressions")
    assert out.count() == source.count() and out.agg(F.max("value")).first()[0] <= 50


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_every_query_has_sql():
    assert set(REGISTRY) == set(SQL) and set(REGISTRY) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def sql_engine():
    return engine(SMOKE)


@pytest.mark.skipif(not Path(SMOKE).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_its_sql(spark, sql_engine, name):
    if name in SLOW and not os.environ.get("SLOW_TESTS"):
        pytest.skip("half a minute and more; runs with SLOW_TESTS=1, and in tools/compare.py")
    got = entry.queries()[name](spark, SMOKE).toPandas()
    problem = difference(got, sql_engine.execute(entry.oracle_sql()[name]).df())
    assert problem is None or problem.startswith("ok"), problem


def test_entry(spark):
    assert entry.entry(spark).count() == spark.read.parquet(f"{SMOKE}/events.parquet").count()
