"""One registered query per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from catalog.views import table, view
from scorekit.functions import losses, scorecard
from scorekit.functions.numbers import clip
from scorekit.functions.scorecard import risk_score
from scorekit.operators import binning, blending, cleaning, collinearity, drift, encoding, features, ranking, reports
from scorekit.plans import boosting, folds, fusion, linear, stacking
from scorekit.plans.boosting import NewtonBooster
from scorekit.plans.key_stats import Lookup, code, row_count
from scorekit.plans.saved_stats import StatsSpec, StatsStore, attach_or
from scorekit.plans.feature_table import CROSS_FIRST, CROSS_SECOND, FeatureTables, build_feature_table
from scorekit.sources import dictionaries, models, tables
from scorekit.workspace import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

LINE = ["l_orderkey", "l_linenumber"]
SCORES = ["p1", "p2", "p3", "p4", "p5", "p6", "p7"]
CROSSES = features.cross_pairs(CROSS_FIRST, CROSS_SECOND)
FOLDS = 10
ROUNDS = 100


def register(query: Query) -> Query:
    REGISTRY[query.__name__] = query
    return query


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, so that engines that add in another order agree."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


# --- cleaning ---------------------------------------------------------------------------------------------------------


@register
def convert_to_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.strings_to_numbers(view(spark, sf_dir, "strings"))


@register
def cap_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return cleaning.cap_outliers(table(spark, sf_dir, "lineitem").select(*LINE, *names), names)


@register
def sentinel_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.fill_sentinel(view(spark, sf_dir, "sentinel")))


@register
def sentinel_median_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.fill_sentinel(view(spark, sf_dir, "sentinel"), positive_only=True))


@register
def narrow_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    return cleaning.narrow_types(table(spark, sf_dir, "lineitem").select("l_orderkey", *names), names)


@register
def split_and_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = view(spark, sf_dir, "features").withColumn("is_test", F.col("is_test") == 1)
    train, test = cleaning.split_by_mark(marked)
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return cleaning.without_columns(both, ["date", "D2", "is_test", "E1", "E14"])


@register
def clip_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, "scored").select("id", clip(F.col("y_prob"), 0.2, 0.8).alias("clipped")))


# --- encoding and dictionaries ----------------------------------------------------------------------------------------


@register
def code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = {"AUTOMOBILE": 3, "BUILDING": 1, "MACHINERY": 2}
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return encoding.encode_codes(customers, "c_mktsegment", segments, to="code")


def _code_map_query(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return encoding.encode_codes(view(spark, sf_dir, f"categories_{name}"), name, name, to="code")

    return query


for _name in encoding.CODE_MAPS:
    REGISTRY[f"code_map_{_name}"] = _code_map_query(_name)


@register
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["A1", "A2", "A3", "B1", "B2", "B3", "C1", "C2", "C3", "E14"]
    return encoding.label_encode(view(spark, sf_dir, "features", spread=True).select("ID", *names), names)


@register
def dict_slash(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "dictionary")
    written = view(spark, sf_dir, "dictionary").toDF("English", "Chinese")
    written.write.option("header", True).csv(path)
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("feature_name"))
    return encoding.translate_or_slash(names, dictionaries.read_headed_dictionary(spark, path))


@register
def dict_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "dictionary")
    view(spark, sf_dir, "dictionary").write.csv(path)
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("Eng_name"))
    return encoding.translate_or_keep(names, dictionaries.read_plain_dictionary(spark, path))


@register
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = view(spark, sf_dir, "scored").select("id", "y_true", "y_prob")
    path = tables.write_result(scored, fresh_path(spark, "output"), "sub", "scored", fmt="csv")
    return rounded(tables.read_table(spark, path, "csv", scored.schema, header="true"))


# --- features ---------------------------------------------------------------------------------------------------------


@register
def time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_time_parts(view(spark, sf_dir, "features").select("ID", "date"))


@register
def time_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = features.add_time_parts(view(spark, sf_dir, "features").select("ID", "date"))
    return features.add_time_segment(timed).select("ID", "hour", "segment")


@register
def cross_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.add_crosses(view(spark, sf_dir, "features"), [*CROSSES, ("B2", "E14")])
    return df.select("ID", *[c for c in df.columns if c.startswith("cross_")])


def _distinct(spark: SparkSession, sf_dir: str, key: str, others: list[str]) -> DataFrame:
    df = features.add_time_parts(view(spark, sf_dir, "features", spread=True)).select("ID", key, *others)
    return features.add_distinct_counts(df, key, others)


@register
def nunique_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct(spark, sf_dir, "A2", ["hour", "E1", "E14", "B2", "B3"])


@register
def nunique_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct(spark, sf_dir, "hour", ["E1", "E14"])


@register
def nunique_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct(spark, sf_dir, "A1", ["B2", "B3"])


@register
def count_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "features").select("ID", "A1", "E14", "A3")
    return features.add_group_count(features.add_group_count(df, ["A1", "E14"]), ["A3"])


@register
def count_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.add_cross_counts(view(spark, sf_dir, "features", spread=True), CROSSES)
    return df.select("ID", *[c for c in df.columns if c.startswith("count_")])


@register
def share_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.add_time_parts(view(spark, sf_dir, "features")).select("ID", "A2", "A3", "hour", "E14")
    return features.add_shares(df, ["A2", "A3", "hour", "E14"])


@register
def label_join_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    train, test = documents.filter("doc_id % 5 <> 0"), documents.filter("doc_id % 5 = 0")
    return features.label_and_union(train, test, labels, key="doc_id")


@register
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = _built(view(spark, sf_dir, "features", spread=True))
    return built.train.unionByName(built.test.withColumn("label", F.lit(features.TEST_LABEL)))


@register
def feature_table_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, counts and shares from train rows alone; what test rows hold beyond them is NULL."""
    built = _built(view(spark, sf_dir, "features", spread=True).drop("A3"), fit_on="train")
    return built.train.unionByName(built.test.withColumn("label", F.lit(features.TEST_LABEL)))


@register
def merged_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of seven days of the week, counted apart, saved, two of them merged, and applied to all rows."""
    rows = features.add_time_parts(view(spark, sf_dir, "features"))
    spec = StatsSpec(distinct=(("A2", "hour"), ("hour", "A2")), counted=("A2",), crosses=(("B2", "C1"),), coded=("B2", "E14"))
    store = StatsStore(spark, fresh_path(spark, "statistics"), spec)
    for day in range(7):
        store.add(rows.filter(F.col("day") % 7 == day), f"day{day}")
    store.merge(["day0", "day5"], "early")
    stats = StatsStore(spark, store.folder, spec).key_stats()
    found = attach_or(
        rows,
        stats,
        [
            Lookup("A2", features.join_key(rows, "A2"), {"A2_rows": row_count, "A2_hours": stats.distinct("A2", "hour")}),
            Lookup("hour", features.join_key(rows, "hour"), {"hour_A2s": stats.distinct("hour", "A2")}),
            Lookup("B2", features.join_key(rows, "B2"), {"B2_code": code}),
            Lookup("E14", features.join_key(rows, "E14"), {"E14_code": code}),
            *features.cross_lookups(rows, stats, [("B2", "C1")]),
        ],
    )
    return found.select("ID", "A2_rows", "A2_hours", "hour_A2s", "B2_code", "E14_code", "count_cross_B2_and_C1")


@register
def merged_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the counted values of seven parts of a table."""
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_extendedprice", "l_quantity")
    store = StatsStore(spark, fresh_path(spark, "statistics"), StatsSpec(numbers=("l_extendedprice", "l_quantity")))
    for part in range(1, 8):
        store.add(rows.filter(F.col("l_linenumber") == part), str(part))
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    found = [(n, p, v) for n, values in store.quantiles(probs).items() for p, v in zip(probs, values, strict=True)]
    return rounded(spark.createDataFrame(found, "feature string, prob double, value double"))


@register
def nunique_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts, and whether those of merged sketches are within five standard errors (4 %, or one)."""
    rows = features.add_time_parts(view(spark, sf_dir, "features")).select("A1", "A2", "B2", "hour", "day")
    wanted = (("A1", "A2"), ("B2", "A2"), ("hour", "A2"))
    store = StatsStore(spark, fresh_path(spark, "statistics"), StatsSpec(distinct=wanted, sketched=wanted))
    for part in range(2):
        store.add(rows.filter(F.col("day") % 2 == part), str(part))
    exact, approx = store.key_stats(), store.approx_key_stats()
    parts = []
    for key, other in wanted:
        a = exact.of(key, {"n": exact.distinct(key, other)}).select("value", "n")
        b = approx.of(key, {"about": approx.distinct(key, other)}).select("value", "about")
        close = F.abs(F.col("about") - F.col("n")) <= F.greatest(F.lit(1.0), 0.04 * F.col("n"))
        parts.append(a.join(b, "value").filter("n is not null").select(F.lit(key).alias("feature"), "value", "n", close.alias("close")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- bins -------------------------------------------------------------------------------------------------------------


@register
def bins_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*LINE, "l_extendedprice")
    return binning.bin_by_quantiles(df, "l_extendedprice", 10)


@register
def bins_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*LINE, "l_extendedprice")
    return binning.bin_by_width(df, "l_extendedprice", 10)


@register
def bins_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.bin_by_step(table(spark, sf_dir, "lineitem").select(*LINE, "l_quantity"), "l_quantity", 5.0)


@register
def bins_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*LINE, "l_quantity")
    return binning.bin_by_edges(df, "l_quantity", [5.0, 10.0, 20.0, 45.0])


@register
def bins_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.bin_by_width(view(spark, sf_dir, "drift").select(*LINE, "f1"), "f1", 5, missing_bin=True)


# --- monitoring -------------------------------------------------------------------------------------------------------


def _is_actual() -> Column:
    return F.col("side") == "actual"


@register
def psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.psi(view(spark, sf_dir, "drift"), "f2", _is_actual()))


@register
def psi_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.psi_by_feature(view(spark, sf_dir, "drift"), ["f1", "f2"], _is_actual()))


@register
def psi_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.psi_by_feature(view(spark, sf_dir, "drift"), ["f1", "f2"], _is_actual(), outside="open"))


@register
def iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.information_value(view(spark, sf_dir, "drift"), ["f1", "f2"], "target"))


@register
def woe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.woe_table(view(spark, sf_dir, "drift"), ["f1", "f2"], "target"))


@register
def iv_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.information_value(view(spark, sf_dir, "drift"), ["f1", "f2"], "target", by="quantile"))


@register
def vif(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return rounded(collinearity.vif(df, ["l_quantity", "l_extendedprice", "l_discount"]))


@register
def vif_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return rounded(collinearity.vif(df, ["l_quantity", "l_extendedprice"], centered=True))


# --- ranking and reports ----------------------------------------------------------------------------------------------


@register
def ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.ks(view(spark, sf_dir, "scored", spread=True), "y_true", "y_prob"))


@register
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.auc(view(spark, sf_dir, "scored", spread=True), "y_true", "y_prob"))


@register
def avg_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.average_precision(view(spark, sf_dir, "scored", spread=True), "y_true", "y_prob"))


@register
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.ranking_metrics(view(spark, sf_dir, "scored", spread=True), "y_true", SCORES))


@register
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.confusion(view(spark, sf_dir, "scored"), "y_true", "y_prob"))


@register
def topn_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.topn_report(view(spark, sf_dir, "scored"), "y_true", "y_prob", "id"))


@register
def threshold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.threshold_report(view(spark, sf_dir, "scored"), "y_true", "y_prob"))


@register
def threshold_report_titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as business readers get it: their headings, shares as percent texts."""
    report = reports.with_percent_text(rounded(reports.threshold_report(view(spark, sf_dir, "scored"), "y_true", "y_prob")))
    return reports.with_titles(report, reports.THRESHOLD_TITLES)


@register
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = view(spark, sf_dir, "scored").select("y_true", (F.col("y_prob") * 1000).alias("score"))
    return rounded(reports.score_bands(scored, "score", "y_true", 50.0))


@register
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.value_shares(view(spark, sf_dir, "features"), "E14"))


@register
def distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distinct_values(view(spark, sf_dir, "features"), ["A1", "A2", "B2", "E14"])


@register
def importance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return rounded(reports.importance_report(parts, "p_name", "p_retailprice", 50), 4)


# --- scores and losses ------------------------------------------------------------------------------------------------


@register
def prob_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, "scored").select("id", risk_score(F.col("y_prob")).alias("score")))


@register
def willingness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "scored").select("id", scorecard.willingness_score(F.col("y_prob")).alias("score"))


def _derivatives(spark: SparkSession, sf_dir: str, loss, **options) -> DataFrame:
    df = view(spark, sf_dir, "scored").withColumn("margin", (F.col("y_prob") - 0.5) * 4)
    pred = F.col("y_prob") if options.get("on") == "prob" else F.col("margin")
    g, h = loss(F.col("y_true"), pred, **options)
    return rounded(df.select("id", g.alias("gradient"), h.alias("hessian")))


@register
def loss_wlogit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derivatives(spark, sf_dir, losses.weighted_log_loss)


@register
def loss_wprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derivatives(spark, sf_dir, losses.weighted_log_loss, on="prob")


@register
def loss_focal_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derivatives(spark, sf_dir, losses.focal_loss)


@register
def loss_focal_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derivatives(spark, sf_dir, losses.focal_loss_scaled)


@register
def loss_hinge(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, margin = F.col("y_true") * 2 - 1, (F.col("y_prob") - 0.5) * 4
    loss = F.avg(losses.weighted_hinge(y, margin)).alias("loss")
    return rounded(view(spark, sf_dir, "scored").groupBy("event_type").agg(loss))


@register
def loss_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, p = F.col("y_true"), F.col("y_prob")
    g, h = losses.weighted_log_loss(y, p, on="prob")
    value = losses.weighted_log_loss_value(y, p, on="prob")
    sums = [F.sum(g).alias("gradient"), F.sum(h).alias("hessian"), F.avg(value).alias("loss")]
    return rounded(view(spark, sf_dir, "scored").groupBy("event_type").agg(*sums), 4)


# --- folds and blending -----------------------------------------------------------------------------------------------


@register
def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "scored").select("id", folds.fold_by_arithmetic(F.col("id"), 10).alias("fold"))


@register
def kfold_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = view(spark, sf_dir, "scored").select("id", "y_true")
    return folds.assign_folds(scored, "id", 10, stratify="y_true", arithmetic=True)


@register
def hard_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]
    return view(spark, sf_dir, "scored").select("id", blending.hard_vote(SCORES, limits).alias("vote"))


@register
def soft_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, "scored").select("id", blending.soft_vote(SCORES).alias("vote")))


@register
def weighted_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Cubed scores in two models, so that their f1 at 0.5 and hence the weights differ.
    scored = view(spark, sf_dir, "scored", spread=True).withColumns({"p1": F.pow("p1", F.lit(3)), "p2": F.pow("p2", F.lit(3))})
    weights = blending.fit_blend_weights(scored, "y_true", SCORES, by="f1")
    return rounded(blending.weighted_blend(scored.select("id", *SCORES), weights).select("id", "blend"))


# --- training ---------------------------------------------------------------------------------------------------------


def _built(source: DataFrame, **options) -> FeatureTables:
    """The feature table of the rows of the features view."""
    bare = source.drop("y", "is_test")
    train = bare.filter(source["is_test"] == 0)
    test = bare.filter(source["is_test"] == 1)
    return build_feature_table(train, test, source.filter("is_test = 0").select("ID", F.col("y").alias("label")), **options)


def _model_tables(spark: SparkSession, sf_dir: str) -> FeatureTables:
    # A3 determines the label of this view (FIXTURES.md), so no model may see it or what is made from it.
    return _built(view(spark, sf_dir, "features", spread=True).drop("A3"))


def _both_sides(scores: folds.FoldedScores, digits: int = 6) -> DataFrame:
    """Out-of-fold scores of train rows with label and fold, and mean scores of test rows, in one table."""
    return rounded(scores.train.unionByName(scores.test, allowMissingColumns=True), digits)


def _trained(spark: SparkSession, sf_dir: str, learners: dict, **options) -> folds.FoldedScores:
    train, test, names = _model_tables(spark, sf_dir)
    return folds.out_of_fold(train, names, learners, k=FOLDS, test=test, arithmetic_folds=True, **options)


def two_learners() -> dict:
    return {"a": stacking.newton(depth=3), "b": stacking.newton(depth=5, step=0.3)}


def one_family() -> dict:
    return stacking.variants({}, stacking.newton, depth=[2, 4], step=[0.1, 0.2])


def learner_a() -> dict:
    return {"a": stacking.newton(depth=4)}


def learner_b() -> dict:
    return {"b": stacking.newton(depth=3, step=0.3, bins=64, leastRows=5)}


def learner_focal() -> dict:
    return {"focal": stacking.newton(depth=3, step=0.3, loss="focal_loss", lossParams="{}")}


@register
def cv_scores_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both_sides(_trained(spark, sf_dir, learner_a()))


@register
def cv_scores_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both_sides(_trained(spark, sf_dir, learner_b(), stratify=True))


@register
def cv_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both_sides(_trained(spark, sf_dir, {"a": stacking.newton(depth=3)}, pos_weight=10.0))


@register
def cv_focal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The focal loss in every fold; the rows are scored by the models as they are read back from the model store."""
    scores = _trained(spark, sf_dir, learner_focal())
    store = fresh_path(spark, "output")
    models.save_folds(scores, store, "focal")
    return _both_sides(models.load_folds(spark, store, "focal", scores.features).score(scores))


@register
def stack_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Iterative solvers agree to about ten digits; with four shown, none of ten thousand rows lies on the edge.
    return _both_sides(stacking.stack(_trained(spark, sf_dir, two_learners()), ["a", "b"], meta=linear_meta()), 4)


@register
def stack_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both_sides(stacking.stack(_trained(spark, sf_dir, two_learners()), ["a", "b"], meta=stacking.newton(depth=3)))


@register
def stack_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    learners = one_family()
    return _both_sides(stacking.stack(_trained(spark, sf_dir, learners), list(learners), meta=stacking.newton(depth=2)))


@register
def vote_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    learners = one_family()
    return stacking.vote(_both_sides(_trained(spark, sf_dir, learners)), list(learners))


@register
def vote_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacking.vote(_both_sides(_trained(spark, sf_dir, two_learners())), ["a", "b"])


@register
def cv_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, names = _model_tables(spark, sf_dir)
    learners = two_learners()
    scores = folds.out_of_fold(train, names, learners, k=FOLDS, arithmetic_folds=True)
    of_each = [
        reports.importance_report(folds.fold_importances(scores, name)).withColumn("learner", F.lit(name)) for name in learners
    ]
    return rounded(of_each[0].unionByName(of_each[1]))


def boosted_alone(loss: str) -> NewtonBooster:
    return NewtonBooster(loss=loss, rounds=ROUNDS, step=0.3)


def _boosted(spark: SparkSession, sf_dir: str, loss) -> DataFrame:
    train, test, names = _model_tables(spark, sf_dir)
    booster = boosted_alone(loss.__name__)
    fitted = boosting.NewtonModel(booster.fit(folds.assemble(train, names, ["label"])), tuple(names))
    return rounded(fitted.score(test, ["ID"]))


@register
def newton_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boosted(spark, sf_dir, losses.weighted_log_loss)


@register
def newton_boost_focal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boosted(spark, sf_dir, losses.focal_loss)


def linear_meta():
    """The logistic meta model, fitted to its optimum, so that other solvers reach the same scores."""
    return stacking.logistic_meta(maxIter=500, tol=1e-13)


@register
def seven_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven models to one result: every kind of output is written, and the fused result is read back."""
    train, test, names = _model_tables(spark, sf_dir)
    scores, base = fusion.seven_models(train, test, names, linear=linear_meta(), k=FOLDS, arithmetic_folds=True)
    store, out = fusion.score_store(scores), fresh_path(spark, "output")
    fitted = fusion.fit_fusion(store)
    tables.write_result(store.filter("label is null").select("ID", "model", "score"), out, "sub", "scores")
    tables.write_result(fitted, out, "chart_output", "weights", fmt="csv")
    models.save_folds(base, out, "base")
    saved = tables.read_table(spark, f"{out}/sub/scores")
    weights = tables.read_table(spark, f"{out}/chart_output/weights", "csv", fitted.schema, header="true")
    fused = fusion.ranked(fusion.fuse(saved, weights), "blend_ks")
    path = tables.write_result(fused, out, "result", "fused")
    return rounded(tables.read_table(spark, path))


@register
def fusion_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold, KS, AUC and F1 of seven models whose scores are functions of one column, with ties."""
    scored = view(spark, sf_dir, "scored", spread=True)
    cells = F.inline(F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).alias("score")) for s in SCORES]))
    return rounded(fusion.fit_fusion(scored.select(F.col("y_true").alias("label"), cells)))


@register
def chart_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The importances of a booster's folds as a chart file, read back."""
    train, _, names = _model_tables(spark, sf_dir)
    scores = folds.out_of_fold(train, names, learner_a(), k=FOLDS, arithmetic_folds=True)
    report = reports.importance_report(folds.fold_importances(scores, "a"))
    path = tables.write_result(report, fresh_path(spark, "output"), "chart_output", "a_10fold_fea_imp", fmt="csv")
    return rounded(tables.read_table(spark, path, "csv", report.schema, header="true"))


HINGE_FEATURES = ["y_prob", "even"]
HINGE_ROUNDS = 12


@register
def hinge_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear model trained on the weighted hinge: its loss after each round."""
    scored = view(spark, sf_dir, "scored", spread=True).withColumn("even", F.col("id") % 2)
    model = linear.fit_hinge(scored, HINGE_FEATURES, "y_true", rounds=HINGE_ROUNDS)
    losses_ = [(n, float(x)) for n, x in enumerate(model.losses)]
    return rounded(spark.createDataFrame(losses_, "round int, loss double"))


RATED_FEATURES = ["lang", "source", "n_chars", "toxic"]


def rated_learner() -> dict:
    return {"a": stacking.newton(depth=3)}


@register
def rated_documents_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = encoding.label_encode(view(spark, sf_dir, "rated"), ["lang", "source"])
    scores = folds.out_of_fold(
        rated, RATED_FEATURES, rated_learner(), label="quality", key="doc_id", k=FOLDS, arithmetic_folds=True
    )
    return rounded(scores.train)
