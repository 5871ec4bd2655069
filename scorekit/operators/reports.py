"""Report tables: top-N, thresholds, score bands, confusion counts, feature importance."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from scorekit.functions.intervals import fixed_step
from scorekit.functions.numbers import present
from scorekit.operators.binning import fit_ranges
from scorekit.plans.order_stats import SMALL_ENOUGH, count_values, values_at_ranks
from scorekit.plans.running_totals import running_totals

DEFAULT_TOPN = (500, 1000, 3000, 5000)
DEFAULT_THRESHOLDS = (0.95, 0.9, 0.85, 0.8, 0.7, 0.6)
#: More bands than this are no report but a wrong width.
MAX_BANDS = 10_000_000

# The headings business readers know, by column of each report.
TOPN_TITLES = {
    "topn": "TopN", "boundary": "边界阈值", "share": "TopN样本占比", "tp": "预测正确", "fp": "预测错误",
    "n_rows": "样本总量", "positives": "总1数量", "positive_rate": "总1比例", "precision": "精准率", "recall": "召回率",
    "f1": "F1", "lift": "Lift",
}
THRESHOLD_TITLES = {
    "threshold": "概率阈值", "n": "样本数量", "share": "样本占比", "tp": "预测正确", "fp": "预测错误",
    "n_rows": "样本总量", "positives": "总1数量", "positive_rate": "总1比例", "recall": "召回率", "precision": "精准率",
    "f1": "F1", "lift": "LIFT",
}
BAND_TITLES = {
    "band": "分数区间", "total": "区间样本总量", "bad": "label_1样本量", "good": "label_0样本量", "cum_total": "累计样本量",
    "cum_bad": "累计label_1样本量", "cum_good": "累计label_0样本量", "cum_total_rate": "累计样本占比",
    "cum_bad_rate": "label_1占比", "cum_good_rate": "label_0占比", "recall": "召回率", "precision": "准确率",
    "f1": "F1-score", "lift": "Lift",
}
PERCENT_COLUMNS = ("share", "positive_rate", "precision", "recall")


def with_titles(report: DataFrame, titles: dict[str, str]) -> DataFrame:
    """The report under its business headings."""
    return report.select(*[F.col(c).alias(titles.get(c, c)) for c in report.columns])


def with_percent_text(report: DataFrame, names: Sequence[str] = PERCENT_COLUMNS) -> DataFrame:
    """Shares as text with two decimals and a percent sign."""
    return report.withColumns({n: F.format_string("%.2f%%", F.col(n) * 100) for n in names if n in report.columns})


def _harmonic(a: Column, b: Column) -> Column:
    return F.try_divide(2 * a * b, a + b)


def topn_report(
    df: DataFrame,
    label: str,
    score: str,
    key: str,
    topn: Sequence[int] = DEFAULT_TOPN,
    small_enough: int = SMALL_ENOUGH,
) -> DataFrame:
    """Quality of the N highest-scored rows, one row per N.

    Rows are never sorted or fetched: the score at rank N is found by counting, and the report is one aggregate around
    these scores. Among equal scores at the boundary the rows with the smallest ``key`` (numeric, or else its hash)
    belong to the top. N beyond the table is cut to its size. Rows without a score do not take part.
    """
    numeric = isinstance(df.schema[key].dataType, T.NumericType)
    rows = df.select(
        F.col(label).alias("y"),
        present(F.col(score)).alias("p"),
        (F.col(key) if numeric else F.xxhash64(key)).alias("k"),
    ).filter("p is not null")
    counts = count_values(rows, {"p": F.col("p")})
    total = counts["p"]
    tops = [min(n, total) for n in topn] if total else []
    ends = values_at_ranks(rows, {"p": F.col("p")}, {"p": [total - n for n in tops]}, counts, small_enough).get("p", {})
    ends = {n: ends[total - n] for n in tops}

    wanted = sorted(set(tops))
    facts = rows.agg(
        *[F.count_if(F.col("p") > ends[n]).alias(f"above{n}") for n in wanted],
        *[F.count_if(F.col("p") == ends[n]).alias(f"equal{n}") for n in wanted],
        F.count_if(F.col("y") == 1).alias("positives"),
    ).first()
    cut = [n for n in wanted if n - facts[f"above{n}"] < facts[f"equal{n}"]]
    tied = {f"n{n}": F.when(F.col("p") == ends[n], F.col("k")) for n in cut}
    last = values_at_ranks(
        rows,
        tied,
        {f"n{n}": [n - facts[f"above{n}"] - 1] for n in cut},
        {f"n{n}": facts[f"equal{n}"] for n in cut},
        small_enough,
    )

    positive = F.col("y") == 1
    sums, lines = [], []
    for n in wanted:
        at_end = F.col("p") == ends[n]
        if n in cut:
            key_end = next(iter(last[f"n{n}"].values()))
            before = (F.col("p") > ends[n]) | (at_end & (F.col("k") < key_end))
            on = at_end & (F.col("k") == key_end)
        else:
            before, on = F.col("p") >= ends[n], F.lit(False)
        sums += [
            F.count_if(before).alias(f"before{n}"),
            F.count_if(before & positive).alias(f"hit{n}"),
            F.count_if(on & positive).alias(f"on{n}"),
        ]
    for n in tops:
        tp = F.col(f"hit{n}") + F.least(F.lit(n) - F.col(f"before{n}"), F.col(f"on{n}"))
        lines.append(F.struct(F.lit(n).cast("bigint").alias("topn"), F.lit(ends[n]).alias("boundary"), tp.alias("tp")))
    listed = F.array(*lines) if lines else F.array().cast("array<struct<topn:bigint,boundary:double,tp:bigint>>")
    counted = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(positive).alias("positives"), *sums)
    base = counted.select(F.inline(listed), "n_rows", "positives")

    n, p, precision = F.col("topn"), F.col("positives"), F.try_divide("tp", "topn")
    recall, rate = F.try_divide("tp", "positives"), F.try_divide("positives", "n_rows")
    return base.select(
        "topn",
        "boundary",
        (n / F.col("n_rows")).alias("share"),
        "tp",
        (n - F.col("tp")).alias("fp"),
        "n_rows",
        "positives",
        rate.alias("positive_rate"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.try_divide(2 * F.col("tp"), n + p).alias("f1"),
        F.try_divide(precision, rate).alias("lift"),
    )


def threshold_report(
    df: DataFrame, label: str, score: str, thresholds: Sequence[float] = DEFAULT_THRESHOLDS
) -> DataFrame:
    """Quality of the rows scored at or above each threshold, one row per threshold, from one pass.

    As in the top-N report, rows without a score do not take part.
    """
    p, positive = present(F.col(score)), F.col(label) == 1
    df = df.filter(p.isNotNull())
    sums = [F.count(F.lit(1)).alias("n_rows"), F.count_if(positive).alias("positives")]
    for i, t in enumerate(thresholds):
        sums += [
            F.count_if(p >= t).alias(f"n{i}"),
            F.count_if((p >= t) & positive).alias(f"tp{i}"),
            F.count_if((p >= t) & (F.col(label) == 0)).alias(f"fp{i}"),
        ]
    lines = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.col(f"n{i}").alias("n"),
            F.col(f"tp{i}").alias("tp"),
            F.col(f"fp{i}").alias("fp"),
        )
        for i, t in enumerate(thresholds)
    ]
    base = df.agg(*sums).select("n_rows", "positives", F.inline(F.array(*lines)))
    precision = F.coalesce(F.try_divide("tp", "n"), F.lit(0.0))
    rate = F.try_divide("positives", "n_rows")
    recall = F.when(F.col("n") == 0, 0.0).otherwise(F.try_divide("tp", "positives"))
    return base.select(
        "threshold",
        "n",
        F.try_divide("n", "n_rows").alias("share"),
        "tp",
        "fp",
        "n_rows",
        "positives",
        rate.alias("positive_rate"),
        recall.alias("recall"),
        precision.alias("precision"),
        F.when(F.col("tp") == 0, 0.0).otherwise(_harmonic(precision, recall)).alias("f1"),
        F.when(F.col("n") == 0, 0.0).otherwise(F.try_divide(precision, rate)).alias("lift"),
    )


def score_bands(df: DataFrame, score: str, label: str, width: float = 5.0) -> DataFrame:
    """Counts, cumulative counts and rates per score band, lowest band first, empty bands included.

    Band 0 is the smallest score itself, band k the scores in ``(low+(k-1)*width, low+k*width]``. Infinite scores, where
    there are any, are in bands of their own below and above all others. NULL and NaN are in none.
    """
    spark = df.sparkSession
    value = present(F.col(score))
    value = F.when(F.abs(value) < float("inf"), value)
    low, high = fit_ranges(df.select(value.alias("s")), {"s": F.col("s")})["s"]
    last = -1 if low is None else math.ceil((high - low) / width)
    if last > MAX_BANDS:
        raise ValueError(f"{last} bands of width {width} from {low} to {high}; at most {MAX_BANDS} make a report")
    low = 0.0 if low is None else low
    band = F.when(value.isNotNull(), fixed_step(value, F.lit(low), width)).when(F.col(score) > 0, last + 1).otherwise(-1)
    counted = (
        df.filter(present(F.col(score)).isNotNull())
        .groupBy(band.cast("bigint").alias("band"))
        .agg(F.count(F.lit(1)).alias("total"), F.sum(label).cast("bigint").alias("bad"))
    )
    outer = counted.filter((F.col("band") < 0) | (F.col("band") > last)).select("band")
    bands = spark.range(0, last + 1).select(F.col("id").alias("band")).unionByName(outer)
    table = bands.join(counted, "band", "left").select(
        F.lit("all").alias("_series"),
        "band",
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("bad", F.lit(0)).alias("bad"),
    )
    summed = running_totals(table, "_series", "band", ["total", "bad"])
    cum_total = F.col("before_total") + F.col("total")
    cum_bad = F.col("before_bad") + F.col("bad")
    bad_rate = F.try_divide(cum_bad, cum_total)
    recall = F.try_divide(cum_bad, F.col("total_bad"))
    upper = F.lit(low) + F.col("band") * F.lit(float(width))
    return summed.select(
        "band",
        F.when(F.col("band") < 0, F.lit(float("-inf")))
        .when(F.col("band") > last, F.lit(float(high if high is not None else 0.0)))
        .when(F.col("band") > 0, upper - F.lit(float(width)))
        .alias("low"),
        F.when(F.col("band") < 0, F.lit(float("-inf"))).when(F.col("band") > last, F.lit(float("inf"))).otherwise(upper).alias("high"),
        "total",
        "bad",
        (F.col("total") - F.col("bad")).alias("good"),
        cum_total.alias("cum_total"),
        cum_bad.alias("cum_bad"),
        (cum_total - cum_bad).alias("cum_good"),
        F.try_divide(cum_total, F.col("total_total")).alias("cum_total_rate"),
        bad_rate.alias("cum_bad_rate"),
        F.try_divide(cum_total - cum_bad, cum_total).alias("cum_good_rate"),
        recall.alias("recall"),
        bad_rate.alias("precision"),
        _harmonic(bad_rate, recall).alias("f1"),
        F.try_divide(bad_rate, F.try_divide(F.col("total_bad"), F.col("total_total"))).alias("lift"),
    )


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: tn, fp, fn, tp, and precision, recall, f1, accuracy for scores from ``threshold`` up."""
    p, true = present(F.col(score)), F.col(label) == 1
    said = p >= threshold
    counts = df.filter(p.isNotNull() & F.col(label).isNotNull()).agg(
        F.count_if(~said & ~true).alias("tn"),
        F.count_if(said & ~true).alias("fp"),
        F.count_if(~said & true).alias("fn"),
        F.count_if(said & true).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        "tn",
        "fp",
        "fn",
        "tp",
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(tp + tn, tn + fp + fn + tp).alias("accuracy"),
    )


def value_shares(df: DataFrame, name: str) -> DataFrame:
    """(value, count, share) of the values of a column; missing values count nowhere."""
    counted = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(name)).scalar()
    return counted.withColumn("share", F.try_divide(F.col("count"), total))


def distinct_values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row with the number of distinct values of each column."""
    return df.agg(*[F.count_distinct(n).alias(n) for n in names])


def importance_report(
    importances: DataFrame, feature: str = "feature", importance: str = "importance", top: int = 50
) -> DataFrame:
    """The most important features, mean importance over folds, and their percentage of the features shown."""
    best = (
        importances.groupBy(F.col(feature).alias("feature"))
        .agg(F.avg(importance).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
        .limit(top)
    )
    shown = Window.partitionBy()
    percent = F.round(100 * F.try_divide(F.col("importance"), F.sum("importance").over(shown)), 2)
    return best.withColumn("percentage", percent).orderBy(F.desc("importance"), "feature")
