"""Category codes and dictionary look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scorekit.functions.text import as_text
from scorekit.operators.features import join_key
from scorekit.plans.key_stats import Lookup, attach, code, fit_key_stats

# Codes of the nine built-in categories; every other value, and a missing one, has code 0.
CODE_MAPS: dict[str, dict[str, int]] = {
    "gender": {"男性": 1, "女性": 2},
    "occupation": {
        "不便分类的其他从业人员": 1,
        "农、林、牧、渔业生产及辅助人员": 2,
        "办事人员和有关人员": 3,
        "企业负责人": 4,
        "社会生产服务和生活服务人员": 5,
        "党的机关、国家机关、群众团体和社会组织、企事业单位负责人": 6,
        "专业技术人员": 7,
        "运输设备和通用工程机械操作人员及有关人员": 8,
    },
    "position": {
        "（副）厅/局级以上": 1,
        "个人服务工作者": 2,
        "（副）处级": 3,
        "中层管理人员": 4,
        "一般管理人员": 5,
        "一般员工": 6,
    },
    "marriage": {"初婚": 1, "离婚": 2, "未说明的婚姻状况": 3, "未婚": 4, "丧偶": 5},
    "residence": {
        "无按揭自置": 1,
        "按揭自置": 2,
        "共有住宅": 3,
        "其他": 4,
        "租房": 5,
        "集体宿舍": 6,
        "亲属产权": 7,
        "未知": 8,
    },
    "education": {
        "初中": 1,
        "高中": 2,
        "大学本科": 3,
        "大专": 4,
        "其他": 5,
        "中专": 6,
        "硕士": 7,
        "博士": 8,
        "小学及以下": 9,
        "职高": 10,
    },
    # The fifth level is accepted with either kind of closing bracket.
    "customer_level": {
        "高净值客户（钻石1）": 1,
        "高净值客户（钻石2）": 2,
        "高净值客户（钻石3）": 3,
        "财富客户（高端）": 4,
        "财富客户（中高端)": 5,
        "财富客户（中高端）": 5,
        "中端客户": 6,
        "大众客户": 7,
    },
    "product": {"存款": 1, "理财": 2, "保险": 3, "代销理财": 4, "基金": 5, "信托": 6},
    "asset_type": {
        "活期存款": 1,
        "定期存款": 2,
        "理财": 3,
        "保险": 4,
        "代销理财": 5,
        "基金": 6,
        "信托": 7,
    },
}


def code_of(col: Column, mapping: dict[str, int], default: int = 0) -> Column:
    """Code of an exact string match, ``default`` otherwise; for mappings short enough to be literals."""
    entries = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, col), F.lit(default))


def encode_codes(
    df: DataFrame, name: str, mapping: str | dict[str, int], default: int = 0, to: str | None = None
) -> DataFrame:
    """Replace (or, with ``to``, add) a column by its codes; ``mapping`` is a dictionary or a built-in name."""
    codes = CODE_MAPS[mapping] if isinstance(mapping, str) else mapping
    return df.withColumn(to or name, code_of(F.col(f"`{name}`"), codes, default))


def label_encode(
    df: DataFrame, names: Sequence[str], fit_on: DataFrame | None = None, suffix: str = "", **options
) -> DataFrame:
    """Dense codes 0..k-1 in ascending text order, the missing value being the text ``nan``.

    Codes come from ``fit_on`` (default: the table itself); a value not seen there has NULL. The columns are
    overwritten unless ``suffix`` is given.
    """
    source = df if fit_on is None else fit_on
    stats = fit_key_stats(source, {n: as_text(source, n) for n in names}, coded=names, **options)
    coded = attach(df, stats, [Lookup(n, join_key(df, n), {f"_code_{n}": code}) for n in names])
    if suffix:
        return coded.select(*df.columns, *[F.col(f"_code_{n}").alias(f"{n}{suffix}") for n in names])
    return coded.select(*[F.col(f"_code_{c}").alias(c) if c in names else F.col(c) for c in df.columns])


def translate_or_slash(
    names: DataFrame,
    dictionary: DataFrame,
    name: str = "feature_name",
    key: str = "English",
    value: str = "Chinese",
    to: str = "中文名称",
) -> DataFrame:
    """Display name of each feature, ``/`` where the dictionary has none. One dictionary row per key."""
    return _translate(names, dictionary, name, key, value, to, F.lit("/"))


def translate_or_keep(
    names: DataFrame,
    dictionary: DataFrame,
    name: str = "Eng_name",
    key: str = "Eng_name",
    value: str = "Cha_name",
    to: str = "Cha_name",
) -> DataFrame:
    """Display name of each feature, the name itself where the dictionary has none. One dictionary row per key."""
    return _translate(names, dictionary, name, key, value, to, F.col(name))


def _translate(
    names: DataFrame, dictionary: DataFrame, name: str, key: str, value: str, to: str, missing: Column
) -> DataFrame:
    """Other columns of ``names``, such as a position that keeps the input order, are carried along."""
    entries = dictionary.select(F.col(key).alias("_word"), F.col(value).alias("_display"), F.lit(True).alias("_known"))
    joined = names.join(entries, F.col(name) == F.col("_word"), "left")
    return joined.select(*names.columns, F.when(F.col("_known"), F.col("_display")).otherwise(missing).alias(to))


def name_list(spark: SparkSession, names: Sequence[str], name: str = "Eng_name") -> DataFrame:
    """A table of feature names with their position, for a list that is already on the driver."""
    return spark.createDataFrame(list(enumerate(names)), f"position int, `{name}` string")
