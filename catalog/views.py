"""The driver's tables in the shape of the domain, once for Spark and once as SQL for the comparison engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorekit.operators.encoding import CODE_MAPS
from scorekit.sources.tables import read_table

_STRING = {"spark": "string", "sql": "varchar"}
_DATE = {"spark": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "sql": "strftime(ts, '%Y-%m-%d %H:%M:%S')"}

# One row per event: the anonymous feature table, with its side (is_test) and label (y).
_FEATURES = """
select event_id as ID, {date} as date, user_id % 5 as A1, user_id as A2, event_type as A3, event_id % 4 as B1,
  concat('b', cast(event_id % 7 as {s})) as B2, concat('c', cast(user_id % 9 as {s})) as B3,
  event_id % 3 as C1, event_id % 6 as C2, user_id % 4 as C3, event_id % 5 as D1, event_id % 2 as D2,
  floor(value / 10) as E1,
  case when event_id % 50 = 0 then null else cast(regexp_extract(props, '([0-9]+)', 1) as int) end as E14,
  case when ts >= timestamp '2024-01-25 00:00:00' then 1 else 0 end as is_test,
  case when event_type = 'purchase' then 1 else 0 end as y
from {events}
"""

# One row per event: a label and eight scores with ties.
_SCORED = """
select event_id as id, event_type,
  case when event_type = 'purchase' or (value > 60 and event_id % 3 <> 0) then 1 else 0 end as y_true,
  value / (value + 50) as y_prob,
  value / (value + 10) as p1, value / (value + 20) as p2, value / (value + 30) as p3, value / (value + 40) as p4,
  value / (value + 60) as p5, value / (value + 80) as p6, value / (value + 100) as p7
from {events}
"""

_DRIFT = """
select l_orderkey, l_linenumber,
  case when l_shipdate < timestamp '1998-01-01 00:00:00' then 'expect' else 'actual' end as side,
  case when l_linenumber = 7 then null else l_quantity end as f1, l_extendedprice as f2,
  case when l_returnflag = 'R' then 1 else 0 end as target
from {lineitem}
"""

_SENTINEL = """
select l_orderkey, l_linenumber, l_partkey, cast(case when l_linenumber = 7 then -1111 else l_quantity end as double) as x1,
  cast(case when l_linenumber = 3 then -1111 else l_extendedprice end as double) as x2, l_discount as x3
from {lineitem}
"""

_STRINGS = """
select c_custkey, cast(c_custkey as {s}) as s_int, concat(cast(c_nationkey as {s}), '.5') as s_dbl,
  c_mktsegment as s_text, case when c_custkey % 10 = 0 then '' else cast(c_nationkey as {s}) end as s_gap,
  case when c_custkey = 5 then 'nan' else '1' end as s_mixed, cast(null as {s}) as s_null
from {customer}
"""

_DICTIONARY = """
select n_name as Eng_name, concat('名', cast(n_nationkey as {s})) as Cha_name from {nation} where n_nationkey % 2 = 0
"""

_LABELS = """
select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic from {documents} d join {labels} l on d.doc_id = l.doc_id
"""


def _categories(name: str) -> str:
    words = list(CODE_MAPS[name])
    cases = " ".join(f"when {i} then '{w}'" for i, w in enumerate(words))
    return (
        f"select c_custkey, case c_custkey % {len(words) + 2} {cases} when {len(words)} then '没有登记' else null end "
        f"as {name} from {{customer}}"
    )


VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "features": (_FEATURES, ("events",)),
    "scored": (_SCORED, ("events",)),
    "drift": (_DRIFT, ("lineitem",)),
    "sentinel": (_SENTINEL, ("lineitem",)),
    "strings": (_STRINGS, ("customer",)),
    "dictionary": (_DICTIONARY, ("nation",)),
    "rated": (_LABELS, ("documents", "labels")),
    **{f"categories_{name}": (_categories(name), ("customer",)) for name in CODE_MAPS},
}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", spread=spread)


def view(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    text, tables = VIEWS[name]
    frames = {t: table(spark, sf_dir, t, spread) for t in tables}
    filled = text.replace("{s}", _STRING["spark"]).replace("{date}", _DATE["spark"])
    return spark.sql(filled, **frames)


def sql(name: str) -> str:
    """The view as a parenthesised sub-query."""
    text, tables = VIEWS[name]
    filled = text.replace("{s}", _STRING["sql"]).replace("{date}", _DATE["sql"])
    for t in tables:
        filled = filled.replace("{" + t + "}", t)
    return f"({filled.strip()})"
