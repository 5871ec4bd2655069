"""SQL counterparts of the registered queries, written from the definitions and run over the whole tables."""

from __future__ import annotations

from catalog import boosted, queries
from catalog.queries import CROSSES, SCORES
from catalog.views import sql
from scorekit.plans import fusion, stacking
from scorekit.plans.key_stats import cross_name

V = {n: sql(n) for n in ("features", "scored", "drift", "sentinel", "strings", "dictionary", "rated")}
SQL: dict[str, str] = {}


def _text(col: str) -> str:
    return f"coalesce(cast({col} as varchar), 'nan')"


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(cast({expr} as double), {digits}) as {name}"


def _features_with_hour() -> str:
    return (
        f"(select *, cast(substr(date, 9, 2) as int) as day, cast(substr(date, 12, 2) as int) as hour "
        f"from {V['features']})"
    )


# --- cleaning ---------------------------------------------------------------------------------------------------------

SQL["convert_to_numeric"] = f"""
select c_custkey, cast(s_int as bigint) as s_int, cast(s_dbl as double) as s_dbl, s_text,
  try_cast(nullif(s_gap, '') as bigint) as s_gap, s_mixed, s_null
from {V['strings']}
"""

_caps = ", ".join(
    f"round_even(quantile_cont({c}, 0.01), 4) as lo_{c}, round_even(quantile_cont({c}, 0.99), 4) as hi_{c}"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
)
_capped = ", ".join(
    f"case when {c} < lo_{c} then lo_{c} when {c} > hi_{c} then hi_{c} else {c} end as {c}"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
)
SQL["cap_outliers"] = f"""
with b as (select {_caps} from lineitem) select l_orderkey, l_linenumber, {_capped} from lineitem, b
"""

SQL["sentinel_median"] = f"""
with m as (select median(x1) filter (x1 <> -1111) as m1, median(x2) filter (x2 <> -1111) as m2 from {V['sentinel']})
select l_orderkey, l_linenumber, l_partkey, {_r('case when x1 = -1111 then m1 else x1 end', 'x1')},
  {_r('case when x2 = -1111 then m2 else x2 end', 'x2')}, {_r('x3', 'x3')}
from {V['sentinel']}, m
"""

SQL["sentinel_median_positive"] = f"""
with m as (
  select coalesce(median(x1) filter (x1 > 0), 0) as m1, coalesce(median(x2) filter (x2 > 0), 0) as m2,
    count(*) filter (x1 = -1111) as n1, count(*) filter (x2 = -1111) as n2
  from {V['sentinel']})
select l_orderkey, l_linenumber, l_partkey, {_r('case when n1 > 1 and x1 = -1111 then m1 else x1 end', 'x1')},
  {_r('case when n2 > 1 and x2 = -1111 then m2 else x2 end', 'x2')}, {_r('x3', 'x3')}
from {V['sentinel']}, m
"""

SQL["narrow_types"] = """
select l_orderkey, cast(l_linenumber as tinyint) as l_linenumber, cast(l_quantity as tinyint) as l_quantity,
  cast(l_discount as float) as l_discount, cast(l_tax as float) as l_tax, l_extendedprice
from lineitem
"""

SQL["split_and_select"] = f"""
select * exclude (date, D2, is_test, E1, E14), case when is_test = 1 then 'test' else 'train' end as side
from {V['features']}
"""

SQL["clip_probability"] = f"""
select id, {_r('case when y_prob < 0.2 then 0.2 when y_prob > 0.8 then 0.8 else y_prob end', 'clipped')}
from {V['scored']}
"""

# --- encoding and dictionaries ----------------------------------------------------------------------------------------

SQL["code_map"] = """
select c_custkey, c_mktsegment,
  case c_mktsegment when 'AUTOMOBILE' then 3 when 'BUILDING' then 1 when 'MACHINERY' then 2 else 0 end as code
from customer
"""

# What the categories should be coded as, in the order of their codes from 1 on; written here apart from the library's own maps.
_EXPECTED_CODES = {
    "gender": "男性|女性",
    "occupation": "不便分类的其他从业人员|农、林、牧、渔业生产及辅助人员|办事人员和有关人员|企业负责人|社会生产服务和生活服务人员|"
    "党的机关、国家机关、群众团体和社会组织、企事业单位负责人|专业技术人员|运输设备和通用工程机械操作人员及有关人员",
    "position": "（副）厅/局级以上|个人服务工作者|（副）处级|中层管理人员|一般管理人员|一般员工",
    "marriage": "初婚|离婚|未说明的婚姻状况|未婚|丧偶",
    "residence": "无按揭自置|按揭自置|共有住宅|其他|租房|集体宿舍|亲属产权|未知",
    "education": "初中|高中|大学本科|大专|其他|中专|硕士|博士|小学及以下|职高",
    "customer_level": "高净值客户（钻石1）|高净值客户（钻石2）|高净值客户（钻石3）|财富客户（高端）|财富客户（中高端）|中端客户|大众客户",
    "product": "存款|理财|保险|代销理财|基金|信托",
    "asset_type": "活期存款|定期存款|理财|保险|代销理财|基金|信托",
}
for _name, _words in _EXPECTED_CODES.items():
    # The bracket of one level is closed in two ways.
    _word = f"replace({_name}, '（中高端)', '（中高端）')" if _name == "customer_level" else _name
    SQL[f"code_map_{_name}"] = (
        f"select c_custkey, {_name}, coalesce(list_position(string_split('{_words}', '|'), {_word}), 0)::int as code "
        f"from {sql('categories_' + _name)}"
    )

_coded = ["A1", "A2", "A3", "B1", "B2", "B3", "C1", "C2", "C3", "E14"]
SQL["label_encode"] = (
    "select ID, "
    + ", ".join(f"cast(dense_rank() over (order by {_text(c)}) - 1 as bigint) as {c}" for c in _coded)
    + f" from {V['features']}"
)

SQL["dict_slash"] = f"""
select n_nationkey as position, n_name as feature_name, coalesce(d.Cha_name, '/') as "中文名称"
from nation left join {V['dictionary']} d on n_name = d.Eng_name
"""

SQL["dict_self"] = f"""
select n_nationkey as position, n_name as Eng_name, coalesce(d.Cha_name, n_name) as Cha_name
from nation left join {V['dictionary']} d on n_name = d.Eng_name
"""

SQL["result_files"] = f"select id, y_true, {_r('y_prob', 'y_prob')} from {V['scored']}"

# --- features ---------------------------------------------------------------------------------------------------------

SQL["time_parts"] = f"select ID, date, day, hour from {_features_with_hour()}"

SQL["time_segment"] = f"""
select ID, hour, case when hour <= 3 or hour >= 19 then 1 when hour <= 12 then 2 else 3 end as segment
from {_features_with_hour()}
"""


def _cross(a: str, b: str) -> str:
    return f"concat({_text(a)}, '_', {_text(b)})"


SQL["cross_features"] = (
    "select ID, "
    + ", ".join(f"{_cross(a, b)} as {cross_name(a, b)}" for a, b in [*CROSSES, ("B2", "E14")])
    + f" from {V['features']}"
)


def _distinct_sql(key: str, others: list[str], shown: list[str]) -> str:
    joins, outs = [], []
    for i, o in enumerate(others):
        for k, f, t in ((key, o, f"f{i}"), (o, key, f"r{i}")):
            joins.append(
                f"left join (select {k}, count(distinct {f}) as n from d where {k} is not null group by {k}) {t} "
                f"on d.{k} = {t}.{k}"
            )
            outs.append(f"{t}.n as {k}_{f}_nuq_num")
    return (
        f"with d as (select * from {_features_with_hour()}) select d.ID, "
        + ", ".join("cast(d.E1 as bigint) as E1" if c == "E1" else f"d.{c}" for c in shown)
        + ", "
        + ", ".join(outs)
        + " from d "
        + " ".join(joins)
    )


SQL["nunique_1"] = _distinct_sql("A2", ["hour", "E1", "E14", "B2", "B3"], ["A2", "hour", "E1", "E14", "B2", "B3"])
SQL["nunique_2"] = _distinct_sql("hour", ["E1", "E14"], ["hour", "E1", "E14"])
SQL["nunique_4"] = _distinct_sql("A1", ["B2", "B3"], ["A1", "B2", "B3"])

SQL["count_feature"] = f"""
with d as (select ID, A1, E14, A3 from {V['features']})
select d.*, p.n as count_A1_E14, q.n as count_A3
from d left join (select A1, E14, count(*) as n from d group by A1, E14) p on d.A1 = p.A1 and d.E14 = p.E14
  left join (select A3, count(*) as n from d group by A3) q on d.A3 = q.A3
"""

SQL["count_cross"] = (
    "select ID, "
    + ", ".join(f"count(*) over (partition by {_cross(a, b)}) as count_{cross_name(a, b)}" for a, b in CROSSES)
    + f" from {V['features']}"
)


def _share(col: str) -> str:
    return (
        f"case when {col} is not null then cast(trunc(cast(count(*) over (partition by {col}) as double) "
        f"/ (count(*) over ()) * 100) as int) end as ratio_click_of_{col}"
    )


SQL["share_feature"] = (
    f"select ID, A2, A3, hour, E14, {', '.join(_share(c) for c in ('A2', 'A3', 'hour', 'E14'))} "
    f"from {_features_with_hour()}"
)

SQL["label_join_union"] = """
select d.doc_id, d.lang, d.n_chars, l.quality as label, false as is_test
from documents d left join labels l on d.doc_id = l.doc_id where d.doc_id % 5 <> 0
union all
select doc_id, lang, n_chars, -1, true from documents where doc_id % 5 = 0
"""

_cats = ["A1", "A2", "A3", "B1", "B2", "B3", "C1", "C2", "C3"]
_sets = [("A2", ["hour", "E1", "E14", "B2", "B3"]), ("hour", ["E1", "E14"])]
_pairs = [p for k, os in _sets for o in os for p in ((k, o), (o, k))]
_nuq_joins = " ".join(
    f"left join (select {k}, count(distinct {f}) as n from d where {k} is not null group by {k}) t{i} on d.{k} = t{i}.{k}"
    for i, (k, f) in enumerate(_pairs)
)
SQL["feature_table"] = (
    f"with d as (select * from {_features_with_hour()}) "
    "select d.ID, case when is_test = 1 then -1 else y end as label, "
    + ", ".join(f"cast(dense_rank() over (order by {_text('d.' + c)}) - 1 as bigint) as {c}" for c in _cats)
    + ", d.D1, cast(d.E1 as bigint) as E1, d.E14, d.hour, "
    + ", ".join(f"t{i}.n as {k}_{f}_nuq_num" for i, (k, f) in enumerate(_pairs))
    + ", "
    + ", ".join(
        f"count(*) over (partition by {_cross('d.' + a, 'd.' + b)}) as count_{cross_name(a, b)}" for a, b in CROSSES
    )
    + ", "
    + ", ".join(
        f"cast(trunc(cast(count(*) over (partition by d.{c}) as double) / (count(*) over ()) * 100) as int) "
        f"as ratio_click_of_{c}"
        for c in ("A2", "A3", "hour")
    )
    + f" from d {_nuq_joins}"
)

SQL["feature_table_train"] = (
    f"with {boosted.model_table('train')} select ID, coalesce(label, -1) as label, {', '.join(boosted.FEATURES)} from model"
)

SQL["merged_stats"] = f"""
with d as (select * from {_features_with_hour()})
select d.ID, case when A2 is not null then count(*) over (partition by A2) end as A2_rows, h.n as A2_hours, a.n as hour_A2s,
  cast(dense_rank() over (order by {_text('B2')}) - 1 as bigint) as B2_code,
  cast(dense_rank() over (order by {_text('E14')}) - 1 as bigint) as E14_code,
  count(*) over (partition by {_cross('B2', 'C1')}) as count_cross_B2_and_C1
from d left join (select A2, count(distinct hour) as n from d group by A2) h using (A2)
  left join (select hour, count(distinct A2) as n from d group by hour) a using (hour)
"""

_probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
SQL["merged_quantiles"] = " union all ".join(
    f"select '{c}' as feature, {p}::double as prob, {_r(f'quantile_cont({c}, {p})', 'value')} from lineitem"
    for c in ("l_extendedprice", "l_quantity")
    for p in _probs
)

SQL["nunique_approx"] = " union all ".join(
    f"select '{k}' as feature, cast({k} as varchar) as value, count(distinct A2) as n, true as close "
    f"from {_features_with_hour()} where {k} is not null group by all"
    for k in ("A1", "B2", "hour")
)

# --- bins -------------------------------------------------------------------------------------------------------------


def _edges(col: str, source: str, q: int = 10) -> str:
    shares = ", ".join(str(i / q) for i in range(q + 1))
    return f"(select list_sort(list_distinct(quantile_cont({col}, [{shares}]))) as e from {source})"


def _bin(col: str, edges: str) -> str:
    """Right-closed bin number, lowest edge included, NULL outside."""
    return (
        f"case when {col} is null or {col} < {edges}[1] or {col} > {edges}[len({edges})] then null "
        f"else greatest(len([v for v in {edges} if v < {col}]), 1) end"
    )


SQL["bins_quantile"] = f"""
select l_orderkey, l_linenumber, l_extendedprice, cast({_bin('l_extendedprice', 'e')} as int) as bin
from lineitem, {_edges('l_extendedprice', 'lineitem')}
"""

SQL["bins_width"] = """
with r as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem)
select l_orderkey, l_linenumber, l_extendedprice,
  cast(least(greatest(ceil((l_extendedprice - lo) / ((hi - lo) / 10)), 1), 10) as int) as bin
from lineitem, r
"""

SQL["bins_step"] = """
select l_orderkey, l_linenumber, l_quantity,
  cast(ceil((l_quantity - (select min(l_quantity) from lineitem)) / 5.0::double) as bigint) as bin
from lineitem
"""

SQL["bins_given"] = """
select l_orderkey, l_linenumber, l_quantity,
  case when l_quantity < 5 or l_quantity > 45 then null when l_quantity <= 10 then 1 when l_quantity <= 20 then 2
    else 3 end as bin
from lineitem
"""

SQL["bins_missing"] = f"""
with d as (select l_orderkey, l_linenumber, f1 from {V['drift']}), r as (select min(f1) as lo, max(f1) as hi from d)
select l_orderkey, l_linenumber, f1,
  case when f1 is null then -1 else cast(least(greatest(ceil((f1 - lo) / ((hi - lo) / 5)), 1), 5) as int) end as bin
from d, r
"""

# --- monitoring -------------------------------------------------------------------------------------------------------


def _psi_part(col: str, open_ends: bool) -> str:
    inner = _edges(col, f"(select * from {V['drift']} where side = 'expect')")
    if open_ends:
        number = f"case when {col} is null then null else least(greatest(len([v for v in e if v < {col}]), 1), len(e) - 1) end"
    else:
        number = _bin(col, "e")
    return f"""
  select '{col}' as feature, sum((a2 - e2) * ln(a2 / e2)) as psi from (
    select case when ec = 0 then 1e-6 else ec / sum(ec) over () end as e2,
      case when ac = 0 then 1e-6 else ac / sum(ac) over () end as a2
    from (
      select b, cast(count(*) filter (side = 'expect') as double) as ec,
        cast(count(*) filter (side = 'actual') as double) as ac
      from (select side, {number} as b from {V['drift']}, {inner}) where b is not null group by b))"""


SQL["psi"] = f"select {_r('psi', 'psi')} from ({_psi_part('f2', False)})"
SQL["psi_by_feature"] = (
    f"select feature, {_r('psi', 'psi')} from ({_psi_part('f1', False)} union all {_psi_part('f2', False)})"
)
SQL["psi_open"] = f"select feature, {_r('psi', 'psi')} from ({_psi_part('f1', True)} union all {_psi_part('f2', True)})"


def _width_bins(col: str) -> str:
    return f"""select '{col}' as feature, target, case when {col} is null then -1 else
      cast(least(greatest(ceil(({col} - lo) / ((hi - lo) / 10)), 1), 10) as int) end as bin
    from {V['drift']}, (select min({col}) as lo, max({col}) as hi from {V['drift']})"""


def _quantile_bins(col: str) -> str:
    return f"""select '{col}' as feature, target, coalesce(cast({_bin(col, 'e')} as int), -1) as bin
    from {V['drift']}, {_edges(col, V['drift'])}"""


def _woe(binned: str) -> str:
    return f"""
select feature, bin, total, bad, good, bad_share, good_share, ln((bad_share + 1e-10) / (good_share + 1e-10)) as woe,
  (bad_share - good_share) * ln((bad_share + 1e-10) / (good_share + 1e-10)) as iv
from (
  select *, cast(bad as double) / sum(bad) over (partition by feature) as bad_share,
    cast(good as double) / sum(good) over (partition by feature) as good_share
  from (
    select feature, bin, count(*) as total, cast(sum(target) as bigint) as bad,
      count(*) - cast(sum(target) as bigint) as good
    from ({binned}) group by feature, bin))"""


_width = _woe(f"{_width_bins('f1')} union all {_width_bins('f2')}")
SQL["woe_table"] = f"""
select feature, bin, total, bad, good, {_r('bad_share', 'bad_share')}, {_r('good_share', 'good_share')},
  {_r('woe', 'woe')}, {_r('iv', 'iv')} from ({_width})
"""
SQL["iv"] = f"select feature, {_r('sum(iv)', 'iv')} from ({_width}) group by feature"
SQL["iv_quantile"] = (
    f"select feature, {_r('sum(iv)', 'iv')} "
    f"from ({_woe(_quantile_bins('f1') + ' union all ' + _quantile_bins('f2'))}) group by feature"
)

SQL["vif"] = f"""
with g as (
  select sum(l_quantity * l_quantity) as a, sum(l_quantity * l_extendedprice) as b, sum(l_quantity * l_discount) as c,
    sum(l_extendedprice * l_extendedprice) as d, sum(l_extendedprice * l_discount) as e,
    sum(l_discount * l_discount) as f
  from lineitem),
h as (select *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) as det from g)
select 'l_quantity' as feature, {_r('a * (d * f - e * e) / det', 'vif')}, false as constant from h
union all select 'l_extendedprice', {_r('d * (a * f - c * c) / det', 'vif')}, false from h
union all select 'l_discount', {_r('f * (a * d - b * b) / det', 'vif')}, false from h
"""

SQL["vif_centered"] = f"""
select unnest(['l_quantity', 'l_extendedprice']) as feature, {_r('1 / (1 - r * r)', 'vif')}, false as constant
from (select corr(l_quantity, l_extendedprice) as r from lineitem)
"""

# --- ranking and reports ----------------------------------------------------------------------------------------------


def _curve(score: str, source: str) -> str:
    """Per distinct score, counted from the top: hits and misses at or above it, and the totals."""
    return f"""(
  select s, p, n, cast(sum(p) over w as double) as up, cast(sum(n) over w as double) as un,
    cast(sum(p) over () as double) as tp, cast(sum(n) over () as double) as tn
  from (select {score} as s, count(*) filter (y_true = 1) as p, count(*) filter (y_true <> 1) as n
        from {source} group by 1)
  window w as (order by s desc))"""


def _metric_exprs() -> dict[str, str]:
    return {
        "ks": "max(abs(up / tp - un / tn))",
        "auc": "sum(n * (up - p + p / 2.0)) / (any_value(tp) * any_value(tn))",
        "avg_precision": "sum(p * up / (up + un)) / any_value(tp)",
    }


for _metric, _expr in _metric_exprs().items():
    SQL[_metric] = f"select {_r(_expr, _metric)} from {_curve('y_prob', V['scored'])}"


def _metrics_of(score: str, source: str) -> str:
    hit, false = f"sum(p) filter (s >= 0.5)", f"sum(n) filter (s >= 0.5)"
    m = _metric_exprs()
    return f"""
  select '{score}' as model, {m['ks']} as ks, {m['auc']} as auc, {m['avg_precision']} as avg_precision,
    2.0 * {hit} / ({hit} + {false} + any_value(tp)) as f1, cast({hit} as double) / ({hit} + {false}) as precision,
    {hit} / any_value(tp) as recall, ({hit} + any_value(tn) - {false}) / (any_value(tp) + any_value(tn)) as accuracy
  from {_curve(score, source)}"""


_all_metrics = " union all ".join(_metrics_of(s, V["scored"]) for s in SCORES)
SQL["ranking_metrics"] = (
    "select model, "
    + ", ".join(_r(c, c) for c in ("ks", "auc", "avg_precision", "f1", "precision", "recall", "accuracy"))
    + f" from ({_all_metrics})"
)

SQL["confusion"] = f"""
select tn, fp, fn, tp, {_r('tp / (tp + fp)', 'precision')}, {_r('tp / (tp + fn)', 'recall')},
  {_r('2 * tp / (2 * tp + fp + fn)', 'f1')}, {_r('(tp + tn) / (tn + fp + fn + tp)', 'accuracy')}
from (select count(*) filter (y_prob < 0.5 and y_true <> 1) as tn, count(*) filter (y_prob >= 0.5 and y_true <> 1) as fp,
  count(*) filter (y_prob < 0.5 and y_true = 1) as fn, count(*) filter (y_prob >= 0.5 and y_true = 1) as tp
  from {V['scored']})
"""

SQL["topn_report"] = f"""
with r as (select y_true, y_prob, row_number() over (order by y_prob desc, id) as k from {V['scored']}),
t as (select count(*) as n_rows, cast(sum(y_true) as bigint) as positives from r),
q as (
  select least(n.n, any_value(n_rows)) as topn, min(y_prob) as boundary, cast(sum(y_true) as bigint) as tp,
    any_value(n_rows) as n_rows, any_value(positives) as positives
  from (select unnest([500, 1000, 3000, 5000])::bigint as n) n, r, t where r.k <= n.n group by n.n)
select topn, {_r('boundary', 'boundary')}, {_r('topn / n_rows', 'share')}, tp, topn - tp as fp, n_rows, positives,
  {_r('positives / n_rows', 'positive_rate')}, {_r('tp / topn', 'precision')}, {_r('tp / positives', 'recall')},
  {_r('2 * tp / (topn + positives)', 'f1')}, {_r('(tp / topn) / (positives / n_rows)', 'lift')}
from q
"""

SQL["threshold_report"] = f"""
with s as (select y_true, y_prob from {V['scored']}),
t as (select count(*) as n_rows, cast(sum(y_true) as bigint) as positives from s),
q as (
  select c.t as threshold, count(*) filter (y_prob >= c.t) as n, count(*) filter (y_prob >= c.t and y_true = 1) as tp,
    count(*) filter (y_prob >= c.t and y_true = 0) as fp
  from s, (select unnest([0.95, 0.9, 0.85, 0.8, 0.7, 0.6]::double[]) as t) c group by c.t)
select {_r('threshold', 'threshold')}, n, {_r('n / n_rows', 'share')}, tp, fp, n_rows, positives,
  {_r('positives / n_rows', 'positive_rate')}, {_r('tp / positives', 'recall')},
  {_r('case when n = 0 then 0 else tp / n end', 'precision')},
  {_r('case when tp = 0 then 0 else 2 * (tp / n) * (tp / positives) / (tp / n + tp / positives) end', 'f1')},
  {_r('case when n = 0 then 0 else (tp / n) / (positives / n_rows) end', 'lift')}
from q, t
"""

SQL["threshold_report_titled"] = f"""
select threshold as "概率阈值", n as "样本数量", printf('%.2f%%', share * 100) as "样本占比", tp as "预测正确", fp as "预测错误",
  n_rows as "样本总量", positives as "总1数量", printf('%.2f%%', positive_rate * 100) as "总1比例",
  printf('%.2f%%', recall * 100) as "召回率", printf('%.2f%%', precision * 100) as "精准率", f1 as "F1", lift as "LIFT"
from ({SQL["threshold_report"]})
"""

SQL["score_bands"] = f"""
with s as (select y_true, y_prob * 1000 as x from {V['scored']}),
b as (select cast(ceil((x - (select min(x) from s)) / 50.0::double) as bigint) as band, y_true from s),
g as (
  select k.band, count(b.band) as total, cast(coalesce(sum(y_true), 0) as bigint) as bad
  from (select unnest(range(0, (select max(band) from b) + 1)) as band) k left join b on b.band = k.band group by k.band),
c as (
  select *, cast(sum(total) over w as bigint) as cum_total, cast(sum(bad) over w as bigint) as cum_bad,
    cast(sum(total) over () as double) as n, cast(sum(bad) over () as double) as p
  from g window w as (order by band))
select band, {_r('case when band > 0 then (select min(x) from s) + (band - 1) * 50 end', 'low')},
  {_r('(select min(x) from s) + band * 50', 'high')}, total, bad, total - bad as good, cum_total, cum_bad, cum_total - cum_bad as cum_good,
  {_r('cum_total / n', 'cum_total_rate')}, {_r('cum_bad / cum_total', 'cum_bad_rate')},
  {_r('(cum_total - cum_bad) / cum_total', 'cum_good_rate')}, {_r('cum_bad / p', 'recall')},
  {_r('cum_bad / cum_total', 'precision')},
  {_r('case when cum_bad = 0 then null else 2 * (cum_bad / cum_total) * (cum_bad / p) / (cum_bad / cum_total + cum_bad / p) end', 'f1')},
  {_r('(cum_bad / cum_total) / (p / n)', 'lift')}
from c
"""

SQL["value_counts"] = f"""
select E14 as value, count(*) as count, {_r('count(*) / sum(count(*)) over ()', 'share')}
from {V['features']} where E14 is not null group by E14
"""

SQL["distinct_count"] = f"""
select count(distinct A1) as A1, count(distinct A2) as A2, count(distinct B2) as B2, count(distinct E14) as E14
from {V['features']}
"""

SQL["importance_report"] = f"""
select feature, {_r('importance', 'importance', 4)}, {_r('100 * importance / sum(importance) over ()', 'percentage', 2)}
from (select p_name as feature, avg(p_retailprice) as importance from part group by 1 order by 2 desc, 1 limit 50)
"""

# --- scores and losses ------------------------------------------------------------------------------------------------

SQL["prob_to_score"] = f"""
select id, {_r("case when y_prob <= 0 then 'inf'::double else 500 - 20 / ln(2) * ln(y_prob / (1 - y_prob)) end", 'score')} from {V['scored']}
"""

SQL["willingness_score"] = f"""
select id, cast(round_even(least(greatest(600 - 20 / ln(2) * ln(5) + 20 / ln(2) * ln(p / (1 - p)), 300), 700), 0) as int) as score
from (select id, least(greatest(y_prob, 1e-10), 1 - 1e-10) as p from {V['scored']})
"""

_margins = f"(select *, (y_prob - 0.5::double) * 4 as f, 1 / (1 + exp(-((y_prob - 0.5::double) * 4))) as q from {V['scored']})"


def _gh(gradient: str, hessian: str) -> str:
    return f"select id, {_r(gradient, 'gradient')}, {_r(hessian, 'hessian')} from {_margins}"


_w = "case when y_true = 1 then 10 else 1 end"
SQL["loss_wlogit"] = _gh(f"(q - y_true) * {_w}", f"q * (1 - q) * {_w}")
SQL["loss_wprob"] = _gh(f"(y_prob - y_true) * {_w}", f"y_prob * (1 - y_prob) * {_w}")
_pt = "case when y_true = 1 then q else 1 - q end"
_at = "case when y_true = 1 then 0.25::double else 0.75::double end"
SQL["loss_focal_a"] = _gh(
    f"-({_at}) * pow(1 - ({_pt}), 2) * (y_true - q)", f"({_at}) * pow(1 - ({_pt}), 2) * q * (1 - q) * (2 * ({_pt}) + 1)"
)
_gb = "(q - y_true) * case when y_true = 1 then 0.9::double * pow(1 - q, 2) else (1 - 0.9::double) * pow(q, 2) end"
SQL["loss_focal_b"] = _gh(_gb, f"0.1::double * abs({_gb})")
SQL["loss_hinge"] = f"""
select event_type, {_r('avg(case when y_true = 1 then 5 * greatest(0, 1 - f) else greatest(0, 1 + f) end)', 'loss')}
from {_margins} group by event_type
"""
SQL["loss_summary"] = f"""
select event_type, {_r(f'sum((y_prob - y_true) * {_w})', 'gradient', 4)},
  {_r(f'sum(y_prob * (1 - y_prob) * {_w})', 'hessian', 4)},
  {_r('avg(-case when y_true = 1 then 10 * ln(greatest(y_prob, 1e-15)) else ln(1 - y_prob) end)', 'loss', 4)}
from {V['scored']} group by event_type
"""

# --- folds and blending -----------------------------------------------------------------------------------------------

SQL["kfold"] = f"""
select id, cast(floor(((id % 2147483648) * 2654435761 % 4294967296) * 10 / 4294967296.0::double) as int) as fold
from {V['scored']}
"""

SQL["kfold_stratified"] = f"select id, y_true, {boosted.stratified_fold('id', 'y_true')} as fold from {V['scored']}"

_limits = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]
_votes = " + ".join(f"(case when {s} >= {t} then 1 else 0 end)" for s, t in zip(SCORES, _limits, strict=True))
SQL["hard_vote"] = f"select id, case when {_votes} >= 4 then 1 else 0 end as vote from {V['scored']}"
SQL["soft_vote"] = f"select id, {_r('(' + ' + '.join(SCORES) + ') / 7', 'vote')} from {V['scored']}"


def _blend() -> str:
    cubed = f"(select * replace (pow(p1, 3) as p1, pow(p2, 3) as p2) from {V['scored']})"
    f1 = ", ".join(
        f"2.0::double * count(*) filter ({s} >= 0.5 and y_true = 1) "
        f"/ (count(*) filter ({s} >= 0.5) + count(*) filter (y_true = 1)) as w{i}"
        for i, s in enumerate(SCORES)
    )
    total = " + ".join(f"w{i}" for i in range(len(SCORES)))
    blend = " + ".join(f"{s} * w{i}" for i, s in enumerate(SCORES))
    return f"with c as {cubed}, w as (select {f1} from c) select id, {_r(f'({blend}) / ({total})', 'blend')} from c, w"


SQL["weighted_blend"] = _blend()

# --- training ---------------------------------------------------------------------------------------------------------


def _scored(columns: list[str], table: str = "scored", digits: int = 6) -> str:
    shown = ", ".join(_r(c, c, digits) for c in columns)
    return f"select id as ID, cast(y as int) as label, nullif(fold, -1) as fold, {shown} from {table}"


def _cv(learners: dict, **options) -> str:
    return f"with recursive {boosted.cross_validated(learners, **options)} {_scored(list(learners))}"


def _stack(learners: dict, meta) -> str:
    base = boosted.cross_validated(learners)
    return f"with recursive {base}, {boosted.stacked('scored', list(learners), meta)} {_scored(['stacked'], 'final')}"


def _vote(learners: dict) -> str:
    mean = " + ".join(_r(x, x).rsplit(" as ", 1)[0] for x in learners)
    return (
        f"with recursive {boosted.cross_validated(learners)} select id as ID, cast(y as int) as label, nullif(fold, -1) as fold, "
        f"({mean}) / {len(learners)} as voted from scored"
    )


_two, _family = queries.two_learners(), queries.one_family()
SQL["cv_scores_a"] = _cv(queries.learner_a())
SQL["cv_scores_b"] = _cv(
    queries.learner_b(), folds=f"case when label is not null then {boosted.stratified_fold('ID', 'label')} end"
)
SQL["cv_weighted"] = _cv({"a": stacking.newton(depth=3)}, pos_weight=10.0)
SQL["cv_focal"] = _cv(queries.learner_focal())
SQL["stack_lr"] = (
    f"with recursive {boosted.cross_validated(_two)}, {boosted.logistic('final', 'scored', list(_two))} {_scored(['stacked'], 'final', 4)}"
)
SQL["stack_gbt"] = _stack(_two, stacking.newton(depth=3))
SQL["stack_single"] = _stack(_family, stacking.newton(depth=2))
SQL["vote_single"] = _vote(_family)
SQL["vote_two"] = _vote(_two)
SQL["cv_importance"] = f"""
with recursive {boosted.cross_validated(_two)}, {boosted.importances(list(_two), 20)},
shown as (select * from whole qualify row_number() over (partition by learner order by importance desc, feature) <= 50)
select learner, feature, {_r('importance', 'importance')},
  {_r('round(100 * importance / sum(importance) over (partition by learner), 2)', 'percentage')} from shown
"""


def _alone(loss: str) -> str:
    learner = queries.boosted_alone(loss)
    return f"""
with recursive {boosted.single(learner)}
select id as ID, {_r('margin', 'margin')}, {_r('1 / (1 + exp(-margin))', 'score')}
from one_boost where round = {learner.growth().rounds} and y is null
"""


SQL["newton_boost"] = _alone("weighted_log_loss")
SQL["newton_boost_focal"] = _alone("focal_loss")

_rated = f"""
model as materialized (
  select doc_id as ID, quality as label, dense_rank() over (order by {_text('lang')}) - 1 as lang,
    dense_rank() over (order by {_text('source')}) - 1 as source, n_chars, toxic from {V['rated']})
"""
_rated_cv = boosted.cross_validated(queries.rated_learner(), source=_rated, features=queries.RATED_FEATURES)
SQL["rated_documents_cv"] = f"""
with recursive {_rated_cv} select id as doc_id, cast(y as int) as label, fold, {_r('a', 'a')} from scored
"""


def _best_cut(long: str) -> str:
    """CTE ``fitted``: model, threshold, ks, auc, f1 from ``long`` (model, label, score)."""
    return f"""
counted as (
  select model, score, count(*) filter (label = 1) as pos, count(*) filter (label <> 1) as neg
  from {long} where label is not null and score is not null group by all),
summed as (
  select *, sum(pos) over (partition by model) as p, sum(neg) over (partition by model) as n,
    sum(pos) over w as up, sum(neg) over w as un
  from counted window w as (partition by model order by score desc)),
curved as (select *, up / p as tpr, un / n as fpr, 2 * up / (up + un + p) as f1 from summed),
fitted as (
  select model, (max_by({{'f': f1, 's': score}}, {{'f': f1, 's': score}})).s as threshold, max(abs(tpr - fpr)) as ks,
    sum(pos * (n - un + neg / 2)) / (any_value(p) * any_value(n)) as auc, max(f1) as f1
  from curved group by model)"""


def _seven() -> str:
    learners = fusion.base_learners()
    meta = stacking.newton(depth=2)
    both, variants = ["first", "second"], ["first", "variant"]
    tables = {
        "m1_stack_linear": ("m1", "stacked"), "m2_stack_trees": ("m2", "stacked"), "m3_stack_variants": ("m3", "stacked"),
        "m4_vote_variants": ("scored", "(first + variant) / 2"), "m5_first": ("scored", "first"),
        "m6_vote_both": ("scored", "(first + second) / 2"), "m7_second": ("scored", "second"),
    }
    long = " union all ".join(f"select id, '{m}' as model, y as label, {of} as score from {t}" for m, (t, of) in tables.items())
    blends = ", ".join(_r(f"sum({m} * score) / sum({m})", f"blend_{m}") for m in ("ks", "auc", "f1"))
    return f"""
with recursive {boosted.cross_validated(learners)}, {boosted.logistic("m1", "scored", both)},
{boosted.stacked("scored", both, meta, name="m2")}, {boosted.stacked("scored", variants, meta, name="m3")},
long as materialized ({long}), {_best_cut("long")}
select id as ID, cast(2 * count(*) filter (score >= threshold) > 7 as int) as vote, {blends}
from long join fitted using (model) where label is null group by id
"""


SQL["seven_models"] = _seven()
_cells = " union all ".join(f"select '{s}' as model, y_true as label, {s} as score from {V['scored']}" for s in SCORES)
SQL["fusion_weights"] = f"""
with long as ({_cells}), {_best_cut("long")}
select model, {', '.join(_r(c, c) for c in ('threshold', 'ks', 'auc', 'f1'))} from fitted
"""
SQL["chart_files"] = f"""
with recursive {boosted.cross_validated(queries.learner_a())}, {boosted.importances(["a"], 20)}
select feature, {_r('importance', 'importance')}, {_r('round(100 * importance / sum(importance) over (), 2)', 'percentage')}
from (select * from whole order by importance desc, feature limit 50)
"""


def _hinge() -> str:
    """Steps along the subgradient, the best of eight taken while it lowers the loss."""
    x, z = "(y_prob - m.mx) / m.sx", "(even - m.mz) / m.sz"
    return f"""
with recursive v as (select y_prob, id % 2 as even, y_true from {V['scored']}),
m as (select avg(y_prob) as mx, stddev_pop(y_prob) as sx, avg(even) as mz, stddev_pop(even) as sz from v),
r as materialized (
  select case when y_true = 1 then 1.0::double else -1 end as y, {x} as x, {z} as z, case when y_true = 1 then 5.0::double else 1 end as w
  from v, m),
run as (
  select 0 as round, a, b, c, 1.0::double as step, sum(w * greatest(0, 1 - y * 0)) / count(*) as loss,
    sum(case when 1 > 0 then -y * w else 0 end * x) / count(*) as ga, sum(-y * w * z) / count(*) as gb, sum(-y * w) / count(*) as gc, true as fell
  from r, (select 0.0::double as a, 0.0::double as b, 0.0::double as c) group by all
  union all
  (with tried as (
    select run.round, run.loss as before, k, step * pow(0.5::double, k) as s, a - step * pow(0.5::double, k) * ga as a,
      b - step * pow(0.5::double, k) * gb as b, c - step * pow(0.5::double, k) * gc as c
    from run, (select unnest(range(8)) as k) where fell and run.round < {queries.HINGE_ROUNDS}),
  summed as (
    select round, before, k, s, a, b, c, sum(w * greatest(0, 1 - y * (a * x + b * z + c))) / count(*) + 0.0005 * (a * a + b * b) as loss,
      sum(case when 1 - y * (a * x + b * z + c) > 0 then -y * w * x else 0 end) / count(*) + 0.001 * a as ga,
      sum(case when 1 - y * (a * x + b * z + c) > 0 then -y * w * z else 0 end) / count(*) + 0.001 * b as gb,
      sum(case when 1 - y * (a * x + b * z + c) > 0 then -y * w else 0 end) / count(*) as gc
    from tried, r group by round, before, k, s, a, b, c)
  select round + 1, a, b, c, 2 * s, loss, ga, gb, gc, loss < before from (select * from summed order by loss, k limit 1)))
select round::int as round, {_r('loss', 'loss')} from run where fell
"""


SQL["hinge_linear"] = _hinge()
