"""Boosting, folds and stacking as recursive SQL, round by round, for the comparison engine."""

from __future__ import annotations

from collections.abc import Sequence

from catalog.queries import CROSSES
from catalog.views import sql
from scorekit.plans.boosting import NewtonBooster
from scorekit.plans.histograms import UNIT
from scorekit.plans.key_stats import cross_name


def _text(col: str) -> str:
    return f"coalesce(cast({col} as varchar), 'nan')"


# --- the feature table without A3, as joins on statistics -----------------------------------------------------------------

CATEGORIES = ("A1", "A2", "B1", "B2", "B3", "C1", "C2", "C3")
DISTINCT = [("A2", ["hour", "E1", "E14", "B2", "B3"]), ("hour", ["E1", "E14"])]
PAIRS = [p for k, others in DISTINCT for o in others for p in ((k, o), (o, k))]
KEPT_CROSSES = [p for p in CROSSES if "A3" not in p]
SHARES = ("A2", "hour")
FEATURES = [
    *CATEGORIES, "D1", "E1", "E14", "hour",
    *(f"{k}_{f}_nuq_num" for k, f in PAIRS),
    *(f"count_{cross_name(a, b)}" for a, b in KEPT_CROSSES),
    *(f"ratio_click_of_{c}" for c in SHARES),
]


def model_table(fit_on: str = "all") -> str:
    """CTEs up to ``model``: ID, is_test, label (NULL in test) and FEATURES; statistics of all rows or of train rows."""
    seen = "d" if fit_on == "all" else "(select * from d where is_test = 0)"
    ctes = [
        f"d as (select *, cast(substr(date, 12, 2) as int) as hour from {sql('features')})",
        f"s as (select * from {seen})",
        "total as (select count(*) as n from s)",
    ]
    joins, columns = [], []
    for i, c in enumerate(CATEGORIES):
        ctes.append(f"code{i} as (select v, row_number() over (order by v) - 1 as c from (select distinct {_text(c)} as v from s))")
        joins.append(f"left join code{i} on code{i}.v = {_text('d.' + c)}")
        columns.append(f"code{i}.c as {c}")
    columns += ["d.D1", "cast(d.E1 as bigint) as E1", "d.E14", "d.hour"]
    for i, (k, f) in enumerate(PAIRS):
        ctes.append(f"nuq{i} as (select {k} as v, count(distinct {f}) as n from s where {k} is not null group by 1)")
        joins.append(f"left join nuq{i} on nuq{i}.v = d.{k}")
        columns.append(f"nuq{i}.n as {k}_{f}_nuq_num")
    for i, (a, b) in enumerate(KEPT_CROSSES):
        crossed = "concat({0}, '_', {1})"
        ctes.append(f"cross{i} as (select {crossed.format(_text(a), _text(b))} as v, count(*) as n from s group by 1)")
        joins.append(f"left join cross{i} on cross{i}.v = {crossed.format(_text('d.' + a), _text('d.' + b))}")
        columns.append(f"cross{i}.n as count_{cross_name(a, b)}")
    for i, c in enumerate(SHARES):
        ctes.append(f"share{i} as (select {c} as v, count(*) as n from s where {c} is not null group by 1)")
        joins.append(f"left join share{i} on share{i}.v = d.{c}")
        columns.append(f"cast(trunc(cast(share{i}.n as double) / total.n * 100) as int) as ratio_click_of_{c}")
    table = f"select d.ID, d.is_test, case when d.is_test = 0 then d.y end as label, {', '.join(columns)} from d, total {' '.join(joins)}"
    return ",\n".join([*ctes, f"model as materialized ({table})"])


# --- folds ------------------------------------------------------------------------------------------------------------

_MIXED = "(({key} % 2147483648) * 2654435761 % 4294967296)"


def fold(key: str, k: int = 10) -> str:
    return f"cast(floor({_MIXED.format(key=key)} * {k} / 4294967296.0::double) as int)"


def stratified_fold(key: str, label: str, k: int = 10) -> str:
    return f"cast((row_number() over (partition by {label} order by {_MIXED.format(key=key)}, {key}) - 1) % {k} as int)"


# --- boosting ---------------------------------------------------------------------------------------------------------

_P = "(1 / (1 + exp(-margin)))"


def _weighted(pos_weight: float = 10.0) -> tuple[str, str]:
    weight = f"(y * {pos_weight}::double + (1 - y))"
    return f"({_P} - y) * {weight}", f"{_P} * (1 - {_P}) * {weight}"


def _focal(alpha: float = 0.25, gamma: float = 2.0) -> tuple[str, str]:
    p = f"greatest(least({_P}, 1 - 1e-15::double), 1e-15::double)"
    true = f"(y * {p} + (1 - y) * (1 - {p}))"
    scale = f"((y * {alpha}::double + (1 - y) * (1 - {alpha}::double)) * pow(1 - {true}, {gamma}::double))"
    return f"{scale} * ({p} - y)", f"{scale} * {p} * (1 - {p}) * ({gamma}::double * {true} + 1)"


LOSSES = {"weighted_log_loss": _weighted, "focal_loss": _focal}


def coded(name: str, source: str, features: Sequence[str], bins: int) -> str:
    """CTE ``name``: (id, f, code) of all rows of ``source`` (id, y and features); bins are cut on rows with a label."""
    values = ", ".join(f"coalesce(cast({c} as double), -1.0)" for c in features)
    return f"""
{name}_long as materialized (
  select id, y, unnest(range({len(features)}))::int as f, unnest([{values}]::double[]) as x from {source}),
{name}_ranked as (
  select f, x, row_number() over (partition by f order by x) - 1 as r, count(*) over (partition by f) as n,
    max(x) over (partition by f) as top from {name}_long where y is not null),
{name}_edges as (
  select f, list(distinct x) as e from ranked_at group by f),
{name} as materialized (
  select l.id, l.f, len([v for v in coalesce(e, []) if v < l.x])::int as code
  from {name}_long l left join {name}_edges using (f))""".replace(
        "ranked_at",
        f"(select f, x from {name}_ranked where x < top and (r * {bins} + n - 1) // n between 1 and {bins - 1} "
        f"and (((r * {bins} + n - 1) // n) * n) // {bins} = r)",
    )


def boosted(name: str, source: str, codes: str, models: int, learner: NewtonBooster) -> str:
    """CTE ``name``: (round, id, m, margin, gains) for rounds 0 to the last.

    ``source``: id, y (NULL: only scored), w, fold. Row ``id`` does not count in the model of its own fold.
    """
    g = learner.growth()
    gradient, hessian = LOSSES[g.loss](**{k: float(v) for k, v in g.loss_params.items()})
    ridge = lambda h: f"greatest({h} + {g.l2 * UNIT}::double, 1)"
    unit = lambda x: f"floor(floor(({x}) * {UNIT} + 0.5::double) * w + 0.5::double)::bigint"
    steps = [
        f"n0 as (select id, y, w, fold, m, margin, 1 as node, y is not null and fold <> m as used, {unit(gradient)} as g, "
        f"{unit(hessian)} as h, round from {name} where round < {g.rounds})"
    ]
    for level in range(g.depth):
        steps.append(f"""
h{level} as (
  select m, node, f, code, sum(g)::bigint as g, sum(h)::bigint as h, count(*) as n
  from n{level} join {codes} using (id) where used group by all),
c{level} as (
  select m, node, f, code, (sum(g) over w)::double as gl, (sum(h) over w)::double as hl, (sum(n) over w)::bigint as nl,
    (sum(g) over t)::double as gt, (sum(h) over t)::double as ht, (sum(n) over t)::bigint as nt
  from h{level} window t as (partition by m, node, f),
    w as (partition by m, node, f order by code rows between unbounded preceding and current row)),
b{level} as (
  select * from (
    select m, node, f, code, gl * gl / {ridge('hl')} + (gt - gl) * (gt - gl) / {ridge('(ht - hl)')} - gt * gt / {ridge('ht')} as gain
    from c{level} where nl >= {g.least_rows} and nt - nl >= {g.least_rows})
  where gain > 0 qualify row_number() over (partition by m, node order by gain desc, f, code) = 1),
n{level + 1} as (
  select a.* replace (case when b.f is null then a.node else 2 * a.node + (c.code > b.code)::int end as node)
  from n{level} a left join b{level} b on a.m = b.m and a.node = b.node left join {codes} c on c.id = a.id and c.f = b.f)""")
    gains = " union all ".join(f"select m, f, gain from b{level}" for level in range(g.depth))
    steps.append(f"""
leaf as (
  select m, node, (-{g.step}::double * sum(g)::double) / {ridge('sum(h)::double')} as v from n{g.depth} where used group by m, node),
won as (select m, list({{'f': f, 'gain': gain}}) as gains from ({gains}) group by m)""")
    return f"""
{name} as (
  select 0 as round, id, y, w, fold, m, {g.start}::double as margin, null::struct(f int, gain double)[] as gains
  from {source}, (select unnest(range({models}))::int as m)
  union all
  (with {','.join(steps)}
  select round + 1, id, y, w, fold, a.m, margin + coalesce(v, 0),
    case when id = (select min(id) from {source}) then won.gains end
  from n{g.depth} a left join leaf on a.m = leaf.m and a.node = leaf.node left join won on won.m = a.m))"""


def scores(name: str, tables: dict[str, NewtonBooster]) -> str:
    """CTE ``name``: id, y, fold and one score per learner: of the own fold's model, or the mean of all."""
    parts = []
    for learner, of in tables.items():
        last = f"(select * from {learner}_boost where round = {of.growth().rounds})"
        parts.append(
            f"{name}_{learner} as (select id, any_value(y) as y, any_value(fold) as fold, "
            f"avg(1 / (1 + exp(-margin))) filter (y is null or m = fold) as {learner} from {last} group by id)"
        )
    first = next(iter(tables))
    joined = " ".join(f"join {name}_{x} using (id)" for x in list(tables)[1:])
    shown = ", ".join(f"{name}_{x}.{x}" for x in tables)
    return ",\n".join([*parts, f"{name} as materialized (select id, {name}_{first}.y, {name}_{first}.fold, {shown} from {name}_{first} {joined})"])


def cross_validated(
    learners: dict[str, NewtonBooster], k: int = 10, pos_weight: float = 1.0, folds: str | None = None, source: str | None = None,
    features: Sequence[str] = FEATURES, name: str = "scored",
) -> str:
    """CTEs up to ``name``: out-of-fold scores of labelled rows and mean scores of the others.

    ``source``: CTEs up to ``model`` (ID, label, features); by default the feature table.
    """
    folds = folds or fold("ID", k)
    rows = (
        f"{name}_rows as materialized (select ID as id, cast(label as double) as y, "
        f"case when label = 1 then {pos_weight}::double else 1 end as w, case when label is null then -1 else {folds} end as fold, "
        f"* exclude (ID, label) from model)"
    )
    parts = [source if source is not None else model_table(), rows]
    for bins in sorted({of.growth().bins for of in learners.values()}):
        parts.append(coded(f"{name}_codes{bins}", f"{name}_rows", features, bins).strip())
    for learner, of in learners.items():
        parts.append(boosted(f"{learner}_boost", f"{name}_rows", f"{name}_codes{of.growth().bins}", k, of).strip())
    parts.append(scores(name, learners))
    return ",\n".join(parts)


def stacked(base: str, columns: Sequence[str], meta: NewtonBooster, k: int = 10, name: str = "final") -> str:
    """CTEs that cross-fit ``meta`` on the scores ``columns`` of ``base`` in its folds, up to ``name`` with ``stacked``."""
    rows = f"{name}_rows as materialized (select id, y, 1.0::double as w, fold, {', '.join(columns)} from {base})"
    one = scores(f"{name}_all", {f"{name}_m": meta})
    return ",\n".join([
        rows,
        coded(f"{name}_codes", f"{name}_rows", columns, meta.growth().bins).strip(),
        boosted(f"{name}_m_boost", f"{name}_rows", f"{name}_codes", k, meta).strip(),
        one,
        f"{name} as (select id, y, fold, {name}_m as stacked from {name}_all)",
    ])


def logistic(name: str, base: str, columns: Sequence[str], k: int = 10, rounds: int = 25) -> str:
    """CTEs up to ``name`` (id, y, fold, stacked): logistic models of two scores, cross-fitted by Newton's method."""
    x, z = columns
    sums = {"g0": "y - p", "g1": f"(y - p) * {x}", "g2": f"(y - p) * {z}"}
    sums |= {"a": "w", "b": f"w * {x}", "c": f"w * {z}", "d": f"w * {x} * {x}", "e": f"w * {x} * {z}", "f": f"w * {z} * {z}"}
    det = "(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))"
    steps = [
        "((d * f - e * e) * g0 + (c * e - b * f) * g1 + (b * e - c * d) * g2)",
        "((c * e - b * f) * g0 + (a * f - c * c) * g1 + (b * c - a * e) * g2)",
        "((b * e - c * d) * g0 + (b * c - a * e) * g1 + (a * d - b * b) * g2)",
    ]
    new = ", ".join(f"b{i} + {step} / {det}" for i, step in enumerate(steps))
    return f"""
{name}_beta as (
  select 0 as it, m, 0.0::double as b0, 0.0::double as b1, 0.0::double as b2 from (select unnest(range({k}))::int as m)
  union all
  (with rows as (
    select it, m, b0, b1, b2, y, {x}, {z}, 1 / (1 + exp(-(b0 + b1 * {x} + b2 * {z}))) as p
    from {name}_beta join {base} r on y is not null and r.fold <> m where it < {rounds}),
  sums as (
    select it, m, b0, b1, b2, {", ".join(f"sum({v}) as {n}" for n, v in sums.items())}
    from (select *, p * (1 - p) as w from rows) group by all)
  select it + 1, m, {new} from sums)),
{name} as materialized (
  select id, any_value(y) as y, any_value(fold) as fold, avg(1 / (1 + exp(-(b0 + b1 * {x} + b2 * {z})))) as stacked
  from {base} join (select * from {name}_beta where it = {rounds}) on y is null or m = fold group by id)"""


def single(learner: NewtonBooster) -> str:
    """One model on all labelled rows of the feature table, up to ``one_boost``."""
    rows = "one_rows as materialized (select ID as id, cast(label as double) as y, 1.0::double as w, -1 as fold, * exclude (ID, label) from model)"
    return ",\n".join([
        model_table(),
        rows,
        coded("one_codes", "one_rows", FEATURES, learner.growth().bins).strip(),
        boosted("one_boost", "one_rows", "one_codes", 1, learner).strip(),
    ])


def importances(learners: Sequence[str], rounds: int, features: Sequence[str] = FEATURES, k: int = 10) -> str:
    """Query: mean share of gain per feature over the folds, its percentage of the total, by learner."""
    names = ", ".join(f"({i}, '{f}')" for i, f in enumerate(features))
    each = " union all ".join(
        f"select '{x}' as learner, m, g.f as f, g.gain as gain from (select m, unnest(gains) as g from {x}_boost where gains is not null)"
        for x in learners
    )
    return f"""
names(f, feature) as (values {names}),
gains as (select learner, m, f, sum(gain) as gain from ({each}) group by all),
shares as (select learner, m, f, gain / sum(gain) over (partition by learner, m) as share from gains),
whole as (
  select l.learner, n.feature, coalesce(sum(share), 0) / {k} as importance
  from (select unnest({list(learners)!r}) as learner) l cross join names n
    left join shares s on s.learner = l.learner and s.f = n.f group by all)"""
