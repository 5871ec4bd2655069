"""URL rules, and for urls without a rule the trust that flows over links between hosts (operator 5).

A rule names a host and the start of a path; it fits the host and all its subdomains, and the longest rule that fits
decides. Hosts of allowed pages are trusted seeds, hosts of blocked pages are blocked seeds. Trust is personalised PageRank
from the trusted seeds along links; distrust is the same from the blocked seeds against the links, so it reaches hosts that
link to blocked ones. A host without enough of either is allowed; else it is blocked if distrust holds more than
``threshold`` of the two.

Only DataFrame operations. Links are summed up to host pairs before the first shuffle; a host with very many links is split
into parts. Each round is written to the shared folder, two numbers per round reach the driver.

Defined results. NULL url or one without ``://``: empty host and path, no rule, the method's verdict of the empty host. NULL
html: no links. NULL page_id, repeated rows: judged like any other, and repeated links count again. Equal pages tie in
nothing: a verdict depends on host and path only. Of rules of equal length the first in code point order wins. Empty table:
no rows. Extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorekit.skew import join_counted
from scorekit.workspace import materialise

#: The rules of the registered query (fixed values).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

DAMPING = 0.85
THRESHOLD = 0.5
#: Distrust below this part of an average host's rank blocks nobody.
LEAST = 1e-3
TOLERANCE = 1e-6
MAX_ROUNDS = 100
#: Links of one host that one task joins.
LINKS_PER_PART = 100_000

LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]*)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: str | Column = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _rules_of_hosts(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per host: its number of pages and the rules for it and its parents, longest first."""
    hosts = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    table = [(r.partition("/")[0], r[len(r.partition("/")[0]) :], r, verdict, -len(r)) for r, verdict in rules]
    known = pages.sparkSession.createDataFrame(table, "rule_host string, start string, rule string, verdict string, less int")
    depth = max((host.count(".") + 1 for host, *_ in table), default=1)
    labels = F.split("host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(depth), F.size(labels))),
        lambda n: F.concat_ws(".", F.slice(labels, F.size(labels) - n + 1, n)),
    )
    fitting = (
        hosts.select("host", F.explode(parents).alias("rule_host"))
        .join(F.broadcast(known), "rule_host")
        .groupBy("host")
        .agg(F.array_sort(F.collect_list(F.struct("less", "rule", "start", "verdict"))).alias("rules"))
    )
    return hosts.join(fitting, "host", "left")


def _by_rules(pages: DataFrame, rules: Sequence[tuple[str, str]], total: int) -> DataFrame:
    """page_id, host, path, and the longest fitting rule with its verdict, or NULLs."""
    hosts = materialise(_rules_of_hosts(pages, rules), "url-hosts")
    joined = join_counted(pages, hosts, ["host"], F.col("n_pages"), total)
    fits = F.filter(F.coalesce("rules", F.array()), lambda r: F.col("path").startswith(r["start"]))
    return joined.withColumn("fit", F.get(fits, F.lit(0))).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("by_rule")
    )


def host_links(pages: DataFrame) -> DataFrame:
    """Links between different hosts: source, target, number of pages' links. ``pages``: url, html."""
    host, _ = host_and_path()
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), ascii_lower))
    return (
        pages.select(host.alias("source"), F.explode(targets).alias("target"))
        .filter("source <> target and target <> ''")
        .groupBy("source", "target")
        .agg(F.count("*").alias("links"))
    )


def propagate(
    links: DataFrame,
    seeds: DataFrame,
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
    max_rounds: int = MAX_ROUNDS,
    links_per_part: int = LINKS_PER_PART,
) -> DataFrame:
    """Trust and distrust of hosts. ``seeds``: host, trusted, blocked (weights); result: host, trust, distrust (each sums to 1).

    Both run in one table: kind 0 follows the links, kind 1 goes against them. What hosts without onward links hold
    returns to the seeds.
    """
    both = [
        links.select(F.lit(kind).alias("kind"), F.col(a).alias("host"), F.col(b).alias("to"), "links")
        for kind, a, b in ((0, "source", "target"), (1, "target", "source"))
    ]
    edges = both[0].unionByName(both[1])
    sums = edges.groupBy("kind", "host").agg(F.sum("links").alias("all_links"), F.count("*").alias("degree"))
    parts = F.ceil(F.col("degree") / links_per_part).cast("int")
    sums = materialise(sums.select("kind", "host", "all_links", "degree", parts.alias("parts")), "link-sums")
    n_edges = sums.agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]
    edges = join_counted(edges, sums, ["kind", "host"], F.col("degree"), n_edges).select(
        "kind",
        "host",
        F.pmod(F.xxhash64("to"), F.col("parts")).cast("int").alias("part"),
        "to",
        (F.col("links") / F.col("all_links")).alias("share"),
    )
    edges = materialise(edges, "link-edges")
    weights = F.inline(
        F.array(
            F.struct(F.lit(0).alias("kind"), F.col("trusted").cast("double").alias("weight")),
            F.struct(F.lit(1).alias("kind"), F.col("blocked").cast("double").alias("weight")),
        )
    )
    weighed = seeds.select("host", weights).filter("weight > 0")
    total = {r["kind"]: r["total"] for r in weighed.groupBy("kind").agg(F.sum("weight").alias("total")).collect()}
    scale = F.when(F.col("kind") == 0, F.lit(total.get(0, 1.0))).otherwise(F.lit(total.get(1, 1.0)))
    hosts = (
        weighed.select("kind", "host", (F.col("weight") / scale).alias("seed"), F.lit(0).alias("parts"))
        .unionByName(sums.select("kind", "host", F.lit(0.0).alias("seed"), "parts"))
        .groupBy("kind", "host")
        .agg(F.max("seed").alias("seed"), F.max("parts").alias("parts"))
    )
    ranks = materialise(hosts.withColumn("rank", F.col("seed")), "link-ranks")
    for _ in range(max_rounds if n_edges else 0):
        sent = ranks.filter("parts > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        flow = (
            edges.join(sent.select("kind", "host", "part", "rank"), ["kind", "host", "part"])
            .groupBy("kind", F.col("to").alias("host"))
            .agg(F.sum(F.col("share") * F.col("rank")).alias("flow"))
        )
        flow = materialise(flow, "link-flow")
        moved = {r["kind"]: r["moved"] for r in flow.groupBy("kind").agg(F.sum("flow").alias("moved")).collect()}
        back = F.when(F.col("kind") == 0, F.lit(1 - damping * moved.get(0, 0.0))).otherwise(F.lit(1 - damping * moved.get(1, 0.0)))
        following = ranks.select("kind", "host", "seed", "parts", F.col("rank").alias("before")).join(
            flow, ["kind", "host"], "full"
        )
        seed = F.coalesce("seed", F.lit(0.0))
        rank = damping * F.coalesce("flow", F.lit(0.0)) + back * seed
        following = materialise(
            following.select(
                "kind", "host", seed.alias("seed"), F.coalesce("parts", F.lit(0)).alias("parts"), rank.alias("rank"), "before"
            ),
            "link-ranks",
        )
        change = following.agg(F.sum(F.abs(F.col("rank") - F.coalesce("before", F.lit(0.0))))).first()[0]
        ranks = following.drop("before")
        if (change or 0.0) < tolerance:
            break
    return ranks.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("rank")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == 1, F.col("rank")).otherwise(0.0)).alias("distrust"),
    )


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    threshold: float = THRESHOLD,
    least: float = LEAST,
    links_per_part: int = LINKS_PER_PART,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the trust and distrust of its host."""
    host, path = host_and_path()
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    total = parsed.count()
    ruled = materialise(_by_rules(parsed, rules, total), "url-rules")
    seeds = ruled.groupBy("host").agg(
        F.count("*").alias("n_pages"),
        F.count_if(F.col("by_rule") == "allow").alias("trusted"),
        F.count_if(F.col("by_rule") == "block").alias("blocked"),
    )
    seeds = materialise(seeds, "url-seeds")
    links = materialise(host_links(pages.select("url", "html")), "url-links")
    trust = materialise(propagate(links, seeds, links_per_part=links_per_part), "url-trust")
    n_hosts = trust.count()
    distrusted = (F.col("distrust") * n_hosts >= least) & (
        F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    )
    hosts = seeds.select("host", "n_pages").join(trust, "host", "left").fillna(0.0, ["trust", "distrust"])
    hosts = hosts.withColumn("host_verdict", F.when(distrusted, "block").otherwise("allow"))
    return join_counted(ruled, hosts, ["host"], F.col("n_pages"), total).select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", "host_verdict").alias("verdict"), "trust", "distrust"
    )
