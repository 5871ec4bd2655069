from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorekit.llm import link_trust
from tests.llm.helpers import rows_of

PAGES = "page_id long, url string, html string, host string, verdict string"


def _pages(spark, rows):
    return spark.createDataFrame([(i, url, html, "x", "y") for i, url, html in rows], PAGES)


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        ("https://WWW.Example.org/es/1?x#y", "www.example.org", "/es/1"),
        ("http://a.b", "a.b", ""),
        ("http://a.b?q=://c/d", "a.b", ""),
        ("x://y#z/w", "y", ""),
        ("no scheme", "", ""),
        (None, "", ""),
        ("://", "", ""),
        ("http://Ä.de/a://b", "Ä.de", "/a://b"),
    ],
)
def test_host_and_path(spark, url, host, path):
    (r,) = rows_of(link_trust.judge(_pages(spark, [(1, url, "")])))
    assert (r["host"], r["path"]) == (host, path)


def test_longest_rule_wins(spark):
    urls = {
        "http://a.org/x": ("org/", "allow"),
        "http://example.org/es/1": ("example.org/es/", "block"),
        "http://b.example.org/en/12": ("example.org/en/1", "block"),
        "http://example.org/en/2": ("org/", "allow"),
        "http://notexample.org/es/1": ("org/", "allow"),
        "http://x.com/fr/": ("com/fr/", "allow"),
        "http://x.com/fr": (None, None),
        "http://org": (None, None),
        "http://x.net/": (None, None),
    }
    got = {r["page_id"]: r for r in rows_of(link_trust.judge(_pages(spark, [(i, u, None) for i, u in enumerate(urls)])))}
    for i, (rule, verdict) in enumerate(urls.values()):
        assert got[i]["rule"] == rule and (verdict is None or got[i]["verdict"] == verdict)


def _ranks(links: dict[tuple[str, str], int], seeds: dict[str, float], hosts: list[str], damping: float) -> dict[str, float]:
    at = {h: i for i, h in enumerate(hosts)}
    flow, seed = np.zeros((len(hosts), len(hosts))), np.zeros(len(hosts))
    for (a, b), n in links.items():
        flow[at[b], at[a]] = n / sum(m for (x, _), m in links.items() if x == a)
    for h, w in seeds.items():
        seed[at[h]] = w / sum(seeds.values())
    rank = seed
    for _ in range(300):
        moved = damping * flow @ rank
        rank = moved + (1 - moved.sum()) * seed
    return dict(zip(hosts, rank, strict=True))


def test_propagation_is_pagerank_both_ways(spark):
    rng = np.random.default_rng(2)
    hosts = [f"h{i}" for i in range(30)]
    links = defaultdict(int)
    for _ in range(120):
        a, b = rng.integers(0, 30, 2)
        if a != b and a != 7:
            links[hosts[a], hosts[b]] += int(rng.integers(1, 4))
    trusted, blocked = {"h1": 3.0, "h2": 1.0}, {"h5": 2.0}
    table = spark.createDataFrame([(a, b, n) for (a, b), n in links.items()], "source string, target string, links long")
    seeds = spark.createDataFrame([(h, trusted.get(h, 0.0), blocked.get(h, 0.0)) for h in hosts], "host string, trusted double, blocked double")
    got = {r["host"]: r for r in rows_of(link_trust.propagate(table, seeds, tolerance=1e-10, links_per_part=2))}
    trust = _ranks(links, trusted, hosts, link_trust.DAMPING)
    distrust = _ranks({(b, a): n for (a, b), n in links.items()}, blocked, hosts, link_trust.DAMPING)
    for h in hosts:
        r = got.get(h)
        assert (r["trust"] if r else 0) == pytest.approx(trust[h], abs=1e-8)
        assert (r["distrust"] if r else 0) == pytest.approx(distrust[h], abs=1e-8)


def test_hosts_that_link_to_blocked_ones_are_blocked(spark):
    link = '<p><a class="x" href="https://Bad.com/de/1">a</a> <a href="/local">b</a> <a href=//good.org/>c</a>'
    rows = [(1, "http://bad.com/de/1", None), (2, "http://spam.net/1", '<a href="http://bad.com/de/1">x</a>'), (3, "http://good.org/", "")]
    rows += [(4, "http://other.net/", None), (5, "http://farm.net/", "<a href='http://spam.net/1'>x</a>"), (6, "http://fine.net/", link)]
    rows += [(7, "http://good.org/2", '<a href="http://fine.net/">x</a>')] * 2
    got = {r["page_id"]: r["verdict"] for r in rows_of(link_trust.judge(_pages(spark, rows)))}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow", 7: "allow"}


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "", ""), (1, "", ""), (2, "http://a.com/x", "<a href=http://>" * 3)]
    got = rows_of(link_trust.judge(_pages(spark, rows)))
    assert len(got) == 4 and {r["verdict"] for r in got} == {"allow"}
    assert rows_of(link_trust.judge(_pages(spark, []))) == []


def test_no_python_in_the_plan(spark):
    plan = link_trust.judge(_pages(spark, [(1, "http://a.com/x", "")])).select(F.col("verdict"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
