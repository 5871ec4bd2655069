from __future__ import annotations

import random

import numpy as np
import pytest

from scorekit.llm import components as components_module
from scorekit.llm import ngram_join
from scorekit.llm.components import components
from tests.llm.helpers import docs_of, odd_rows, rows_of


def _set(text: str | None, n: int) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def _expected(rows: list[tuple], n: int, percent: int) -> list[tuple]:
    sets, root = [_set(t, n) for _, t, *_ in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, row in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((row[0], len(sets[i]), min(ids, default=None) if sets[i] else row[0]))
    return sorted(out, key=str)


def _got(df, n, percent):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(ngram_join.components_of(df, n, percent))), key=str)


def _edited(rng: random.Random, words: list[str], share: float) -> list[str]:
    out = list(words)
    for _ in range(int(share * len(words))):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[at] = rng.choice("pqrstuvw") * 3
        elif kind < 0.7:
            del out[at]
        else:
            out.insert(at, rng.choice("klmno") * 2)
    return out or ["x"]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_near_copies(spark, n, percent):
    rng = random.Random(n)
    rows, words = [], [f"w{i}" for i in range(300)]
    passage = rng.choices(words, k=60)
    for _ in range(30):
        base = rng.choices(words, k=rng.choice([1, 3, 8, 20, 60, 150])) + (passage if rng.random() < 0.4 else [])
        rows += [(len(rows) * 3 + 1, " ".join(base), "en", "s")]
        for _ in range(rng.randint(0, 5)):
            rows.append((len(rows) * 3 + 1, " ".join(_edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06]))), "en", "s"))
    rng.shuffle(rows)
    assert _got(docs_of(spark, rows), n, percent) == _expected(rows, n, percent)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = [(i, " ".join(_edited(rng, base, rng.choice([0.01, 0.02, 0.03, 0.05]))), "en", "s") for i in range(400)]
    assert _got(docs_of(spark, rows), 4, 85) == _expected(rows, 4, 85)


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_similar_sets_agree_in_as_many_blocks_as_are_asked_for(percent):
    rng = np.random.default_rng(percent)
    seen = 0
    while seen < 1500:
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 400), np.uint64))
        kept = a[rng.random(len(a)) > rng.random() * 0.3]
        b = np.unique(np.r_[kept, rng.integers(0, 2**64, rng.integers(0, max(2, len(a) // 6)), np.uint64)])
        both = len(np.intersect1d(a, b))
        if not both or 100 * both < percent * (len(a) + len(b) - both):
            continue
        seen += 1
        (x, fills), (y, _) = (ngram_join.signatures(s, percent) for s in (a, b))
        differences = len(a) + len(b) - 2 * ngram_join.least_overlap(len(a) + len(b), percent)
        level = ngram_join.level_of(differences)
        common = np.intersect1d(x, y)
        counted = ((common & ngram_join.PREFIX) == level).sum()
        filled = fills[(x & ngram_join.PREFIX) == level]
        assert len(filled) and (counted >= max(1, filled[0] - differences) or ((common & ngram_join.PREFIX) == ngram_join.PREFIX).any())


@pytest.mark.parametrize("bits", [1 << 15, 1 << 20])
def test_bitmaps_and_parts_of_any_size_change_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(ngram_join, "MOST_BITS", bits)
    monkeypatch.setattr(ngram_join, "BITS_PER_KEY", 10_000)
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(ngram_join, "ROLES_PER_READ", 2)
    monkeypatch.setattr(components_module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngram_join, "TILE", 8)
    monkeypatch.setattr(ngram_join, "PAIRS_PER_PART", 3)
    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    rows = [(i, " ".join(_edited(rng, base, 0.04)), "en", "s") for i in range(60)]
    rows += [(100 + i, rows[i % 3][1], "en", "s") for i in range(40)] + [(200 + i, "copies of one text", "en", "s") for i in range(40)]
    assert _got(docs_of(spark, rows), 4, 85) == _expected(rows, 4, 85)


@pytest.mark.parametrize("rows", [0, 200_000])
def test_components(spark, monkeypatch, rows):
    monkeypatch.setattr(components_module, "BROADCAST_ROWS", rows)
    rng = random.Random(6)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    root: dict[int, int] = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in rows_of(components(spark.createDataFrame(links, "a long, b long")))}
    assert all(got.get(i, i) == find(i) for i in list(root))
    assert rows_of(components(spark.createDataFrame([], "a long, b long"))) == []


def test_keep_one_and_odd_rows(spark):
    docs = docs_of(spark, odd_rows())
    assert _got(docs, 4, 85) == _expected(odd_rows(), 4, 85)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in rows_of(kept)]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 8] and ids.count(None) == 2
    assert _got(docs_of(spark, []), 4, 85) == [] and rows_of(ngram_join.keep_one(docs_of(spark, []))) == []


def test_a_block_of_thousands_of_classes(spark):
    """Short texts that differ in one word share the elements of their prefixes, all with all."""
    rows = [(i, f"one two three four five six seven eight nine w{i}", "en", "s") for i in range(3000)]
    got = _got(docs_of(spark, rows), 1, 80)
    assert {r[2] for r in got} == {0} and len(got) == 3000


@pytest.fixture
def many_partitions(spark):
    """A session whose shuffles have 64 partitions, none of them put together afterwards."""
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_a_bitmap_takes_few_jobs_however_many_partitions(spark, many_partitions):
    keys = spark.range(5000).selectExpr("xxhash64(id) as key")
    spark.sparkContext.setJobGroup("bitmap", "bitmap")
    bitmap = ngram_join._bitmap(keys)
    spark.sparkContext.setJobGroup("other", "other")
    assert ngram_join._held(bitmap, keys.toArrow()["key"].to_numpy()).all()
    # One for each piece, and some for the count and the shuffle.
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap")) <= 12


def test_rounds_over_few_links_have_few_tasks(spark, many_partitions):
    edges = spark.range(1, 400).selectExpr("id as a", "id - 1 as b")
    most = spark.sparkContext.defaultParallelism
    assert components_module._large_star(edges, 399).rdd.getNumPartitions() <= most
    assert components_module._small_star(edges, 399).rdd.getNumPartitions() <= most
