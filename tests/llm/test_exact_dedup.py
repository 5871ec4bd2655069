from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from scorekit.llm import exact_dedup
from scorekit.llm.text import with_locator
from scorekit.workspace import fresh_path
from tests.llm.helpers import docs_of, odd_rows, rows_of


def _norm(text):
    return re.sub("[ \t-\r]", "", text or "")


def _expected(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[_norm(text)].append((-len(text or ""), i is None, i if i is not None else 0))
    return groups


def _check(got, rows):
    groups = _expected(rows)
    by_sha = {hashlib.sha256(norm.encode()).hexdigest(): members for norm, members in groups.items()}
    assert len(got) == len(rows)
    for r in got:
        members = by_sha[r["text_sha256"]]
        _, no_id, best = min(members)
        assert r["group_size"] == len(members) and r["keep_id"] == (None if no_id else best)
    for sha in by_sha:
        assert sum(r["kept"] for r in got if r["text_sha256"] == sha) == 1


def test_groups_and_survivors(spark):
    rows = [(i, f"text {i % 17}" + " " * (i % 3), "en", "s") for i in range(200)] + [(500 + i, "hot text", "en", "s") for i in range(100)]
    _check(rows_of(exact_dedup.decisions(docs_of(spark, rows))), rows)


def test_full_bytes_decide_where_digests_meet(spark):
    rows = [(i, f"text {i % 23}", "en", "s") for i in range(150)]
    weak = lambda text: F.substring(exact_dedup.sha256(text), 1, 1)
    _check(rows_of(exact_dedup.decisions(docs_of(spark, rows), weak)), rows)


def test_batches_of_one_file_and_a_second_run_give_one_state(spark):
    rows = [(i, f"text {i % 5}", "en", "s") for i in range(60)]
    prints = exact_dedup.fingerprints(with_locator(docs_of(spark, rows)))
    folder, checkpoint = fresh_path(spark, "prints"), fresh_path(spark, "state")
    prints.repartition(4).write.parquet(folder)
    state = rows_of(exact_dedup.run_stream(spark, folder, 1, checkpoint))
    assert sorted(r["size"] for r in state) == [12] * 5 and {r["keep_id"] for r in state} == set(range(5))
    exact_dedup.fingerprints(with_locator(docs_of(spark, [(-1, "text 0", "en", "s"), (99, "new", "en", "s")]))).write.mode("append").parquet(folder)
    state = {r["keep_id"]: r["size"] for r in rows_of(exact_dedup.run_stream(spark, folder, 1, checkpoint))}
    assert state == {-1: 13, 1: 12, 2: 12, 3: 12, 4: 12, 99: 1}


def test_keep(spark):
    docs = docs_of(spark, [(2, "a b", "en", "s"), (1, "ab", "en", "s"), (3, "c", "en", "s")])
    kept = exact_dedup.keep(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in rows_of(kept)) == [2, 3]


def test_odd_rows(spark):
    _check(rows_of(exact_dedup.decisions(docs_of(spark, odd_rows()))), odd_rows())
    assert rows_of(exact_dedup.decisions(docs_of(spark, []))) == [] and rows_of(exact_dedup.keep(docs_of(spark, []))) == []
