from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from scorekit.llm import exact_dedup, mixing, ngram_join, registered, toxicity
from tests.llm.helpers import docs_of, odd_rows, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage leaves of the smallest tables."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_every_query_is_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert set(registered.SQL) <= set(registered.REGISTRY)


def test_stages_do_what_they_say(spark, stages):
    raw, clean, unique, single, mixed, encoded = stages
    columns = raw.columns
    assert all(df.columns == columns for df in stages[:-1])
    model = toxicity.fit(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r["doc_id"] for r in rows_of(toxicity.scores(raw, model).filter("rejected").select("doc_id"))}
    assert {r["doc_id"] for r in rows_of(clean)} == {r["doc_id"] for r in rows_of(raw)} - rejected
    kept = {r["doc_id"] for r in rows_of(exact_dedup.decisions(clean).filter("kept"))}
    assert {r["doc_id"] for r in rows_of(unique)} == kept
    groups = Counter(r["component_id"] for r in rows_of(ngram_join.components_of(unique)))
    assert {r["doc_id"] for r in rows_of(single)} == set(groups)
    taken = {r["doc_id"]: r["copies"] for r in rows_of(mixing.takes(single)) if r["copies"]}
    assert Counter(r["doc_id"] for r in rows_of(mixed)) == Counter(taken)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in rows_of(mixed)}
    for r in rows_of(encoded):
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == np.array(ids, "<u4").tobytes() and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_odd_rows_and_empty_tables_pass(spark, tmp_path):
    spark.createDataFrame([(901, 0, 1), (902, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (odd_rows(), []):
        docs = docs_of(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() > 0 if rows else docs.count() == 0
