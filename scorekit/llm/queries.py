"""Registered queries of this subpackage, with the production parameters of their operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorekit.llm import (
    bpe,
    collocations,
    exact_dedup,
    katz,
    kmeans_tree,
    licences,
    link_trust,
    mixing,
    ngram_join,
    repetition,
    token_files,
    toxicity,
    whitening,
)
from scorekit.llm.ship import ship

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    REGISTRY[f.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


@_query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    folder = token_files.write(_table(spark, sf_dir, "documents"), vocabulary, end_id=2)
    return token_files.read_checksums(spark, folder)


@_query
def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, vocabulary, decoded=True).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@_query
def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.concat_ws(" ", c).alias(c) for c in ("sentences", "licences", "unmatched")])


@_query
def op5_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@_query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components_of(_table(spark, sf_dir, "documents"), n=4, percent=85)


@_query
def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.fit_and_score(_table(spark, sf_dir, "documents"), order=3)


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scores(docs.select("doc_id", "lang", "text"), model).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold",
        "rejected",
    )


@_query
def op2_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


@_query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return whitened.withColumn("deviation", F.col("deviation").try_cast("long"))


@_query
def op13_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.verdicts(_table(spark, sf_dir, "documents"))
    contract = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *contract, *[m for m in repetition.MEASURES if m not in contract])
