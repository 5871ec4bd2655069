"""From raw documents to token ids: the stages of a corpus, each written to the shared folder and read again.

1. toxicity: documents that reach the threshold of their language go.
2. exact dedup: of equal texts one stays.
3. n-gram Jaccard join: of each group of near duplicates (shingles of five words, similarity 0.8) one stays.
4. mixing: sources are brought to their target weights in whole documents; some go, some are repeated.
5. BPE: every document becomes token ids, which are decoded again.

Empty tables pass every stage; NULLs, repeats and extra columns are treated as each operator states.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorekit.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from scorekit.llm.ship import ship
from scorekit.workspace import materialise


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep(docs)


def _ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.keep_one(docs, n=5, percent=80)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode(docs, vocabulary, decoded=True).select(
        "doc_id",
        "lang",
        "source",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _toxicity),
    ("exact dedup", _exact_dedup),
    ("n-gram Jaccard join", _ngram_join),
    ("mixing sources to target weights", _mixing),
    ("BPE encoding and decoding", _bpe),
]

#: The classifier is trained, so no SQL gives these rows; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
