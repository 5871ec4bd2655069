"""Small document tables with every odd case that the operators state a result for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: ``ids``, ``score`` and ``component`` clash with columns that operators add.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, component string"


def docs_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows (doc_id, text, lang, source) with the other columns filled in."""
    full = [(i, t, lang, source, len(t) if t is not None else None, "x", "y", "z") for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows() -> list[tuple]:
    long_text = " ".join(f"word{i % 997} of{i % 13}" for i in range(60_000))
    return [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
        (2, "The quick  brown fox\njumps over the lazy dog", "en", "a"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \t\n", "de", "b"),
        (6, long_text, "en", "b"),
        (7, "Ünïcödé ΑΣ 世界 😀 é <|endoftext|> it's", "fr", "c"),
        (7, "Ünïcödé ΑΣ 世界 😀 é <|endoftext|> it's", "fr", "c"),
        (None, "a row without an id", "es", None),
        (None, None, None, None),
        (8, "one", "en", "c"),
        (9, "The quick brown fox jumps over the lazy dog", "xx", "a"),
    ]


def rows_of(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]
