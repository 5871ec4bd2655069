"""What the operators on texts share: words, files of rows, and rows that can be found again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorekit.workspace import materialise

#: White space and words of every operator here, as patterns that Java, Python and RE2 read alike.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

FILE, ROW = "__file", "__row"


def or_empty(text: str | Column = "text") -> Column:
    """The text; NULL counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: str | Column = "text") -> Column:
    return F.regexp_count(or_empty(text), F.lit(WORD)).cast("long")


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased. ``bytes`` methods know ASCII only, which is what is wanted."""
    return text.lower().split()


def with_locator(docs: DataFrame) -> DataFrame:
    """Add the place of each row in its Parquet file; two rows never share one, whatever their columns hold.

    ``docs`` has to be a (filtered, projected) scan. Anything without such places is written to the shared folder first.
    """
    place = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW)]
    try:
        return docs.select("*", *place)
    except AnalysisException:
        return materialise(docs, "documents").select("*", *place)
