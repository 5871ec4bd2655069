"""Phrase collocation mining by marginalising the longest windows (operator 11).

Each word of a piece of text begins one window: itself and the words that follow it, up to the longest phrase, padded at the
piece's end. Only these windows are counted. Spark's ROLLUP then drops one column after the other from the end, and the sums
are the counts of all shorter phrases, down to words and to all words of a language.

Before that, a first pass counts pairs of neighbours by hash alone. A phrase that is frequent enough holds only pairs that are,
so a window is padded from its first rare pair on: no wanted count changes, and few different windows are left. The
frequent hashes go into a bit table sized by their counted number, up to ``MAX_BITS``; a clash, or a table that is too full, only
leaves more windows.

Defined results. NULL text: empty. NULL lang: ``und``, together with documents that say so. Texts are read whole, in pieces
with the words that follow, so that no window is lost between them. Repeated rows: each counts. doc_id is not read. Phrases
of equal score and count: in byte order. Empty table, or no frequent phrase: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorekit.llm.arrow import bounded_batches, bytes_of, give_back
from scorekit.skew import join_counted
from scorekit.workspace import materialise

#: Fixed values of the task: occurrences of a phrase at least, its words at most, and phrases reported per language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: A phrase goes if a longer one has at least this percentage of its occurrences.
INSIDE = 100
UNKNOWN = "und"

#: Bits of the table of frequent pairs: per pair, and at most (64 MB, so that each worker can hold it).
BITS_PER_PAIR, MAX_BITS = 16, 1 << 29
#: Bytes of text that are taken apart together, and words a task remembers between.
BYTES_AT_ONCE, REMEMBERED = 4 << 20, 200_000
#: First phrases of a language are found in so many parts before one task orders them.
PARTS = 64

#: A-Z in lower case, what ends a piece as a line end, what ends a word as a space.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_END = re.compile(rb"[ \n]")
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Words(dict):
    """Numbers of words from 1 on, with the hash of each; 0 is the padding."""

    def __init__(self):
        self.clear()

    def __missing__(self, word: bytes) -> int:
        self.hashes.append(xxhash.xxh64_intdigest(word))
        self.words.append(word)
        number = self[word] = len(self) + 1
        return number

    def clear(self) -> None:
        super().clear()
        self.words, self.hashes = [b""], [0]


class _Block:
    """Words of several texts: their numbers, and for each its piece, its text's language, and whether its window counts."""

    def __init__(self, texts: list[tuple[bytes, int, int]], words: _Words):
        joined = b"\n".join(t for t, _, _ in texts)
        letters = np.frombuffer(joined, np.uint8)
        gap = (letters == 32) | (letters == 10)
        starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        split = joined.split()
        self.ids = np.fromiter(map(words.__getitem__, split), np.int64, len(split))
        self.piece = np.cumsum(letters == 10, dtype=np.int32)[starts]
        sizes = np.array([len(t) + 1 for t, _, _ in texts])
        begins = np.cumsum(sizes) - sizes
        text = np.searchsorted(begins, starts, side="right") - 1
        self.lang = np.array([lang for _, _, lang in texts], np.int64)[text]
        self.own = starts - begins[text] < np.array([limit for _, limit, _ in texts])[text]

    def pairs(self, words: _Words, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each word with the next one, and which of them lie in one piece."""
        hashes = np.array(words.hashes, np.uint64)[self.ids]
        mixed = (hashes[:-1] * _A ^ (hashes[1:] * _B >> np.uint64(7))) + hashes[1:] * _C + langs[self.lang[:-1]]
        return (mixed ^ (mixed >> np.uint64(31))) * _B, self.piece[:-1] == self.piece[1:]


def _texts(batch: pa.RecordBatch, longest: int) -> Iterator[tuple[bytes, int, int]]:
    """(text, bytes whose windows count, row): texts in pieces, each with the words that its last windows reach into."""
    ahead = re.compile(rb"(?:[ ]*[^ \n]+){0,%d}" % (longest - 1))
    for row, text in enumerate(bytes_of(batch, "text")):
        plain, start = text.translate(_PLAIN), 0
        while len(plain) - start > BYTES_AT_ONCE and (end := _END.search(plain, start + BYTES_AT_ONCE)):
            yield plain[start : ahead.match(plain, end.start()).end()], end.start() - start, row
            start = end.start()
        if len(plain) > start:
            yield plain[start:], len(plain) - start, row


def _blocks(batch: pa.RecordBatch, longest: int, words: _Words) -> Iterator[tuple[_Block, list[str]]]:
    """Blocks of words of a batch (lang, text), and the languages they number."""
    langs = batch.column(0).to_pylist()
    numbers = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
    waiting, size = [], 0
    for text, limit, row in _texts(batch, longest):
        waiting.append((text, limit, numbers[langs[row]]))
        size += len(text)
        if size > BYTES_AT_ONCE:
            yield _Block(waiting, words), list(numbers)
            waiting, size = [], 0
            if len(words) > REMEMBERED:
                words.clear()
    if waiting:
        yield _Block(waiting, words), list(numbers)
        if len(words) > REMEMBERED:
            words.clear()


def _seeds(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(lang) for lang in langs], np.uint64)


def _source(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")


def _frequent_pairs(docs: DataFrame, least: int, longest: int) -> DataFrame:
    """(key): hashes of neighbours that together occur at least ``least`` times; those of every frequent pair are here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for block, langs in _blocks(batch, longest, words):
                keys, within = block.pairs(words, _seeds(langs))
                found, counts = np.unique(keys[within & block.own[:-1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["key", "n"])
        give_back(words)

    pairs = _source(docs).mapInArrow(run, "key long, n long")
    return pairs.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key")


def _bit_table(spark: SparkSession, keys: DataFrame) -> np.ndarray:
    """A table of bits, a power of two of them, with the bit at the first digits of every key set."""
    wanted = BITS_PER_PAIR * keys.count()
    bits = 64
    while bits < wanted and bits < MAX_BITS:
        bits *= 2
    placed = keys.select(F.shiftrightunsigned("key", 64 - bits.bit_length() + 1).alias("place"))
    lanes = placed.select(
        F.shiftright("place", 6).cast("int").alias("lane"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit")
    )
    found = lanes.groupBy("lane").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[found["lane"].to_numpy()] = found["bits"].to_numpy()
    return table.view(np.uint64)


def _holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(64 - (len(table) * 64).bit_length() + 1)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def windows(block: _Block, follows: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest window from each word on, one row each, and how often it occurs in the block. Column 0: the language.

    ``follows`` says of each word but the last whether the next one may be in its window. The same window may have two rows.
    """
    n = len(block.ids)
    columns = np.zeros((longest + 1, n), np.int64)
    columns[0], columns[1] = block.lang, block.ids
    alive = np.ones(n, bool)
    for k in range(1, longest):
        more = max(n - k, 0)
        alive[:more] &= follows[k - 1 :][:more]
        alive[more:] = False
        columns[k + 1, :more] = np.where(alive[:more], block.ids[k:], 0)
    columns = columns[:, block.own]
    mixed = np.zeros(columns.shape[1], np.uint64)
    for column in columns:
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _A + column.astype(np.uint64)
    order = np.argsort(mixed * _B)  # brings equal windows together; where others lie between, they stay two rows
    columns = columns[:, order]
    first = np.concatenate([[True], (columns[:, 1:] != columns[:, :-1]).any(axis=0)]) if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return columns[:, at], np.diff(np.concatenate([at, [len(order)]]))


def _names(longest: int) -> list[str]:
    return [f"w{k}" for k in range(1, longest + 1)]


def padded_windows(docs: DataFrame, table: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(lang, w1, w2, ..., n): how often each longest window occurs; columns behind its end are empty texts."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = ["lang", *_names(longest), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = _Words(), shared.value
        for batch in batches:
            for block, langs in _blocks(batch, longest, words):
                keys, within = block.pairs(words, _seeds(langs))
                columns, counts = windows(block, within & _holds(bits, keys), longest)
                texts = pa.array(words.words, pa.binary()).cast(pa.string())
                arrays = [pa.array(langs, pa.string()).take(pa.array(columns[0]))]
                arrays += [texts.take(pa.array(c)) for c in columns[1:]]
                whole = pa.RecordBatch.from_arrays([*arrays, pa.array(counts)], names=names)
                for start in range(0, whole.num_rows, 100_000):
                    yield whole.slice(start, 100_000)
        give_back(words)

    schema = ", ".join([*[f"{c} string" for c in names[:-1]], "n long"])
    found = _source(docs).mapInArrow(run, schema)
    return found.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, size, phrase, f): occurrences of every phrase of 1 to ``longest`` words that occurs ``least`` times.

    ``phrase`` is an array of words. One row per language has size 0 and counts all its words.
    """
    spark = docs.sparkSession
    table = _bit_table(spark, materialise(_frequent_pairs(docs, least, longest), "collocation-pairs"))
    names = _names(longest)
    rolled = spark.sql(
        f"select lang, {', '.join(names)}, sum(n) as f, {longest} - bit_count(grouping_id()) as size "
        f"from {{windows}} group by lang, rollup ({', '.join(names)})",
        windows=padded_windows(docs, table, longest),
    )
    words = F.slice(F.array(*names), F.lit(1), F.col("size"))
    last = F.try_element_at(F.array(*names), F.col("size"))
    kept = rolled.filter((F.col("size") == 0) | ((F.col("f") >= least) & (last != "")))
    return kept.select("lang", F.col("size").cast("int").alias("size"), words.alias("phrase"), "f")


def _scored(found: DataFrame) -> DataFrame:
    """Candidates of ``found`` (as of ``phrase_counts``) with the cut of lowest score: lang, phrase, size, a, l, r, n, score."""
    keyed = found.select("lang", "size", "phrase", F.concat_ws(" ", "phrase").alias("part"), "f")
    candidates = keyed.filter("size >= 2")
    cuts = candidates.select("lang", "part", "phrase", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    halves = F.array(
        F.struct(F.lit(True).alias("left"), F.concat_ws(" ", F.slice("phrase", F.lit(1), F.col("k"))).alias("part")),
        F.struct(F.lit(False).alias("left"), F.expr("concat_ws(' ', slice(phrase, k + 1, size(phrase) - k))").alias("part")),
    )
    parts = cuts.select("lang", F.col("part").alias("of"), "k", F.inline(halves))
    parts = materialise(parts, "collocation-parts")
    asked = parts.groupBy("lang", "part").agg(F.count("*").alias("asked"))
    answers = keyed.filter("size >= 1").select("lang", "part", "f").join(asked, ["lang", "part"])
    met = join_counted(parts, answers, ["lang", "part"], F.col("asked"), parts.count())
    halved = met.groupBy("lang", "of", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    sizes = candidates.groupBy("lang").agg(F.count("*").alias("held"))
    totals = keyed.filter("size = 0").select("lang", F.col("f").alias("n")).join(sizes, "lang")
    whole = join_counted(candidates, totals, ["lang"], F.col("held"), candidates.count()).select(
        "lang", F.col("part").alias("of"), "size", F.col("f").alias("a"), "n"
    )
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    scored = halved.join(whole, ["lang", "of"]).withColumns({f"{c}_": x for c, x in wide.items()})
    score = F.expr("(1000 * a_ * n_) div (l_ * r_)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return scored.groupBy("lang", "of", "size", "a", "n").agg(best).select(
        "lang", F.col("of").alias("phrase"), "size", "a", "best.l", "best.r", "n", "best.score"
    )


def _outside(scored: DataFrame, inside: int) -> DataFrame:
    """Candidates that lie in no longer one with ``inside`` percent of their occurrences."""
    words = F.split("phrase", " ")
    longer = scored.filter("size >= 3").select("lang", "size", "a", words.alias("words"))
    starts = longer.select("lang", "size", "a", "words", F.explode(F.expr("sequence(2, size - 1)")).alias("m"))
    parts = starts.select(
        "lang", "a", F.explode(F.expr("transform(sequence(1, size - m + 1), i -> concat_ws(' ', slice(words, i, m)))")).alias("phrase")
    )
    most = parts.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return scored.join(most, ["lang", "phrase"], "left").filter(
        F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a"))
    ).drop("most")


def _first(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language, ranked; they are sought in parts, so no task orders a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = Window.partitionBy("lang", "__part").orderBy(*order)
    cut = scored.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    cut = cut.withColumn("__rank", F.row_number().over(parts)).filter(F.col("__rank") <= top)
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).drop("__part", "__rank")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE
) -> DataFrame:
    """lang, rank, phrase (words with a space between), a, l, r, n, score of each language's first ``top`` phrases."""
    found = materialise(phrase_counts(docs, least, longest), "collocation-counts")
    scored = materialise(_scored(found), "collocation-scores")
    return _first(_outside(scored, inside), top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
