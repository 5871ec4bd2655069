"""Quality rules by repetition coverage (operator 13).

For several lengths n, the words of a text that lie inside an n-word window found earlier in the same text are marked, and
their characters are summed; so are the characters of lines equal to an earlier one. A text is kept if none of these shares
of its word characters passes its limit. The base rule counts words inside windows found twice or more, the first included.

Windows are compared by rolling hashes in numpy, for all texts of an Arrow batch together. A window of n + 1 words is found
twice only if its first n words are, so each length looks only at what the one before has left. Windows of equal hash are
compared word by word, so a clash of hashes changes no result. Texts are read to their end, in pieces of bounded size.

Defined results. NULL or empty text, or white space only: no words, all measures 0, and ``base_failed`` (fewer than 10 words).
NULL doc_id and repeated rows: a row like any other. Empty table: no rows. Extra columns: ignored by ``measures`` and ``verdicts``, kept by ``keep``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorekit.llm.arrow import bounded_batches, bytes_of, give_back, with_columns

#: Fixed values of a published rule set: for windows of so many words, the largest percentage of characters inside repeats.
LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LENGTHS = tuple(LIMITS)
#: The same for lines.
LINE_LIMIT = 20
#: The base rules: words at least, and the largest percentage of words inside repeated windows of BASE_LENGTH words.
LEAST_WORDS, BASE_LENGTH, BASE_LIMIT = 10, 5, 20

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes that do not begin a code point.
CONTINUED = bytes(range(0x80, 0xC0))

#: Texts are split in pieces of about so many bytes, and compared together up to so many words.
PIECE = 1 << 20
WORDS_AT_ONCE = 200_000
#: Words that a task remembers between groups of texts.
REMEMBERED = 200_000

_GAP = re.compile(rb"[\x20\x09-\x0D]")
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")
MEASURES = (*COUNTS, *(f"dup_{n}_chars" for n in LENGTHS))


class _Words(dict):
    """Numbers of words in order of appearance, with their length in code points."""

    def __init__(self):
        self.lengths: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self.lengths.append(code_points(word))
        number = self[word] = len(self)
        return number

    def clear(self) -> None:
        super().clear()
        self.lengths.clear()


def code_points(text: bytes) -> int:
    return len(text.translate(None, CONTINUED))


def _pieces(text: bytes) -> Iterator[bytes]:
    start = 0
    while len(text) - start > PIECE and (gap := _GAP.search(text, start + PIECE)):
        yield text[start : gap.start()]
        start = gap.end()
    yield text[start:] if start else text


def _numbers(text: bytes, words: _Words) -> np.ndarray:
    found = [np.fromiter(map(words.__getitem__, split), np.int64, len(split)) for split in map(bytes.split, _pieces(text))]
    return found[0] if len(found) == 1 else np.concatenate(found)


def _mixed(numbers: np.ndarray) -> np.ndarray:
    x = (numbers.astype(np.uint64) + np.uint64(1)) * _ODD
    return (x ^ (x >> np.uint64(29))) * _MIX


def _repeats(words: np.ndarray, text: np.ndarray, at: np.ndarray, hashed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the windows that begin ``at`` (ascending) are found at least twice in their text, and which earlier in it."""
    order = np.argsort(hashed, kind="stable")
    left, right = at[order[:-1]], at[order[1:]]
    same = hashed[order[1:]] == hashed[order[:-1]]
    left, right = left[same], right[same]
    equal = text[left] == text[right]
    for k in range(n):
        equal &= words[left + k] == words[right + k]
    if not equal.all():  # different windows share a hash: number them by their words
        rows = np.column_stack([text[at], *[words[at + k] for k in range(n)]])
        return _repeats(words, text, at, np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1), n)
    again = np.zeros(len(at), bool)
    again[order[1:]] = same
    twice = again.copy()
    twice[order[:-1]] |= same
    return twice, again


def _inside(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie inside a window of ``n`` words that begins ``at``."""
    change = np.bincount(at, minlength=size + 1) - np.bincount(at + n, minlength=size + 1)
    return np.cumsum(change[:size]) > 0


def inside_repeats(
    words: np.ndarray, text: np.ndarray, lengths: tuple[int, ...] = LENGTHS
) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each window length, which words lie inside a window found twice or more in their text, and found earlier in it.

    ``words`` are the numbers of the words of several texts, one after the other; ``text`` says which text each belongs to.
    """
    marks = {}
    mixed = _mixed(words)
    at = np.arange(len(words))
    hashed = _mixed(text)
    done = 0
    for n in sorted(lengths):
        at, hashed = at[at + n <= len(words)], hashed[at + n <= len(words)]
        within = text[at] == text[at + n - 1]
        at, hashed = at[within], hashed[within]
        for k in range(done, n):
            hashed = hashed * _MIX + mixed[at + k]
        done = n
        twice, again = _repeats(words, text, at, hashed, n) if len(at) else (at > 0, at > 0)
        later = at[again]
        at, hashed = at[twice], hashed[twice]
        marks[n] = _inside(at, n, len(words)), _inside(later, n, len(words))
    return marks


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that are equal to an earlier one, and the characters of their words."""
    if b"\n" not in text:
        return 0, 0
    seen = Counter(text.split(b"\n"))
    repeated = [(line, n) for line, n in seen.items() if n > 1 and line.strip(SPACES)]
    characters = sum((n - 1) * code_points(line.translate(None, SPACES)) for line, n in repeated)
    return sum(n - 1 for _, n in repeated), characters


def _measured(texts: list[bytes], words: _Words) -> np.ndarray:
    """One row of MEASURES per text."""
    numbers = [_numbers(t, words) for t in texts]
    sizes = np.array([len(x) for x in numbers])
    text = np.repeat(np.arange(len(texts)), sizes)
    every = np.concatenate(numbers)
    lengths = np.array(words.lengths or [0], np.int64)[every]
    marks = inside_repeats(every, text)
    out = np.zeros((len(texts), len(MEASURES)), np.int64)
    out[:, 0] = sizes
    out[:, 1] = [code_points(t.translate(None, SPACES)) for t in texts]
    out[:, 2] = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
    lines = [_lines(t) for t in texts]
    out[:, 3], out[:, 5] = [x[0] for x in lines], [x[1] for x in lines]
    out[:, 4] = np.bincount(text[marks[BASE_LENGTH][0]], minlength=len(texts))
    for i, n in enumerate(LENGTHS):
        inside = marks[n][1]
        out[:, len(COUNTS) + i] = np.bincount(text[inside], weights=lengths[inside], minlength=len(texts)).astype(np.int64)
    return out


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts that are compared together; a long one makes a group of its own."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > 5 * WORDS_AT_ONCE:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def measure(texts: list[bytes], words: _Words | None = None) -> np.ndarray:
    """One row of MEASURES for each UTF-8 text."""
    words = words if words is not None else _Words()
    rows = []
    for group in _groups(texts):
        if len(words) > REMEMBERED:
            words.clear()
        rows.append(_measured(group, words))
    return np.concatenate(rows) if rows else np.zeros((0, len(MEASURES)), np.int64)


def measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: the columns ``keep`` (default: doc_id) and the MEASURES of its whole text, as long."""
    keep = ["doc_id"] if keep is None else keep
    bounded_batches(docs.sparkSession)
    source = docs.select(*[F.col(f"`{c}`") for c in keep if c not in MEASURES], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            found = measure(bytes_of(batch, "__text"), words)
            columns = {name: pa.array(found[:, i]) for i, name in enumerate(MEASURES)}
            yield with_columns(batch.drop_columns(["__text"]), **columns)
        give_back(words)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return source.mapInArrow(run, ", ".join([*kinds, *[f"{m} long" for m in MEASURES]]))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > BASE_LIMIT * F.col("n_words"))


def covered(limits: dict[int, int] = LIMITS, line_limit: int = LINE_LIMIT) -> Column:
    """Whether the repeats of some length, or repeated lines, cover more of a text than they may."""
    above = 100 * F.col("dup_line_chars") > line_limit * F.col("word_chars")
    for n, limit in limits.items():
        above = above | (100 * F.col(f"dup_{n}_chars") > limit * F.col("word_chars"))
    return above


def verdicts(docs: DataFrame, limits: dict[int, int] = LIMITS, line_limit: int = LINE_LIMIT, text: str = "text") -> DataFrame:
    """doc_id, the MEASURES, base_failed and kept of each document. ``limits``: percentages for lengths of LENGTHS."""
    return measures(docs, text).select(
        "*", base_failed().alias("base_failed"), (~base_failed() & ~covered(limits, line_limit)).alias("kept")
    )


def keep(docs: DataFrame, limits: dict[int, int] = LIMITS, line_limit: int = LINE_LIMIT) -> DataFrame:
    """The documents that pass the rules, whole, with all their columns."""
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    whole = renamed.withColumn("text", F.col(f"c{docs.columns.index('text')}"))
    judged = measures(whole, keep=renamed.columns).filter(~base_failed() & ~covered(limits, line_limit))
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
