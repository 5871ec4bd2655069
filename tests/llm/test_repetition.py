from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorekit.llm import repetition
from tests.llm.helpers import docs_of, odd_rows, rows_of


def plain(text: str) -> list[int]:
    """The measures by their definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def inside(n: int, first: bool) -> set[int]:
        seen: dict[tuple, list[int]] = {}
        for i in range(len(words) - n + 1):
            seen.setdefault(tuple(words[i : i + n]), []).append(i)
        return {i + k for at in seen.values() if len(at) > 1 for i in (at if first else at[1:]) for k in range(n)}

    chars = lambda marked: sum(len(words[i]) for i in marked)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    again = [line for i, line in enumerate(lines) if line in lines[:i]]
    return [
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(again),
        len(inside(5, True)),
        sum(len(re.sub(r"[\x20\x09-\x0D]", "", line)) for line in again),
        *[chars(inside(n, False)) for n in repetition.LENGTHS],
    ]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "世界", "#1", "&", "\n", " \t", "\xa0"]), max_size=60), max_size=5))
def test_measures_equal_their_definition(parts):
    texts = [" ".join(p) for p in parts]
    assert repetition.measure([t.encode() for t in texts]).tolist() == [plain(t) for t in texts]


def test_hashes_that_clash_change_nothing(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abc", k=80)) for _ in range(6)]
    monkeypatch.setattr(repetition, "_mixed", lambda numbers: (numbers % 2).astype(np.uint64))
    assert repetition.measure([t.encode() for t in texts]).tolist() == [plain(t) for t in texts]


@pytest.mark.parametrize("piece", [1, 7, 100])
def test_pieces_and_groups_change_nothing(monkeypatch, piece):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["ab", "c", "dé"], k=n)) + "\n" for n in (0, 3, 50, 400, 20)]
    monkeypatch.setattr(repetition, "PIECE", piece)
    monkeypatch.setattr(repetition, "WORDS_AT_ONCE", piece)
    monkeypatch.setattr(repetition, "REMEMBERED", 1)
    assert repetition.measure([t.encode() for t in texts]).tolist() == [plain(t) for t in texts]


def test_odd_rows(spark):
    rows = odd_rows()
    got = repetition.verdicts(docs_of(spark, rows).repartition(3))
    assert got.columns == ["doc_id", *repetition.MEASURES, "base_failed", "kept"]
    found = sorted(([r[m] for m in repetition.MEASURES], r["doc_id"]) for r in rows_of(got) if r["doc_id"] is not None)
    assert found == sorted((plain(t or ""), i) for i, t, *_ in rows if i is not None)
    without = [r for r in rows_of(got) if r["doc_id"] is None]
    assert len(without) == 2 and all(r["base_failed"] and not r["kept"] for r in without)
    assert repetition.verdicts(docs_of(spark, [])).collect() == []


def test_repetitive_texts_go_and_others_stay(spark):
    rng = random.Random(6)
    clean = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(200)) for _ in range(20)]
    line = "one line of seven words and more"
    spam = [f"{c}\n" + f"{line}\n" * 40 for c in clean] + [c + " " + c for c in clean]
    rows = [(i, t, "en", "s") for i, t in enumerate(clean + spam)]
    docs = docs_of(spark, rows).withColumnRenamed("ids", "n_words")
    kept = repetition.keep(docs)
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["text"], r["n_words"]) for r in rows_of(kept)} == {(i, t, "x") for i, t in enumerate(clean)}


def test_a_verdict_beyond_the_base_rule(spark):
    """Eighteen words of a hundred are a repeat of long words: few words, many characters."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(100)]
    long = ["x" * 60 + str(i) for i in range(9)]
    text = " ".join([*words[:41], *long, *words[41:82], *long])
    (row,) = rows_of(repetition.verdicts(docs_of(spark, [(1, text, "en", "s")])))
    assert not row["base_failed"] and not row["kept"] and row["n_repeat_words"] == 18
