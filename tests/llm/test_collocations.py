from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorekit.llm import collocations
from tests.llm.helpers import docs_of, odd_rows, rows_of


def plain_counts(rows, longest=5):
    found, totals = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    found[lang, tuple(words[i : i + k])] += 1
    return found, totals


def plain(rows, least, longest=5, top=2000, inside=100):
    found, totals = plain_counts(rows, longest)
    frequent = {p: n for p, n in found.items() if n >= least}
    out = []
    for (lang, words), a in frequent.items():
        if len(words) < 2:
            continue
        parts = [(found[lang, words[:k]], found[lang, words[k:]]) for k in range(1, len(words))]
        score, _, l, r = min((1000 * a * totals[lang] // (l * r), k, l, r) for k, (l, r) in enumerate(parts))
        within = any(
            other == lang and len(longer) > len(words) and 100 * f >= inside * a
            and any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
            for (other, longer), f in frequent.items()
        )
        if not within:
            out.append((lang, -score, -a, " ".join(words).encode(), l, r, totals[lang]))
    ranks, rows = Counter(), []
    for lang, score, a, phrase, l, r, n in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            rows.append((lang, ranks[lang], phrase.decode(), -a, l, r, n, -score))
    return rows


def _rows(seed, n=80):
    rng = random.Random(seed)
    words = ["the", "of", "And", "é", "世界", "a", "x\xa0y"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r"]) for _ in range(rng.randint(0, 60)))
        out.append((i, text, rng.choice(["en", "de", None, "und"]), "s"))
    return out


@pytest.mark.parametrize("least, longest, top, inside", [(5, 5, 2000, 100), (12, 3, 7, 80), (1, 5, 40, 100)])
def test_rows_equal_their_definition(spark, least, longest, top, inside):
    rows = _rows(least) + _rows(1, 5) * 3 + odd_rows()[:5]
    got = collocations.collocations(docs_of(spark, rows).repartition(4), least, longest, top, inside)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {f.dataType.simpleString() for f in got.schema.fields} == {"string", "bigint"}
    assert sorted(tuple(r.values()) for r in rows_of(got)) == sorted(plain(rows, least, longest, top, inside))


@pytest.mark.parametrize("bytes_at_once, bits", [(10, 64), (50, 1 << 29), (1, 1 << 10)])
def test_pieces_of_long_texts_and_full_bit_tables_change_nothing(spark, monkeypatch, bytes_at_once, bits):
    rows = _rows(9, 30) + [(99, " ".join(random.Random(3).choices(["the", "of", "a"], k=3000)), "en", "s")]
    monkeypatch.setattr(collocations, "BYTES_AT_ONCE", bytes_at_once)
    monkeypatch.setattr(collocations, "REMEMBERED", 2)
    monkeypatch.setattr(collocations, "MAX_BITS", bits)
    got = collocations.phrase_counts(docs_of(spark, rows), 6)
    found, totals = plain_counts(rows)
    wanted = {(lang, p): n for (lang, p), n in found.items() if n >= 6}
    wanted |= {(lang, ()): n for lang, n in totals.items() if n}
    assert {(r["lang"], tuple(r["phrase"])): r["f"] for r in rows_of(got)} == wanted


def test_pieces_of_a_text_overlap_by_what_windows_reach(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice(["a", "bc", "d"]) + rng.choice([" ", "  ", "\t", "."]) for _ in range(500)).encode()
    whole = collocations._Block([(text.translate(collocations._PLAIN), len(text), 0)], collocations._Words())
    monkeypatch.setattr(collocations, "BYTES_AT_ONCE", 20)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text.decode()])], names=["lang", "text"])
    words, every = collocations._Words(), Counter()
    for block, _ in collocations._blocks(batch, 5, words):
        columns, counts = collocations.windows(block, block.piece[:-1] == block.piece[1:], 5)
        for column, n in zip(columns.T, counts):
            every[tuple(words.words[c] for c in column[1:])] += n
    expected, names = Counter(), collocations._Words()
    again = collocations._Block([(text.translate(collocations._PLAIN), len(text), 0)], names)
    columns, counts = collocations.windows(again, again.piece[:-1] == again.piece[1:], 5)
    for column, n in zip(columns.T, counts):
        expected[tuple(names.words[c] for c in column[1:])] += n
    assert every == expected and sum(every.values()) == len(whole.ids)


def test_bit_table_holds_every_key(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 1000)
    table = collocations._bit_table(spark, spark.createDataFrame([(int(k),) for k in keys] + [(-1,), (0,)], "key long"))
    held = collocations._holds(table, np.concatenate([keys, [-1, 0]]).view(np.uint64))
    assert held.all() and len(table) * 64 == 16384
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 1000).view(np.uint64)
    assert collocations._holds(table, others).mean() < 0.2
    assert not collocations._holds(collocations._bit_table(spark, spark.createDataFrame([], "key long")), others).any()


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    rows = [("en", 0, [], 4 * 10**13), ("en", 1, ["a"], big), ("en", 1, ["b"], big + 1), ("en", 2, ["a", "b"], big - 7)]
    found = spark.createDataFrame(rows, "lang string, size int, phrase array<string>, f long")
    (row,) = rows_of(collocations._scored(found))
    assert row["score"] == 1000 * (big - 7) * 4 * 10**13 // (big * (big + 1))


def test_empty_tables_and_rare_phrases(spark):
    assert collocations.collocations(docs_of(spark, [])).collect() == []
    assert collocations.collocations(docs_of(spark, odd_rows()[:3])).collect() == []


def test_no_task_orders_a_whole_language(spark):
    many = spark.range(3000).select(
        F.lit("en").alias("lang"), F.concat(F.lit("p "), F.col("id")).alias("phrase"), (F.col("id") % 5).alias("score"), F.lit(1).alias("a")
    )
    got = collocations._first(many, 10).orderBy("rank").collect()
    wanted = sorted((f"p {i}" for i in range(3000) if i % 5 == 4))[:10]
    assert [r["phrase"] for r in got] == wanted and [r["rank"] for r in got] == list(range(1, 11))
