from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scorekit.llm import bpe
from tests.llm.helpers import docs_of, odd_rows, rows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "  ", "\n", "\t", "é", "'s", "'", "1", "22", ".", "!!", "<|endoftext|>", "<|endof", "\u00a0", "\u3000", "世", "😀"]
PIECES += ["aaaa", "the", " th", "\r\n", "\x1c", "\x85", "İ", "ing", "\u0301", "xyzzy", "\u2003"]


@pytest.fixture(scope="module")
def both():
    return bpe.PrefixBpe(PATH), Tokenizer.from_file(PATH)


def _ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def test_random_texts(both):
    own, library = both
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choices(PIECES, k=rng.randint(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert _ids(own.encode(text)) == ids
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_every_code_point_once(both):
    own, library = both
    for c in [*range(0x3000), *range(0x3000, 0x110000, 211)]:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}1 {chr(c)}b"
            assert _ids(own.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_long_words(both):
    own, library = both
    for text in ("a" * 20000, "the" * 7000, "ab" * 3000 + "世界" * 2000, " " * 5000):
        assert _ids(own.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_broken_bytes_decode_like_the_library(both):
    own, library = both
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 20))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_small_caches_change_nothing(both, monkeypatch):
    for name in ("WORDS", "PIECES", "PAIRS"):
        monkeypatch.setattr(bpe, name, 3)
    small, library = bpe.PrefixBpe(PATH), both[1]
    text = "the cat sat on the mat and the other cat sat too " * 5
    assert _ids(small.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_odd_rows(spark, both):
    library = both[1]
    docs = docs_of(spark, odd_rows())
    got = rows_of(bpe.decode(bpe.encode(docs, PATH), PATH))
    assert len(got) == len(odd_rows())
    want = sorted(hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for _, t, *_ in odd_rows())
    assert sorted(hashlib.sha256(r["ids"]).hexdigest() for r in got) == want
    assert all(r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["ids"]) // 4 and r["score"] == "y" for r in got)
    assert rows_of(bpe.encode(docs_of(spark, []), PATH, decoded=True)) == []


def test_many_texts_at_once_in_any_pieces(both, monkeypatch):
    own, library = both
    rng = random.Random(3)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 60))) for _ in range(300)] + ["", " ".join(["the", "cat😀"] * 50)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [_ids(i) for i in own.encode_all(texts)] == want
    for name, value in (("PIECES", 7), ("WORDS", 5), ("PAIRS", 5)):
        monkeypatch.setattr(bpe, name, value)
    assert [_ids(i) for i in bpe.PrefixBpe(PATH).encode_all(texts)] == want
    assert own.encode_all([]) == []


def test_shared_prefixes_are_worked_out_once(both):
    class Counting(dict):
        steps = 0

        def __missing__(self, key):
            Counting.steps += 1
            return bpe_again._step(key)

    bpe_again, library = bpe.PrefixBpe(PATH), both[1]
    bpe_again._next = Counting()
    text = " ".join("antidisestablishmentarian" + a + b for a in "abcdefghij" for b in "klmnopqrst")
    assert _ids(bpe_again.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert Counting.steps < len(text) / 5


def test_the_pattern_of_the_basic_plane_cuts_alike():
    for c in [*range(0xD800), *range(0xE000, 0x10000)]:
        text = f"a{chr(c)}1 {chr(c)}{chr(c)}b {chr(c)}"
        assert bpe.basic_pattern().findall(text) == bpe.PATTERN.findall(text)
