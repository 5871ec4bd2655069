from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs, ipc
from tokenizers import Tokenizer

from scorekit.llm import token_files
from tests.llm.helpers import docs_of, odd_rows, rows_of

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "B", " ", "  ", "\n", "É", "'s", "'", "1", "22", ".", "!!", "<|endoftext|>", "<|ENDOFTEXT|>", "\u00a0", "\u3000", "世"]
PIECES += ["😀", "THE", "the", "W", "\u030a", "\u0328", "İ", "Σ", "ς", "ß", "ﬁ", "\x1c", "\x85", "~", "##", "&", "ª", "ſ", "\u212a"]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_is_the_library(path):
    rng = random.Random(4)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(4000)]
    encoder, library = token_files.ChunkEncoder(path), Tokenizer.from_file(path)
    assert encoder.by_words == (path == WORDS)
    for text, ids in zip(texts, encoder([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def _expected(rows):
    library, start, out = Tokenizer.from_file(WORDS), 0, []
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, ids))
        start += len(ids)
    return out


def test_files_hold_every_document(spark):
    rng = random.Random(9)
    rows = [(i * 7 % 101, " ".join(rng.choices(["alpha", "beta,", "Gamma", "42"], k=rng.randint(0, 80))), "en", "s") for i in range(101)]
    folder = token_files.write(docs_of(spark, rows), WORDS, 2, sequence=16)
    got = {r["doc_id"]: r for r in rows_of(token_files.read_checksums(spark, folder))}
    index = {r["doc_id"]: r for r in rows_of(token_files.index(spark, folder))}
    for i, start, ids in _expected(rows):
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        parts = token_files.Reader(index[i]["path"]).ids(index[i]["place"], len(ids))
        assert np.concatenate(parts).tolist() == ids


def test_sequences_are_slices_of_the_mapped_file(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_SEQUENCES", 4)
    folder = token_files.write(docs_of(spark, [(1, "a b c d e " * 30, "en", "s")]), WORDS, 2, sequence=16)
    (row,) = rows_of(token_files.index(spark, folder))
    system, at = fs.FileSystem.from_uri(row["path"])
    schema = ipc.open_file(system.open_input_file(at)).schema
    assert str(schema.field("ids").type).startswith("fixed_size_list") and schema.field("ids").type.list_size == 16
    reader, stream = token_files.Reader(row["path"]), []
    for number in range(-(-row["n_tokens"] // 16)):
        ids, mask = reader.rows(number)
        assert len(ids) == len(mask) == 16 and not ids.flags.owndata
        stream += ids[mask].tolist()
        assert mask.all() or not ids[~mask].any()
    assert stream == _expected([(1, "a b c d e " * 30)])[0][2]


def test_odd_rows(spark):
    rows = odd_rows()
    folder = token_files.write(docs_of(spark, rows), WORDS, 2)
    got = sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(token_files.read_checksums(spark, folder)))
    tokens = sum(len(ids) for *_, ids in _expected(rows))
    assert len(got) == len(rows) and got[0][0] == 0 and sum(n for _, n, _ in got) == tokens
    assert sorted(c for *_, c in got) == sorted(zlib.crc32(np.array(ids, "<u4").tobytes()) for *_, ids in _expected(rows))
    empty = token_files.write(docs_of(spark, []), WORDS, 2)
    assert rows_of(token_files.read_checksums(spark, empty)) == []


def test_many_rows_of_one_id_are_many_tasks_and_files(spark):
    rng = random.Random(3)
    rows = [(None if i % 3 else 5, " ".join(rng.choices(["a", "bc", "d"], k=rng.randint(0, 30))), "en", "s") for i in range(6000)]
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # it would put so few rows into one task
    spark.conf.set(name, "false")
    try:
        folder = token_files.write(docs_of(spark, rows).repartition(4), WORDS, 2)
    finally:
        spark.conf.unset(name)
    index = rows_of(token_files.index(spark, folder))
    assert len(index) == 6000
    sizes = {}
    for r in index:
        sizes.setdefault((r["doc_id"], r["path"]), []).append(r)
    assert len({path for i, path in sizes if i is None}) > 2 and max(map(len, sizes.values())) < 2500
    got = rows_of(token_files.read_checksums(spark, folder))
    assert sorted(r["ids_crc32"] for r in got) == sorted(zlib.crc32(np.array(ids, "<u4").tobytes()) for *_, ids in _expected(rows))
    spans = sorted((r["start"], r["start"] + r["n_tokens"], r["doc_id"] is None) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] and a[2] <= b[2] for a, b in zip(spans, spans[1:]))
