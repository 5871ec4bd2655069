from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from scorekit.llm import toxicity
from tests.llm.helpers import docs_of, odd_rows, rows_of

BAD = ["idiot", "scum", "trash"]


def _corpus(n: int, seed: int) -> list[tuple]:
    """Documents of gibberish; every fifth insults."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(rng.randint(5, 60))]
        if i % 5 == 0:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randint(0, len(text)), rng.choice(BAD) + rng.choice(["", ",", "!"]))
        out.append((i, " ".join(text), rng.choice(["en", "de"]), "s"))
    return out


def _aside(doc_id: int) -> bool:
    return zlib.crc32(f"aside {doc_id}".encode()) % toxicity.ASIDE == 0


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def trained(spark):
    rows = _corpus(1500, 1)
    docs = docs_of(spark, rows)
    return docs, toxicity.fit(docs, _labels(spark, [(i, 1, int(i % 5 == 0)) for i, *_ in rows]))


def test_rows_that_teach_nothing_are_recognised(spark, trained):
    docs, model = trained
    got = rows_of(toxicity.scores(docs, model).withColumn("held_out", toxicity.held_out()))
    held = [r for r in got if r["held_out"]]
    right = np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in held])
    assert len(held) > 200 and right >= 0.95
    assert np.mean([r["rejected"] == (r["doc_id"] % 5 == 0) for r in held]) >= 0.95


def test_new_texts_and_long_ones(spark, trained):
    _, model = trained
    long_text = " ".join("".join(random.Random(i).choices("abcdefgh", k=4)) for i in range(20_000))
    rows = [(1, long_text, "en", "s"), (2, f"{long_text} you idiot {long_text}", "en", "s")]
    got = {r["doc_id"]: r["score"] for r in rows_of(toxicity.scores(docs_of(spark, rows), model))}
    assert got[2] > 0.5 > got[1]


def test_pieces_and_batches_change_no_score(trained, monkeypatch):
    _, model = trained
    texts = [toxicity.hashed(t.encode()) for _, t, *_ in _corpus(40, 2)] + [np.empty(0, np.int64)]
    whole = toxicity.score(model, model.table(), texts)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert np.allclose(toxicity.score(model, model.table(), texts), whole)
    alone = np.concatenate([toxicity.score(model, model.table(), [t]) for t in texts])
    assert np.allclose(alone, whole)


def test_gradients_are_those_of_the_loss(trained):
    _, model = trained
    texts = [model.rows(toxicity.hashed(t.encode())) for _, t, *_ in _corpus(6, 3)]
    labels = np.array([1.0, 0, 0, 0, 0, 1])

    def loss() -> float:
        stream, begins, ends = toxicity._stream(model, texts)
        out = []
        for b, e in zip(begins, ends, strict=True):
            best = np.hstack(
                [max_over for w in model.filters
                 for max_over in [np.max([sum(model.embeddings[stream[t + i]] @ w[i] for i in range(len(w))) for t in range(b, e)], axis=0)]]
            )
            out.append(np.maximum(best + model.bias, 0) @ model.dense + model.offset)
        p = 1 / (1 + np.exp(-np.array(out)))
        return float(-np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)))

    gradients, _, _ = toxicity._gradients(model, texts, labels)
    for which, index in ((1, (1, 3, 2)), (2, (0, 5, 4))):
        step, w = 1e-6, model.filters[which]
        before = w[index]
        w[index] = before + step
        up = loss()
        w[index] = before - step
        down = loss()
        w[index] = before
        assert gradients[which][index] - 1e-4 * before == pytest.approx((up - down) / (2 * step), abs=1e-5)


def test_thresholds_by_language():
    scores = np.array([0.9, 0.8, 0.3, 0.2] * 10)
    assert toxicity.best_threshold(scores, np.array([1, 1, 0, 0] * 10)) == pytest.approx(0.55)
    langs = ["en", "en", "de", "de"] * 10
    got = toxicity.calibrate(scores, np.array([1, 0, 1, 0] * 10, float), langs)
    assert got["en"] == pytest.approx(0.85) and got["de"] == pytest.approx(0.25) and None in got
    assert toxicity.best_threshold(np.array([0.4]), np.array([1.0])) == 0.5


def test_clean_keeps_rows_and_columns(spark, trained):
    docs, model = trained
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in rows_of(kept.select("doc_id"))}
    gone = {r["doc_id"] for r in rows_of(toxicity.scores(docs, model).filter("rejected").select("doc_id"))}
    assert not ids & gone and len(ids) + len(gone) == docs.count()


def test_odd_rows_and_labels(spark, trained):
    _, model = trained
    got = rows_of(toxicity.scores(docs_of(spark, odd_rows()), model))
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert rows_of(toxicity.scores(docs_of(spark, []), model)) == []
    assert len(rows_of(toxicity.clean(docs_of(spark, odd_rows()), model))) <= len(odd_rows())
    docs = docs_of(spark, odd_rows())
    for labels, want in (([], 0.0), ([(1, 0, 1), (None, 0, 0), (2, 0, None)], 1.0), ([(77, 0, 0)], 0.0)):
        constant = toxicity.fit(docs, _labels(spark, labels))
        assert {r["score"] for r in rows_of(toxicity.scores(docs, constant))} == {want}
    assert toxicity.fit(docs, _labels(spark, [(901, 0, 1), (902, 0, 0), (903, 0, 0)])).constant is not None


def test_windows_of_a_long_text():
    ids = np.arange(10_000)
    assert toxicity.windows_of(ids, 10_000) is ids
    some = toxicity.windows_of(ids, 1000)
    assert len(some) == 960 and (np.diff(some) > 0).all() and some[0] > 0 or some[-1] > 5000
    assert (np.diff(some[:64]) == 1).all()


def test_an_overlong_training_text_leaves_the_others_in_the_sample(spark):
    rows = _corpus(600, 4)
    giant = " ".join("".join(random.Random(i).choices("abcdefgh", k=4)) for i in range(60_000))
    rows.append((10_001, giant, "en", "s"))
    labels = _labels(spark, [(i, 1, int(i % 5 == 0)) for i, *_ in rows[:-1]] + [(10_001, 1, 0)])
    model = toxicity.fit(docs_of(spark, rows), labels, train_words=30_000)
    got = rows_of(toxicity.scores(docs_of(spark, _corpus(200, 5)), model))
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in got]) >= 0.9


def test_rows_without_an_id_are_held_out(spark):
    (row,) = docs_of(spark, [(None, "x", "en", "s")]).select(toxicity.held_out().alias("h")).collect()
    assert row["h"]
    docs = docs_of(spark, [(None, "idiot", "en", "s"), (1, "fine", "en", "s")])
    with pytest.warns(UserWarning, match="one class"):
        model = toxicity.fit(docs, spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int"))
    assert not any(r["rejected"] for r in rows_of(toxicity.scores(docs, model)))


def test_all_labelled_rows_teach_whatever_the_size_of_a_shard(spark):
    """Counts are those of all training rows, however few a shard holds, and the network learns over shards."""
    rows = _corpus(900, 6)
    docs, labels = docs_of(spark, rows), _labels(spark, [(i, 1, int(i % 5 == 0)) for i, *_ in rows])
    model = toxicity.fit(docs, labels, train_rows=200)
    teaching = [r for r in rows_of(docs.withColumn("held", toxicity.held_out())) if not r["held"]]
    counts = {}
    for r in teaching:
        if not _aside(r["doc_id"]):
            for b in set(toxicity.hashed(r["text"].encode()).tolist()):
                counts[b] = counts.get(b, 0) + 1
    assert model.buckets.tolist() == sorted(b for b, n in counts.items() if n >= toxicity.LEAST_TEXTS)
    got = rows_of(toxicity.scores(docs_of(spark, _corpus(200, 7)), model))
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in got]) >= 0.9


def test_thresholds_from_counted_scores_equal_those_from_rows():
    rng = np.random.default_rng(3)
    scores, labels = rng.integers(0, 30, 500) / 30, rng.integers(0, 2, 500).astype(float)
    cells, where = np.unique(scores, return_inverse=True)
    hits, n = np.bincount(where, labels), np.bincount(where).astype(float)
    assert toxicity.best_threshold(cells, hits, n) == toxicity.best_threshold(scores, labels)


def test_a_text_longer_than_a_piece_teaches_whole(trained, monkeypatch):
    _, model = trained
    texts = [model.rows(toxicity.hashed(t.encode())) for _, t, *_ in _corpus(8, 8)]
    labels = np.array([1.0, 0, 0, 0, 0, 1, 0, 0])
    whole, touched, change = toxicity._gradients(model, texts, labels)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    pieces, again, changed = toxicity._gradients(model, texts, labels)
    assert all(np.allclose(a, b) for a, b in zip(whole, pieces, strict=True))
    assert np.array_equal(touched, again) and np.allclose(change, changed)
