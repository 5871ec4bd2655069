from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from scorekit.llm import katz, queries
from tests.llm.helpers import docs_of, odd_rows, rows_of


class Plain:
    """The model as its definition says, over Python dictionaries."""

    def __init__(self, docs: list[tuple[int | None, str | None]], order: int):
        self.order, self.tokens = order, [(i, (t or "").encode().lower().split() + [b" end"]) for i, t in docs]
        self.counts = [Counter() for _ in range(order + 1)]
        for i, tokens in self.tokens:
            if not katz.held_out(i):
                padded = [b" start"] * (order - 1) + tokens
                for at in range(order - 1, len(padded)):
                    for k in range(1, order + 1):
                        self.counts[k][tuple(padded[at - k + 1 : at + 1])] += 1
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        self.d = {}
        self.after = [defaultdict(list) for _ in range(order + 1)]
        for k in range(1, order + 1):
            seen = Counter(self.counts[k].values())
            self.d[k] = katz.discounts({r: seen.get(r, 0) for r in range(1, katz.DISCOUNTED + 2)})
            for gram in self.counts[k]:
                self.after[k][gram[:-1]].append(gram[-1])

    def kept(self, k: int, count: int) -> float:
        return count * self.d[k][min(count, katz.DISCOUNTED + 1)]

    def p(self, gram: tuple) -> float:
        k, count = len(gram), self.counts[len(gram)][gram]
        words = self.after[k][gram[:-1]] if gram[:-1] in self.after[k] else []
        total = sum(self.counts[k][gram[:-1] + (w,)] for w in words)
        kept = sum(self.kept(k, self.counts[k][gram[:-1] + (w,)]) for w in words)
        if total - kept < 1e-9 * total or not total:
            total = kept + 1
        if count:
            return self.kept(k, count) / total
        if k == 1:
            return (total - kept) / total
        if not words:
            return self.p(gram[1:])
        low = sum(self.p(gram[1:-1] + (w,)) for w in words)
        return (total - kept) / total / (1 - low) * self.p(gram[1:])


def _texts(n: int) -> list[tuple[int, str]]:
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    return [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_are_those_of_the_definition(spark, order):
    docs = _texts(80) + [(100 + i, text + " unseen") for i, (_, text) in enumerate(_texts(10))]
    got = rows_of(katz.fit_and_score(docs_of(spark, [(i, t, "en", "s") for i, t in docs]), order, group_tokens=300, bucket_entries=50))
    plain = Plain(docs, order)
    want = dict(plain.tokens)
    assert len(got) == len(docs)
    for r in got:
        tokens = want[r["doc_id"]]
        padded = [b" start"] * (order - 1) + tokens
        score = sum(math.log10(plain.p(tuple(padded[at - order + 1 : at + 1]))) for at in range(order - 1, len(padded)))
        base = sum(math.log10((plain.counts[1][(t,)] + 1) / (plain.n + plain.v + 1)) for t in tokens)
        assert r["score"] == pytest.approx(score, rel=1e-9) and r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["n_tokens"] == len(tokens) and r["n_known"] == sum((t,) in plain.counts[1] for t in tokens)
        assert r["train_tokens"] == plain.n and r["held_out"] == katz.held_out(r["doc_id"])


def test_probabilities_after_every_context_sum_to_one():
    plain = Plain(_texts(60), 3)
    for context in random.Random(1).sample(sorted(plain.after[3]), 40):
        whole = sum(plain.p((*context, w)) for (w,) in plain.counts[1]) + plain.p((*context, b"never seen"))
        assert whole == pytest.approx(1, abs=1e-9)


def test_odd_rows(spark):
    got = rows_of(katz.fit_and_score(docs_of(spark, odd_rows())))
    assert len(got) == len(odd_rows())
    assert all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    assert rows_of(katz.fit_and_score(docs_of(spark, []))) == []


def test_without_training_rows_everything_is_unknown(spark):
    held = next(i for i in range(100) if katz.held_out(i))
    (r,) = rows_of(katz.fit_and_score(docs_of(spark, [(held, "a b", "en", "s")])))
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (True, 3, 0, 0)
    assert r["score"] == pytest.approx(0, abs=1e-9)


def test_the_corpus_has_a_better_score_than_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = [r for r in rows_of(katz.fit_and_score(docs)) if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_the_registered_query_is_three_words_deep(spark, tmp_path):
    docs = _texts(60)
    docs_of(spark, [(i, t, "en", "s") for i, t in docs]).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(queries.REGISTRY["op1_katz"](spark, str(tmp_path)))
    plain = Plain(docs, 3)
    want = dict(plain.tokens)
    assert len(got) == len(docs)
    for r in got:
        padded = [b" start"] * 2 + want[r["doc_id"]]
        score = sum(math.log10(plain.p(tuple(padded[at - 2 : at + 1]))) for at in range(2, len(padded)))
        assert r["score"] == pytest.approx(score, rel=1e-9)
