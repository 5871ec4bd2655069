"""Toxicity by a convolutional text classifier (operator 7).

Words are hashed into a wide space; buckets that occur in enough training texts have an embedding, all others share one.
Filters of several widths slide over the whole text, the strongest response of each is kept, and a logistic layer makes a
score of them. The network learns from the whole text of every labelled row that is not held out: the rows are dealt by hash
to shards, a task trains a copy of the network on each shard, batch by batch, and after each pass over all rows Spark adds up
the changes of the copies; a weight moves by their mean, an embedding by the mean of the shards that hold its word. Which
words have an embedding follows from counts over all training rows. One in ``ASIDE`` rows is set aside; all of those choose,
for each language, the threshold of best F1, on a grid of scores; the language is never an input of a score.

For scoring, the product of each embedding with each filter column is tabulated once and broadcast (its size is bounded by
``MAX_WORDS``), so a text of any length is a stream of table rows, handled in pieces of bounded size.

Defined results. NULL or empty text: scored like a text without known words. NULL doc_id: scored; held out, like an empty id.
Labels: rows with a NULL or without a document teach nothing; a document with both labels teaches both. No usable labels, or
of one class only: every score is the share of label 1 (0 without any) and nothing is rejected; a warning says so if there are
labels of both. Repeated rows: each teaches and is scored. Empty table: no rows. Extra columns: ignored by ``scores``, kept by ``clean``.
"""

from __future__ import annotations

import copy
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorekit.llm.arrow import bounded_batches, bytes_of, give_back
from scorekit.skew import BROADCAST_ROWS
from scorekit.workspace import release, write_compact

#: Labelled rows, and words of their texts, from which a further shard is worth it; and shards at most.
TRAIN_ROWS = 6000
TRAIN_WORDS = 6_000_000
SHARDS = 16
#: Hash space of words; buckets with an embedding at most, and the training texts that one has to be in at least.
SPACE_BITS = 24
MAX_WORDS = 1 << 16
LEAST_TEXTS = 4

DIMENSION, FILTERS, WIDTHS = 16, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 8, 32, 0.02
#: Of the sample, one in so many rows is set aside for the thresholds.
ASIDE = 4
#: A language with fewer rows of a class than this, set aside, takes the threshold of all.
LEAST_ROWS = 10
#: Words of a window of a long text.
WINDOW = 64
PIECE = 1 << 15
#: Steps of the grid of scores on which thresholds are chosen.
GRID = 10_000
#: Embeddings whose changes travel together.
PART_WORDS = 4096

WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def hashed(text: bytes) -> np.ndarray:
    """The buckets of a text's words (letters and digits, A-Z lower-cased)."""
    seen = _hashes
    found = WORD.findall(text.lower())
    return np.fromiter(map(seen.__getitem__, found), np.int64, len(found))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) & ((1 << SPACE_BITS) - 1)
        return value


_hashes = _Hashes()


@dataclass
class Model:
    """``buckets`` (sorted) own rows 1.. of the embeddings; row 0 is every other word, the last row is padding."""

    buckets: np.ndarray
    embeddings: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: float
    constant: float | None = None
    thresholds: dict[str | None, float] = field(default_factory=dict)

    @property
    def pad(self) -> int:
        return len(self.embeddings) - 1

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        """Embedding rows of buckets."""
        if not len(self.buckets):
            return np.zeros(len(buckets), np.int32)
        at = np.searchsorted(self.buckets, buckets)
        at[at == len(self.buckets)] = 0
        return np.where(self.buckets[at] == buckets, at + 1, 0).astype(np.int32)

    def table(self) -> np.ndarray:
        """Each embedding times each filter column, side by side: width 1, then both columns of width 2, and so on."""
        return np.hstack([self.embeddings @ column for w in self.filters for column in w]).astype(np.float32)


def _stream(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as one stream of rows with padding between them; where each begins and ends. Empty texts are one padding."""
    pad = np.full(max(WIDTHS) - 1, model.pad, np.int32)
    parts, begins, ends, at = [], [], [], 0
    for text in texts:
        rows = text if len(text) else np.array([model.pad], np.int32)
        parts += [rows, pad]
        begins.append(at)
        ends.append(at + len(rows))
        at += len(rows) + len(pad)
    return np.concatenate(parts), np.array(begins), np.array(ends)


def _responses(table: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Responses of all filters to the ``n`` windows that begin first in ``rows``."""
    looked, out, column = table[rows], [], 0
    for width in WIDTHS:
        total = looked[:n, column : column + FILTERS].copy()
        for i in range(1, width):
            total += looked[i : n + i, column + i * FILTERS : column + (i + 1) * FILTERS]
        out.append(total)
        column += width * FILTERS
    return np.hstack(out)


def pooled(model: Model, table: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """The strongest response of each filter in each text, piece by piece."""
    stream, begins, ends = _stream(model, texts)
    best = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
    for start in range(0, len(stream), PIECE):
        end = min(start + PIECE, len(stream))
        got = _responses(table, np.r_[stream[start : end + max(WIDTHS) - 1], [model.pad] * (max(WIDTHS) - 1)], end - start)
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(begins, end, "left")
        if first == last:
            continue
        lo, hi = np.maximum(begins[first:last], start) - start, np.minimum(ends[first:last], end) - start
        cuts = np.stack([lo, hi], 1).ravel()
        padded = np.vstack([got, np.full((1, got.shape[1]), -np.inf, np.float32)])
        best[first:last] = np.maximum(best[first:last], np.maximum.reduceat(padded, cuts, axis=0)[::2])
    return best


def score(model: Model, table: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Scores of texts given as buckets."""
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    return scored(model, table, [model.rows(t) for t in texts])


def scored(model: Model, table: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Scores of texts given as embedding rows."""
    if not texts:
        return np.empty(0)
    strongest = pooled(model, table, texts).astype(np.float64)
    return 1 / (1 + np.exp(-(np.maximum(strongest + model.bias, 0) @ model.dense + model.offset)))


# ---- training ----------------------------------------------------------------------------------------------------------


def _new(buckets: np.ndarray, seed: int = 7) -> Model:
    """A network that has not learned yet, with embeddings for ``buckets`` (sorted)."""
    rng = np.random.default_rng(seed)
    model = Model(
        buckets,
        rng.normal(0, 0.1, (len(buckets) + 2, DIMENSION)),
        [rng.normal(0, (w * DIMENSION) ** -0.5, (w, DIMENSION, FILTERS)) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS)),
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)),
        0.0,
    )
    model.embeddings[-1] = 0
    return model


class _Learner:
    """A network with what its steps remember: moments of the dense parts, and squared changes of the embeddings."""

    def __init__(self, model: Model):
        self.model, self.step = model, 0
        self.dense = [*model.filters, model.bias, model.dense, np.zeros(1)]
        self.moments = [np.zeros_like(p) for p in self.dense for _ in range(2)]
        self.squares = np.full(len(model.embeddings), 1e-6)

    def flat(self) -> np.ndarray:
        """Everything but the embeddings, as one row of numbers."""
        return np.concatenate([x.ravel() for x in (*self.dense, *self.moments)])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for x in (*self.dense, *self.moments):
            x[...] = values[at : at + x.size].reshape(x.shape)
            at += x.size
        self.model.offset = float(self.dense[-1][0])

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, rate: float) -> None:
        """One step: texts as embedding rows, labels 0/1."""
        model, self.step = self.model, self.step + 1
        gradients, touched, change = _gradients(model, texts, labels)
        for k, (p, g) in enumerate(zip(self.dense, gradients, strict=True)):
            m, v = self.moments[2 * k : 2 * k + 2]
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= rate * 0.5 * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
        model.offset = float(self.dense[-1][0])
        self.squares[touched] += (change**2).mean(axis=1)
        model.embeddings[touched] -= rate * 5 * change / np.sqrt(self.squares[touched])[:, None]
        model.embeddings[-1] = 0


def _strongest(model: Model, stream: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the stream each text has the strongest response of each filter, and that response; by pieces of the stream."""
    at = np.zeros((len(begins), FILTERS * len(WIDTHS)), np.int64)
    best = np.full(at.shape, -np.inf)
    for start in range(0, len(stream) - max(WIDTHS) + 1, PIECE):
        end = min(start + PIECE, len(stream) - max(WIDTHS) + 1)
        looked, n = model.embeddings[stream[start : end + max(WIDTHS) - 1]], end - start
        responses = np.hstack([sum(looked[i : n + i] @ w[i] for i in range(len(w))) for w in model.filters])
        for text in range(np.searchsorted(ends, start, "right"), np.searchsorted(begins, end, "left")):
            first = max(begins[text], start)
            own = responses[first - start : ends[text] - start]
            place = own.argmax(0)
            value = own[place, np.arange(own.shape[1])]
            better = value > best[text]
            at[text, better], best[text, better] = (place + first)[better], value[better]
    return at, best


def _gradients(model: Model, texts: list[np.ndarray], labels: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Gradients of the mean log loss: of the dense parts, and of the embeddings that the strongest windows touch."""
    stream, begins, ends = _stream(model, texts)
    at, found = _strongest(model, stream, begins, ends)
    strongest = found + model.bias
    active = np.maximum(strongest, 0)
    p = 1 / (1 + np.exp(-(active @ model.dense + model.offset)))
    error = (p - labels) / len(labels)
    back = error[:, None] * model.dense * (strongest > 0)
    gradients: list[np.ndarray] = []
    tokens, changes = [], []
    for k, w in enumerate(model.filters):
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        gradient = np.zeros_like(w)
        for i in range(len(w)):
            windows = stream[at[:, own] + i]
            gradient[i] = np.einsum("df,dfe->ef", back[:, own], model.embeddings[windows])
            tokens.append(windows.ravel())
            changes.append((back[:, own, None] * w[i].T[None]).reshape(-1, DIMENSION))
        gradients.append(gradient + 1e-4 * w)
    touched, where = np.unique(np.concatenate(tokens), return_inverse=True)
    change = np.zeros((len(touched), DIMENSION))
    np.add.at(change, where, np.concatenate(changes))
    gradients += [back.sum(0), active.T @ error + 1e-4 * model.dense, np.array([error.sum()])]
    return gradients, touched, change


def best_threshold(scores: np.ndarray, labels: np.ndarray, rows: np.ndarray | None = None) -> float:
    """The threshold of best F1; in the middle between two scores. 0.5 where labels are all alike.

    ``rows``: how many rows have the score; ``labels`` are then how many of them have label 1.
    """
    rows = np.ones(len(labels)) if rows is None else rows
    if not len(labels) or labels.sum() in (0, rows.sum()):
        return 0.5
    order = np.argsort(-scores, kind="stable")
    ranked, hits = scores[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.cumsum(rows[order]) + labels.sum())
    last = np.r_[ranked[1:] < ranked[:-1], True]
    at = int(np.argmax(np.where(last, f1, -1)))
    return float((ranked[at] + (ranked[at + 1] if at + 1 < len(ranked) else 0)) / 2)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that teach nothing: one in five, by a checksum of the id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def windows_of(ids: np.ndarray, most: int) -> np.ndarray:
    """All of a text's words, or of a longer one windows of WINDOW words, chosen by hash over the whole text, in order."""
    if len(ids) <= most:
        return ids
    blocks = len(ids) // WINDOW
    order = sorted(range(blocks), key=lambda b: xxhash.xxh64_intdigest(b"%d" % b))
    chosen = sorted(order[: max(1, most // WINDOW)])
    return np.concatenate([ids[b * WINDOW : (b + 1) * WINDOW] for b in chosen])


def _untaught(share: float) -> Model:
    """A model that has learned nothing: it gives every text one score and rejects none."""
    filters = [np.zeros((w, DIMENSION, FILTERS)) for w in WIDTHS]
    flat = np.zeros(FILTERS * len(WIDTHS))
    return Model(np.empty(0, np.int64), np.zeros((2, DIMENSION)), filters, flat, flat, 0.0, share, {None: float("inf")})


LABELLED = "lang string, toxic int, aside boolean, mixed long, ids binary"


def _labelled(docs: DataFrame, usable: DataFrame, n: int) -> DataFrame:
    """One row per usable label and document: (lang, toxic, aside, mixed, ids), the text as buckets. Written once."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([hashed(t).astype("<u4").tobytes() for t in bytes_of(batch, "text")], pa.binary())
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], ids], names=[*names, "ids"])
        give_back(_hashes)

    texts = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").filter(~held_out())
    schema = f"doc_id {kind}, lang string, ids binary"
    if n <= BROADCAST_ROWS:
        met = texts.join(F.broadcast(usable), "doc_id").select("doc_id", "lang", "toxic", "text")
        met = met.mapInArrow(run, f"doc_id {kind}, lang string, toxic int, ids binary")
    else:
        met = texts.mapInArrow(run, schema).join(usable, "doc_id")
    aside = F.crc32(F.concat(F.lit("aside "), F.col("doc_id").cast("string")).cast("binary")) % ASIDE == 0
    mixed = F.xxhash64("doc_id", "toxic", "ids")
    return write_compact(met.select("lang", "toxic", aside.alias("aside"), mixed.alias("mixed"), "ids"), "toxicity")


def _vocabulary(rows: DataFrame) -> np.ndarray:
    """The buckets, sorted, that are in enough of the training texts; the most frequent MAX_WORDS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(np.frombuffer(t.as_buffer(), "<u4")) for t in batch.column(0)]
            every, counts = np.unique(np.concatenate([np.empty(0, "<u4"), *own]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(every.astype(np.int64)), pa.array(counts)], names=["bucket", "n"])

    counted = rows.select("ids").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    often = counted.filter(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "bucket").limit(MAX_WORDS - 2)
    return np.sort(often.select("bucket").toArrow()["bucket"].to_numpy().astype(np.int64))


def _coded(rows: DataFrame, buckets: np.ndarray) -> DataFrame:
    """Texts as rows of the embeddings, two bytes a word. Written once."""
    shared = rows.sparkSession.sparkContext.broadcast(_new(buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            ids = [shared.value.rows(np.frombuffer(t.as_buffer(), "<u4").astype(np.int64)).astype("<u2").tobytes() for t in batch.column(at)]
            yield batch.set_column(at, "ids", pa.array(ids, pa.binary()))

    return write_compact(rows.mapInArrow(run, LABELLED), "toxicity")


def _pass(rows: DataFrame, learner: _Learner, epoch: int, shards: int) -> None:
    """One pass over all training rows: each shard trains a copy, and the learner takes the copies' changes together."""
    shared = rows.sparkSession.sparkContext.broadcast(learner)
    rate = RATE * (1 - epoch / EPOCHS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, begun = copy.deepcopy(shared.value), shared.value
        waiting: list[tuple[np.ndarray, int]] = []
        taught = 0

        def step() -> None:
            own.learn([t for t, _ in waiting], np.array([y for _, y in waiting], float), rate)
            waiting.clear()

        for batch in batches:
            shard = batch.column("shard")[0].as_py()
            taught += batch.num_rows
            for t, y in zip(batch.column("ids"), batch.column("toxic").to_pylist(), strict=True):
                waiting.append((np.frombuffer(t.as_buffer(), "<u2").astype(np.int32), y))
                if len(waiting) >= BATCH:
                    step()
        if waiting:
            step()
        # The dense parts go as -1, weighted by rows; of the embeddings only those that have changed.
        out = [(-1, shard, np.r_[taught * own.flat(), taught, own.step].tobytes())]
        change = np.c_[own.model.embeddings - begun.model.embeddings, own.squares - begun.squares, own.squares != begun.squares]
        for part, first in enumerate(range(0, len(change), PART_WORDS)):
            if change[first : first + PART_WORDS, -1].any():
                out.append((part, shard, change[first : first + PART_WORDS].tobytes()))
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "shard", "body"])

    def add(table: pa.Table) -> pa.Table:
        bodies = table.sort_by("shard").column("body")
        # Steps are not summed: all copies begin with the same number, and the next pass goes on from the greatest.
        arrays = [np.frombuffer(x.as_buffer(), np.float64) for x in bodies]
        whole = sum(arrays)
        if table.column("part")[0].as_py() < 0:
            whole[-1] = max(x[-1] for x in arrays)
        return pa.table({"part": table.column("part")[:1].cast(pa.int32()), "body": pa.array([whole.tobytes()], pa.binary())})

    dealt = rows.select(F.pmod("mixed", F.lit(shards)).cast("int").alias("shard"), F.xxhash64("mixed", F.lit(epoch)).alias("mixed"), "toxic", "ids")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "mixed")
    # Most shuffle partitions hold no shard and no part; each task of each pass would leave its record on the driver.
    changes = dealt.groupBy("shard").applyInArrow(run, "part int, shard int, body binary").coalesce(4 * SHARDS)
    found = changes.groupBy("part").applyInArrow(add, "part int, body binary").coalesce(SHARDS).collect()
    shared.destroy()
    for r in found:
        body = np.frombuffer(r["body"], np.float64)
        if r["part"] < 0:
            learner.set_flat(body[:-2] / body[-2])
            learner.step = int(body[-1])
        else:
            body = body.reshape(-1, DIMENSION + 2)
            own = slice(r["part"] * PART_WORDS, r["part"] * PART_WORDS + len(body))
            copies = np.maximum(body[:, -1], 1)
            learner.model.embeddings[own] += body[:, :DIMENSION] / copies[:, None]
            learner.squares[own] += body[:, DIMENSION] / copies


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_words: int = TRAIN_WORDS) -> Model:
    """Train on all rows of ``labels`` (doc_id, toxic) that are not held out; see above. A shard holds about ``train_rows``
    rows or ``train_words`` words of texts, and more once there are ``SHARDS`` shards; a task holds a batch of them at a time."""
    spark = docs.sparkSession
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    usable = usable.filter(~held_out())
    found = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return _untaught(float(next(iter(found), 0)))
    prior = found[1] / (found[0] + found[1])
    rows = _labelled(docs, usable, found[0] + found[1])
    counts = rows.filter("not aside").groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.length("ids")).alias("size")).collect()
    if len(counts) < 2:
        warnings.warn("the sample of labelled texts holds one class only; nothing is rejected", stacklevel=2)
        return _untaught(prior)
    n, words = sum(r["n"] for r in counts), sum(r["size"] for r in counts) // 4
    shards = min(SHARDS, max(1, -(-n // train_rows), -(-words // train_words)))
    buckets = _vocabulary(rows.filter("not aside"))
    coded = _coded(rows, buckets)
    release(spark, rows)
    learner = _Learner(_new(buckets))
    for epoch in range(EPOCHS):
        _pass(coded.filter("not aside"), learner, epoch, shards)
        release(spark)
    share = sum(r["n"] for r in counts if r["toxic"]) / n
    model = learner.model
    model.offset += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    model.thresholds = _thresholds(coded.filter("aside"), model)
    release(spark, coded)
    return model


def _thresholds(rows: DataFrame, model: Model) -> dict[str | None, float]:
    """Thresholds from all rows set aside: their scores are counted on a grid, by language."""
    shared = rows.sparkSession.sparkContext.broadcast((model, model.table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, table = shared.value
        for batch in batches:
            got = scored(trained, table, [np.frombuffer(t.as_buffer(), "<u2").astype(np.int32) for t in batch.column("ids")])
            cell = np.floor(got * GRID + 0.5).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(cell)], names=["lang", "toxic", "cell"])

    cells = rows.select("lang", "toxic", "ids").mapInArrow(run, "lang string, toxic int, cell int")
    table = cells.groupBy("lang", "cell").agg(F.sum("toxic").alias("hits"), F.count("*").alias("n")).orderBy("lang", "cell").toArrow()
    numbers = [table[c].to_numpy().astype(float) for c in ("cell", "hits", "n")]
    return calibrate(numbers[0] / GRID, numbers[1], table["lang"].to_pylist(), numbers[2])


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list[str | None], rows: np.ndarray | None = None) -> dict[str | None, float]:
    """A threshold for each language, and one for all others under None. ``rows``: see ``best_threshold``."""
    rows = np.ones(len(labels)) if rows is None else rows
    cells, where = np.unique(scores, return_inverse=True)
    whole = [np.bincount(where, x, len(cells)) for x in (labels, rows)]
    result: dict[str | None, float] = {None: best_threshold(cells, *whole)}
    of = np.array([lang or "" for lang in langs], object)
    for lang in {lang for lang in langs if lang}:
        own = of == lang
        if min(labels[own].sum(), (rows - labels)[own].sum()) >= LEAST_ROWS:
            result[lang] = best_threshold(scores[own], labels[own], rows[own])
    return result


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` but the text, and ``score``, ``threshold`` (of the row's language) and ``rejected``."""
    spark, docs = docs.sparkSession, docs.drop("score", "threshold", "rejected")
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model, model.table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, table = shared.value
        for batch in batches:
            got = score(trained, table, [hashed(t) for t in bytes_of(batch, "text")])
            columns = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(got, pa.float64())], names=[*names, "score"])
        give_back(_hashes)

    rest = [f for f in docs.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", score double"
    scored = docs.select(*[f.name for f in rest], "text").mapInArrow(run, schema)
    threshold = F.lit(model.thresholds.get(None, 0.5))
    for lang, value in model.thresholds.items():
        if lang is not None:
            threshold = F.when(F.col("lang") == lang, F.lit(value)).otherwise(threshold)
    return scored.withColumn("threshold", threshold).withColumn("rejected", F.col("score") >= F.col("threshold"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold of their language, with all their columns."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model, model.table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, table = shared.value
        others = trained.thresholds.get(None, 0.5)
        for batch in batches:
            got = score(trained, table, [hashed(t) for t in bytes_of(batch, "text")])
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            below = got < np.array([trained.thresholds.get(lang, others) for lang in langs], float)
            yield batch.filter(pa.array(below, pa.bool_()))
        give_back(_hashes)

    return docs.mapInArrow(run, docs.schema)
