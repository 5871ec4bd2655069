"""Token ids in Arrow files of fixed-size lists (operator 6).

Documents are range-partitioned and sorted by id; each task encodes its documents one after the other and writes the
stream of ids as sequences of one length: record batches with ``ids: fixed_size_list<uint16 or uint32>`` and
``mask: fixed_size_list<bool>`` (false: padding at the end of the last sequence). All sequences of a file lie at fixed
distances, so a reader that maps the file gets any sequence, or the ids of any document, as a slice without a copy. The
index of the documents (file, place, length) is a Parquet table beside the files; a file's position in the whole stream is
the sum of those before it. Tasks hold one record batch at a time.

The folder has to be one that Python on the executors can reach through ``pyarrow.fs`` (a shared mount, hdfs, s3). A file
gets its name only when complete; a task that runs again writes another one, and the index names the one that counts.

Defined results. NULL text: empty, so only the end id. NULL doc_id: behind all others. Repeated rows: each is encoded; the
order among equal ids is that of the sort. Empty table: no files, an empty index. Extra columns: ignored.
"""

from __future__ import annotations

import gc
import json
import operator
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorekit.llm.arrow import bounded_batches, bytes_of
from scorekit.llm.text import FILE, ROW, with_locator
from scorekit.workspace import fresh_path

SEQUENCE = 2048
BATCH_SEQUENCES = 256

#: Entries that a task remembers of chunks and of words; then those not asked for any more go. Memory only, never a result.
CHUNKS, WORDS = 400_000, 800_000

#: The word pattern of the lower-casing word vocabulary (fixed value). White space ends every match, and a run of
#: punctuation is a match of its own.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: ASCII punctuation that may end a word; without the apostrophe, which begins matches.
PUNCTUATION = b""".,;:!?()[]{}"#$%&*+-/<=>@\\^_`|~"""

INDEX = "doc_id long, shard int, path string, place long, n_tokens long"


class _Memory:
    """A mapping of two generations: when the young one is full it becomes the old one, and what was old is forgotten."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def lacking(self, keys: set[bytes]) -> list[bytes]:
        """Make room for ``keys``, take over those of the old generation, and return the others."""
        if len(self.young) + len(keys) > self.limit:
            self.young, self.old = {}, self.young
        keys = keys.difference(self.young)
        known = keys & self.old.keys()
        self.young.update((key, self.old[key]) for key in known)
        return list(keys - known)


class ChunkEncoder:
    """Encodes texts. Where no token can cross white space, the library encodes each new word once and it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.by_words = self._drops_white_space()
        self.chunks, self.words = _Memory(CHUNKS), _Memory(WORDS)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _drops_white_space(self) -> bool:
        """Whether this is a vocabulary of lower-cased words between white space and punctuation."""
        spec = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
        inside = all(len(t["content"].split()) == 1 and t["content"].startswith("<|") for t in spec["added_tokens"])
        return (
            steps == ["NFC", "Replace", "Lowercase"]
            and split.get("pattern") == {"Regex": WORD_PATTERN}
            and split.get("behavior") == "Removed"
            and plain
            and inside
        )

    def _library(self, texts: list[str]) -> list[bytes]:
        encodings = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in encodings]

    @staticmethod
    def _chunks(text: bytes) -> list[bytes]:
        """Parts between ASCII white space. A-Z may be lower-cased first where no special token and no combining mark is."""
        return (text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()).split()

    @staticmethod
    def _plain(word: bytes) -> bool:
        """Whether all are letters that stay single letters when lower-cased."""
        if word.isalpha():  # ASCII
            return True
        letters = word.decode("utf-8")
        return letters.isalpha() and max(letters) < "\u0250" and "\u0130" not in letters

    def _parts(self, chunk: bytes) -> tuple[bytes, bytes]:
        """A word of plain letters and the punctuation behind it; or the chunk as it is."""
        stem = chunk.rstrip(PUNCTUATION)
        if len(stem) == len(chunk) or not stem or b"<|" in chunk or not self._plain(stem):
            return chunk, b""
        return stem, chunk[len(stem) :]

    def _learn(self, words: list[bytes]) -> None:
        """Plain words are encoded together, each ends at its only token with a word end; others one by one."""
        plain = [word for word in words if word.isalpha() or self._plain(word)]
        if plain:
            encoding = self.tokenizer.encode(b" ".join(plain).decode("utf-8"), add_special_tokens=False)
            ids = np.array(encoding.ids, self.dtype)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * self.dtype.itemsize
            data, starts = ids.tobytes(), [0, *ends[:-1].tolist()]
            self.words.young.update((w, data[s:e]) for w, s, e in zip(plain, starts, ends.tolist(), strict=True))
        rest = [word for word in words if word not in self.words.young]
        self.words.young.update(zip(rest, self._library([word.decode("utf-8") for word in rest]), strict=True))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_words:
            return self._library([text.decode("utf-8") for text in texts])
        split = [self._chunks(text) for text in texts]
        whole, chunks, stems, tails = [], [], [], []
        for chunk in self.chunks.lacking(set().union(*split)):
            stem, tail = (chunk, b"") if chunk.isalpha() else self._parts(chunk)
            if tail:
                chunks.append(chunk)
                stems.append(stem)
                tails.append(tail)
            else:
                whole.append(chunk)
        self._learn(self.words.lacking(set(whole).union(stems, tails)))
        word = self.words.young.__getitem__
        self.chunks.young.update(zip(whole, map(word, whole)))
        self.chunks.young.update(zip(chunks, map(operator.add, map(word, stems), map(word, tails))))
        get = self.chunks.young.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    """One for all tasks of a worker process."""
    return ChunkEncoder(path)


class _Writer:
    """One file: ids come in as bytes, full record batches go out."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, sequence: int):
        self.fs, base = fs.FileSystem.from_uri(folder)
        self.path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.arrow"
        self.final = f"{base}/{self.path.rsplit('/', 1)[1]}"
        self.dtype, self.sequence, self.bytes = dtype, sequence, sequence * dtype.itemsize
        self.schema = pa.schema(
            [("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))]
        )
        self.fs.create_dir(base, recursive=True)
        self.sink = self.fs.open_output_stream(self.final + ".part")
        self.writer = ipc.new_file(self.sink, self.schema)
        self.buffer = bytearray()
        self.place = 0

    def add(self, ids: bytes) -> int:
        """Append the ids of a document; its place in the file."""
        place = self.place
        self.place += len(ids) // self.dtype.itemsize
        self.buffer += ids
        full = BATCH_SEQUENCES * self.bytes
        while len(self.buffer) >= full:
            self._batch(bytes(self.buffer[:full]), full)
            del self.buffer[:full]
        return place

    def _batch(self, data: bytes, real: int) -> None:
        ids = pa.Array.from_buffers(pa.from_numpy_dtype(self.dtype), len(data) // self.dtype.itemsize, [None, pa.py_buffer(data)])
        mask = pa.array(np.arange(len(ids)) < real // self.dtype.itemsize)
        columns = [pa.FixedSizeListArray.from_arrays(c, self.sequence) for c in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if real := len(self.buffer):
            self._batch(bytes(self.buffer) + b"\0" * (-real % self.bytes), real)
        self.writer.close()
        self.sink.close()
        self.fs.move(self.final + ".part", self.final)


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, sequence: int = SEQUENCE) -> str:
    """Encode ``docs`` into a new folder of token files and return the folder."""
    folder = folder or fresh_path(docs.sparkSession, "token-files")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer = TaskContext.get().partitionId(), None
        encoder = _encoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or _Writer(f"{folder}/shards", shard, encoder.dtype, sequence)
            gc.disable()  # nothing here is cyclic, and the collector would walk through all that is remembered
            try:
                ids = [i + end for i in encoder(bytes_of(batch, "text"))]
            finally:
                gc.enable()
            n = len(ids)
            columns = [
                batch.column(0),
                pa.array([shard] * n, pa.int32()),
                pa.array([writer.path] * n, pa.string()),
                pa.array([writer.add(i) for i in ids], pa.int64()),
                pa.array([len(i) // encoder.dtype.itemsize for i in ids], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "path", "place", "n_tokens"])
        if writer:
            writer.close()

    # Rows of one id, or of none, are ordered by a hash of their place, so that many of them are many tasks and files.
    order = [F.col("doc_id").asc_nulls_last(), F.col("place")]
    rows = with_locator(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = rows.select("doc_id", "text", F.xxhash64(FILE, ROW).alias("place"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("place")
    rows.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return folder


class Reader:
    """Random access to one file; slices of a mapped file are not copied."""

    def __init__(self, path: str):
        system, at = fs.FileSystem.from_uri(path)
        local = isinstance(system, fs.LocalFileSystem)
        self.file = ipc.open_file(pa.memory_map(at) if local else system.open_input_file(at))
        self.sequence = self.file.schema.field("ids").type.list_size
        self.per_batch = self.sequence * (self.file.get_batch(0).num_rows if self.file.num_record_batches else 1)
        self.at, self.batch = -1, None

    def _flat(self, number: int, column: str) -> np.ndarray:
        if number != self.at:
            self.at, self.batch = number, self.file.get_batch(number)
        return self.batch.column(column).flatten().to_numpy(zero_copy_only=column == "ids")

    def rows(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        batch, row = divmod(number, self.per_batch // self.sequence)
        cut = slice(row * self.sequence, (row + 1) * self.sequence)
        return self._flat(batch, "ids")[cut], self._flat(batch, "mask")[cut]

    def ids(self, place: int, n: int) -> list[np.ndarray]:
        """The ids at a place of the stream: one slice for each record batch they lie in."""
        parts = []
        while n > 0:
            batch, start = divmod(place, self.per_batch)
            part = self._flat(batch, "ids")[start : start + n]
            parts.append(part)
            place, n = place + len(part), n - len(part)
        return parts


def index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, path, place, n_tokens and ``start``, the ids of all documents before."""
    rows = spark.read.schema(INDEX).parquet(f"{folder}/index")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, "shard").withColumn("start", F.col("offset") + F.col("place")).drop("offset", "shard")


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """Read every document back from the files: doc_id, start, n_tokens and the CRC-32 of its ids as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, reader = None, None
        for batch in batches:
            sums = []
            for at, place, n in zip(*(batch.column(c).to_pylist() for c in ("path", "place", "n_tokens")), strict=True):
                if at != path:
                    path, reader = at, Reader(at)
                crc = 0
                for part in reader.ids(place, n):
                    crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    rows = index(spark, folder).select("doc_id", "start", "n_tokens", "path", "place")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
