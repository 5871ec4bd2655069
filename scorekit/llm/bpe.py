"""Exact byte-level BPE by dynamic programming over prefixes (operator 9).

For each prefix of a word there is exactly one token that can end its encoding. An Aho-Corasick automaton over the
vocabulary lists the tokens that are suffixes of the prefix; the one whose predecessor (stored for the shorter prefix) may
stand in front of it is the last token of this prefix. Whether two tokens may stand side by side is decided by undoing
their merges from the latest on: no merge across the border may have been due earlier. Back-pointers give the ids. The
time is linear in the length of a word, however long it is, and no merge queue is needed.

Whole texts are encoded where they lie, batch by batch; nothing is shuffled. The words of a batch that are new are encoded
in sorted order: what was found for the prefixes that a word shares with the one before it holds for both.

Defined results. NULL text: empty, no ids. NULL doc_id, repeated rows: encoded like any other. Empty table: no rows. Other
columns stay as they are; ``ids`` and ``n_tokens`` (``decoded`` when decoding) replace columns of the same name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scorekit.llm.arrow import bounded_batches, give_back, texts_of, with_columns

#: White space as the public tokenizers understand it: the Unicode property.
_S = r"\t-\r \x85\xA0  -     　"
#: The word pattern of the byte-level vocabularies (fixed value), for given classes of letters and digits.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^" + _S + r"{L}{N}]+|[" + _S + r"]+(?![^" + _S + r"])|[" + _S + "]+"
PATTERN = regex.compile(_WORDS.format(L=r"\p{L}", N=r"\p{N}"))
#: Characters beyond the basic plane; texts without them are cut by the standard library, which is faster.
BEYOND = re.compile("[\U00010000-\U0010FFFF]")
#: Between two characters that are not white space, a single blank always starts a new word: texts may be cut there.
SAFE_BLANK = regex.compile(r"(?<=[^" + _S + r"]) (?=[^" + _S + "])")

#: Entries that a task keeps of what it has seen, then it starts anew: words and token pairs. Memory only (about 200 bytes
#: an entry), never a result.
WORDS, PAIRS = 400_000, 200_000
#: Characters that are cut into words together; longer texts are taken in pieces. Memory only, never a result.
PIECES = 4_000_000


@lru_cache(maxsize=1)
def basic_pattern() -> re.Pattern:
    """``PATTERN`` for texts of the basic plane, its classes written out as ranges."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    ranges = {}
    for kind in "LN":
        runs = regex.findall(rf"\p{{{kind}}}+", plane)
        ranges[kind] = "".join(re.escape(run[0]) + "-" + re.escape(run[-1]) for run in runs)
    return re.compile(_WORDS.format(**ranges))


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Cache(dict):
    """A dictionary that computes what it lacks."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class PrefixBpe:
    """A vocabulary file of byte-level BPE, encoded by prefixes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stands_for = byte_alphabet()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {i: bytes(stands_for[c] for c in token) for token, i in ids.items() if token not in self.special}
        size = max([*raw, *self.special.values()]) + 1
        self.bytes = [raw.get(i, b"") for i in range(size)]
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        # When a token comes into being (a single byte: before all merges), and what it is made of.
        self.born = [-1] * size
        self.parts: list[tuple[int, int]] = [(-1, -1)] * size
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = ids[left], ids[right], ids[left + right]
            self.merge[a, b] = rank
            if self.born[whole] < 0:
                self.born[whole], self.parts[whole] = rank, (a, b)
        self._build_automaton({token: i for i, token in raw.items() if self.born[i] < 0 or self._reachable(i)})
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._fits = _Cache(lambda pair: self._compatible(pair >> 32, pair & 0xFFFFFFFF), PAIRS)
        self._next = _Cache(self._step, PAIRS)
        self._words: dict[str, bytes] = {}
        self.remembered = (self._fits, self._next, self._words)

    def _build_automaton(self, tokens: dict[bytes, int]) -> None:
        """States are the prefixes of tokens; ``suffixes`` has the tokens (with lengths) that each ends with, longest first."""
        edges, level, own = {}, {b"": 0}, [-1]
        self._edges, self._shorter, self.suffixes = edges, [0], [()]
        by_length = sorted(tokens, key=len)
        for size in range(1, len(by_length[-1]) + 1 if by_length else 1):
            before, level = level, {}
            by_length = [t for t in by_length if len(t) >= size]
            for token in by_length:
                prefix = token[:size]
                if prefix not in level:
                    node = before[token[: size - 1]]
                    state = level[prefix] = len(own)
                    own.append(tokens.get(prefix, -1))
                    # The states one level up are complete, so the longest shorter suffix is found through them.
                    shorter = self._step(self._shorter[node] << 8 | prefix[-1]) if node else 0
                    edges[node << 8 | prefix[-1]] = state
                    self._shorter.append(shorter)
                    rest = self.suffixes[shorter]
                    self.suffixes.append(((own[state], size), *rest) if own[state] >= 0 else rest)

    def _step(self, at: int) -> int:
        """The state that follows a state (``at >> 8``) and a byte: the longest suffix that is a prefix of a token."""
        state, byte = at >> 8, at & 255
        while (found := self._edges.get(state << 8 | byte)) is None:
            if not state:
                return 0
            state = self._shorter[state]
        return found

    def _reachable(self, token: int) -> bool:
        """A token is its own encoding if its two parts would not have merged otherwise before."""
        left, right = self.parts[token]
        return self._compatible(left, right, self.born[token])

    def _compatible(self, left: int, right: int, until: int | None = None) -> bool:
        """Whether the merges that make ``left`` and ``right`` leave their border alone (up to the merge ``until``).

        Seen backwards, the token at the border that was made last falls apart first; of two equal merges the right one is
        the later. A merge of the two tokens at the border would have come first if it ranks in front of the merge that
        uses up the left one, and not behind the one that uses up the right one.
        """
        end = len(self.merge) if until is None else until
        left_end = right_end = end
        first = until is not None
        while True:
            rank = self.merge.get((left, right))
            if rank is not None and not first and rank < left_end and rank <= right_end:
                return False
            first = False
            if self.born[left] > self.born[right]:
                left_end, left = self.born[left], self.parts[left][1]
            elif self.born[right] >= 0:
                right_end, right = self.born[right], self.parts[right][0]
            else:
                return True

    def _learn(self, words: set[str]) -> None:
        """Encode words in the order of their bytes; prefixes shared with the word before are not worked out again."""
        known, fits, following, suffixes = self._words, self._fits, self._next, self.suffixes
        last, length, states, before = [0], [0], [0], b""
        for data in sorted([word.encode() for word in words]):
            shared = 0
            for a, b in zip(before, data, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], length[shared + 1 :], states[shared + 1 :]
            before, size, state = data, len(data), states[shared]
            for end in range(shared + 1, size + 1):
                state = following[state << 8 | data[end - 1]]
                for token, n in suffixes[state]:
                    if n == end or fits[last[end - n] << 32 | token]:
                        last.append(token)
                        length.append(n)
                        states.append(state)
                        break
            ids, end = [], size
            while end:
                ids.append(last[end])
                end -= length[end]
            ids.reverse()
            known[data.decode()] = pack(f"<{len(ids)}I", *ids)

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        words = [(PATTERN if BEYOND.search(t) else basic_pattern()).findall(t) for t in texts]
        distinct = set().union(*words)
        new = distinct.difference(self._words)
        if len(self._words) + len(new) > WORDS:
            self._words.clear()
            new = distinct
        self._learn(new)
        return [b"".join(map(self._words.__getitem__, w)) for w in words]

    def _parts(self, text: str) -> Iterator[str]:
        """A text cut at special tokens, which are parts of their own, and where it is long at safe blanks."""
        special = self.special and any(s in text for s in self.special)
        for part in self.special_pattern.split(text) if special else [text]:
            start = 0
            while len(part) - start > PIECES and (blank := SAFE_BLANK.search(part, start + PIECES)):
                yield part[start : blank.start()]
                start = blank.start()
            yield part[start:] if start else part

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers. Special tokens in a text are themselves."""
        ids: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, str]] = []

        def work_off() -> None:
            plain = iter(self._encode_plain([part for _, part in waiting if part not in self.special]))
            for i, part in waiting:
                ids[i].append(self.special[part].to_bytes(4, "little") if part in self.special else next(plain))
            waiting.clear()

        size = 0
        for i, text in enumerate(texts):
            for part in self._parts(text):
                if size + len(part) > PIECES:
                    work_off()
                    size = 0
                waiting.append((i, part))
                size += len(part)
        work_off()
        return [b"".join(parts) for parts in ids]

    def encode(self, text: str) -> bytes:
        """Ids of one text; see ``encode_all``."""
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Add ids (little-endian unsigned 32-bit integers) and n_tokens of each whole text. Executors read ``vocabulary``.

    With ``decoded`` the ids are decoded again in the same pass and their text is added as ``decoded``.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary)
        for batch in batches:
            ids = bpe.encode_all(texts_of(batch, text))
            new = {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64())}
            if decoded:
                new["decoded"] = pa.array(map(bpe.decode, ids), pa.string())
            yield with_columns(batch, **new)
        give_back(*bpe.remembered)

    added = T.StructType().add("ids", T.BinaryType()).add("n_tokens", T.LongType())
    if decoded:
        added = added.add("decoded", T.StringType())
    kept = [f for f in docs.schema if f.name not in added.names]
    return docs.mapInArrow(run, T.StructType([*kept, *added]))


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Add the text of each row's ids as ``decoded``. NULL ids: empty."""
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            yield with_columns(batch, decoded=pa.array([bpe.decode(i or b"") for i in column.to_pylist()], pa.string()))

    schema = T.StructType([f for f in encoded.schema if f.name != "decoded"])
    return encoded.mapInArrow(run, schema.add("decoded", T.StringType()))
