"""Encoding whole texts with a public byte-level BPE tokenizer, exactly and in linear time.

Pieces of text are encoded by backtracking. An Aho-Corasick automaton over the vocabulary's bytes finds the longest token at
every position of a piece. Going left to right, the longest token that is compatible with the one before is taken; where none
is, the last token is shortened. Two tokens are compatible when merging their joined bytes gives just these two; a sequence is
the result of the merges exactly when all its neighbours are compatible. Compatibility is a table that fills as pairs occur,
and positions from which no encoding goes on are never tried again, so the work stays linear. Pieces repeat a lot (Zipf), so
each worker also keeps the ids of pieces it has met. Decoding slices one byte buffer by an offset table.

The vocabulary (under 1 MB, fixed) is read on the driver from a path given as parameter and broadcast.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlattice.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 16 << 20

# Fixed value: how text is split before the merges; white space is Unicode's White_Space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

KNOWN_FITS = 1_000_000  # pairs that a worker remembers; more are worked out again
KNOWN_PIECES = 400_000  # pieces a worker keeps before it starts over
LONG_PIECE = 400  # bytes; longer pieces are rarely met again


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The rank file: a line for each token, base64 of its bytes and its rank, which is its id."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is larger than what may be broadcast")
    return raw


class Tokenizer:
    """Encoder and decoder for one rank file."""

    def __init__(self, raw: bytes):
        import ahocorasick
        import regex

        self.rank = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line.strip())}
        size = max(self.rank.values()) + 1
        self.token = [b""] * size
        for t, r in self.rank.items():
            self.token[r] = t
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(t) for t in self.token], out=self.offsets[1:])
        self.buffer = b"".join(self.token)
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.pieces = regex.compile(SPLIT).findall
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The plain merges: the adjacent pair of least rank first, the leftmost of equals. For pairs, and to test against."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(self.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            best, i = min(ranked)
            if best == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) >= KNOWN_FITS:
                self.fits.clear()
            got = self.fits[(a, b)] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return got

    def shortened(self, t: int) -> int:
        """The longest token that is a proper prefix of ``t``; -1 if none."""
        got = self.shorter.get(t)
        if got is None:
            data = self.token[t]
            got = next((r for n in range(len(data) - 1, 0, -1) if (r := self.rank.get(data[:n])) is not None), -1)
            self.shorter[t] = got
        return got

    def backtrack(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        n = len(data)
        longest = [-1] * n
        length = [0] * n
        token = self.token
        for end, r in self.automaton.iter(data.decode("latin-1")):
            size = len(token[r])
            start = end - size + 1
            if size > length[start]:
                length[start], longest[start] = size, r
        dead = bytearray(n + 1)  # positions from which nothing goes on
        out: list[int] = []
        at, candidate = 0, longest[0] if n else -1
        while at < n:
            while candidate >= 0:
                end = at + len(token[candidate])
                if not dead[end] and (not out or self.compatible(out[-1], candidate)):
                    break
                candidate = self.shortened(candidate)
            if candidate >= 0:
                out.append(candidate)
                at = end
                candidate = longest[at] if at < n else -1
            else:  # no token fits here after the last one: shorten that
                dead[at] = 1
                last = out.pop()
                at -= len(token[last])
                candidate = self.shortened(last)
        return out

    def piece(self, text: str) -> tuple[int, ...]:
        got = self.known.get(text)
        if got is None:
            data = text.encode("utf-8")
            whole = self.rank.get(data)
            got = (whole,) if whole is not None and self._is_own(data, whole) else tuple(self.backtrack(data))
            if len(data) <= LONG_PIECE:
                if len(self.known) >= KNOWN_PIECES:
                    self.known.clear()
                self.known[text] = got
        return got

    def _is_own(self, data: bytes, r: int) -> bool:
        return len(data) == 1 or self.merge(data) == [r]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; none for null and empty text."""
        out: list[int] = []
        if text:
            known, piece = self.known, self.piece
            for p in self.pieces(text):
                out += known.get(p) or piece(p)
        return out

    def decode(self, ids) -> str:
        """The text of ids; bytes that aren't UTF-8 by themselves become U+FFFD."""
        o, b = self.offsets, self.buffer
        return b"".join(b[o[i] : o[i + 1]] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _tokenizer(raw: bytes) -> Tokenizer:
    return Tokenizer(raw)


def encode_texts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns of every row with ``ids ARRAY<INT>``. Null and empty text: an empty list. Large inputs stay where they are, small
    ones are shuffled once to use all cores."""
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    src = spread(docs.select(*keep, F.col(text).alias("_text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_text") + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(raw.value)
        for b in batches:
            lists = [tok.encode(t.as_py()) for t in b.column("_text")]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, offsets[-1])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), ids], names=[*keep, "ids"])

    return src.mapInArrow(run, schema)


def token_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns of every row with ``n_tokens BIGINT``, without carrying the ids along."""
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    src = spread(docs.select(*keep, F.col(text).alias("_text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_text") + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(raw.value)
        for b in batches:
            n = pa.array([len(tok.encode(t.as_py())) for t in b.column("_text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), n], names=[*keep, "n_tokens"])

    return src.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns with the ``text`` of the ids; null ids give null."""
    raw = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    src = encoded.select(*keep, F.col(ids).alias("_ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_ids") + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(raw.value)
        for b in batches:
            texts = pa.array([None if x.as_py() is None else tok.decode(x.as_py()) for x in b.column("_ids")], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), texts], names=[*keep, "text"])

    return src.mapInArrow(run, schema)
