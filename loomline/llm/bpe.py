"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

The tree's leaves are the byte positions of one piece; a leaf holds the rank of the pair that starts at a live token
there, packed with its position, so that the root is the leftmost pair of the smallest rank. A merge changes the
leaves of three positions at most and so costs a logarithm of the piece's length, however long the piece is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Pieces whose ids a worker keeps; beyond, it starts anew.
CACHE = 500_000

_NONE = 1 << 62


class Vocabulary:
    """Ranks of byte strings, from a file of lines "base64 rank"."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b
        self.longest = max(map(len, ranks), default=0)
        self.findall = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}  # ids as int32

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}, pattern)

    def piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        n = len(piece)
        bits = max(1, (n - 1).bit_length())
        m = 1 << bits
        low = m - 1
        get, longest = ranks.get, self.longest
        # leaves from m on; a parent is the lesser of its children
        tree = [_NONE] * (2 * m)
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                tree[m + i] = r << bits | i
        for i in range(low, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 2)), list(range(-1, n))
        while (top := tree[1]) != _NONE:
            i = top & low
            j = after[i]
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                end = after[k]
                r = get(piece[i:end]) if end - i <= longest else None
                own = _NONE if r is None else r << bits | i
            else:
                own = _NONE
            updates = [(j, _NONE), (i, own)]
            h = before[i]
            if h >= 0:
                r = get(piece[h:k]) if k - h <= longest else None
                updates.append((h, _NONE if r is None else r << bits | h))
            for at, value in updates:
                at += m
                if tree[at] == value:
                    continue
                tree[at] = value
                while at > 1:
                    b = tree[at ^ 1]
                    if b < value:
                        value = b
                    at >>= 1
                    if tree[at] == value:
                        break
                    tree[at] = value
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(ranks[piece[i:j]])
            i = j
        return tuple(out)

    def _miss(self, piece: str) -> bytes:
        if len(self.cache) >= CACHE:
            self.cache.clear()
        ids = np.array(self.piece(piece.encode()), dtype=np.int32).tobytes()
        if len(piece) <= 64:
            self.cache[piece] = ids
        return ids

    def packed(self, text: str) -> bytes:
        """The ids of a text as int32 end to end."""
        get, miss = self.cache.get, self._miss
        return b"".join([get(x) or miss(x) for x in self.findall(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a file, read once by each worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Vocabulary.load(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token ids of whole texts: doc_id, ids array<int>.

    docs: doc_id, text; other columns are ignored. Each match of ``pattern`` is encoded by itself, and special tokens
    are ordinary text. A null text is an empty one and has no ids. Each row is encoded by itself, whether or not rows share a
    doc_id or have a null one. ``path`` is a file that every worker can open, such
    as one of an installed package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                rows = batch.slice(a, 1000)
                ids = [v.packed(t) if t else b"" for t in rows.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The bytes of (doc_id, ids): doc_id, ids, decoded binary. Null ids are decoded as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                rows = batch.slice(a, 1000)
                out = [v.decode(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in rows.column(1)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode and compare: doc_id, ids, exact (whether the decoded bytes are the text's).

    docs: doc_id, text; other columns are ignored; a null text is an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                rows = batch.slice(a, 1000)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                ids = [v.encode(t) for t in texts]
                exact = [v.decode(x) == t.encode() for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(exact)], names=["doc_id", "ids", "exact"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, exact boolean")
