"""Words, shingles and hashes of whole texts, vectorised over packed UTF-8 bytes.

A :class:`Pack` holds the texts of several documents end to end in one byte array. Packs are cut at
``PACK_BYTES`` so that the arrays derived from one stay small whatever the Arrow batch holds; a single
longer text gets a pack of its own and is never cut.

Words are ``[^\\x20\\x09-\\x0D]+``. All of these separators are single ASCII bytes, so words can be found on
the UTF-8 bytes. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PACK_BYTES = 2_000_000

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x += _ODD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _table(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(seed << 32))


#: A random 64-bit value for each byte and odd multipliers for each position of a word's first bytes.
_BYTE = _table(1, 256)
_POWER = np.cumprod(np.full(256, np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)


@dataclass
class Pack:
    """ids: int64 per document; bytes: uint8 of all texts; starts: document boundaries, one more than ids."""

    ids: np.ndarray
    bytes: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.starts[i + 1]].tobytes()


def packs(batches: Iterable[pa.RecordBatch], limit: int = PACK_BYTES, id_col: int = 0, text_col: int = 1) -> Iterator[Pack]:
    """Cut Arrow batches of (id, text) into packs of about ``limit`` bytes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column(id_col).to_numpy(zero_copy_only=False)
        ids = np.where(np.isnan(ids), -1, ids).astype(np.int64) if ids.dtype.kind == "f" else ids.astype(np.int64)
        col = batch.column(text_col).cast(pa.large_binary())
        if col.null_count:
            col = col.fill_null(b"")
        offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
        data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
            b = min(b, n)
            yield Pack(ids[a:b], data[offs[a] : offs[b]], (offs[a : b + 1] - offs[a]).astype(np.int64))
            a = b


@dataclass
class Words:
    """start, end: byte spans; doc: document index of each word; first: index of each document's first word, one more than documents."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def words(pack: Pack) -> Words:
    buf = pack.bytes
    n = len(buf)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return Words(z, z, z, np.zeros(len(pack) + 1, dtype=np.int64))
    inside = ~_SEP[buf]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    cut = pack.starts[1:-1]
    cut = cut[cut < n]
    edge[cut] = inside[cut]  # a word never runs on into the next document
    start = np.flatnonzero(edge)
    stop = np.empty(n, dtype=bool)
    stop[-1] = inside[-1]
    stop[:-1] = inside[:-1] & (~inside[1:] | edge[1:])
    end = np.flatnonzero(stop) + 1
    first = np.searchsorted(start, pack.starts)
    doc = np.repeat(np.arange(len(pack)), np.diff(first))
    return Words(start, end, doc, first)


def _placed(byte: np.ndarray) -> np.ndarray:
    """What each byte at each of a word's first places adds to its hash: nothing, if it is a separator."""
    out = byte[None, :] * _POWER[:, None]
    out[:, _SEP] = 0
    return out.reshape(-1)


_PLACED, _PLACED_LOWER = _placed(_BYTE), _placed(_BYTE[_LOWER])


def word_hashes(buf: np.ndarray, w: Words, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every pack."""
    if not len(w):
        return np.zeros(0, dtype=np.uint64)
    # 256 times each byte's place after the last word's start, then the byte
    at = np.full(len(buf), 256, dtype=np.int64)
    at[: w.start[0] + 1] = 0
    gap = np.diff(w.start, append=len(buf))
    at[w.start[1:]] -= gap[:-1] * 256
    np.cumsum(at, out=at)
    far = np.flatnonzero(at > 255 << 8) if gap.max() > 256 else np.zeros(0, dtype=np.int64)
    place = at[far] >> 8
    at[far] = 255 << 8
    at += buf
    values = (_PLACED_LOWER if lower else _PLACED).take(at)
    if len(far):
        values[far] = np.where(_SEP[buf[far]], np.uint64(0), mix(values[far] ^ mix(place.astype(np.uint64))))
    sums = np.add.reduceat(values, w.start)
    return mix(sums ^ mix((w.end - w.start).astype(np.uint64) + np.uint64(seed)))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries of h (len(h) - k + 1 of them), dependent on their order."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out *= _M1
        out += h[i : i + n]
    return mix(out)


_LARGE = 0xD1342543DE82EF95
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes (of any lengths), from prefix sums."""
    global _powers
    if len(_powers[0]) <= len(buf):
        n = max(len(buf) + 1, PACK_BYTES + PACK_BYTES // 4)
        _powers = tuple(np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n - 1, np.uint64(m)))), dtype=np.uint64) for m in (_LARGE, pow(_LARGE, -1, 1 << 64)))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[buf] * _powers[0][: len(buf)], dtype=np.uint64)))
    return mix(((sums[end] - sums[start]) * _powers[1][start]) ^ mix((end - start).astype(np.uint64)))
