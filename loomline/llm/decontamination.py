"""Benchmark decontamination by greedy string tiling.

Seeds are hashes of ``least`` consecutive tokens. Documents are joined with benchmark items on shared seeds; pairs whose
seeds cannot cover enough of the item are left, and for each other pair the longest matches of unmarked tokens, found by
running Karp-Rabin hashes, are marked again and again. The share of the item's tokens that are covered by tiles is its
coverage, whatever the order in which its passages stand in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import materialize
from .text import Pack, Words, packs, windows, word_hashes, words

#: Bytes of benchmark text that go to the workers at a time; a larger benchmark is worked off in several blocks.
BLOCK_BYTES = 8_000_000

_BASE = 0xD1342543DE82EF95
_TRIM = np.zeros(256, dtype=bool)
_TRIM[[i for i in range(128) if not chr(i).isalnum()]] = True


def tokens(p: Pack) -> tuple[Words, np.ndarray]:
    """Words with A-Z lower-cased and ASCII punctuation taken off both ends; words of nothing else are left out."""
    w = words(p)
    solid = np.flatnonzero(~_TRIM[p.bytes])
    first, past = np.searchsorted(solid, w.start), np.searchsorted(solid, w.end)  # of each word's bytes that stay
    keep = past > first
    w = Words(solid[first[keep]], solid[past[keep] - 1] + 1, w.doc[keep], np.searchsorted(w.doc[keep], np.arange(len(p) + 1)))
    return w, _trimmed_hashes(p, w)


def _trimmed_hashes(p: Pack, w: Words) -> np.ndarray:
    """Hashes of words whose spans leave out punctuation, by the bytes within the spans alone."""
    if not len(w):
        return np.zeros(0, dtype=np.uint64)
    buf = np.full(len(p.bytes), 0x20, dtype=np.uint8)
    step = np.zeros(len(buf) + 1, dtype=np.int8)
    step[w.start] += 1
    np.subtract.at(step, w.end, 1)
    inside = np.cumsum(step[:-1], dtype=np.int8) > 0
    buf[inside] = p.bytes[inside]
    return word_hashes(buf, w, lower=True)


class Strings:
    """Karp-Rabin hashes of all stretches of a sequence of token hashes, from prefix sums."""

    _power = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(1 << 16, np.uint64(_BASE)))), dtype=np.uint64)

    def __init__(self, h: np.ndarray) -> None:
        self.n = len(h)
        if len(self._power) <= self.n:
            Strings._power = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(2 * self.n, np.uint64(_BASE)))), dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * self._power[: self.n], dtype=np.uint64)))
        self.free = np.arange(self.n + 1)  # of each place where the unmarked tokens from there end

    def at(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where unmarked stretches of k tokens begin, and their hashes; a product with a power of the end makes places equal."""
        i = np.flatnonzero(self.free[: self.n - k + 1] >= k) if self.n >= k else np.zeros(0, dtype=np.int64)
        return i, (self.sums[i + k] - self.sums[i]) * self._power[self.n - i]

    def reset(self, used: np.ndarray) -> None:
        stop = np.append(np.where(used, np.arange(self.n), self.n), self.n)
        self.free = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(self.n + 1)


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document start, item start, length) of two sequences of token hashes.

    The longest match of unmarked tokens goes first (of equal ones the first in the document, then in the item) and is
    marked. Its length is found by halving with running Karp-Rabin hashes of all unmarked stretches, whose number is that
    of the tokens, so memory does not grow with the matches; lengths only fall.
    """
    a, b = Strings(doc), Strings(item)
    a.reset(np.zeros(len(doc), dtype=bool))
    b.reset(np.zeros(len(item), dtype=bool))
    shift = a.n - b.n  # so that hashes of both are of one degree
    lift = Strings._power[abs(shift)]

    def common(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        i, x = a.at(k)
        j, y = b.at(k)
        if shift > 0:
            y = y * lift
        elif shift < 0:
            x = x * lift
        hit = np.isin(x, y)
        return i[hit], x[hit], j, y

    used, taken = np.zeros(a.n, dtype=bool), np.zeros(b.n, dtype=bool)
    tiles: list[tuple[int, int, int]] = []
    high = min(a.n, b.n)
    while high >= least and len(common(least)[0]):
        low = least
        while low < high:
            k = (low + high + 1) // 2
            low, high = (k, high) if len(common(k)[0]) else (low, k - 1)
        i, x, j, y = common(low)
        order = np.lexsort((j, y))
        j, y = j[order], y[order]
        first, past = np.searchsorted(y, x), np.searchsorted(y, x, side="right")
        nearest: dict[int, int] = {}  # of each string the first of its places that may still be free
        end = -1
        for s, f, p in zip(i.tolist(), first.tolist(), past.tolist(), strict=True):
            if s < end:
                continue
            at = nearest.get(f, f)
            while at < p and taken[j[at] : j[at] + low].any():
                at += 1
            nearest[f] = at
            if at < p:
                tiles.append((s, int(j[at]), low))
                used[s : s + low] = taken[j[at] : j[at] + low] = True
                end = s + low
        a.reset(used)
        b.reset(taken)
        high = low
    return tiles


class Items:
    """Seeds of benchmark items, sorted by hash."""

    def __init__(self, ids: list[int], texts: list[str | None], least: int) -> None:
        text = [(t or "").encode() for t in texts]
        starts = np.concatenate(([0], np.cumsum([len(t) for t in text]))).astype(np.int64)
        p = Pack(np.array(ids, dtype=np.int64), np.frombuffer(b"".join(text), dtype=np.uint8), starts)
        w, h = tokens(p)
        self.ids, self.sizes, self.least, self.h, self.first = p.ids, np.diff(w.first), least, h, w.first
        s = windows(h, least)
        at = np.flatnonzero(w.doc[: len(s)] == w.doc[least - 1 : least - 1 + len(s)]) if len(s) else np.zeros(0, dtype=np.int64)
        order = np.argsort(s[at], kind="stable")
        self.seed, self.item = s[at][order], w.doc[at][order]
        self.place = at[order] - w.first[self.item]

    def _pairs(self, w: Words, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Document, item and place in the item of all shared seeds, a part at a time."""
        s = windows(h, self.least)
        if not len(s) or not len(self.seed):
            return
        low = np.searchsorted(self.seed, s)
        hit = np.flatnonzero(self.seed[np.minimum(low, len(self.seed) - 1)] == s)
        hit = hit[w.doc[hit] == w.doc[hit + self.least - 1]]
        if not len(hit):
            return
        # one entry for each seed of a document, however often it stands there
        pair, at = np.unique(np.stack((w.doc[hit], low[hit]), axis=1), axis=0, return_index=True)
        doc, low = pair[:, 0], pair[:, 1]
        count = np.searchsorted(self.seed, s[hit[at]], side="right") - low
        for a in range(0, len(doc), 4096):  # a part at a time: entries of an item that repeats a seed are many
            d, n, first = doc[a : a + 4096], count[a : a + 4096], low[a : a + 4096]
            e = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            yield np.repeat(d, n), self.item[e], self.place[e]

    def leaks(self, p: Pack, threshold: float) -> Iterator[tuple[int, int, int, int, list[tuple[int, int, int]]]]:
        """(document index, item id, covered tokens, item tokens, tiles) of the pairs covered to the threshold."""
        w, h = tokens(p)
        cells = [np.unique(np.stack(x, axis=1), axis=0) for x in self._pairs(w, h)]
        if not cells:
            return
        cells = np.unique(np.concatenate(cells), axis=0)  # document, item, place of a seed in the item
        edge = np.flatnonzero(np.append(True, (np.diff(cells[:, :2], axis=0) != 0).any(axis=1)))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(cells)], strict=True):
            d, x, places = int(cells[a, 0]), int(cells[a, 1]), cells[a:b, 2]
            size = int(self.sizes[x])
            most = np.minimum(np.diff(places), self.least).sum() + self.least  # tokens that some seed covers
            if most < threshold * size:
                continue
            first = w.first[d]
            tiles = tile(h[first : w.first[d + 1]], self.h[self.first[x] : self.first[x + 1]], self.least)
            covered = sum(k for _, _, k in tiles)
            if covered >= threshold * size:
                spans = [(int(w.start[first + u] - p.starts[d]), int(w.end[first + u + k - 1] - p.starts[d]), k) for u, _, k in tiles]
                yield d, int(self.ids[x]), covered, size, sorted(spans)


_SCHEMA = "doc_id long, item_id long, covered long, item_tokens long, coverage double, spans array<struct<start:long,end:long,tokens:long>>"


def _leaks(items: Items, threshold: float):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in packs(batches):
            rows = [(int(p.ids[d]), x, c, n, c / n, [{"start": a, "end": b, "tokens": k} for a, b, k in t]) for d, x, c, n, t in items.leaks(p, threshold)]
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), kind]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "covered", "item_tokens", "coverage", "spans"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of a document and a benchmark item of whose tokens tiles cover ``threshold`` or more.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Returns doc_id, item_id, covered,
    item_tokens, coverage and spans (byte spans of the tiles in the document's UTF-8 text). Tokens are words with A-Z
    lower-cased and ASCII punctuation taken off both ends; tiles have ``least`` tokens or more, so items with fewer
    are never found. Null texts and null ids take no part. Rows that share an id are judged row by row.

    The benchmark's size is checked: it is sent to the workers in blocks of at most ``block_bytes`` of text (or one
    item, if longer), with one pass over the documents for each block.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > block_bytes:
        n = -(-2 * total // block_bytes)
        items = materialize(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "benchmark")
    else:
        n, items = 1, items.withColumn("block", F.lit(0))
    out = None
    for b in range(n):
        rows = items.where(F.col("block") == b).select("item_id", "text").collect()
        part = docs.mapInArrow(_leaks(Items([r.item_id for r in rows], [r.text for r in rows], least), threshold), _SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out
