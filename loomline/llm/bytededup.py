"""Removal of repeated byte strings with run-length indexes.

1. In every ``length`` consecutive bytes of a document the smallest of its 32-byte grams, by hash, is its anchor
   (the last one, where equal), so equal strings have equal anchors at equal offsets.
2. Anchors that occur twice in the corpus are found by exchange between chunks and buckets; a string whose anchor
   is unique is unique.
3. The other strings go to their anchor's bucket, neighbours with the same anchor as one piece. A bucket builds a
   run-length index of its distinct pieces, streams matching statistics from it, and finds for every string the
   earliest place (smallest doc_id, then smallest start) among all that it matches over ``length`` bytes.
4. A string that has an earlier place is removed where it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .chunks import SENT, answered, buckets, chunked, read_bits, send, unpack
from .recompression import _least_most, _shared
from .runindex import build, first_matches
from .scratch import materialize_by
from .text import Pack, _BYTE, mix, span_hashes

GRAM = 32
KEY_BITS = 40
#: Text bytes that one index holds at most; a bucket with more has its index built for the pieces of some anchors at a time.
INDEX_BYTES = 1_000_000
STEP = 1 << 16
_LAST = np.uint64(0xFFFFFFFF)
#: Multipliers that join grams of 1, 2, 4, 8 and 16 bytes.
_DOUBLING = [np.uint64(pow(0xD6E8FEB86659FD93, 1 << i, 1 << 64)) for i in range(5)]


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of every GRAM consecutive bytes."""
    h = _BYTE[buf]
    for i, m in enumerate(_DOUBLING):
        width = 1 << i
        if len(h) <= width:
            return np.zeros(0, dtype=np.uint64)
        h = h[:-width] * m + h[width:]
    return _spread_bits(h)


def _spread_bits(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _least_of(v: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    have = 1
    while have * 2 <= w:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (w - have)], v[w - have :]) if have < w else v


def anchors(p: Pack, length: int) -> np.ndarray:
    """For the strings of ``length`` bytes that lie in one document: the sorted positions of their anchors."""
    n = len(p.bytes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    inside = _inside(p, n, length)
    mark = np.zeros(len(p.bytes), dtype=bool)
    for a in range(0, n, STEP):  # in steps whose arrays stay in the processor's cache
        b = min(n, a + STEP)
        h = gram_hashes(p.bytes[a : b + length - 1])
        v = (h & ~_LAST) | (_LAST - np.arange(len(h), dtype=np.uint64))  # the smallest hash; of equal ones the last
        mark[a + (_LAST - (_least_of(v, length - GRAM + 1)[inside[a:b]] & _LAST)).astype(np.int64)] = True
    return np.flatnonzero(mark)


def _inside(p: Pack, n: int, length: int) -> np.ndarray:
    """Which of the first n positions begin ``length`` bytes that lie in one document."""
    step = np.zeros(n + 1, dtype=np.int32)
    sizes = np.diff(p.starts)
    ok = sizes >= length
    np.add.at(step, p.starts[:-1][ok], 1)
    np.add.at(step, p.starts[1:][ok] - length + 1, -1)
    return np.cumsum(step[:-1]) > 0


def _extra(length: int):
    def run(p: Pack) -> bytes:
        return np.diff(anchors(p, length), prepend=0).astype(np.uint32).tobytes()

    return run


def _marked(row: dict, i: int) -> tuple[Pack, np.ndarray, np.ndarray]:
    """The pack, its anchors' positions and their keys."""
    p = unpack(row["ids"][i], row["starts"][i], row["body"][i])
    gaps = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["extra"][i].as_buffer()), dtype=np.uint32)
    at = np.cumsum(gaps, dtype=np.int64)
    if not len(at):
        return p, at, np.zeros(0, dtype=np.uint64)
    grams = _BYTE[p.bytes[at[:, None] + np.arange(GRAM)]]
    for m in _DOUBLING:
        grams = grams[:, 0::2] * m + grams[:, 1::2]
    return p, at, _spread_bits(grams[:, 0])


def _keys(h: np.ndarray) -> np.ndarray:
    """Keys of anchors; hashed anew, as anchors have small hashes and would all meet in the first buckets."""
    return mix(h) >> np.uint64(64 - KEY_BITS)


def _send_anchors(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, at, h = _marked(batch, i)
                keys, inverse, _, _ = _least_most(_keys(h), at)
                if len(keys):
                    several = np.bincount(inverse) > 1
                    yield send(batch["chunk"][i].as_py(), keys, n, KEY_BITS, lambda a, b, m=several: np.packbits(m[a:b]).tobytes())

    return run


def _pieces(p: Pack, at: np.ndarray, h: np.ndarray, answers: list[dict], n: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of strings with one shared anchor, in the order of its key: (key, first string, strings, the piece of equal bytes that stands for it)."""
    none = np.zeros(0, dtype=np.int64)
    if not len(at):
        return none.astype(np.uint64), none, none, none
    key = _keys(h)
    keys, inverse, _, _ = _least_most(key, at)
    hit = read_bits(answers, keys, n, KEY_BITS)[inverse]
    # each string's anchor: the least of those in it, by the same value as in anchors()
    total = len(p.bytes) - length + 1
    inside = _inside(p, total, length)
    owner = _owners(at, h, total, length - GRAM + 1)
    new = np.ones(total, dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    document = p.starts[(p.starts > 0) & (p.starts < total)]
    new[document] = True
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, total))
    ok = inside[start]
    ok[ok] = hit[owner[start[ok]]]
    start, count = start[ok], count[ok]
    if not len(start):
        return none.astype(np.uint64), none, none, none
    k = key[owner[start]]
    order = np.argsort(k, kind="stable")
    k, start, count = k[order], start[order], count[order]
    doc = np.searchsorted(p.starts, start, side="right") - 1
    name = span_hashes(p.bytes, start, start + count + length - 1) ^ mix(k)
    place = np.lexsort((start - p.starts[doc], p.ids[doc], name))  # equal pieces are sent once, from the earliest place
    new = np.ones(len(place), dtype=bool)
    new[1:] = name[place[1:]] != name[place[:-1]]
    same = np.empty(len(start), dtype=np.int64)
    same[place] = np.repeat(place[new], np.diff(np.append(np.flatnonzero(new), len(place))))
    return k, start, count, same


def _owners(at: np.ndarray, h: np.ndarray, total: int, w: int) -> np.ndarray:
    """For each string start the index of the anchor with the least hash (the last of equal ones) among the w grams from there."""
    own = np.empty(total, dtype=np.int64)
    for a in range(0, total, STEP):
        b = min(total, a + STEP)
        x, y = np.searchsorted(at, (a, b + w - 1))
        v = np.full(b - a + w - 1, np.uint64(0xFFFFFFFFFFFFFFFF))
        v[at[x:y] - a] = (h[x:y] & ~_LAST) | (_LAST - np.arange(y - x, dtype=np.uint64))
        own[a:b] = x + (_LAST - (_least_of(v, w) & _LAST)).astype(np.int64)
    return np.minimum(own, len(at) - 1)  # starts outside any document's strings may hold none


def _send_pieces(n: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i in range(batch.num_rows):
                p, at, h = _marked(batch, i)
                k, start, count, same = _pieces(p, at, h, batch["answers"][i].as_py(), n, length)
                sent = np.flatnonzero(same == np.arange(len(same)))
                k, start, count = k[sent], start[sent], count[sent]
                doc = np.searchsorted(p.starts, start, side="right") - 1
                place = np.stack((p.ids[doc], start - p.starts[doc], count, k.view(np.int64)), axis=1)
                raw = p.bytes.tobytes()
                bucket = ((k * np.uint64(n)) >> np.uint64(KEY_BITS)).astype(np.int64)
                full, a = np.unique(bucket, return_index=True)
                b = np.append(a[1:], len(k))
                texts = [b"".join(raw[s : s + c + length - 1] for s, c in zip(start[x:y].tolist(), count[x:y].tolist(), strict=True)) for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), batch["chunk"][i].as_py(), dtype=np.int64)), pa.array([z.compress(place[x:y].tobytes()) for x, y in zip(a, b, strict=True)], pa.binary()), pa.array([z.compress(t) for t in texts], pa.binary())],
                    names=["bucket", "chunk", "keys", "payload"],
                )

    return run


def _index_groups(key: np.ndarray, size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Indexes of pieces, all pieces of an anchor together, in groups of about ``most`` bytes."""
    order = np.argsort(key, kind="stable")
    k, total = key[order], np.cumsum(size[order])
    ends = np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, len(k))
    a = 0
    while a < len(k):
        fit = ends[(ends > a) & (total[ends - 1] - (total[a - 1] if a else 0) <= most)]
        b = int(fit[-1]) if len(fit) else int(ends[ends > a][0])
        yield order[a:b]
        a = b


def _first_places(length: int):
    """For one bucket: for every string of every row's pieces whether it also starts earlier."""

    def run(_, blobs: list[tuple[memoryview, memoryview]]) -> list[np.ndarray]:
        z = zstandard.ZstdDecompressor()
        places = [np.frombuffer(z.decompress(a), dtype=np.int64).reshape(-1, 4) for a, _ in blobs]
        strings: list[bytes] = []
        for pl, (_, t) in zip(places, blobs, strict=True):
            text = z.decompress(t)
            ends = np.cumsum(pl[:, 2] + length - 1)
            strings += [text[e - c - length + 1 : e] for e, c in zip(ends.tolist(), pl[:, 2].tolist(), strict=True)]
        every = np.concatenate(places)
        place = np.lexsort((every[:, 1], every[:, 0]))
        standing = np.empty(len(every), dtype=np.int64)
        seen: dict[bytes, int] = {}
        for x in place.tolist():
            standing[x] = seen.setdefault(strings[x], x)
        own = np.flatnonzero(standing == np.arange(len(every)))
        later: list = [None] * len(every)
        # the earliest places as numbers in order of (doc_id, start)
        _, anchor, alone = np.unique(every[own, 3], return_inverse=True, return_counts=True)
        alone = alone[anchor] == 1  # no other text has its anchor, so none of its strings
        for x in own[alone].tolist():
            later[x] = np.zeros(every[x, 2], dtype=bool)
        own = own[~alone]
        for g in _index_groups(every[own, 3], every[own, 2] + length, INDEX_BYTES):
            at = own[g]
            at = at[np.lexsort((every[at, 1], every[at, 0]))]
            index = build([strings[x] for x in at.tolist()])
            sizes = np.diff(index.first)
            inner = np.arange(index.n) - np.repeat(index.first[:-1], sizes)
            doc, pos = np.repeat(every[at, 0], sizes), np.repeat(every[at, 1], sizes) + inner
            by = np.lexsort((pos, doc))
            new = np.ones(len(by), dtype=bool)  # overlapping pieces of a document hold the same place twice
            new[1:] = (doc[by][1:] != doc[by][:-1]) | (pos[by][1:] != pos[by][:-1])
            order = np.empty(index.n, dtype=np.int64)
            order[by] = np.cumsum(new)
            early = first_matches(index, length, order) < order
            for x, a, c in zip(at.tolist(), index.first[:-1].tolist(), every[at, 2].tolist(), strict=True):
                later[x] = early[a : a + c]
        out, i = [], 0
        for pl in places:
            # an equal piece is a copy, unless it stands at the same place of a row with the same doc_id
            tied = (every[i : i + len(pl), :2] == every[standing[i : i + len(pl)], :2]).all(axis=1)
            rows = [later[standing[x]] if t else np.ones(every[x, 2], dtype=bool) for x, t in zip(range(i, i + len(pl)), tied.tolist(), strict=True)]
            out.append(np.concatenate(rows))
            i += len(pl)
        return out

    return run


def _kept(n: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p, at, h = _marked(batch, i)
                k, start, count, same = _pieces(p, at, h, batch["answers"][i].as_py(), n, length)
                gone = np.zeros(len(p.bytes) + 1, dtype=np.int32)
                if len(k):
                    sent = np.flatnonzero(same == np.arange(len(same)))
                    bucket = ((k[sent] * np.uint64(n)) >> np.uint64(KEY_BITS)).astype(np.int64)
                    bits = {x["bucket"]: np.frombuffer(x["bits"], dtype=np.uint8) for x in batch["later"][i].as_py() or ()}
                    full, a = np.unique(bucket, return_index=True)
                    early = [np.unpackbits(bits[b], count=int(count[sent[x:y]].sum())).astype(bool) for b, x, y in zip(full.tolist(), a, np.append(a[1:], len(sent)), strict=True)]
                    early = np.concatenate(early)
                    begins = np.cumsum(count[sent]) - count[sent]
                    doc = np.searchsorted(p.starts, start, side="right") - 1
                    inner = start - p.starts[doc]
                    # an equal piece stands earlier in this very chunk, or at the same place of a row with the same doc_id
                    copies = (p.ids[doc] != p.ids[doc[same]]) | (inner != inner[same])
                    tied = np.flatnonzero(~copies)
                    bit = _spread(begins[np.searchsorted(sent, same[tied])], count[tied])
                    where = np.concatenate((_spread(start[tied], count[tied])[early[bit]], _spread(start[copies], count[copies])))
                    np.add.at(gone, where, 1)
                    np.add.at(gone, where + length, -1)
                drop = np.cumsum(gone[:-1]) > 0
                total = np.concatenate(([0], np.cumsum(drop)))
                begin = drop.copy()
                begin[1:] &= ~drop[:-1]
                edge = p.starts[:-1][p.starts[:-1] < len(drop)]
                begin[edge] = drop[edge]
                spans = np.concatenate(([0], np.cumsum(begin)))
                kept = [p.bytes[a:b][~drop[a:b]].tobytes() for a, b in zip(p.starts[:-1], p.starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.ids), pa.array(np.diff(p.starts)), *(pa.array(t[p.starts[1:]] - t[p.starts[:-1]]) for t in (total, spans)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
                )

    return run


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of count."""
    return np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(start) else np.zeros(0, dtype=np.int64)


def byte_dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts earlier: in a document with a smaller
    doc_id, or before it in the same document.

    docs: doc_id, text; other columns are ignored. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs)
    and kept (binary: the other bytes in order). Texts are taken as UTF-8; matches never cross documents and may
    overlap; strings are judged on the input. A null text is an empty one; a text shorter than ``length`` is kept
    whole; rows with a null doc_id are left out. Every other row gives one row: rows that share a doc_id are judged each by
    its own text, and a string at the same start of another such row is not earlier.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    chunks = chunked(docs, _extra(length))
    n = buckets(chunks)
    shared = materialize_by(answered(chunks.mapInArrow(_send_anchors(n), SENT), n, _shared), "anchors", "chunk")
    near = chunks.join(shared, "chunk")
    later = materialize_by(answered(near.mapInArrow(_send_pieces(n, length), SENT), n, _first_places(length), raw=True).withColumnRenamed("answers", "later"), "places", "chunk")
    both = chunks.join(shared, "chunk", "left").join(later, "chunk", "left")
    return both.mapInArrow(_kept(n, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
