"""Removal of repeated passages by recompression of word sequences.

Words get hash names that are the same everywhere. Runs and then two rounds of pairs
shorten every document's sequence:

* a run of three or more equal words is first named as one symbol, and it also yields the name "a long run of this
  word"; equal symbols of later rounds never pair with each other;
* every symbol is left or right by a bit of its name, and each left symbol followed by a right one is replaced by
  the name of the pair. Pairs cannot overlap, and whether two neighbours pair depends on these two alone.

So equal word sequences have equal symbols except near their ends: of any 13 words, either three in a row are equal
and both copies yield the long-run name, or the symbol over the middle word (at most four words long) is the same in
every copy. Only windows around a symbol that occurs in two documents can repeat; these windows, and no others, are
compared with each other exactly by their 64-bit names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .chunks import SENT, answered, buckets, chunked, encode, key_ranges, read_bits, send, unpack
from .scratch import materialize_by, release
from .text import Pack, Words, mix, windows, word_hashes, words

#: Words a window must have: below, two rounds do not leave a shared symbol in every window.
LEAST_WINDOW = 13
ROUNDS = 2
RUN = 3
#: Bits of a symbol's name that are sent at least: chance agreement only adds windows to compare.
SYMBOL_BITS = 40


def symbol_bits(total: int) -> int:
    """Ten bits more than it takes to number the bytes of the corpus, so that few symbols agree by chance whatever its size."""
    return min(64, max(SYMBOL_BITS, total.bit_length() + 10))


def symbols(h: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after the rounds, and the long-run names: (name, first word, words, words that tell it).

    A symbol is told by all of its words, a long-run name by any RUN of them.
    """
    name, at, size = h, np.arange(len(h), dtype=np.int64), np.ones(len(h), dtype=np.int64)
    n = len(name)
    new = np.ones(n, dtype=bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, n))
    long = length >= RUN
    s, k = start[long], length[long]
    runs = (mix(name[s] + np.uint64(0xA5A5)), s, k, np.full(len(s), RUN))
    if len(s):
        name, size = name.copy(), size.copy()
        name[s], size[s] = mix(name[s] ^ mix(k.astype(np.uint64))), k
        keep = new | ~np.repeat(long, length)
        name, at, size = name[keep], at[keep], size[keep]
    for r in range(rounds):
        n, own = len(name), doc[at]
        # a symbol's side is a bit of its name
        side = (name >> np.uint64(3)) & np.uint64(1) == 1
        head = np.zeros(n, dtype=bool)
        head[:-1] = ~side[:-1] & side[1:] & (own[1:] == own[:-1])
        p = np.flatnonzero(head)
        # another name for a symbol that stays, so that its side is drawn anew
        pair = mix(mix(name[p]) + np.uint64(3) * name[p + 1] + np.uint64(r + 1))
        name, size = mix(name ^ np.uint64(r + 1)), size.copy()
        name[p] = pair
        size[p] += size[p + 1]
        keep = np.ones(n, dtype=bool)
        keep[p + 1] = False
        name, at, size = name[keep], at[keep], size[keep]
    return tuple(np.concatenate(x) for x in zip((name, at, size, size), runs, strict=True))


def _named(pack: Pack, bits: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    w = words(pack)
    h = word_hashes(pack.bytes, w)
    name, at, size, need = symbols(h, w.doc)
    return w, h, name >> np.uint64(64 - bits), at, size, need


def _least_most(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the inverse, and each key's least and greatest value."""
    order = np.argsort(key)
    k, v = key[order], value[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    start = np.flatnonzero(new)
    inverse = np.empty(len(k), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    if not len(k):
        return k, inverse, v, v
    return k[start], inverse, np.minimum.reduceat(v, start), np.maximum.reduceat(v, start)


def _send_symbols(n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p = unpack(batch["ids"][i], batch["starts"][i], batch["body"][i])
                w, _, name, at, _, _ = _named(p, bits)
                keys, _, least, most = _least_most(name, p.ids[w.doc[at]])
                if len(keys):
                    several = least != most
                    yield send(batch["chunk"][i].as_py(), keys, n, bits, lambda a, b, m=several: np.packbits(m[a:b]).tobytes())

    return run


def _shared(keys: list[np.ndarray], payloads: list[memoryview]) -> list[np.ndarray]:
    """For each key whether it came twice, or from several documents of one chunk."""
    several = [np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=len(k)).astype(bool) for k, p in zip(keys, payloads, strict=True)]
    every = np.concatenate(keys)
    order = np.argsort(every)
    s = every[order]
    twice = np.zeros(len(s), dtype=bool)
    twice[1:] = s[1:] == s[:-1]
    twice[:-1] |= twice[1:]
    start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    flag = twice | np.repeat(np.maximum.reduceat(np.concatenate(several)[order], start), np.diff(np.append(start, len(s))))
    out = np.empty(len(s), dtype=bool)
    out[order] = flag
    return np.split(out, np.cumsum([len(k) for k in keys])[:-1])


def _candidates(p: Pack, answers: list[dict], n: int, width: int, bits: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, the first words of the windows that hold a shared symbol, and these windows' names."""
    w, h, name, at, size, need = _named(p, bits)
    keys, inverse, _, _ = _least_most(name, name)
    hit = read_bits(answers, keys, n, bits)[inverse]
    at, size, need = at[hit], size[hit], need[hit]
    limit = len(w) - width + 1
    if limit <= 0 or not len(at):
        return w, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    low, high = np.maximum(at + need - width, 0), np.minimum(at + size - need, limit - 1)
    ok = low <= high
    step = np.zeros(limit + 1, dtype=np.int32)
    np.add.at(step, low[ok], 1)
    np.add.at(step, high[ok] + 1, -1)
    start = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    start = start[w.doc[start] == w.doc[start + width - 1]]
    x = windows(h, width)[start] if len(start) else np.zeros(0, dtype=np.uint64)
    return w, start, x


def _send_windows(n: int, width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i in range(batch.num_rows):
                p = unpack(batch["ids"][i], batch["starts"][i], batch["body"][i])
                w, start, x = _candidates(p, batch["answers"][i].as_py(), n, width, bits)
                keys, _, least, _ = _least_most(x, p.ids[w.doc[start]])
                if len(keys):
                    yield send(batch["chunk"][i].as_py(), keys, n, 64, lambda a, b, v=least: z.compress(v[a:b].tobytes()))

    return run


def _earlier(keys: list[np.ndarray], payloads: list[memoryview]) -> list[np.ndarray]:
    """For each key of each row whether another row has it with a smaller document."""
    z = zstandard.ZstdDecompressor()
    own = [np.frombuffer(z.decompress(p), dtype=np.int64) for p in payloads]
    out = [np.empty(len(k), dtype=bool) for k in keys]
    for spans in key_ranges(keys):
        part = np.concatenate([k[a:b] for k, (a, b) in zip(keys, spans, strict=True)])
        ids = np.concatenate([v[a:b] for v, (a, b) in zip(own, spans, strict=True)])
        _, inverse, least, _ = _least_most(part, ids)
        flag, done = least[inverse] < ids, 0
        for o, (a, b) in zip(out, spans, strict=True):
            o[a:b], done = flag[done : done + b - a], done + b - a
    return out


def _cover(length: int, start: np.ndarray, width: int) -> np.ndarray:
    step = np.zeros(length + 1, dtype=np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(start + width, length), -1)
    return np.cumsum(step[:-1]) > 0


def _without(p: Pack, i: int, w: Words, drop: np.ndarray, layout: bool) -> bytes:
    """The kept words of document i: joined by single spaces, or with the separators that follow them."""
    a, b = w.first[i], w.first[i + 1]
    gone = drop[a:b]
    text = p.text(i)
    if not layout:
        return b" ".join(compress(text.split(), (~gone).tolist()) if gone.any() else text.split())
    if not gone.any():
        return text
    keep = np.ones(len(text), dtype=np.int8)
    begin, follow = w.start[a:b] - p.starts[i], np.append(w.start[a + 1 : b] - p.starts[i], len(text))
    step = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(step, begin[gone], 1)
    np.add.at(step, follow[gone], -1)
    keep[np.cumsum(step[:-1]) > 0] = 0
    return np.frombuffer(text, dtype=np.uint8)[keep == 1].tobytes()


def _kept(n: int, width: int, bits: int, layout: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p = unpack(batch["ids"][i], batch["starts"][i], batch["body"][i])
                w, start, x = _candidates(p, batch["answers"][i].as_py(), n, width, bits)
                keys, inverse, least, _ = _least_most(x, p.ids[w.doc[start]])
                before = read_bits(batch["later"][i].as_py(), keys, n, 64)[inverse] if len(keys) else np.zeros(0, dtype=bool)
                before |= p.ids[w.doc[start]] > least[inverse]
                drop = _cover(len(w), start[before], width)
                total = np.concatenate(([0], np.cumsum(drop)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.ids), pa.array(np.diff(w.first)), pa.array(total[w.first[1:]] - total[w.first[:-1]]), pa.array([_without(p, d, w, drop, layout) for d in range(len(p))], pa.binary()).cast(pa.string()), pa.array([xxhash.xxh64_intdigest(p.text(d), 42) for d in range(len(p))], pa.uint64()).view(pa.int64())],
                    names=["doc_id", "n_words", "n_removed", "text", "source"],
                )

    return run


def substring_dedup(docs: DataFrame, window: int = LEAST_WINDOW, layout: bool = False) -> DataFrame:
    """Remove each word covered by a window of words that also starts in a document with a smaller doc_id.

    docs: doc_id, text; other columns are ignored. Returns doc_id, n_words, n_removed, text, and source (xxhash64 of the
    text that came in, which tells rows of one doc_id apart). ``text`` is the kept
    words joined by single spaces or, with ``layout``, the original text less the removed words and the separators
    after them. Words are ``[^\\x20\\x09-\\x0D]+`` as they stand. Windows are judged on the input. A null text is an
    empty one; a text shorter than a window is kept whole; rows with a null doc_id are left out, and rows that share
    a doc_id never remove words of each other.
    """
    if window < LEAST_WINDOW:
        raise ValueError(f"window must be at least {LEAST_WINDOW}")
    chunks = chunked(docs)
    n = buckets(chunks)
    bits = symbol_bits(int(chunks.agg(F.sum("size")).first()[0] or 0))
    shared = materialize_by(answered(chunks.mapInArrow(_send_symbols(n, bits), SENT), n, _shared), "symbols", "chunk")
    release(docs.sparkSession)
    near = chunks.join(shared, "chunk", "left")
    later = materialize_by(answered(near.mapInArrow(_send_windows(n, window, bits), SENT), n, _earlier).withColumnRenamed("answers", "later"), "windows", "chunk")
    release(docs.sparkSession)
    both = chunks.join(shared, "chunk", "left").join(later, "chunk", "left")
    return both.mapInArrow(_kept(n, window, bits, layout), "doc_id long, n_words long, n_removed long, text string, source long")
