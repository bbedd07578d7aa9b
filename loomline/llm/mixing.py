"""Language-model scores by online logistic mixing of hashed-context bit predictors over whole texts.

A text is a sequence of tokens: its words, A-Z lower-cased, then one end token. It is coded token by token, in order:

1. Novelty: whether the token stands in another training text. Predicted by an adaptive map over the document's class
   and the novelty of the two tokens before.
2. A token that does is coded by the bits of its name (a hash), down to where names are as good as unique. Each bit has
   four predictors with counts of how the training tokens went on from here: none but the bits so far; the document's
   class (a hash of its most frequent short word; coded first, its cost is part of the score); the word before; and
   the whole words before that make up ``REACH`` bytes or more.
3. A new token is spelled: each bit of its bytes and of a closing byte is predicted by its last byte, its last two and
   (hashed) its last three, with counts over the rare words of all chunks.

The predictors' logits are combined by weights chosen by a gate (how often two of the contexts have been seen, and how
deep the bit is). The weights are learned online: a chunk's texts are coded in order, a batch of tokens at a time, and each
batch is first coded by the weights so far and then, as far as it is of training texts, learned from. A last stage refines the
mixed probability by an adaptive map of how often a probability of that size has been right. Counts are of the whole corpus;
weights and maps (some hundreds of numbers) are a chunk's own. The score is the sum of log10 probabilities of all decisions.

A training text is scored by what the other training texts say: its own occurrences are taken out of its tokens' counts,
so that texts which were learned from and texts which were not can be compared, and a text with a copy stands out.

Counts of words and of long contexts are exact but for hash collisions, kept by hash in buckets that answer the chunks
which ask, and grow with the corpus; nothing is capped. The counts of classes, of words before and of spellings are in
tables whose size has a bound (CLASSES * 2^CELL_BITS, BEFORE * 2^BEFORE_BITS, and 2^24 pairs of a spelling context and a
byte for each order, of which texts have some hundred thousand), as they are of hashed contexts and few bits.
Counts above 15 are sent in steps of an eighth of a binary order, so probabilities are right to a few hundredths of a bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .chunks import buckets, by_bucket, chunked, decode, encode, key_ranges, unpack
from .scratch import materialize_by
from .text import Pack, _LOWER, mix, word_hashes, words

#: Bytes that the long context reaches back over at least, in whole words.
REACH = 10
#: Bits of a word's name that order-0 counts are kept of in one table at least; deeper ones are asked for.
TOP_BITS = 18
#: Bits by which words are counted.
WORD_BITS = 56
#: Bits of a token's name that a long context tells apart; tokens that share them are one to it.
NAME_BITS = 14
#: Classes of documents and bits of names that they predict; words before (hashed) and bits that these predict.
CLASSES, CELL_BITS = 256, 12
BEFORE, BEFORE_BITS = 1024, 8
#: Letters of the longest word that can name a class.
SHORT = 4
#: Orders of the spelling contexts; bytes of the longest are hashed to 16 bits.
ORDERS = (1, 2, 3)
CLOSING = 0x20
#: What is added to both counts of a bit.
PRIOR = np.float32(0.05)
INPUTS, WORD_GATES, SPELL_GATES = 4, 40, 9
GATES = WORD_GATES + SPELL_GATES
#: Mixed logits are taken in steps of 1/32 from -16 to 16; the last stage's map joins a quarter's steps of either sign.
FINE, BINS = 1024, 64
#: Tokens worked on at a time: few at first, while weights move fast.
STEPS = (512, 1024, 2048, 4096, 8192, 16384)
SLICES = 64
LN10 = float(np.log(10))
_NAMED = np.uint64((1 << 64) - (1 << 64 - WORD_BITS))
_END = np.uint64(0x0E0D0E0D0E0D0E00)


# counts as bytes: exact up to 15, then eight steps to an octave
_VALUE = np.concatenate((np.arange(16), 16 * 2 ** ((np.arange(240) + 0.5) / 8))).astype(np.float32)


def _quantised(x: np.ndarray) -> np.ndarray:
    out = np.minimum(x, 15).astype(np.uint8)
    large = np.flatnonzero(x > 15)
    out[large] = np.minimum(16 + np.floor(8 * np.log2(x[large] / 16)), 255)
    return out


def mix_light(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the inverse, and how many entries each has."""
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)
    inverse = np.empty(len(k), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return k[first], inverse, np.diff(np.append(first, len(k)))


_tables: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
_BASE = 0xD1342543DE82EF95


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) < n:
        size = max(n, 1 << 20)
        for i, m in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _tables[i] = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(size - 1, np.uint64(m)))), dtype=np.uint64)
    return _tables[0][:n], _tables[1][:n]


def _ranges(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of h[begin:end] for each pair of the two, from prefix sums."""
    power, inverse = _powers(len(h) + 1)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)))
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


@dataclass
class Layout:
    """What all chunks and buckets agree on: the number of buckets, the bits of an order-0 cell, of a token's code and of a context's group."""

    n: int
    cell_bits: int
    code_bits: int
    group_bits: int

    @classmethod
    def of(cls, total: int, n: int) -> Layout:
        cell = max(TOP_BITS, (n - 1).bit_length())
        # there is about a distinct word in 64 bytes, so most names are unique
        code = min(40, max(cell + 1, NAME_BITS, (total // 64).bit_length()))
        return cls(n, cell, code, min(47, max(28, (total // n).bit_length() + 4)))

    def word_bucket(self, h: np.ndarray) -> np.ndarray:
        """Words of one cell are in one bucket."""
        return ((h >> np.uint64(64 - self.cell_bits)) * np.uint64(self.n) >> np.uint64(self.cell_bits)).astype(np.int64)

    def context_key(self, group: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket, and the key in it: some bits of the group, then the name."""
        bucket = ((group >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int64)
        return bucket, (group & np.uint64((1 << self.group_bits) - 1)) << np.uint64(NAME_BITS) | name.astype(np.uint64)


class Tokens:
    """The tokens of a chunk in coding order, with what is counted of them."""

    def __init__(self, p: Pack, learns: np.ndarray, lay: Layout) -> None:
        w = words(p)
        n = len(p)
        self.n_docs, self.learns, self.lay = n, learns, lay
        at, ends = np.arange(len(w)) + w.doc, w.first[1:] + np.arange(n)
        size = len(w) + n
        self.h, self.doc = np.empty(size, dtype=np.uint64), np.empty(size, dtype=np.int64)
        self.h[at], self.h[ends] = word_hashes(p.bytes, w, lower=True) & _NAMED, _END
        self.doc[at], self.doc[ends] = w.doc, np.arange(n)
        self.start, self.size = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        self.start[at], self.size[at] = w.start, w.end - w.start
        self.first = np.append(0, ends + 1)
        self.bytes = p.bytes

    def find_words(self) -> None:
        """The distinct words with their occurrences in training texts, of each token's word those in its own text, and the texts' classes."""
        n, size, learns = self.n_docs, len(self.h), self.learns
        self.word, self.of, _ = _groups(self.h)
        trained = learns[self.doc]
        self.count = np.bincount(self.of[trained], minlength=len(self.word))
        pair = self.of * n + self.doc
        self.pair, self.pair_of, held = _groups(pair)
        self.held = held[self.pair_of]
        self.own = np.where(trained, self.held, 0)
        doc_of = self.pair % n if n else self.pair
        self.docs = np.bincount((self.pair // max(n, 1))[learns[doc_of]], minlength=len(self.word))
        # the class: the most frequent short word, of equal ones the one with the smallest hash
        where = np.empty(len(self.word), dtype=np.int64)
        where[self.of] = np.arange(size)
        self.where = where
        word_of = self.pair // max(n, 1)
        short = (self.size[where[word_of]] <= SHORT) & (self.word[word_of] != _END)
        word_of, doc_of, held = word_of[short], doc_of[short], held[short]
        best = np.lexsort((word_of, -held, doc_of))
        lead = np.ones(len(best), dtype=bool)
        lead[1:] = doc_of[best][1:] != doc_of[best][:-1]
        self.kind = np.zeros(n, dtype=np.int64)
        self.kind[doc_of[best[lead]]] = 1 + (mix(self.word[word_of[best[lead]]]) % np.uint64(CLASSES - 1)).astype(np.int64)
        before = np.zeros(size, dtype=np.uint64)
        before[1:] = self.h[:-1]
        before[self.first[:-1]] = np.uint64(0)
        self.before = (mix(before) >> np.uint64(54)).astype(np.int64)

    def find_contexts(self) -> None:
        """The distinct pairs of a long context and a token's name, by bucket and key, with their occurrences in training
        texts; and where each token's is (-1 near the start of a text, where there is no context yet)."""
        reach = np.concatenate(([0], np.cumsum(self.size + 1)))
        j = np.arange(len(self.h)) - 1
        near = np.flatnonzero(j >= 0)
        while len(near):  # at most REACH times: every token is a byte or more
            near = near[reach[j[near]] > reach[near] - REACH]
            j[near] -= 1
            near = near[j[near] >= 0]
        has = np.flatnonzero(j >= self.first[self.doc])
        bucket, key = self.lay.context_key(_ranges(self.h, j[has], has), self.h[has] >> np.uint64(64 - NAME_BITS))
        bits = np.uint64(NAME_BITS + self.lay.group_bits)
        if int(bits) + self.lay.n.bit_length() <= 64:
            both, inverse, _ = _groups(bucket.astype(np.uint64) << bits | key)
            self.bucket, self.key = (both >> bits).astype(np.int64), both & ((np.uint64(1) << bits) - np.uint64(1))
        else:
            order = np.lexsort((key, bucket))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
            inverse = np.empty(len(order), dtype=np.int64)
            inverse[order] = np.cumsum(new) - 1
            self.bucket, self.key = bucket[order][new], key[order][new]
        self.weight = np.bincount(inverse[self.learns[self.doc[has]]], minlength=len(self.key))
        self.context = np.full(len(self.h), -1, dtype=np.int64)
        self.context[has] = inverse

    def find_rare(self) -> None:
        """The rare words: those that may be new somewhere, in one training text of the chunk at most."""
        self.rare = np.flatnonzero((self.docs <= 1) & (self.word != _END))
        self.rare_learned = self.docs[self.rare] == 1
        self.rare_size = self.size[self.where[self.rare]] + 1

    def spelled(self, rare: np.ndarray) -> list[np.ndarray]:
        """For each order and each byte of rare words: the spelling context (in at most 16 bits, zeros before a word's start) and the byte."""
        size = self.rare_size[rare]
        n = int(size.sum())
        edge = np.cumsum(size)
        take = np.repeat(self.start[self.where[self.rare[rare]]] - (edge - size), size) + np.arange(n)
        byte = _LOWER.take(self.bytes.take(take, mode="clip")).astype(np.int32)  # clip: the last word may end the chunk
        byte[edge - 1] = CLOSING
        begin = edge - size
        context, out = np.zeros(n, dtype=np.int32), []
        for back in ORDERS:
            before = np.zeros(n, dtype=np.int32)
            before[back:] = byte[:-back] if back < n else 0
            for i in range(back):  # a word has no bytes before its own
                before[(begin + i)[size > i]] = 0
            context = context | before << 8 * (back - 1)
            short = context if back < 3 else (mix_light(context.astype(np.uint64)) >> np.uint64(48)).astype(np.int32)
            out.append(short << 8 | byte)
        return out

    def context_own(self) -> np.ndarray:
        """How often each token's context goes on with its name in its own text, if that was learned from."""
        out = np.zeros(len(self.h), dtype=np.int64)
        has = np.flatnonzero((self.context >= 0) & self.learns[self.doc])
        out[has] = 1
        has = has[self.weight[self.context[has]] > 1]
        _, inverse, count = _groups(self.context[has] * self.n_docs + self.doc[has])
        out[has] = count[inverse]
        return out


def _read(batch: pa.RecordBatch, i: int, lay: Layout, words: bool = True) -> tuple[np.ndarray, Tokens]:
    p = unpack(batch["ids"][i], batch["starts"][i], batch["body"][i])
    t = Tokens(p, np.frombuffer(batch["flags"][i].as_buffer(), dtype=np.uint8) == 1, lay)
    if words:
        t.find_words()
    return p.ids, t


SENT = "bucket int, chunk long, keys binary, payload binary"


def _rows(chunk: int, bucket: np.ndarray, key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """A chunk's sorted keys and their counts, a row a bucket."""
    z = zstandard.ZstdCompressor(level=1)
    full, a = np.unique(bucket, return_index=True)
    spans = list(zip(a, np.append(a, len(bucket))[1:], strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk, dtype=np.int64)), pa.array([encode(key[x:y]) for x, y in spans], pa.binary()), pa.array([z.compress(count[x:y].astype(np.uint32).tobytes()) for x, y in spans], pa.binary())],
        names=["bucket", "chunk", "keys", "payload"],
    )


def _send_words(lay: Layout):
    """Each chunk's words for buckets 0 to n, and each task's tables: slices for the next SLICES buckets, then a row an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        tables, some = np.zeros(CLASSES * ((1 << CELL_BITS) + 1) + BEFORE * (1 << BEFORE_BITS), dtype=np.int64), False
        spelled = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(ORDERS)
        for batch in batches:
            for i in range(batch.num_rows):
                some, (_, t) = True, _read(batch, i, lay)
                _tabulate(t, tables)
                t.find_rare()
                for k, v in enumerate(t.spelled(np.flatnonzero(t.rare_learned))):
                    spelled[k] = _added(spelled[k], np.unique(v, return_counts=True))
                yield _rows(batch["chunk"][i].as_py(), lay.word_bucket(t.word), t.word >> np.uint64(64 - WORD_BITS), t.count)
        if some:
            parts = [np.concatenate((np.arange(len(v)), v)) for v in np.array_split(tables, SLICES)] + [np.concatenate(v) for v in spelled]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32) + lay.n), pa.array(np.full(len(parts), -1)), pa.array([b""] * len(parts), pa.binary()), pa.array([z.compress(v.tobytes()) for v in parts], pa.binary())], names=["bucket", "chunk", "keys", "payload"])

    return run


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two sparse tables of places and counts."""
    place, inverse = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    return place, np.bincount(inverse, weights=np.concatenate((a[1], b[1])), minlength=len(place)).astype(np.int64)


def _send_contexts(lay: Layout):
    """Each chunk's context pairs for buckets n to 2 n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, t = _read(batch, i, lay, words=False)
                t.find_contexts()
                if len(t.key):
                    yield _rows(batch["chunk"][i].as_py(), t.bucket, t.key, t.weight)

    return run


def _tabulate(t: Tokens, tables: np.ndarray) -> None:
    """Add training tokens by class and cell (and training texts by class), and by the word before and cell."""
    cells, split = 1 << CELL_BITS, CLASSES * ((1 << CELL_BITS) + 1)
    trained = t.learns[t.doc]
    kind = t.kind[t.doc[trained]] * (cells + 1) + (t.h[trained] >> np.uint64(64 - CELL_BITS)).astype(np.int64)
    tables[:split] += np.bincount(np.concatenate((kind, t.kind[t.learns] * (cells + 1) + cells)), minlength=split)
    before = (t.before[trained] << BEFORE_BITS) + (t.h[trained] >> np.uint64(64 - BEFORE_BITS)).astype(np.int64)
    tables[split:] += np.bincount(before, minlength=len(tables) - split)


def _paths(keys: np.ndarray, count: np.ndarray, bits: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted distinct keys of so many bits: the sums over keys that share the first ``low`` bits and the first ``high``,
    and for each bit from low to high that over those which share the bits before and differ in it, quantised, as (high - low, keys)."""
    other = np.zeros((max(0, high - low), len(keys)), dtype=np.uint8)
    first = above = None
    live = np.arange(len(keys))  # a key that nothing shares its bits with differs from nothing further down
    for d in range(low, high + 1):
        top = keys >> np.uint64(bits - d) if d else np.zeros(len(keys), dtype=np.uint64)
        edge = np.flatnonzero(np.append(True, top[1:] != top[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(edge, len(keys)))
        here = np.repeat(np.add.reduceat(count, edge) if len(edge) else count, size)
        if above is None:
            first, above = here, here.copy()
        else:
            other[d - low - 1, live] = _quantised(above[live] - here)
            above[live] = here
        several = np.repeat(size > 1, size)
        live, keys, count = live[several], keys[several], count[several]
    return first, above, other


def _answers(chunk: list[int], bucket: int, blob: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array([bucket] * len(chunk), pa.int32()), pa.array(blob, pa.binary())], names=["chunk", "bucket", "blob"])


def _received(rows: list[tuple]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The sorted keys and the counts of each of a bucket's rows."""
    z = zstandard.ZstdDecompressor()
    return [decode(memoryview(r[1].as_buffer())) for r in rows], [np.frombuffer(z.decompress(r[2].as_buffer()), dtype=np.uint32) for r in rows]


def _merged(keys: list[np.ndarray], sent: list[np.ndarray], spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of spans of a bucket's rows the distinct keys and their counts; where each row's keys are and its own counts, row after row; and where rows end."""
    own = np.concatenate([v[a:b] for v, (a, b) in zip(sent, spans, strict=True)])
    every, inverse, _ = _groups(np.concatenate([k[a:b] for k, (a, b) in zip(keys, spans, strict=True)]))
    count = np.bincount(inverse, weights=own, minlength=len(every)).astype(np.int64)
    return every, count, inverse, own, np.cumsum([b - a for a, b in spans])


#: Answers that go to Spark at a time.
ANSWERS = 64


def _answer_rows(rows: list[tuple], bucket: int, blob: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), ANSWERS):
        some = rows[i : i + ANSWERS]
        yield _answers([r[0].as_py() for r in some], bucket, [next(blob) for _ in some])


def _answer_words(lay: Layout):
    """For each chunk's words the training count, the others of each bit below the cell, and the others that share all of the
    code. Sums of tables, and a bucket's own totals (distinct words, tokens by cell), go to chunk -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, out = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        for b, rows in by_bucket(batches):
            if b >= lay.n:
                total = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
                for r in rows:
                    total = _added(total, np.split(np.frombuffer(z.decompress(r[2].as_buffer()), dtype=np.int64), 2))
                yield _answers([-1], b, [out.compress(np.concatenate(total).tobytes())])
                continue
            keys, sent = _received(rows)
            counts, tables, cells, sums, distinct = [[] for _ in rows], [[] for _ in rows], [], [], 0
            for spans in key_ranges(keys, WORD_BITS - lay.cell_bits):
                every, count, at, _, edge = _merged(keys, sent, spans)
                _, same, other = _paths(every, count, WORD_BITS, lay.cell_bits, lay.code_bits)
                table = np.concatenate((other, _quantised(same - count)[None]))
                for c, t, v, w in zip(counts, tables, np.split(count.astype(np.uint32)[at], edge[:-1]), np.split(table[:, at], edge[:-1], axis=1), strict=True):
                    c.append(v)
                    t.append(w)
                cell, of, _ = _groups(every >> np.uint64(WORD_BITS - lay.cell_bits))
                cells.append(cell.astype(np.int64))
                sums.append(np.bincount(of, weights=count, minlength=len(cell)).astype(np.int64))
                distinct += int((count > 0).sum())
            yield from _answer_rows(rows, b, (out.compress(np.concatenate(c).tobytes() + np.concatenate(t, axis=1).tobytes()) for c, t in zip(counts, tables, strict=True)))
            yield _answers([-1], b, [out.compress(np.concatenate(([distinct], *cells, *sums)).tobytes())])

    return run


def _answer_contexts(lay: Layout):
    """For each chunk's pairs a bit each, whether anything is known beyond what the chunk sent; of those, the count and the others of each bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = zstandard.ZstdCompressor(level=3)
        for b, rows in by_bucket(batches):
            keys, sent = _received(rows)
            flags, tables = [[] for _ in rows], [[] for _ in rows]
            for spans in key_ranges(keys, NAME_BITS):
                every, count, at, own, edge = _merged(keys, sent, spans)
                known, _, other = _paths(every, count, NAME_BITS + lay.group_bits, lay.group_bits, NAME_BITS + lay.group_bits)
                table = np.concatenate((_quantised(count)[None], other))
                more = known[at] > own
                upto = np.concatenate(([0], np.cumsum(more)))[edge]
                for f, t, v, w in zip(flags, tables, np.split(more, edge[:-1]), np.split(table[:, at[more]], upto[:-1], axis=1), strict=True):
                    f.append(v)
                    t.append(w)
            yield from _answer_rows(rows, b, (out.compress(np.packbits(np.concatenate(f)).tobytes() + np.concatenate(t, axis=1).tobytes()) for f, t in zip(flags, tables, strict=True)))

    return run


@dataclass
class Model:
    """order0, kind, before: pyramids of counts at each bit for all tokens, by class, and by the word before; classes: training
    texts of each; spelled: of each order the places (context and byte) and counts; weights: a row for each gate; seen: decisions by gate and mixed logit; novel: by class and two flags."""

    order0: list[np.ndarray]
    kind: list[np.ndarray]
    before: list[np.ndarray]
    classes: np.ndarray
    spelled: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray = field(default_factory=lambda: np.array([[0.3, 0.3, 0.2, 1.0]] * WORD_GATES + [[0.2, 0.25, 0.5, 0.0]] * SPELL_GATES))
    curve: np.ndarray = field(default_factory=lambda: np.tile(np.eye(INPUTS) * 30.0, (GATES, 1, 1)))
    seen: np.ndarray = field(default_factory=lambda: np.zeros((GATES, FINE)))
    novel: np.ndarray = field(default_factory=lambda: np.zeros((CLASSES, 4, 2)))

    def fresh(self) -> Model:
        """A model of the same counts that has learned nothing else."""
        return Model(self.order0, self.kind, self.before, self.classes, self.spelled)

    def mixed(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """The logit that each decision goes as it went, from the predictors' logits of that; a predictor may have the first rows alone."""
        w = self.weights.astype(np.float32).T.copy()
        t = x[0] * w[0].take(gate)
        for i in range(1, len(x)):
            t[: len(x[i])] += x[i] * w[i].take(gate[: len(x[i])])
        return t

    @staticmethod
    def fine(t: np.ndarray) -> np.ndarray:
        return np.clip(t * np.float32(32) + np.float32(FINE // 2), np.float32(0), np.float32(FINE - 1)).astype(np.intp)

    def logs(self, low: int, high: int) -> np.ndarray:
        """(gates, FINE) logarithms of refined probabilities for the gates from low to high: of the mean of the mixed one and of the map's, which is how often
        a decision with a logit of about this size goes the likelier way."""
        size = self.seen[low:high].reshape(high - low, BINS, -1).sum(axis=2)
        up, down = size[:, BINS // 2 :], size[:, BINS // 2 - 1 :: -1]  # as likely, and as unlikely
        middle = 1 / (1 + np.exp(-(np.arange(BINS // 2) + 0.5) / 2))
        right = (up + 20 * middle) / (up + down + 20)
        mapped = np.concatenate((1 - right[:, ::-1], right), axis=1).repeat(FINE // BINS, axis=1)
        return np.log(np.clip((_LOGISTIC + mapped) / 2, 1e-7, 1)).astype(np.float32)

    def learn(self, x: list[np.ndarray], gate: np.ndarray, cell: np.ndarray, low: int, some: np.ndarray) -> None:
        """One online Newton step of each gate (from ``low`` on) for some of a batch's decisions, and the map's counts. cell: the
        gate's number from ``low`` and the mixed logit."""
        x, gate, cell, some = [v.reshape(-1) for v in x], gate.reshape(-1), cell.reshape(-1), some.reshape(-1)
        step = np.zeros((GATES, INPUTS))
        a = 0
        for b in sorted({len(v) for v in x}):  # up to here these predictors are heard
            heard = [i for i, v in enumerate(x) if len(v) >= b]
            own = gate[a:b]
            least, most = (own.min(), own.max()) if b > a else (0, 0)
            if np.count_nonzero(own == least) + np.count_nonzero(own == most) >= b - a:
                self._learn_two(heard, np.stack([x[i][a:b] for i in heard]), own == most, int(least), int(most), cell[a:b], low, some[a:b], step)
            else:
                self._learn_many(heard, [x[i][a:b] for i in heard], own, cell[a:b], low, some[a:b], step)
            a = b
        self.weights += np.linalg.solve(self.curve, step[:, :, None])[:, :, 0]


    def _saw(self, count: np.ndarray, low: int) -> None:
        self.seen[low:].reshape(-1)[: len(count)] += count

    def _learn_two(self, heard: list[int], full: np.ndarray, upper: np.ndarray, least: int, most: int, cell: np.ndarray, low: int, some: np.ndarray, step: np.ndarray) -> None:
        """Sums for decisions of two gates (or one), as they lie: those of which nothing is learned weigh nothing."""
        place = cell & (FINE - 1)
        miss, slope = _MISS.take(place) * some, _SLOPE.take(place) * some
        np.copyto(place, cell)
        place[~some] = len(self.seen[low:]) * FINE
        self._saw(np.bincount(place)[: len(self.seen[low:]) * FINE], low)
        both = np.ix_(heard, heard)
        for g, own in ((most, upper), (least, ~upper)) if least < most else ((least, None),):
            m, v = (miss, slope) if own is None else (miss * own, slope * own)
            self.curve[g][both] += (full * v) @ full.T
            step[g, heard] += full @ m

    def _learn_many(self, heard: list[int], x: list[np.ndarray], gate: np.ndarray, cell: np.ndarray, low: int, some: np.ndarray, step: np.ndarray) -> None:
        """Sums for decisions of many gates, by gate."""
        order = np.flatnonzero(some)
        gate = gate.take(order)
        by_gate = np.argsort(gate, kind="stable")
        order, gate = order.take(by_gate), gate.take(by_gate)
        full = np.empty((len(heard), len(order)), dtype=np.float32)
        for own, v in zip(full, x, strict=True):
            v.take(order, out=own, mode="clip")
        place = cell.take(order)
        self._saw(np.bincount(place), low)
        place &= FINE - 1
        miss, slope = _MISS.take(place), full * _SLOPE.take(place)
        both, edge = np.ix_(heard, heard), np.searchsorted(gate, np.arange(GATES + 1, dtype=np.uint8)).tolist()
        for g, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            if b > a:
                self.curve[g][both] += slope[:, a:b] @ full[:, a:b].T
                step[g, heard] += full[:, a:b] @ miss[a:b]


#: For each step of a logit: the probability, that of the other way, and the slope.
_LOGISTIC = 1 / (1 + np.exp(-(np.arange(FINE) - FINE // 2 + 0.5) / 32))
_MISS, _SLOPE = (1 - _LOGISTIC).astype(np.float32), np.maximum(_LOGISTIC * (1 - _LOGISTIC), 1e-5).astype(np.float32)


def _stretch(taken: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.log((taken + PRIOR) / (other + PRIOR))


def _down(table: list[np.ndarray], row: np.ndarray | None, cell: np.ndarray, bits: int) -> np.ndarray:
    """(bits + 1, tokens) counts at each bit on the way to the cells, of one row of a pyramid each."""
    out = np.empty((bits + 1, len(cell)), dtype=np.float32)
    at = cell if row is None else (row << bits) + cell
    for d in range(bits + 1):
        table[d].take(at >> (bits - d), out=out[d], mode="clip")
    return out


class Coder:
    """The decisions of a chunk's tokens, with the counts of their contexts."""

    def __init__(self, t: Tokens, words_: list[dict], contexts: list[dict] | None, lay: Layout, model: Model) -> None:
        self.t, self.lay, self.model = t, lay, model
        t.find_contexts()
        t.find_rare()
        z = zstandard.ZstdDecompressor()
        got = {a["bucket"]: z.decompress(a["blob"]) for a in words_}
        levels = lay.code_bits - lay.cell_bits + 1
        self.count, self.below = np.zeros(len(t.word), dtype=np.int64), np.zeros((levels, len(t.word)), dtype=np.uint8)
        edge = np.searchsorted(lay.word_bucket(t.word), np.arange(lay.n + 1))
        for b in range(lay.n):
            x, y = int(edge[b]), int(edge[b + 1])
            if y > x:
                self.count[x:y] = np.frombuffer(got[b], dtype=np.uint32, count=y - x)
                self.below[:, x:y] = np.frombuffer(got[b], dtype=np.uint8, offset=4 * (y - x)).reshape(levels, y - x)
        # of pairs of which nothing more is known the chunk's own count is all there is
        got = {a["bucket"]: z.decompress(a["blob"]) for a in contexts or ()}
        known, tables = np.zeros(len(t.key), dtype=bool), []
        edge = np.searchsorted(t.bucket, np.arange(lay.n + 1))
        for b in range(lay.n):
            x, y = int(edge[b]), int(edge[b + 1])
            if y > x:
                size = (y - x + 7) // 8
                known[x:y] = np.unpackbits(np.frombuffer(got[b], dtype=np.uint8, count=size), count=y - x).astype(bool)
                tables.append(np.frombuffer(got[b], dtype=np.uint8, offset=size).reshape(NAME_BITS + 1, -1))
        # the last row, of zeros, is that of pairs which nobody else has
        self.table = np.ascontiguousarray(np.concatenate([*tables, np.zeros((NAME_BITS + 1, 1), dtype=np.uint8)], axis=1).T)
        self.row = np.append(np.where(known, np.cumsum(known) - 1, len(self.table) - 1), len(self.table) - 1)
        self.alone = np.append(t.weight, 0).astype(np.float32)
        self.below = np.ascontiguousarray(self.below.T)
        # the bits below the cell after which no other word shares the name so far
        apart = self.below[:, -2::-1] > 0
        self.deep = np.where(apart.any(axis=1), levels - 1 - apart.argmax(axis=1), 0).astype(np.int8) if levels > 1 else np.zeros(len(t.word), dtype=np.int8)
        self.context_own = t.context_own()
        self.known = self.count[t.of] > t.own

    def _pair(self, key: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For context pairs (-1: none): (bits + 1, pairs) counts that share the bits so far, and (bits, pairs) of those that differ next."""
        row = self.row[key]  # the last one is of none
        got = _VALUE.take(self.table.take(row, axis=0).T)
        seen = np.empty((NAME_BITS + 1, len(key)), dtype=np.float32)
        seen[NAME_BITS] = np.maximum(np.where(row == len(self.table) - 1, self.alone[key], got[0]) - own, 0)
        for d in range(NAME_BITS - 1, -1, -1):
            np.add(seen[d + 1], got[d + 1], out=seen[d])
        return seen, got[1:]

    def word_decisions(self, at: np.ndarray, context: bool = True) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of known tokens, which come by falling depth: the predictors' logits, the gate, and whether there is anything to
        decide, bit by bit: the cell's for all tokens, each one below for the first tokens alone, those that have it (a
        predictor that is silent after some bits has the first ones alone); how many these are; and the logarithms of the word's share among those of its code."""
        t, lay, m = self.t, self.lay, self.model
        cells, n = lay.cell_bits, len(at)
        h, own, word = t.h[at], t.own[at].astype(np.float32), t.of[at]
        count = self.count[word].astype(np.float32) - own
        below = _VALUE.take(self.below.take(word, axis=0).T)
        width = np.searchsorted(-self.deep[word], -np.arange(lay.code_bits - cells), side="left")
        edge = cells * n + np.append(0, np.cumsum(width))
        spans = list(zip(edge[:-1].tolist(), edge[1:].tolist(), width.tolist(), strict=True))
        # counts that go the token's way, and the others, for each bit of the code
        taken, other = np.empty(edge[-1], dtype=np.float32), np.empty(edge[-1], dtype=np.float32)
        down = _down(m.order0, None, (h >> np.uint64(64 - cells)).astype(np.int64), cells)
        np.maximum(down[1:] - own, count, out=taken[: edge[0]].reshape(cells, n))
        np.subtract(down[:-1], down[1:], out=other[: edge[0]].reshape(cells, n))
        same = count + below[-1]
        left = np.log(count / same)
        for d, (a, b, k) in reversed(list(enumerate(spans))):
            taken[a:b], other[a:b] = same[:k], below[d, :k]
            same[:k] += below[d, :k]
        x = [_stretch(taken, other)]
        down = _down(m.kind, t.kind[t.doc[at]], (h >> np.uint64(64 - CELL_BITS)).astype(np.int64), CELL_BITS)
        x.append(_stretch(np.maximum(down[1:] - own, 0), down[:-1] - down[1:]).reshape(-1))
        gate = np.full(len(taken), 3, dtype=np.uint8)
        rows = gate[: edge[0]].reshape(cells, n)
        rows[:] = np.searchsorted((BEFORE_BITS, CELL_BITS, NAME_BITS), np.arange(cells), side="right").astype(np.uint8)[:, None]
        rows[:CELL_BITS] += (down[:-1] - own >= 8) * np.uint8(4)
        down = _down(m.before, t.before[at], (h >> np.uint64(64 - BEFORE_BITS)).astype(np.int64), BEFORE_BITS)
        x.append(_stretch(np.maximum(down[1:] - own, 0), down[:-1] - down[1:]).reshape(-1))
        if not context:
            return x, gate, other > 0, width, left
        seen, differ = self._pair(t.context[at], self.context_own[at].astype(np.float32))
        v, end = np.empty(len(taken), dtype=np.float32), np.log((seen[-1] + PRIOR) / PRIOR)
        v[: NAME_BITS * n] = _stretch(seen[1:], differ).reshape(-1)
        v[NAME_BITS * n : edge[0]].reshape(-1, n)[:] = end
        trust = np.zeros((NAME_BITS + 1, n), dtype=np.uint8)
        for least in (0.5, 1.5, 3.5, 15.5):
            trust += seen > np.float32(least)
        trust *= np.uint8(8)
        rows[:NAME_BITS] += trust[:-1]
        rows[NAME_BITS:] += trust[-1]
        for a, b, k in spans:
            v[a:b] = end[:k]
            gate[a:b] += trust[-1, :k]
        x.append(v)
        return x, gate, other > 0, width, left

    def word_logs(self, at: np.ndarray, context: bool, learned: np.ndarray) -> np.ndarray:
        """Logarithms of known tokens' probabilities; the model learns from those of ``learned``."""
        by = np.argsort(-self.deep[self.t.of[at]], kind="stable")
        x, gate, live, width, left = self.word_decisions(at[by], context)
        cells, n, learned = self.lay.cell_bits, len(at), learned[by]
        edge = (cells * n + np.append(0, np.cumsum(width))).tolist()
        some = live.copy()
        some[: edge[0]].reshape(cells, n)[:] &= learned
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            some[a:b] &= learned[: b - a]
        logs = self._coded(x, gate, some, 0, WORD_GATES if context else 8) * live
        sums = logs[: edge[0]].reshape(cells, n).sum(axis=0)
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            sums[: b - a] += logs[a:b]
        out = np.empty(n)
        out[by] = sums + left
        return out

    def batches(self, size: int) -> Iterator[tuple[int, int]]:
        a = i = 0
        while a < size:
            b = min(size, a + STEPS[min(i, len(STEPS) - 1)])
            yield a, b
            a, i = b, i + 1

    def spell_decisions(self, rare: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Of rare words (by their number among them), as (8, bytes): the predictors' logits and the gate; and each byte's word."""
        t = self.t
        place = np.repeat(np.arange(len(rare)), t.rare_size[rare])
        own = t.rare_learned[rare][place]
        x, gate = [], np.full((8, len(place)), WORD_GATES, dtype=np.uint8)
        for (at, (known, total)), (share, trusts) in zip(zip(t.spelled(rare), self.model.spelled, strict=True), ((0, ()), (1, (7.5, 127.5)), (3, (3.5, 31.5))), strict=True):
            # sums over the bytes that share a context and the bits so far, by their place in the sorted table
            at, back, _ = _groups(at)
            bound = np.empty((9, len(at)), dtype=np.float32)
            for d in range(9):
                low = at >> (8 - d)
                new = np.append(True, low[1:] != low[:-1])
                low = low[new]
                sums = total[np.searchsorted(known, (low + 1) << 8 - d)] - total[np.searchsorted(known, low << 8 - d)]
                bound[d] = sums[np.cumsum(new) - 1]
            # of each place as it is without an occurrence of its own, then as with one
            taken, other = np.concatenate((bound[1:], np.maximum(bound[1:] - np.float32(1), 0)), axis=1), bound[:-1] - bound[1:]
            back[own] += len(at)
            x.append(_stretch(taken, np.concatenate((other, other), axis=1)).take(back, axis=1))
            if share:
                seen = np.concatenate((bound[:-1], bound[:-1] - np.float32(1)), axis=1)
                gate += (np.uint8(share) * sum((seen > least).astype(np.uint8) for least in trusts)).take(back, axis=1)
        return x, gate, place

    def flags(self) -> np.ndarray:
        """Novelty of the two tokens before, 0 to 3; none before counts as known."""
        t = self.t
        new = ~self.known
        place = np.arange(len(new)) - t.first[t.doc]
        one, two = np.zeros(len(new), dtype=np.int64), np.zeros(len(new), dtype=np.int64)
        one[1:], two[2:] = new[:-1], new[:-2]
        return np.where(place >= 1, one, 0) + 2 * np.where(place >= 2, two, 0)

    def new_words(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words of new tokens, as numbers among the rare ones, and each token's place among these."""
        number = np.full(len(self.t.word), -1, dtype=np.int64)
        number[self.t.rare] = np.arange(len(self.t.rare))
        return np.unique(number[self.t.of[tokens]], return_inverse=True)

    def _coded(self, x: list[np.ndarray], gate: np.ndarray, some: np.ndarray, low: int, high: int) -> np.ndarray:
        """Logarithms of the probabilities of a batch's decisions with gates from low to high, by the model so far, which then learns from some of them."""
        m, place = self.model, gate.astype(np.intp)
        at = m.fine(m.mixed(x, place))
        place -= low
        place *= FINE
        place += at
        out = m.logs(low, high).reshape(-1).take(place)
        m.learn(x, gate, place, low, some)
        return out

    def log10(self) -> np.ndarray:
        """log10 probability of each token, the class not counted; the model learns on the way."""
        t, m = self.t, self.model
        trained, flags = t.learns[t.doc], self.flags()
        cell = (t.kind[t.doc] * 4 + flags)[trained] * 2 + ~self.known[trained]
        m.novel = np.bincount(cell, minlength=m.novel.size).reshape(m.novel.shape)
        every = m.novel.sum(axis=0)
        share = (every[:, 1] + 0.5) / (every.sum(axis=1) + 1)
        new = (m.novel[:, :, 1] + 2 * share) / (m.novel.sum(axis=2) + 2)
        p = new[t.kind[t.doc], flags]
        out = np.log(np.where(self.known, 1 - p, p))
        tokens = np.flatnonzero(self.known)
        key = t.context[tokens]
        silent = (self.row[key] == len(self.table) - 1) & (self.alone[key] <= self.context_own[tokens])
        for a, b in self.batches(len(tokens)):
            own, quiet = tokens[a:b], silent[a:b]
            for at, context in ((own[~quiet], True), (own[quiet], False)):  # nobody else has the quiet ones' long context
                if len(at):
                    out[at] += self.word_logs(at, context, trained[at])
        fresh = np.flatnonzero(~self.known & (t.h != _END))
        rare, of = self.new_words(fresh)
        cost = np.zeros(len(rare))
        for a, b in self.batches(len(rare)):
            x, gate, place = self.spell_decisions(rare[a:b])
            learned = np.broadcast_to(t.rare_learned[rare[a:b]][place], gate.shape)
            logs = self._coded(x, gate, learned, WORD_GATES, GATES).sum(axis=0)
            cost[a:b] = np.bincount(place, weights=logs, minlength=b - a)
        out[fresh] += cost[of]
        return out / LN10


def _pyramid(cells: np.ndarray, bits: int) -> list[np.ndarray]:
    """Of (rows, 2^bits) counts the sums at each bit, as flat arrays."""
    out = [cells.astype(np.float32)]
    for _ in range(bits):
        out.append(out[-1].reshape(len(cells), -1, 2).sum(axis=2))
    return [v.reshape(-1) for v in reversed(out)]


def _model(side: list, lay: Layout) -> tuple[Model, int, int]:
    """The model's tables from the buckets' own totals; the training tokens and distinct words."""
    z = zstandard.ZstdDecompressor()
    cells, distinct, tables = np.zeros(1 << lay.cell_bits), 0, {}
    for r in side:
        v = np.frombuffer(z.decompress(r.blob), dtype=np.int64)
        n = len(v) // 2
        if r.bucket >= lay.n:
            tables[r.bucket - lay.n] = v[:n], v[n:]
        else:
            distinct += int(v[0])
            cells[v[1 : 1 + n]] += v[1 + n :]
    kinds = CLASSES * ((1 << CELL_BITS) + 1)
    fixed = np.concatenate([tables[k][1] for k in range(SLICES)]) if tables else np.zeros(kinds + BEFORE * (1 << BEFORE_BITS), dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    spelled = [(place, np.concatenate(([0], np.cumsum(count)))) for place, count in (tables.get(SLICES + k, (none, none)) for k in range(len(ORDERS)))]
    kind = fixed[:kinds].reshape(CLASSES, -1)
    model = Model(_pyramid(cells[None], lay.cell_bits), _pyramid(kind[:, :-1], CELL_BITS), _pyramid(fixed[kinds:].reshape(BEFORE, -1), BEFORE_BITS), kind[:, -1].astype(float), spelled)
    return model, int(cells.sum()), distinct


_SCORES = "doc_id long, n_tokens long, n_known long, coded long, base double, score double"


def _scored(spark: SparkSession, lay: Layout, model: Model):
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m = shared.value.fresh()
                ids, t = _read(batch, i, lay)
                c = Coder(t, batch["words"][i].as_py(), batch["contexts"][i].as_py(), lay, m)
                count = c.count[t.of]
                sums = lambda v: np.bincount(t.doc, weights=v, minlength=t.n_docs)
                share = (m.classes + 0.5) / (m.classes.sum() + 0.5 * CLASSES)
                score = sums(c.log10()) + np.log10(share)[t.kind]
                longs = [sums(v).astype(np.int64) for v in (np.ones(len(t.h)), count > 0, t.size + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(v) for v in longs), pa.array(sums(np.log10(count + 1.0))), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "coded", "base", "score"])

    return run


_BLOBS = "chunk long, bucket int, blob binary"


def fitted(docs: DataFrame, learns: Column) -> tuple[DataFrame, Layout, Model, int, int]:
    """The chunks with what the buckets answer them, the model's tables, and the training tokens and distinct words."""
    chunks = chunked(docs, flag=learns)
    n = buckets(chunks)
    lay = Layout.of(int(chunks.agg(F.sum("size")).first()[0] or 0), n)
    exchange = lambda send, answer: chunks.mapInArrow(send, SENT).repartitionById(n, F.pmod("bucket", F.lit(n))).sortWithinPartitions("bucket").mapInArrow(answer, _BLOBS)
    gathered = lambda name: F.collect_list(F.struct("bucket", "blob")).alias(name)  # noqa: E731  # at most one a bucket and chunk
    # rows of chunk -1 stay single, so as not to meet in one
    key = F.when(F.col("chunk") < 0, -1 - F.col("bucket")).otherwise(F.col("chunk")).alias("chunk")
    known = materialize_by(exchange(_send_words(lay), _answer_words(lay)).groupBy(key).agg(gathered("words")), "words", "chunk")
    side = known.where("chunk < 0").select(F.inline("words")).collect()  # two numbers a cell, and the bounded tables
    contexts = exchange(_send_contexts(lay), _answer_contexts(lay)).groupBy("chunk").agg(gathered("contexts"))
    return chunks.join(known, "chunk").join(contexts, "chunk", "left"), lay, *_model(side, lay)


def scores(docs: DataFrame, learns: Column) -> DataFrame:
    """Score whole texts by a model of those for which ``learns`` holds.

    docs: doc_id, text and what learns needs; other columns are ignored. Returns doc_id, n_tokens, n_known, train_tokens,
    base_score, score and bits_per_byte (of the tokens' bytes and one each to close them). base_score is the sum over tokens of
    log10((c + 1) / (N + V + 1)), c being the token's count among the N training tokens, V of them distinct; score is
    the mixer's log10 probability, by the other texts in the case of a training text. A null text is an empty one and
    is the end token alone. Rows with a null doc_id are left out; rows that share a doc_id are scored one by one. A null
    of ``learns`` is no. Without training texts every count is zero and all tokens are spelled.
    """
    both, lay, model, total, distinct = fitted(docs, learns)
    out = both.mapInArrow(_scored(docs.sparkSession, lay, model), _SCORES)
    base = F.col("base") - F.col("n_tokens") * float(np.log10(total + distinct + 1))
    bits = -F.col("score") / F.log10(F.lit(2.0)) / F.col("coded")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))
