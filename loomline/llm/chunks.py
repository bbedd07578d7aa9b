"""Exchange of per-chunk keys between packed chunks of documents and buckets of the key space.

A corpus of many small rows is costly to shuffle key by key. Here the documents are written once as chunks of
two megabytes of text or more, and each chunk sends every bucket one blob: its distinct keys in that bucket, sorted
and packed, with an optional payload. A bucket answers each chunk with one blob of bits in the order of
the chunk's own keys, so an answer costs a bit a key. A key that is hot in the corpus is sent once by each chunk, so
buckets get equal shares of the keys however hot some are.

There is a blob for each pair of a chunk and a bucket. Beyond about 200 GB both grow with the root of the corpus, so
that a pair holds 64 keys or more and the number of blobs grows as the corpus does, not as its square: at 100 TB a
chunk has 73 MB of text and a bucket answers for 290 MB (about 3 GB of a worker's memory).

Chunks and answers are stored in Spark buckets by chunk, so joining them shuffles neither.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import materialize_by
from .text import PACK_BYTES, Pack, packs

#: Raw text bytes a bucket answers for at least, so that its keys fit in a Python worker.
BUCKET_BYTES = 24_000_000
#: Keys of a bucket that are sorted at a time.
RANGE_KEYS = 1 << 18


def chunk_bytes(total: int) -> int:
    """Text bytes of a chunk, for so many in all."""
    return max(PACK_BYTES, math.isqrt(53 * total))


def bucket_bytes(total: int) -> int:
    """Text bytes a bucket answers for: so that a chunk has 64 keys or more for each (a key for about three bytes)."""
    return max(BUCKET_BYTES, 213 * total // chunk_bytes(total))


def _pack_rows(extra: Callable[[Pack], bytes] | None, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, i, z = TaskContext.get().partitionId() << 32, 0, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            flags, done = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8), 0
            for p in packs([batch], limit):
                more = z.compress(extra(p)) if extra else b""
                own, done = flags[done : done + len(p)], done + len(p)
                yield pa.RecordBatch.from_arrays([pa.array([base + i]), pa.array([len(p.bytes)]), pa.array([p.ids.tobytes()]), pa.array([own.tobytes()]), pa.array([p.starts.tobytes()]), pa.array([z.compress(p.bytes.tobytes())]), pa.array([more])], names=["chunk", "size", "ids", "flags", "starts", "body", "extra"])
                i += 1

    return run


def chunked(docs: DataFrame, extra: Callable[[Pack], bytes] | None = None, flag: Column | None = None) -> DataFrame:
    """Write (doc_id, text) as chunks: chunk, size, ids, flags (a byte a document), starts, body, and what extra makes of each."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    flag = F.lit(0) if flag is None else F.coalesce(flag.cast("int"), F.lit(0))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), flag.alias("flag")).where("doc_id is not null")
    return materialize_by(docs.mapInArrow(_pack_rows(extra, chunk_bytes(total)), "chunk long, size long, ids binary, flags binary, starts binary, body binary, extra binary"), "chunks", "chunk")


def buckets(chunks: DataFrame) -> int:
    """How many buckets the keys of these chunks go to: in proportion to the text, one a shuffle partition at least."""
    total = chunks.agg(F.sum("size")).first()[0] or 0
    return max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes(total)))


def unpack(ids: pa.Scalar, starts: pa.Scalar, body: pa.Scalar) -> Pack:
    data = zstandard.ZstdDecompressor().decompress(body.as_buffer(), max_output_size=0) if len(body.as_buffer()) else b""
    return Pack(np.frombuffer(ids.as_buffer(), dtype=np.int64), np.frombuffer(data, dtype=np.uint8), np.frombuffer(starts.as_buffer(), dtype=np.int64))


def encode(keys: np.ndarray) -> bytes:
    """Sorted distinct uint64 keys in Elias and Fano's form: their number, the width of low parts, the first key, the
    low bits of the differences from it, and a map of the high ones; about two bits a key more than the least possible.
    """
    n = len(keys)
    if not n:
        return b""
    d = keys - keys[0]
    low = max(0, (int(d[-1]) // n).bit_length() - 1)
    some = (low + 7) // 8  # bytes that hold the low parts
    lows = np.unpackbits(d.astype(">u8").view(np.uint8).reshape(n, 8)[:, 8 - some :], axis=1)[:, 8 * some - low :]
    at = (d >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(at[-1] + 1, dtype=np.uint8)
    high[at] = 1
    return n.to_bytes(4, "little") + bytes([low]) + keys[:1].tobytes() + np.packbits(lows).tobytes() + np.packbits(high).tobytes()


def decode(blob: memoryview) -> np.ndarray:
    if not len(blob):
        return np.zeros(0, dtype=np.uint64)
    n, low = int.from_bytes(blob[:4], "little"), blob[4]
    first = np.frombuffer(blob, dtype=np.uint64, count=1, offset=5)
    end = 13 + (n * low + 7) // 8
    some = (low + 7) // 8
    bits, lows = np.zeros((n, 8 * some), dtype=np.uint8), np.zeros((n, 8), dtype=np.uint8)
    bits[:, 8 * some - low :] = np.unpackbits(np.frombuffer(blob[13:end], dtype=np.uint8), count=n * low).reshape(n, low)
    lows[:, 8 - some :] = np.packbits(bits, axis=1)
    at = np.flatnonzero(np.unpackbits(np.frombuffer(blob[end:], dtype=np.uint8)))
    high = (at - np.arange(n)).astype(np.uint64) << np.uint64(low)
    return first + (high | lows.view(">u8").reshape(n).astype(np.uint64))


def cuts(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Where each of n buckets begins in sorted keys of so many bits; n + 1 entries."""
    whole, rest = divmod(1 << bits, n)
    b = np.arange(n, dtype=np.uint64)
    edges = b * np.uint64(whole % (1 << 64)) + b * np.uint64(rest) // np.uint64(n)  # b * 2^bits // n
    return np.append(np.searchsorted(keys, edges), len(keys))


SENT = "bucket int, chunk long, keys binary, payload binary"


def send(chunk: int, keys: np.ndarray, n: int, bits: int, payload: Callable[[int, int], bytes]) -> pa.RecordBatch:
    """Rows of one chunk's sorted distinct keys for the n buckets; payload gives the bytes that go with keys[a:b]."""
    at = cuts(keys, n, bits)
    full = np.flatnonzero(np.diff(at))
    return pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk, dtype=np.int64)), pa.array([encode(keys[at[b] : at[b + 1]]) for b in full], pa.binary()), pa.array([payload(at[b], at[b + 1]) for b in full], pa.binary())], names=["bucket", "chunk", "keys", "payload"]
    )


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """From rows sorted by their first column, each bucket with its rows' other columns."""
    at, rows = None, []
    for batch in batches:
        first = batch.column(0).to_pylist()
        for i, b in enumerate(first):
            if b != at and rows:
                yield at, rows
                rows = []
            at = b
            rows.append(tuple(batch.column(c)[i] for c in range(1, batch.num_columns)))
    if rows:
        yield at, rows


def key_ranges(keys: list[np.ndarray], low: int = 0) -> Iterator[list[tuple[int, int]]]:
    """One after the other, ranges of the key space that hold about RANGE_KEYS keys of the rows together: of each row's
    sorted keys the span. Keys that agree in all but the ``low`` lowest bits are in one range. What is worked out of
    one range is small, however large the bucket."""
    n = max(1, -(-sum(map(len, keys)) // RANGE_KEYS))
    some = np.sort(np.concatenate([k[(len(k) - 1) % 64 // 2 :: 64] for k in keys]))
    edges = np.unique(some[np.arange(1, n) * len(some) // n] >> np.uint64(low) << np.uint64(low))
    cut = [[0, *np.searchsorted(k, edges).tolist(), len(k)] for k in keys]
    for i in range(len(edges) + 1):
        yield [(c[i], c[i + 1]) for c in cut]


ANSWER = "chunk long, bucket int, bits binary"


def answered(sent: DataFrame, n: int, answer: Callable[[list, list], list[np.ndarray]], raw: bool = False) -> DataFrame:
    """Each chunk's answers as one list: chunk, answers array<struct<bucket, bits>>, sorted by bucket.

    n: the number of buckets, which get a task each. answer: from the key arrays and payloads of one bucket's rows, a boolean array for each row; with ``raw``, from the
    keys and payloads as pairs of blobs, whatever they hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in by_bucket(batches):
            keys, payloads = ([memoryview(r[c].as_buffer()) for r in rows] for c in (1, 2))
            got = answer([], list(zip(keys, payloads, strict=True))) if raw else answer([decode(k) for k in keys], payloads)
            yield pa.RecordBatch.from_arrays([pa.array([r[0].as_py() for r in rows], pa.int64()), pa.array([b] * len(rows), pa.int32()), pa.array([np.packbits(g).tobytes() for g in got], pa.binary())], names=["chunk", "bucket", "bits"])

    out = sent.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, ANSWER)
    # at most one entry a bucket and a bit a key: bounded by the chunk
    return out.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "bits"))).alias("answers"))


def read_bits(answers: list[dict], keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The answer for each of a chunk's sorted distinct keys."""
    out, at = np.zeros(len(keys), dtype=bool), cuts(keys, n, bits)
    for x in answers or ():
        a, b = at[x["bucket"]], at[x["bucket"] + 1]
        out[a:b] = np.unpackbits(np.frombuffer(x["bits"], dtype=np.uint8), count=b - a).astype(bool)
    return out
