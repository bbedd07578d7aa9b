"""Nearest vectors by inner product with multi-index hashing.

Vectors are extended to equal length, so that the largest inner product is the nearest direction; binary codes are
signs after principal components and several learned rotations (iterative quantisation on a bounded sample). A code is
split into substrings of 16 bits and each substring has a table of the vectors by its value. Codes within radius R of a
query's agree with it, in one substring at least, but for R // substrings bits: probing all such values of every table
retrieves every code within R, and the floats of these are compared exactly, in double precision.

The index is kept in blocks of vectors, and every block of queries meets every block of the index. A query that finds
fewer than k vectors within the radius in the whole index is searched anew by all floats; blocks decide nothing by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .chunks import by_bucket
from .scratch import materialize

#: Vectors that codes are learned from at most (those with the smallest hash of vec_id), and how many of these act as queries.
SAMPLE, PROBES = 4096, 256
#: Vectors of one block of the index, and queries of one block.
INDEX_BLOCK, QUERY_BLOCK = 50_000, 2_000
ROTATIONS, SUBSTRING = 4, 16


@dataclass
class Codes:
    """scale: the longest vector's length; mean, rotation: of the extended vectors; radius: to search to."""

    scale: float
    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def of(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(rows, substrings) uint16 codes."""
        bits = (_extended(x, self.scale, query) - self.mean) @ self.rotation > 0
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)


def _extended(x: np.ndarray, scale: float, query: bool) -> np.ndarray:
    n = np.sqrt((x**2).sum(axis=1, keepdims=True))
    if query:
        return np.concatenate((x / np.maximum(n, 1e-300), np.zeros((len(x), 1))), axis=1)
    y = x / scale
    return np.concatenate((y, np.sqrt(np.maximum(0, 1 - (n / scale) ** 2))), axis=1)


def learn(x: np.ndarray, scale: float, k: int, total: int, rounds: int = 30, recall: float = 0.97) -> Codes:
    """Codes from a sample of vectors; the radius holds a share ``recall`` of the sample's nearest, as near as the k nearest of all are."""
    e = _extended(x, scale, False)
    mean = e.mean(axis=0)
    d = e.shape[1] - (e.shape[1] % SUBSTRING if e.shape[1] >= SUBSTRING else 0)
    _, _, axes = np.linalg.svd(e - mean, full_matrices=True)
    d = max(SUBSTRING, d)
    basis = np.zeros((e.shape[1], d))
    basis[:, : min(d, len(axes))] = axes[:d].T
    v = (e - mean) @ basis
    parts = []
    for seed in range(ROTATIONS):
        r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(basis @ r)
    codes = Codes(scale, mean, np.concatenate(parts, axis=1), 0)
    q = x[:PROBES]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = min(len(x) - 1, max(1, -(-k * len(x) // max(total, 1))))
    top = np.argsort(-s, axis=1)[:, :near]
    h = hamming(codes.of(q, True), codes.of(x, False))
    codes.radius = int(np.ceil(np.quantile(np.take_along_axis(h, top, axis=1), recall))) if near > 0 else codes.rotation.shape[1]
    return codes


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(b ^ x).sum(axis=1) for x in a]) if len(a) else np.zeros((0, len(b)), dtype=np.int64)


def masks(bits: int, radius: int) -> np.ndarray:
    """All values of so many bits with at most ``radius`` ones."""
    return np.array([sum(1 << b for b in c) for r in range(min(radius, bits) + 1) for c in combinations(range(bits), r)], dtype=np.int64)


class Tables:
    """One block of the index: for each substring the rows by value."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.rows = [np.argsort(c, kind="stable") for c in codes.T]
        self.first = [np.searchsorted(c[r], np.arange((1 << SUBSTRING) + 1)) for c, r in zip(codes.T, self.rows, strict=True)]

    def within(self, code: np.ndarray, radius: int, probe: np.ndarray) -> np.ndarray:
        """Rows whose code is within ``radius`` of the given one."""
        hit = np.zeros(len(self.codes), dtype=bool)
        for value, rows, first in zip(code.tolist(), self.rows, self.first, strict=True):
            v = probe ^ value
            a, n = first[v], first[v + 1] - first[v]
            full = n > 0
            a, n = a[full], n[full]
            hit[rows[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        at = np.flatnonzero(hit)
        return at[np.bitwise_count(self.codes[at] ^ code).sum(axis=1) <= radius]


def _search(codes: Codes, k: int, dim: int, whole: bool):
    """The k best of each block for each query, of those within the radius or, with ``whole``, of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = masks(SUBSTRING, codes.radius // (codes.rotation.shape[1] // SUBSTRING))
        for _, rows in by_bucket(batches):
            read = lambda r, d: np.frombuffer(r.as_buffer(), dtype=d)
            items = [r for r in rows if not r[0].as_py()]
            queries = [r for r in rows if r[0].as_py()]
            if not items or not queries:
                continue
            ids = np.concatenate([read(r[1], np.int64) for r in items])
            x = np.concatenate([read(r[2], np.float64).reshape(-1, dim) for r in items])
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            table = None if whole else Tables(codes.of(x, False))
            for r in queries:
                own, q = read(r[1], np.int64), read(r[2], np.float64).reshape(-1, dim)
                code = codes.of(q, True)
                out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
                for i in range(len(own)):
                    at = table.within(code[i], codes.radius, probe) if table else np.arange(len(ids))
                    at = at[ids[at] != own[i]]
                    s = np.einsum("ij,j->i", x[at], q[i])
                    best = np.lexsort((ids[at], -s))[:k]
                    out.append((np.full(len(best), own[i]), ids[at][best], s[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def _blobs(dim: int, block: int):
    """Rows (block, query, id, vector) sorted by the first two, as blobs of at most ``block`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, x = batch.column(0).to_numpy(), batch.column(2).values.to_numpy().astype(np.float64).reshape(-1, dim)
            ids = batch.column(1).to_numpy()
            for v in np.unique(b).tolist():
                at = np.flatnonzero(b == v)
                for a in range(0, len(at), block):
                    part = at[a : a + block]
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()), pa.array([ids[part].tobytes()]), pa.array([x[part].tobytes()])], names=["block", "ids", "vectors"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Each query's k nearest of the vectors by inner product: query_id, rank (from 1), vec_id, score.

    vectors, queries: vec_id, embedding (array of numbers); other columns are ignored. A query's own vec_id is no
    candidate. Fewer than k candidates are all returned; ties go to the smaller vec_id. Vectors that are null or zero,
    hold null or non-finite components, have a null vec_id, or are not of the most common length take no part. Rows of
    queries that share a vec_id are one query, with the least of their vectors; each row of vectors is a candidate.
    """
    vectors, queries = _valid(vectors), _valid(queries)
    dims = vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)).alias("longest"))
    first = dims.orderBy(F.desc("n"), "dim").first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total, scale = first.dim, first.n, float(np.sqrt(first.longest))
    vectors, queries = (t.where(F.size("embedding") == dim) for t in (vectors, queries))
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    wanted = vectors.select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    sample = sorted(vectors.join(wanted, "vec_id", "left_semi").collect())
    codes = learn(np.array([r.embedding for r in sample], dtype=np.float64), scale, k, total)
    blocks = -(-total // INDEX_BLOCK)
    put = lambda t, n, size: t.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("block"), "vec_id", "embedding").mapInArrow(_blobs(dim, size), "block int, ids binary, vectors binary")
    items = put(vectors, blocks, QUERY_BLOCK).select("block", F.lit(False).alias("query"), "ids", "vectors")
    # a block is searched by several tasks, each with a share of the queries and the block's vectors
    shares = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // (2 * blocks))
    items = items.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def search(some: DataFrame, whole: bool) -> DataFrame:
        asked = put(some, 1, QUERY_BLOCK // 8).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("query"), "ids", "vectors")
        asked = asked.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int"))
        both = items.union(asked.select(*items.columns)).select((F.col("block") * shares + F.col("share")).alias("task"), "query", "ids", "vectors")
        found = both.repartition("task").sortWithinPartitions("task").mapInArrow(_search(codes, k, dim, whole), "query_id long, vec_id long, score double")
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = materialize(search(queries, False), "nearest")
    full = found.where(F.col("rank") == k).select("query_id")
    short = queries.join(full, queries["vec_id"] == full["query_id"], "left_anti")
    if short.isEmpty():
        return found
    return found.join(full, "query_id", "left_semi").select(*found.columns).union(search(short, True))


def _valid(t: DataFrame) -> DataFrame:
    e = t.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return e.where("vec_id is not null and embedding is not null").where(F.forall("embedding", good) & F.exists("embedding", lambda v: v != 0))
