"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

1. One pass over the texts gives each document its set size, a 128-bit key of its shingle set and its band keys.
2. Documents with equal sets form one class and only the class's smallest id goes on, so that exact copies never
   meet in a bucket.
3. In each bucket of equal band keys every member is compared with the bucket's smallest member, on full sets.
   Links give components.
4. Members of one bucket that are still in different components are compared with each other, in blocks: pairs whose
   sketches agree on ``estimate`` of the coordinates are verified on full sets, best agreement first, unless links
   found on the way have joined their components. Only links leave a block, so no join makes rows for pairs, a group
   of n near-copies costs about n comparisons, and no pair is left out for a bucket's size.

A pair of similarity 0.75 shares none of the 32 bands of 4 coordinates with probability 5e-6, and falls below
the estimate of 0.55 with probability 2e-7, so that the estimate loses next to nothing beside the bands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .scratch import materialize
from .sketch import band_keys, shingle_sets, sketches
from .text import mix, packs

#: Members of a bucket that one task compares at a time; larger buckets are compared block by block.
BLOCK = 500


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[first[1:]] - total[first[:-1]]


def _sketch_rows(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in packs(batches):
            s, first = shingle_sets(p, k)
            n = np.diff(first)
            keys = band_keys(sketches(s, first, bands * rows), rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) * bands + 1, bands), pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(p.ids), pa.array(n.astype(np.int64)), pa.array(_sums(s, first).view(np.int64)), pa.array(_sums(mix(s ^ np.uint64(77)), first).view(np.int64)), lists], names=["doc_id", "n_shingles", "k1", "k2", "bands"])

    return run


def _set_rows(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in packs(batches):
            s, first = shingle_sets(p, k)
            small = (sketches(s, first, bands * rows) & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(p.ids), pa.array([s[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()), pa.array([r.tobytes() for r in small], pa.binary())], names=["rep", "elements", "small"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            keep, last, right = np.zeros(batch.num_rows, dtype=bool), None, None
            for i in range(batch.num_rows):
                if last is None or b[i].as_py() != last:
                    last, right = b[i].as_py(), np.frombuffer(y[i].as_buffer(), dtype=np.uint64)
                keep[i] = _similar(np.frombuffer(x[i].as_buffer(), dtype=np.uint64), right, percent)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], names=["a", "b"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    x = sets.select(F.col("rep").alias("a"), F.col("elements").alias("x"))
    y = sets.select(F.col("rep").alias("b"), F.col("elements").alias("y"))
    both = pairs.join(y, "b").join(x, "a").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("y").alias("x"), F.col("x").alias("y"))
    return both.mapInArrow(_verified(percent), "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """Runs of rows equal in the first ``by`` columns, of batches sorted by them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy() for i in range(by)]
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        if rest and any(rest[-1].column(i)[-1].as_py() != keys[i][0].item() for i in range(by)):
            yield pa.Table.from_batches(rest)
            rest = []
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rest.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(rest)
                rest = []
    if rest:
        yield pa.Table.from_batches(rest)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _across(estimate: float, percent: int):
    """Links between components, from groups (key, i, j) of members (block, component, rep, n, small, elements).

    The components of a group are merged as links are found, so a pair is verified only while its two ends are in
    different ones; of a member's possible partners those whose sketches agree most come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 3):
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            block, comp, rep, n = (g.column(c).to_numpy() for c in ("block", "component", "rep", "n"))
            names, own, size = np.unique(comp, return_inverse=True, return_counts=True)
            if len(names) < 2:
                continue
            small = np.frombuffer(b"".join(g.column("small").to_pylist()), dtype=np.uint8).reshape(len(rep), -1)
            sets = [np.frombuffer(e.as_buffer(), dtype=np.uint64) for e in g.column("elements")]
            found: list[tuple[int, int]] = []
            # members of small components look for partners first
            for x in np.lexsort((rep, size[own])).tolist():
                other = (own != own[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
                if i != j:
                    other &= block != block[x]
                at = np.flatnonzero(other)
                same = (small[at] == small[x]).mean(axis=1)
                at, same = at[same >= estimate], same[same >= estimate]
                for y in at[np.lexsort((rep[at], -same))].tolist():
                    if own[y] != own[x] and _similar(sets[x], sets[y], percent):
                        found.append((int(rep[x]), int(rep[y])))
                        own[own == own[y]] = own[x]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, estimate: float = 0.55, block: int = BLOCK) -> DataFrame:
    """Group documents whose sets of k-word shingles have 100 * intersection >= percent * union.

    docs: doc_id, text; other columns are ignored. Returns doc_id, n_shingles, component_id, kept, a row for each row of
    docs. Rows that share a doc_id are one document where links are concerned: each of them is linked as its own text is,
    and all of them bear the same id.
    A null text is an empty one; a document without words has an empty set and is linked with nothing; rows with a
    null doc_id are left out. Equal texts are linked; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    rows_of = materialize(docs.mapInArrow(_sketch_rows(k, bands, rows), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "sketches")
    filled = rows_of.where("n_shingles > 0")
    classes = filled.groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("many"))
    reps = filled.select("doc_id", "n_shingles", "bands").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    entries = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"))
    hubs = entries.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    member = materialize(entries.join(hubs, "key").select("key", "rep", "n", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"), "members"), "members")
    near = f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"
    wanted = member.select("rep").distinct()
    sets = materialize(docs.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").mapInArrow(_set_rows(k, bands, rows), "rep long, elements binary, small binary"), "sets")
    stars = materialize(member.where("rep <> hub").where(near).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    links = materialize(_links(stars, sets, percent), "links")
    label = components(links)
    at = materialize(member.select("key", "rep", "n", "members").join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "at")
    mixed = at.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"), F.count("*").alias("many")).where("c0 <> c1")
    # buckets with the same members are worked off once
    mixed = mixed.groupBy("who", "many").agg(F.min("key").alias("key")).select("key")
    at = at.join(mixed, "key").join(sets, "rep")
    blocks = F.ceil(F.col("members") / block)
    at = at.withColumn("block", F.pmod(F.hash("rep"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    at = at.select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "component", "rep", "n", "small", "elements")
    more = at.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_across(estimate, percent), "a long, b long")
    more = materialize(more.distinct(), "links")
    if not more.isEmpty():
        label = components(links.union(more))
    set_key = ["n_shingles", "k1", "k2"]
    found = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(*set_key, F.coalesce("component", "rep").alias("component_id"), "many")
    # all exact copies of a text share a key: the classes that hold a thousandth of all rows or more, a thousand at most, are joined where the rows are
    found = materialize(found, "classes")
    least = max(2, rows_of.count() // 1000)
    out = rows_of.select("doc_id", *set_key).join(F.broadcast(found.where(F.col("many") >= least).select(*set_key, F.col("component_id").alias("hot"))), set_key, "left")
    rest = out.where("hot is null").drop("hot").join(found.where(F.col("many") < least).drop("many"), set_key, "left")
    out = out.where("hot is not null").select("doc_id", "n_shingles", F.col("hot").alias("component_id")).union(rest.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id")))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
