"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Model: each token gets a log-odds ratio of the labelled documents of either class that hold it, under an informative
Dirichlet prior (pseudo-counts in proportion to the token's overall frequency); counting documents keeps a token that
one text repeats from standing for many. Tokens whose likelihood ratio between the classes is significant keep their
log-odds; all others share a small negative drift, so that the expected score of a clean token is negative.

Scan: all maximal-scoring segments of a text (Ruzzo and Tompa, 1999) in linear time. A segment of score S in a text of
n tokens has normalised score lambda S - ln(K n), lambda being the positive root of E[exp(lambda s)] = 1 over clean
tokens; by Karlin and Altschul the count of such segments in clean text is Poisson with mean exp of minus that. A
text's evidence is the sum over its segments of the positive normalised scores, and a logistic curve turns evidence into
the probability of label 1. K and the curve are fitted to labelled texts by terms that come from the other half of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .decontamination import tokens
from .scratch import materialize
from .text import Pack, packs

#: Labelled documents that the model is fitted to at most (those with the smallest hash of doc_id).
MAX_LABELLED = 20_000
#: Pseudo-documents of the Dirichlet prior, and the likelihood-ratio statistic that a term must reach (chi-squared, 1 degree).
PRIOR = 10.0
LEAST_RATIO = 20.0
#: Log-odds below which a term tells of a topic or a language rather than of a passage.
LEAST_ODDS = 3.0
DRIFT = -0.02


@dataclass
class Model:
    """terms: sorted token hashes with their scores; lam, k: Karlin-Altschul parameters; a, b: the logistic curve."""

    terms: np.ndarray
    scores: np.ndarray
    lam: float = 1.0
    k: float = 0.1
    a: float = 1.0
    b: float = 0.0

    def token_scores(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), DRIFT)
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
            hit = self.terms[at] == h
            out[hit] = self.scores[at[hit]]
        return out

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a * evidence + self.b))))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past the last, score) by Ruzzo and Tompa's scan."""
    out: list[tuple[int, int, float, float, float]] = []  # first, end, total before, total through, index kept by position
    total = np.concatenate(([0.0], np.cumsum(scores)))
    for i in np.flatnonzero(scores > 0).tolist():
        first, left, right = i, float(total[i]), float(total[i + 1])
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= right:
                out.append((first, i + 1, left, right, j))
                break
            first, left = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, r - x) for a, b, x, r, _ in out]


def _scored(p: Pack, m: Model) -> Iterator[tuple[float, list[tuple[int, int, float, float]]]]:
    """Each document's evidence and significant segments (first byte, past the last, score, normalised score)."""
    w, h = tokens(p)
    s = m.token_scores(h)
    for d in range(len(p)):
        a, b = int(w.first[d]), int(w.first[d + 1])
        found, evidence = [], 0.0
        if b > a:
            base = math.log(max(m.k * (b - a), 1e-9))
            for x, y, score in segments(s[a:b]):
                normal = m.lam * score - base
                if normal > 0:
                    evidence += normal
                    found.append((int(w.start[a + x] - p.starts[d]), int(w.end[a + y - 1] - p.starts[d]), score, normal))
        yield evidence, found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each half the documents of either class that hold a term, and its occurrences in clean ones."""
    for batch in batches:
        label, half = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
        done = 0
        for p in packs([batch]):
            w, h = tokens(p)
            own = slice(done, done + len(p))
            done += len(p)
            for part in (0, 1):
                at = np.flatnonzero(half[own][w.doc] == part)
                y, doc = label[own][w.doc[at]], w.doc[at]
                u, inverse = np.unique(h[at], return_inverse=True)
                clean = np.bincount(inverse, weights=1 - y, minlength=len(u)).astype(np.int64)
                by = np.lexsort((doc, inverse))
                new = np.ones(len(by), dtype=bool)
                new[1:] = (inverse[by][1:] != inverse[by][:-1]) | (doc[by][1:] != doc[by][:-1])
                seen = by[new]  # a term once for each document
                one = np.bincount(inverse[seen], weights=y[seen], minlength=len(u)).astype(np.int64)
                every = np.bincount(inverse[seen], minlength=len(u))
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.full(len(u), part, dtype=np.int32)), pa.array(one), pa.array(every - one), pa.array(clean)], names=["term", "half", "one", "zero", "clean"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, 0/1), of which at most ``max_labelled`` documents are used.

    Rows with null ids or labels are left out; without documents of both classes every score is the share of label 1.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    half = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(2)).cast("int")
    sample = materialize(docs.select("doc_id", "text").join(known, "doc_id").select("doc_id", "text", "y", half.alias("half")), "labelled")
    counts = sample.select("doc_id", "text", "y", "half").mapInArrow(_counts, "term long, half int, one long, zero long, clean long")
    counts = materialize(counts.groupBy("term", "half").agg(*(F.sum(c).alias(c) for c in ("one", "zero", "clean"))), "terms")
    size = {r.half: (r.ones, r.zeros) for r in sample.groupBy("half").agg(F.count_if(F.col("y") == 1).alias("ones"), F.count_if(F.col("y") == 0).alias("zeros")).collect()}
    clean = {r.half: r.clean for r in counts.groupBy("half").agg(F.sum("clean").alias("clean")).collect()}
    # each half's evidence is by the terms of the other, so that the curve and K rest on texts the terms do not come from
    halves = [_terms(counts.where(F.col("half") == 1 - h), *size.get(1 - h, (0, 0)), clean.get(1 - h, 0)) for h in (0, 1)]
    every = counts.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("one", "zero", "clean")))
    n1, n0 = (sum(v[i] for v in size.values()) for i in (0, 1))
    model = _terms(every, n1, n0, sum(clean.values()))
    apart = sample.select("doc_id", "text", "y", "half")
    found = apart.mapInArrow(_found(halves), "tokens long, scores array<double>, y int, half int").collect()  # of the bounded sample
    for h, m in enumerate(halves):
        m.k = _k(m.lam, [r for r in found if r.half == h and r.y == 0])
    ks = [m.k for m in halves if len(m.terms)]
    model.k = math.exp(sum(map(math.log, ks)) / len(ks)) if ks else model.k
    evidence = np.array([sum(max(0.0, halves[r.half].lam * s - math.log(max(halves[r.half].k * r.tokens, 1e-9))) for s in r.scores) for r in found])
    model.a, model.b = _logistic(evidence, np.array([r.y for r in found], dtype=float))
    return model


def _terms(counts: DataFrame, n1: int, n0: int, total: int) -> Model:
    """The terms that tell n1 labelled documents from n0, with their log-odds, and lambda; ``total``: tokens of clean texts.

    Terms that pass number at most the tokens of the bounded sample; those of one language or topic fall to LEAST_ODDS.
    """
    model = Model(np.zeros(0, dtype=np.uint64), np.zeros(0))
    if not n1 or not n0:
        return model
    one, zero = F.col("one"), F.col("zero")
    share = (one + zero) / F.lit(float(n1 + n0))
    y1, y0 = one + F.lit(PRIOR) * share, zero + F.lit(PRIOR) * share
    odds = F.log(y1 / (F.lit(n1 + PRIOR) - y1 + 0.5)) - F.log(y0 / (F.lit(n0 + PRIOR) - y0 + 0.5))
    cell = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    ratio = 2 * (cell(one, share * n1) + cell(zero, share * n0) + cell(n1 - one, (1 - share) * n1) + cell(n0 - zero, (1 - share) * n0))
    kept = counts.withColumn("odds", odds).where((ratio >= LEAST_RATIO) & (F.col("odds") >= LEAST_ODDS))
    rows = sorted((r.term % 2**64, r.odds, r.clean) for r in kept.collect())
    model.terms, model.scores = np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows])
    clean = np.array([r[2] for r in rows], dtype=float)
    model.lam = _root(np.append(model.scores, DRIFT), np.append(clean, total - clean.sum()))
    return model


def _k(lam: float, clean: list) -> float:
    """K of the extreme-value law from the segments of clean texts: their number above a score s is Poisson with mean K n
    exp(-lambda s), so each tells exp(lambda s) / n at the least score seen; half a segment is added, as none may be seen."""
    n = sum(r.tokens for r in clean)
    scores = [s for r in clean for s in r.scores]
    if not n:
        return 0.1
    least = min(scores, default=LEAST_ODDS)
    return min(1.0, max(1e-6, (len(scores) + 0.5) * math.exp(min(lam * least, 50.0)) / n))


def _root(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; counts get a half added, as none of them is surely zero."""
    p = (counts + 0.5) / (counts + 0.5).sum()
    if not (scores > 0).any() or (p * scores).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(np.minimum(high * scores, 700))).sum() < 1 and high < 100:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * scores, 700))).sum() < 1 else (low, mid)
    return high


def _found(halves: list[Model]):
    """Each document's number of tokens and the scores of its segments, by the model of its half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half, tokens_, scores = batch.column(3).to_pylist(), [], []
            done = 0
            for p in packs([batch]):
                w, h = tokens(p)
                by = [m.token_scores(h) for m in halves]
                for d in range(len(p)):
                    x, y = int(w.first[d]), int(w.first[d + 1])
                    tokens_.append(y - x)
                    scores.append([s for _, _, s in segments(by[half[done + d]][x:y])])
                done += len(p)
            yield pa.RecordBatch.from_arrays([pa.array(tokens_, pa.int64()), pa.array(scores, pa.list_(pa.float64())), batch.column(2).cast(pa.int32()), batch.column(3).cast(pa.int32())], names=["tokens", "scores", "y", "half"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept of a logistic curve with Platt's targets, by Newton steps."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 0.0, math.log((pos + 0.5) / (neg + 0.5))
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.zeros(2)
    z = np.stack((np.minimum(x, 50.0), np.ones(len(x))), axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - t) + np.array([1e-3, 0]) * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), g)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0])), float(w[1])


_SCHEMA = "doc_id long, score double, predicted int, passages array<struct<start:long,end:long,score:double,normalised:double>>"


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Score whole texts: doc_id, score (0 to 1), predicted (1 if score >= 0.5), passages.

    docs: doc_id, text; other columns are ignored. passages are the significant segments, as byte spans of the UTF-8
    text with their score and normalised score. A null or empty text has no evidence and gets the score of that. Each
    row is scored by itself, whether or not rows share a doc_id or have a null one.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("normalised", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for p in packs([batch]):
                got = list(_scored(p, model))
                score = [model.probability(min(e, 50.0)) for e, _ in got]
                spans = [[dict(zip(("start", "end", "score", "normalised"), s, strict=True)) for s in f] for _, f in got]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(p)), pa.array(score), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(spans, kind)], names=["doc_id", "score", "predicted", "passages"]
                )
                done += len(p)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)


def fold(column: str = "doc_id", of: int = 5) -> Column:
    """crc32 of an id's decimal text, modulo ``of``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of
