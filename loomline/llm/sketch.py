"""Fast similarity sketching of sets (Dahlgaard, Knudsen and Thorup, 2017), vectorised over many sets.

A sketch has ``t`` coordinates. In round ``i < t`` each element is hashed to a bin and a value, and bins that
are still empty keep the smallest value; in round ``t + i`` every element goes to bin ``i``, so that after
``2 t`` rounds every coordinate of a non-empty set is filled. A set of more than about ``t log t`` elements is
full after one or two rounds. Two sets agree on a coordinate with probability equal to their Jaccard similarity,
with Chernoff-like concentration over coordinates.
"""

from __future__ import annotations

import numpy as np

from .text import Pack, Words, mix, windows, word_hashes, words

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(pack: Pack, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each document, A-Z lower-cased.

    Returns (hashes, first): hashes sorted within each document, first with one entry more than documents.
    A document of 1 to k - 1 words has its whole word sequence as its one shingle; without words it has none.
    """
    w: Words = words(pack)
    h = word_hashes(pack.bytes, w, lower=True)
    counts = np.diff(w.first)
    s = windows(h, k)
    doc = w.doc[: len(s)]
    whole = doc == w.doc[k - 1 : k - 1 + len(s)]
    s, doc = s[whole], doc[whole]
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        extra = np.empty(len(few), dtype=np.uint64)
        for j, d in enumerate(few):
            x = np.uint64(counts[d])
            for v in h[w.first[d] : w.first[d + 1]]:
                x = mix(np.array([x ^ v]))[0]
            extra[j] = x
        s, doc = np.concatenate((s, extra)), np.concatenate((doc, few))
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    if len(s):
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        s, doc = s[new], doc[new]
    return s, np.searchsorted(doc, np.arange(len(pack) + 1))


def sketches(s: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """A (sets, t) array of uint64 coordinates; rows of empty sets are all ones."""
    n = len(first) - 1
    out = np.full(n * t, _EMPTY, dtype=np.uint64)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(first))
    x = s
    for i in range(2 * t):
        if not len(x):
            break
        v = mix(x ^ mix(np.array([i + 1], dtype=np.uint64)))
        bins = (v % np.uint64(t)).astype(np.int64) if i < t else np.full(len(x), i - t)
        at = doc * t + bins
        free = out[at] == _EMPTY
        if free.any():
            np.minimum.at(out, at[free], v[free] - np.uint64(1))  # never the mark of an empty bin
        open_docs = (out.reshape(n, t) == _EMPTY).any(axis=1)
        keep = open_docs[doc]
        if not keep.all():
            x, doc = x[keep], doc[keep]
    return out.reshape(n, t)


def band_keys(sk: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) int64 keys; a band is ``rows`` coordinates in turn, and keys of different bands differ."""
    n, t = sk.shape
    bands = t // rows
    g = sk[:, : bands * rows].reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
    for j in range(rows):
        key = mix(key ^ g[:, :, j])
    return key.view(np.int64)
