"""A run-length (r-) index of a set of byte strings, and self-matching statistics streamed from it.

The strings are ended by terminators that differ from all bytes and from each other. Of the suffix array only what
stands at run ends of the Burrows-Wheeler transform is kept: for the first suffix of each run, the text position
before it, and the position before the suffix that precedes it in order. Between two such samples the neighbour of
position i in suffix order moves along with i (phi(i - 1) = phi(i) - 1 within a run), and the length of their common
prefix grows by one with each step to the left, so both are streamed from r samples over the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class RunIndex:
    """text: the strings end to end; first: their starts, one more than strings; end: each byte's string end.

    at, phi, lcp: the samples in text order. n counts each string's terminator too, after its bytes.
    """

    first: np.ndarray
    at: np.ndarray
    phi: np.ndarray
    lcp: np.ndarray
    runs: int

    @property
    def n(self) -> int:
        return int(self.first[-1]) if len(self.first) else 0


def _ranks(order_key: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    order = np.argsort(order_key)
    k = order_key[order]
    new = np.ones(len(k), dtype=np.int64)
    new[1:] = k[1:] != k[:-1]
    names = np.cumsum(new)
    rank = np.empty(len(k), dtype=np.int64)
    rank[order] = names
    return rank, order, bool(names[-1] == len(k))


def suffix_order(text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes up to the string's terminator; equal ones by position.

    text: values above 0, terminators 0; end: the position of the terminator of each position's string.
    """
    n = len(text)
    at = np.arange(n, dtype=np.int64)
    key = np.zeros(n, dtype=np.uint64)
    padded = np.concatenate((text.astype(np.uint64), np.zeros(8, dtype=np.uint64)))
    for j in range(7):
        inside = at + j <= end
        key = (key << np.uint64(9)) | np.where(inside, padded[j : j + n], np.uint64(0))
    rank, order, unique = _ranks(key)
    depth, longest = 7, int((end - at).max()) + 1
    while not unique and depth < longest:
        after = np.zeros(n, dtype=np.int64)
        ok = at + depth <= end
        after[ok] = rank[at[ok] + depth]
        rank, order, unique = _ranks(rank.astype(np.uint64) * np.uint64(n + 1) + after.astype(np.uint64))
        depth *= 2
    # equal suffixes are ended by terminators, which stand in the order of position
    return order if unique else np.argsort(rank.astype(np.uint64) * np.uint64(n) + at.astype(np.uint64))


def build(strings: list[bytes]) -> RunIndex:
    sizes = np.array([len(s) + 1 for s in strings], dtype=np.int64)
    first = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(sizes)))
    n = int(first[-1])
    raw = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
    text = raw.astype(np.int16) + 1
    text[first[1:] - 1] = 0
    end = np.repeat(first[1:] - 1, sizes)
    order = suffix_order(text, end)
    before = text[order - 1].astype(np.int64)  # position -1 is the last terminator
    # a terminator is unlike any other, so each one is a run by itself
    head = np.ones(n, dtype=bool)
    head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
    j = np.flatnonzero(head)
    at = (order[j] - 1) % n
    # the neighbour above the position before a run's first suffix: by rank, as the lemma says nothing of it
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    above = rank[at] - 1
    phi = np.where(above >= 0, order[np.maximum(above, 0)], -1)
    by = np.argsort(at)
    at, phi = at[by], phi[by]
    return RunIndex(first, at, phi, _common(text, end, at, phi), len(j))


def _common(text: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, terminators left out; b may be -1."""
    out = np.zeros(len(a), dtype=np.int64)
    live = np.flatnonzero(b >= 0)
    step = 0
    while len(live):
        x, y = a[live] + step, b[live] + step
        ok = (x < end[a[live]]) & (y < end[b[live]])
        ok[ok] = text[x[ok]] == text[y[ok]]
        live = live[ok]
        out[live] += 1
        step += 1
    return out


def stream(index: RunIndex) -> tuple[np.ndarray, np.ndarray]:
    """phi and the length matched with it, for every text position."""
    n = index.n
    pos = np.arange(n, dtype=np.int64)
    gap = np.diff(np.concatenate(([-1], index.at)))
    back = np.repeat(index.at, gap)[:n] - pos
    phi = np.repeat(index.phi, gap)[:n]
    lcp = np.repeat(index.lcp, gap)[:n] + back
    phi = np.where(phi >= 0, phi - back, -1)
    lcp[phi < 0] = 0
    return phi, lcp


def first_matches(index: RunIndex, length: int, order: np.ndarray) -> np.ndarray:
    """For every text position the least ``order`` among all positions whose next ``length`` bytes are equal to its own.

    order: a value for each text position. A position with no other match, or too near its string's end, gets its own.
    """
    phi, lcp = stream(index)
    long = lcp >= length
    root = np.where(long, phi, np.arange(index.n))
    while True:  # the chain of phi over long matches leads to the first of the interval in suffix order
        further = root[root]
        if np.array_equal(further, root):
            break
        root = further
    least = order.copy()
    np.minimum.at(least, root, order)
    return least[root]
