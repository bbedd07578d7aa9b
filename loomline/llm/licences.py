"""Licence notices in paragraphs: a trained classifier with a calibrated unknown class, confirmed by templates.

Paragraphs are the lines of a text that hold words; long lines are scored by overlapping windows of words, so that a
notice is found wherever it stands. Features are the word 1-, 2- and 3-grams that occur in the
licence templates, weighted by how much of the paragraph they make up. A multinomial logistic regression over the families and an
unknown class is trained on templates with words dropped or put around them, and on paragraphs of a bounded sample of
the corpus that resemble no template; its temperature is fitted on a part that training leaves out. A prediction holds
if the probability reaches a threshold and the paragraph shares most word pairs with one of the family's templates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .decontamination import tokens
from .text import Pack, packs, windows

#: Notices of each family, in the words in which they are usually given.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GNU General Public License version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under CC BY-NC-SA 4.0.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released under CC BY-SA 4.0.",
    ),
    "Public-domain": (
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "Proprietary": (
        "Copyright, all rights reserved.",
        "This document is confidential and proprietary. Unauthorized copying is strictly prohibited.",
    ),
}
UNKNOWN = "unknown"
#: Documents whose paragraphs serve as unknown ones at most (those with the smallest hash of doc_id).
MAX_UNKNOWN = 500
#: A paragraph is confirmed by a template when they share this part of the word pairs of the shorter one.
CONFIRM = 0.6
#: Words of a window and from one to the next in lines that are longer: any 12 words in a row are in a window of 16, any 32 in one of 40.
WINDOWS = ((16, 4), (40, 8))


def _pack(texts: list[str]) -> Pack:
    raw = [t.encode() for t in texts]
    return Pack(np.arange(len(raw)), np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))


def _grams(h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 1-, 2- and 3-grams that lie in one group, and the group of each."""
    out, own = [], []
    for n in (1, 2, 3):
        g = windows(h, n)
        keep = group[: len(g)] == group[n - 1 : n - 1 + len(g)]
        out.append(g[keep])
        own.append(group[: len(g)][keep])
    return np.concatenate(out), np.concatenate(own)


@dataclass
class Model:
    families: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    pairs: list[tuple[int, np.ndarray]]
    threshold: float = 0.5

    def hits(self, g: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.vocabulary, g), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == g
        return at[hit], group[hit]

    def rows(self, h: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
        """(n, vocabulary) features of groups: 1 over the square root of the words, for each gram that occurs."""
        at, own = self.hits(*_grams(h, group))
        x = np.zeros((n, len(self.vocabulary)), dtype=np.float32)
        x[own, at] = 1
        return x / np.sqrt(np.maximum(np.bincount(group, minlength=n), 1))[:, None]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.weights + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def spans(self, group: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, first token and number of tokens of what is scored: lines, and windows that hold enough of the templates' word pairs to be confirmed."""
        n = np.bincount(group)
        edge = np.concatenate(([0], np.cumsum(n)))
        lines = np.flatnonzero(n <= WINDOWS[-1][0])
        out = [(lines, edge[lines], n[lines])]
        pair = np.isin(windows(h, 2), np.concatenate([v for _, v in self.pairs])) & (group[1:] == group[:-1])
        seen = np.concatenate(([0], np.cumsum(pair)))
        need = CONFIRM * min(len(v) for _, v in self.pairs)
        for w, step in WINDOWS:
            long = np.flatnonzero(n > w)
            k = 1 - (w - n[long]) // step  # the last one ends with the line
            of = np.repeat(long, k)
            a = edge[of] + np.minimum((np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)) * step, n[of] - w)
            # min(): the agreement's bound is of the shorter of the two
            keep = seen[a + w - 1] - seen[a] >= min(need, CONFIRM * (w - 1))
            out.append((of[keep], a[keep], np.full(keep.sum(), w)))
        return tuple(np.concatenate(v) for v in zip(*out, strict=True))

    def shared(self, h: np.ndarray, family: int) -> int:
        """The most word pairs in common with a template of the family."""
        own = np.unique(windows(h, 2)) if len(h) > 1 else np.unique(h)
        return max(len(np.intersect1d(own, pairs, assume_unique=True)) for f, pairs in self.pairs if f == family)

    def agreement(self, h: np.ndarray, family: int) -> float:
        """The largest share of word pairs in common with a template of the family, over the shorter of the two."""
        own = np.unique(windows(h, 2)) if len(h) > 1 else np.unique(h)
        best = 0.0
        for f, pairs in self.pairs:
            if f == family and len(own):
                best = max(best, len(np.intersect1d(own, pairs, assume_unique=True)) / max(1, min(len(own), len(pairs))))
        return best


def paragraphs(p: Pack) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes and their paragraph, each paragraph's document and number, and each token's byte span in the document."""
    w, h = tokens(p)
    line = np.cumsum(p.bytes == 0x0A)
    if not len(w):
        z = np.zeros(0, dtype=np.int64)
        return h, z, z, z, z, z
    new = np.ones(len(w), dtype=bool)
    new[1:] = (line[w.start[1:]] != line[w.start[:-1]]) | (w.doc[1:] != w.doc[:-1])
    first = np.flatnonzero(new)
    doc = w.doc[first]
    number = np.arange(len(first)) - np.searchsorted(doc, doc)
    return h, np.cumsum(new) - 1, doc, number, w.start - p.starts[w.doc], w.end - p.starts[w.doc]


def fit(docs: DataFrame, max_unknown: int = MAX_UNKNOWN, copies: int = 24, max_plain: int = 1440) -> Model:
    """Train on the templates (``copies`` of each) and, as unknown ones, on at most ``max_plain`` paragraphs of at most ``max_unknown`` documents (doc_id, text)."""
    rng = np.random.default_rng(7)
    families = [*TEMPLATES, UNKNOWN]
    plain = [(i, t) for i, f in enumerate(families[:-1]) for t in TEMPLATES[f]]
    h, group, *_ = paragraphs(_pack([t for _, t in plain]))
    vocabulary = np.unique(_grams(h, group)[0])
    of = [h[group == k] for k in range(len(plain))]
    pairs = [(plain[k][0], np.unique(windows(t, 2)) if len(t) > 1 else np.unique(t)) for k, t in enumerate(of)]
    model = Model(families, vocabulary, np.zeros((len(vocabulary), len(families)), dtype=np.float32), np.zeros(len(families), dtype=np.float32), 1.0, pairs)
    usable = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    wanted = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_unknown)
    sample = usable.join(wanted, "doc_id", "left_semi").collect()  # of each partition only ids meet at the driver
    sample.sort(key=lambda r: (r.doc_id, r.text))
    h, group, doc, *_ = paragraphs(_pack([r.text for r in sample]))
    edge = np.searchsorted(group, np.arange(len(doc) + 1))
    other = [h[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
    other = [t for t in other if all(model.agreement(t, f) < CONFIRM / 2 for f in range(len(families) - 1))]
    filler = np.concatenate(other) if other else np.zeros(1, dtype=np.uint64)
    texts: list[tuple[int, np.ndarray]] = []
    for k, t in enumerate(of):
        for _ in range(copies):
            part = t[rng.random(len(t)) > 0.1]
            a = rng.integers(len(filler))
            around = filler[a : a + rng.integers(0, 12)]
            texts.append((plain[k][0], np.concatenate((part, around)) if rng.random() < 0.5 else np.concatenate((around, part))))
    # words of notices that make no notice
    words_ = np.concatenate(of)
    for _ in range(copies * 20):
        a = rng.integers(len(filler))
        mixed = np.concatenate((filler[a : a + rng.integers(3, 30)], words_[rng.integers(0, len(words_), rng.integers(0, 5))]))
        texts.append((len(families) - 1, mixed[rng.permutation(len(mixed))]))
    texts += [(len(families) - 1, t) for t in other[:max_plain]]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    y = np.array([f for f, _ in texts])
    x = model.rows(np.concatenate([t for _, t in texts]), np.repeat(np.arange(len(texts)), [len(t) for _, t in texts]), len(texts))
    held = np.arange(len(y)) % 5 == 0
    one = np.eye(len(families), dtype=np.float32)[y]
    weight = 1 / np.bincount(y, minlength=len(families)).clip(1)[y]
    weight = (weight / weight.mean()).astype(np.float32)
    speed = [np.full(model.weights.shape, 1e-3, dtype=np.float32), np.full(model.bias.shape, 1e-3, dtype=np.float32)]
    train = np.flatnonzero(~held)
    for _ in range(30):
        order = rng.permutation(train)
        for a in range(0, len(order), 64):
            at = order[a : a + 64]
            g = (one[at] - model.probabilities(x[at])) * weight[at, None] / len(at)
            for target, step, sums in ((model.weights, x[at].T @ g - 1e-5 * model.weights, speed[0]), (model.bias, g.sum(axis=0), speed[1])):
                sums += step * step  # Adagrad
                target += 0.5 * step / np.sqrt(sums)
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(-1.5, 1.5, 61)):
        model.temperature = float(t)
        loss = float((-np.log(model.probabilities(x[held])[np.arange(held.sum()), y[held]] + 1e-12) * weight[held]).sum())
        best = min(best, (loss, float(t)))
    model.temperature = best[1]
    return model


_SCHEMA = "doc_id long, paragraph long, start long, end long, family string, probability double, agreement double"


def licences(docs: DataFrame, model: Model) -> DataFrame:
    """Licence notices: doc_id, paragraph (its number in the text), start, end (byte span), family, probability, agreement.

    docs: doc_id, text; other columns are ignored. Whole texts are scanned. Null and empty texts have no notices; rows
    with a null doc_id are left out; rows that share one are scanned one by one. Of predictions that overlap in a line,
    the one that shares the most word pairs with a template holds.
    """
    none = len(model.families) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in packs(batches):
            words_, of, doc, number, start, end = paragraphs(p)
            if not len(words_):
                continue
            line, begin, size = model.spans(of, words_)
            group = np.repeat(np.arange(len(line)), size)
            h = words_[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(group))]
            at, own = model.hits(*_grams(h, group))
            likely = np.unique(own)  # others have no feature, and are unknown by the bias
            if not len(likely):
                continue
            key = np.unique(own * len(model.vocabulary) + at)
            own, at = key // len(model.vocabulary), key % len(model.vocabulary)
            first = np.searchsorted(own, likely)
            z = np.add.reduceat(model.weights[at], first, axis=0) / np.sqrt(size[likely])[:, None] + model.bias
            z = z / model.temperature
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            family = z.argmax(axis=1)
            found, rows = [], []
            for k in np.flatnonzero((family != none) & (z.max(axis=1) >= model.threshold)).tolist():
                g = int(likely[k])
                own_words = words_[begin[g] : begin[g] + size[g]]
                agreement = model.agreement(own_words, int(family[k]))
                if agreement >= CONFIRM:
                    found.append((-model.shared(own_words, int(family[k])), -float(z[k].max()), int(size[g]), int(begin[g]), int(line[g]), int(family[k]), agreement))
            taken: dict[int, list[tuple[int, int]]] = {}
            for _, p_, n, a, g, f, agreement in sorted(found):
                if all(a >= y or a + n <= x for x, y in taken.setdefault(g, [])):
                    taken[g].append((a, a + n))
                    rows.append((int(p.ids[doc[g]]), int(number[g]), int(start[a]), int(end[a + n - 1]), model.families[f], -p_, agreement))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "paragraph", "start", "end", "family", "probability", "agreement"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null").mapInArrow(run, _SCHEMA)
