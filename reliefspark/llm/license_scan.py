"""Licence scan: a trained paragraph classifier - multinomial logistic regression on sparse word n-grams - names licence
families, with a calibrated class for everything else; a comparison with the family's templates confirms it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, materialize, release, small_batches, values

# Families and the notices and opening words by which their licences are known.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is released under the Apache License 2.0.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL v2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0.", "This work is dedicated to the public domain."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
    "isc": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "proprietary": ["All rights reserved.", "Copyright 2020 Example Corporation. All rights reserved.", "Confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited."],
}
#: Ordinary prose with words of licences, of the class for everything else.
OTHERS = [
    "She lost her driving license on the way to the public library.", "The general public was free to walk in the park.", "The software on this machine is old and slow.", "He asked for permission to copy the notes of the lecture.",
    "Version 3 of the plan was released under pressure.", "The apache tribe lived in the south west.", "They work under the terms of an agreement with the city.", "All seats are reserved for members and their guests.",
    "The students of MIT won the contest.", "You may use the kitchen, provided that you clean it.", "This file is a list of names.", "The author has the right to publish at any time.", "A copy of the letter was found in the source of the river.",
    "You can obtain one at the counter.", "The foundation gives money to free schools.", "Cc the manager by noon, please.",
]
UNKNOWN = "unknown"
#: Documents (by hash of doc_id) whose paragraphs are examples of the class for everything else, how many of each, and their words.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS, SAMPLE_WORDS = 500, 4, 240
#: Chance from which a family is named, and share of the paragraph's or template's word pairs that must be shared with a template.
CHANCE, SIMILARITY = 0.5, 0.5
#: Paragraphs and lines of up to this many words are classified whole.
WINDOW = 120
#: Words of the windows in which every paragraph is looked at, a quarter of a window apart: a notice within other text.
NARROW = (8, 16, 32, 64)
FEATURES = 1 << 14
#: Words that are scored at once in one table.
STRETCH = 20_000
_WORD = re.compile(rb"[a-z0-9]+")
_VARIANTS = ("", "copyright 2021 the authors ", "the code is ", "notice ", "this document ", "see license file ")


def words_of(data: bytes) -> list[bytes]:
    return _WORD.findall(data.lower())


def ngrams(h: np.ndarray) -> list[np.ndarray]:
    """Features of the words, word pairs and triples that begin at each place, from the hashes of the words."""
    out = [h]
    for n in (1, 2):
        out.append(out[-1][: max(0, len(h) - n)] * np.uint64(0x9FB21C651E98DF25) ^ h[n:])
    return [((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % FEATURES for x in out]


def vector(w: list[bytes], memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams and their weights: counts over the root of the number of n-grams."""
    grams = np.concatenate(ngrams(np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))))
    i, c = np.unique(grams, return_counts=True)
    return i, c / max(1, len(grams)) ** 0.5


@dataclass
class LicenceModel:
    families: list[str]  # the last is UNKNOWN
    weights: np.ndarray  # (FEATURES, families)
    bias: np.ndarray
    temperature: float
    templates: list[list[set[bytes]]]  # word pairs, by family

    def likely(self, h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows begin to end over words with hashes h, those that are of a family with CHANCE or more: which, the
        family, and its chance. Scores are sums over n-grams, so those of all windows come from running sums."""
        sums = []
        for x in ngrams(h):
            c = np.zeros((len(x) + 1, len(self.families)))
            np.cumsum(self.weights[x], axis=0, out=c[1:])
            sums.append(c)
        size = end - begin
        z = np.zeros((len(begin), len(self.families)))
        for n, c in enumerate(sums):
            z += c[np.maximum(end - n, begin).clip(max=len(c) - 1)] - c[begin.clip(max=len(c) - 1)]
        z = (z / np.sqrt(size + np.maximum(size - 1, 0) + np.maximum(size - 2, 0))[:, None] + self.bias) / self.temperature
        best = z[:, :-1].argmax(axis=1)
        ahead = np.flatnonzero(z[np.arange(len(z)), best] > z[:, -1])  # the rest is unknown or has too small a chance
        e = np.exp(z[ahead] - z[ahead].max(axis=1, keepdims=True))
        p = e[np.arange(len(ahead)), best[ahead]] / e.sum(axis=1)
        sure = p >= CHANCE
        return ahead[sure], best[ahead[sure]], p[sure]

    def similarity(self, w: list[bytes], family: int) -> tuple[float, int]:
        """Largest share of word pairs in common with a template of the family, of the smaller of both, and how many pairs."""
        own = _pairs(w)
        return max(((len(own & t) / max(1, min(len(own), len(t))), len(own & t)) for t in self.templates[family]), default=(0.0, 0))

    def classify(self, w: list[bytes]) -> tuple[str, float, float, bool] | None:
        """Family, its chance, likeness to its templates, and whether both agree; None for the class of everything else."""
        memo = WordHashes()
        if not w:
            return None
        at, family, chance = self.likely(np.fromiter(map(memo.__getitem__, w), np.uint64, len(w)), np.array([0]), np.array([len(w)]))
        if not len(at):
            return None
        s = self.similarity(w, int(family[0]))[0]
        return self.families[family[0]], float(chance[0]), s, s >= SIMILARITY


def _pairs(w: list[bytes]) -> set[bytes]:
    return {a + b" " + b for a, b in zip(w, w[1:], strict=False)} or set(w)


def _examples(prose: list[list[bytes]], seed: int) -> tuple[list[list[bytes]], np.ndarray]:
    """Templates whole, cut, with something before or after them and with a word left out; prose whole, cut and mixed."""
    rng = np.random.default_rng(seed)
    x: list[list[bytes]] = []
    y: list[int] = []
    prose = prose or [words_of(s.encode()) for s in OTHERS]
    for k, texts in enumerate(TEMPLATES.values()):
        for t in texts:
            w = words_of(t.encode())
            for n in range(40):
                v = list(w)
                if len(v) > 12 and n % 4 == 1:
                    a = int(rng.integers(0, len(v) // 2))
                    v = v[a : a + max(10, len(v) // 2)]
                if len(v) > 6 and n % 4 == 2:
                    del v[int(rng.integers(0, len(v)))]
                v = words_of(_VARIANTS[n % len(_VARIANTS)].encode()) + v
                if n % 5 == 4:
                    extra = prose[int(rng.integers(0, len(prose)))]
                    v = v + extra[: int(rng.integers(1, max(2, len(v))))]
                x.append(v)
                y.append(k)
            for n in range(12):  # as a narrow window has it: prose before and after, or a part
                size = NARROW[n % len(NARROW)]
                a = int(rng.integers(0, max(1, len(w) - size + 1)))
                v = w[a : a + size]
                before = int(rng.integers(0, size - len(v) + 1))
                around = [z for _ in range(size) for z in prose[int(rng.integers(0, len(prose)))]][: size - len(v)]
                x.append(around[:before] + v + around[before:])
                y.append(k)
    rest = len(TEMPLATES)
    common = [w for t in TEMPLATES.values() for s in t for w in words_of(s.encode())]
    for w in [words_of(s.encode()) for s in OTHERS] * 15 + prose:
        x.append(w)
        y.append(rest)
    for _ in range(len(x) // 2):  # licence words in no order, among prose
        w = list(prose[int(rng.integers(0, len(prose)))][: int(rng.integers(3, 30))])
        for _ in range(int(rng.integers(1, 4))):
            w.insert(int(rng.integers(0, len(w) + 1)), common[int(rng.integers(0, len(common)))])
        x.append(w)
        y.append(rest)
    return x, np.array(y)


def train(prose: list[bytes], seed: int = 3, epochs: int = 30) -> LicenceModel:
    """AdaGrad on three quarters of the examples; the temperature is the one of least loss on the rest."""
    paragraphs = [w for w in (words_of(p)[:WINDOW] for p in prose) if w]
    memo = WordHashes()
    x, y = _examples(paragraphs, seed)
    families = [*TEMPLATES, UNKNOWN]
    rng = np.random.default_rng(seed)
    vectors = [vector(w, memo) for w in x]
    order = rng.permutation(len(x))
    held, fit = order[: len(x) // 4], order[len(x) // 4 :]
    weight = (len(y) / (len(families) * np.bincount(y, minlength=len(families)).clip(1))) ** 0.5
    w, b = np.zeros((FEATURES, len(families))), np.zeros(len(families))
    gw, gb = np.full(w.shape, 1e-2), np.full(b.shape, 1e-2)
    size = 32
    for _ in range(epochs):
        for lo in range(0, len(fit), size):
            rows = fit[lo : lo + size]
            sizes = [len(vectors[r][0]) for r in rows]
            i = np.concatenate([vectors[r][0] for r in rows])
            v = np.concatenate([vectors[r][1] for r in rows])
            at = np.repeat(np.arange(len(rows)), sizes)
            used, where = np.unique(i, return_inverse=True)
            m = np.zeros((len(rows), len(used)))
            m[at, where] = v
            z = m @ w[used] + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[y[rows]][:, None] / len(rows)
            g = m.T @ p + 1e-5 * w[used]
            gw[used] += g * g
            w[used] -= 0.3 * g / np.sqrt(gw[used])
            g = p.sum(axis=0)
            gb += g * g
            b -= 0.3 * g / np.sqrt(gb)
        rng.shuffle(fit)
    z = np.array([vectors[r][1] @ w[vectors[r][0]] + b for r in held])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(held)), y[held]]).mean())

    temperature = min((0.25 * 1.25**k for k in range(16)), key=loss)
    texts = [[words_of(t.encode()) for t in ts] for ts in TEMPLATES.values()]
    return LicenceModel(families, w, b, temperature, [[_pairs(t) for t in ts] for ts in texts])


def _windows(n: int, breaks: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of every window to look at in n words: paragraphs and lines of up to WINDOW words whole, and windows
    of NARROW words within each paragraph, the last of each size at its end. breaks, lines: where paragraphs and lines begin."""
    begin, end = [], []
    for heads in (breaks, lines):
        tails = np.append(heads[1:], n)
        whole = tails - heads <= WINDOW
        begin.append(heads[whole])
        end.append(tails[whole])
    tails = np.append(breaks[1:], n)
    of = np.repeat(tails, tails - breaks)  # the end of each word's paragraph
    head = np.repeat(breaks, tails - breaks)
    for size in NARROW:
        at = np.flatnonzero(((np.arange(n) - head) % (size // 4) == 0) & (np.arange(n) + size <= of))
        last = tails[tails - breaks > size] - size
        begin += [at, last]
        end += [at + size, last + size]
    pairs = np.unique(np.concatenate(begin) * (n + 1) + np.concatenate(end))
    return pairs // (n + 1), pairs % (n + 1)


def scan_text(model: LicenceModel, data: bytes | None, memo: WordHashes | None = None) -> list[dict]:
    """Licences of a whole text: byte range, family, chance, similarity, confirmed.

    Paragraphs stand between blank lines, so a wrapped notice is one. All windows of _windows go through the classifier, and
    those it names are compared with the family's templates. Of hits that overlap, the one with most word pairs of its
    template is kept; its range is the words between the first and last such pair. A paragraph or line that was named but
    shares too little with every template is given as not confirmed, where nothing confirmed overlaps it."""
    memo = WordHashes() if memo is None else memo
    found: list[dict] = []
    if not data:
        return found
    low = data.lower()
    w = _WORD.findall(low)
    if not w:
        return found
    h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
    breaks, lines = _heads(low, w)
    confirmed, named = [], []
    # long texts go through in stretches that overlap by the longest window
    for lo in range(0, max(1, len(w) - WINDOW), STRETCH):
        hi = min(len(w), lo + STRETCH + WINDOW)
        own = [np.unique(np.append(x[(x > lo) & (x < hi)], lo)) - lo for x in (breaks, lines)]
        begin, end = _windows(hi - lo, *own)
        at, family, chance = model.likely(h[lo:hi], begin, end)
        for k, f, p in zip(at.tolist(), family.tolist(), chance.tolist(), strict=True):
            a, e = int(begin[k]) + lo, int(end[k]) + lo
            s, n = model.similarity(w[a:e], f)
            if s >= SIMILARITY:
                known = set().union(*model.templates[f])
                pairs = [i for i in range(a, e - 1) if w[i] + b" " + w[i + 1] in known] or [a, max(a, e - 2)]
                confirmed.append((-n, -s, -p, pairs[0], min(e - 1, pairs[-1] + 1), f))
            elif e - a <= WINDOW and (a in own[1] + lo or a in own[0] + lo) and s >= SIMILARITY / 2:
                named.append((-n, -s, -p, a, e - 1, f))
    kept: list[tuple] = []
    for hits in (sorted(set(confirmed)), sorted(set(named))):
        for hit in hits:
            if all(hit[4] < o[3] or o[4] < hit[3] for o in kept):
                kept.append(hit)
    if kept:
        spans = [m.span() for m in _WORD.finditer(low)]
        sure = set(confirmed)
        found = [{"start": spans[x[3]][0], "end": spans[x[4]][1], "family": model.families[x[5]], "chance": -x[2], "similarity": -x[1], "confirmed": x in sure} for x in sorted(kept, key=lambda x: x[3])]
    return found


def _heads(low: bytes, w: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words that begin a paragraph, and a line."""
    counts = [len(_WORD.findall(x)) for x in low.split(b"\n")]
    lines = np.cumsum([0, *counts])[:-1]
    blank = [not x.strip() for x in low.split(b"\n")]
    first = [True, *[blank[k - 1] for k in range(1, len(blank))]]
    has = np.array(counts) > 0
    # a paragraph begins at the first line with words after a blank one
    after = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    seen = np.append(0, np.cumsum(has))
    new = has & (seen[np.arange(len(has))] == seen[after])
    return np.unique(np.append(0, lines[new])), np.unique(np.append(0, lines[has]))


def prose_sample(docs: DataFrame, rows: int = SAMPLE_DOCS) -> list[bytes]:
    """The first SAMPLE_PARAGRAPHS lines of a bounded sample of documents, by hash of doc_id, up to SAMPLE_WORDS words each; those
    that name licences are left out. Only training sees this sample."""
    own = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null")
    chosen = materialize(own.select("i").distinct().orderBy(F.xxhash64("i"), "i").limit(rows), "prose")
    texts = own.join(F.broadcast(chosen), "i", "left_semi").select(F.slice(F.filter(F.split("t", "\n"), lambda p: F.length(p) > 20), 1, SAMPLE_PARAGRAPHS).alias("p"))
    taken = sorted(b" ".join(p.encode().split()[:SAMPLE_WORDS]) for r in texts.toArrow()["p"].to_pylist() for p in r or [])
    key = re.compile(rb"(?i)licen[sc]|copyright|reserved|permission|redistribut|software|public domain|warrant")
    return [p for p in taken if not key.search(p)]


SCHEMA = "doc_id long, families array<string>, licences array<struct<start: long, end: long, family: string, chance: double, similarity: double, confirmed: boolean>>"


def scan(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row of docs: doc_id, families (confirmed ones, sorted), licences (see scan_text).

    Null, empty and licence-free texts have empty lists. Rows that repeat an id and null ids are scanned each. Other
    columns are not looked at. The classifier is trained on the driver from the templates and a bounded sample of prose."""
    model = train(prose_sample(docs, sample_docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = shared.value, WordHashes()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("chance", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))
        for b in batches:
            found = [scan_text(m, t, memo) for t in values(b.column(1))]
            families = [sorted({x["family"] for x in f if x["confirmed"]}) for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(families, pa.list_(pa.string())), pa.array(found, kind)], ["doc_id", "families", "licences"])
        release()

    src = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("t"))
    return src.mapInArrow(run, SCHEMA)
