"""Licence families of paragraphs: a trained classifier, calibrated, then confirmed by templates.

*Classifier.* Multinomial logistic regression over hashed word 1- to 3-grams
(A-Z lower-cased, edge marks off), one class per licence family, one for
"unknown" licences and one for "none". Families are trained on notices made from
the templates below (words dropped, prose around them), "unknown" on the same
notices with the family's names replaced by invented ones or by ``OTHERS``.
"none" is trained on at most ``NEGATIVES`` opening paragraphs of documents that
hold no cue word, as they are and with cue words strewn in; the bound is a
parameter, and the fit runs on the driver.

*Calibration.* A fifth of the training rows is held out. The scores' temperature
is the one with the smallest held-out loss.

*Templates.* A prediction of at least ``CONFIDENT`` counts if the paragraph holds
``CONFIRM`` of the word pairs of one of that family's templates, and one of the
family's names where the template has one. Other paragraphs that are a notice of
some kind by the model (``NOTICE``), with ``CONFIRM`` of the pairs of any
template without its names, are reported as ``unknown``.

*Scale.* The model (a bounded table) goes to every task; documents are scanned
once as they lie, without a shuffle. Any report needs a word pair of a template, so
a document without one is done after one look at its pairs, and so is a paragraph;
nothing else decides what the model sees.

*Paragraphs.* Each line is one, and so are the lines between two blank ones
together (a hard-wrapped notice) if none of them is a notice; ``paragraph`` is
the number of the first line.

Defined cases: a null or empty text has no paragraph; blank lines are no
paragraphs; equal rows are reported each; of families with equal probability the
first in the list counts; a very long text is scanned whole, a paragraph at a
time; on an empty table the negatives are empty and the result is empty. Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, gram_hash, is_in

DIMENSIONS = 1 << 15
NEGATIVES = 2_000
CONFIDENT = 0.8
CONFIRM = 0.5
#: A paragraph is a notice if its probability of "none" is below 1 less this.
NOTICE = 0.9
GRAMS = (1, 2, 3)

OUT = "doc_id long, paragraph int, family string, probability double, confirmed double, text string"

# How notices of each family read.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "License: MIT",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GPL v3.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License v3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Distributed under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without permission.",
        "Copyright 2020 The Authors. All rights reserved.",
        "All rights reserved.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
    ],
}
# Words by which templates name their family; and names of other licences.
NAMES = frozenset(
    "mit apache apache-2.0 gnu general public lesser affero gpl v3 bsd 3-clause mozilla cc by by-sa by-nc cc0 creative commons attribution attribution-noncommercial international".split()
)
OTHERS = "ISC; Zlib; Artistic; EUPL 1.2; Eclipse Public; Boost Software; Unlicense; WTFPL; Open Software; Academic Free; Python Software Foundation; SIL Open Font; Custom; Example; Community; Vendor"
UNKNOWN = "unknown"
FAMILIES = ["none", *TEMPLATES, UNKNOWN]

_MARKS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


class _Bare(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.strip(_MARKS).lower())
        return h


_BARE = _Bare()


def _hashes(paragraph: bytes) -> np.ndarray:
    words = paragraph.split()
    return np.fromiter(map(_BARE.__getitem__, words), np.uint64, len(words))


def _slots(h: np.ndarray) -> np.ndarray:
    """Feature slots of a paragraph, each once."""
    grams = np.concatenate([gram_hash(h, k) + np.uint64(k) for k in GRAMS])
    return np.unique(grams % np.uint64(DIMENSIONS)).astype(np.int64)


class _Template:
    """Word pairs of a template, those of it without its family's names, and its names."""

    def __init__(self, text: str):
        words = text.encode().split()
        named = np.array([w.strip(_MARKS).lower().decode() in NAMES for w in words])
        h = _hashes(text.encode())
        self.pairs, self.names = np.unique(gram_hash(h, 2)), h[named]
        plain = ~(named[1:] | named[:-1])
        self.plain = np.unique(gram_hash(h, 2)[plain]) if len(h) > 1 else h[:0]


class Model:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.weights, self.bias, self.temperature = weights, bias, temperature
        self.templates = {f: [_Template(t) for t in ts] for f, ts in TEMPLATES.items()}
        self.pairs = np.unique(np.concatenate([t.pairs for ts in self.templates.values() for t in ts]))

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        scores = np.array([self.weights[r].sum(axis=0) / np.sqrt(max(1, len(r))) for r in rows]) + self.bias
        scores = scores / self.temperature
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def confirm(self, family: str, h: np.ndarray) -> float:
        """The largest share of a template's word pairs that are here."""
        have = gram_hash(h, 2)
        if family == UNKNOWN:
            return max(float(np.isin(t.plain, have).mean()) for ts in self.templates.values() for t in ts if len(t.plain) > 1)
        return max(float(np.isin(t.pairs, have).mean()) if not len(t.names) or np.isin(t.names, h).any() else 0.0 for t in self.templates[family])

    def classify(self, paragraph: bytes) -> tuple[str, float, float] | None:
        """(family, probability, share of a template confirmed), or nothing."""
        h = _hashes(paragraph)
        return self.judge(h) if is_in(gram_hash(h, 2), self.pairs).any() else None

    def judge(self, h: np.ndarray) -> tuple[str, float, float] | None:
        """The same of a paragraph's words, which hold a word pair of some template (no other can be confirmed)."""
        p = self.probabilities([_slots(h)])[0]
        best = int(p.argmax())
        if best and FAMILIES[best] != UNKNOWN and p[best] >= CONFIDENT and (share := self.confirm(FAMILIES[best], h)) >= CONFIRM:
            return FAMILIES[best], float(p[best]), share
        if 1 - p[0] >= NOTICE and (share := self.confirm(UNKNOWN, h)) >= CONFIRM:
            return UNKNOWN, float(p[-1]), share
        return None

    def notices(self, text: bytes) -> Iterator[tuple[int, str, float, float, bytes]]:
        """(line, family, probability, share, paragraph) of lines, and of runs of lines in which no line is a notice."""
        h = _hashes(text)
        pairs = np.flatnonzero(is_in(gram_hash(h, 2), self.pairs))
        if not len(pairs):
            return
        lines = text.split(b"\n")
        ends = np.cumsum([len(x.split()) for x in lines])
        # pairs before a word's place: a stretch of words holds one if the count grows inside it
        before = np.searchsorted(pairs, np.arange(len(h) + 1))

        def judge(a: int, b: int):
            lo, hi = int(ends[a - 1]) if a else 0, int(ends[b - 1])
            return self.judge(h[lo:hi]) if hi - lo > 1 and before[hi - 1] > before[lo] else None

        start = 0
        while start < len(lines):
            end = start
            while end < len(lines) and lines[end].strip():
                end += 1
            found = [(k, *y, lines[k]) for k in range(start, end) if (y := judge(k, k + 1))]
            if not found and end - start > 1 and (whole := judge(start, end)):
                found = [(start, *whole, b"\n".join(lines[start:end]))]
            yield from found
            start = end + 1


def _prose(rng: np.random.Generator, pool: list[bytes], n: int) -> list[bytes]:
    return [w for i in rng.integers(0, len(pool), 1 + n // 8) for w in pool[i].split()][:n] if pool else []


def _unnamed(words: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """A notice with its family's names replaced by those of another licence or by invented ones."""
    out: list[bytes] = []
    others = OTHERS.encode().split(b"; ")
    for i, w in enumerate(words):
        if w.strip(_MARKS).lower().decode() not in NAMES:
            out.append(w)
        elif not i or words[i - 1].strip(_MARKS).lower().decode() not in NAMES:
            name = others[rng.integers(len(others))] if rng.random() < 0.6 else b"".join(bytes([97 + x]) for x in rng.integers(0, 26, rng.integers(3, 9))).title()
            out += name.split()
    return out


def notices(pool: list[bytes], each: int = 40, seed: int = 3) -> list[tuple[bytes, int]]:
    """Labelled notices: templates with words lost and, often, prose around them; and prose with cue words in it."""
    rng = np.random.default_rng(seed)
    out = []
    for label, family in enumerate(FAMILIES):
        for t in TEMPLATES.get(family, ()):
            words = t.encode().split()
            names = [w for w in words if w.strip(_MARKS).lower().decode() in NAMES]
            for k in range(each):
                for other in (False, True) if names and k % 2 else (False,):
                    kept = [w for w in words if k < 5 or w in names or rng.random() > 0.08]
                    mine = _unnamed(kept, rng) if other else kept
                    if k % 3 == 1:
                        mine = _prose(rng, pool, int(rng.integers(1, 15))) + mine
                    if k % 4 == 2:
                        mine = mine + _prose(rng, pool, int(rng.integers(1, 15)))
                    out.append((b" ".join(mine), len(FAMILIES) - 1 if other else label))
    cues = sorted(_CUES)
    for _ in range(10 * each if pool else 0):
        words = _prose(rng, pool, int(rng.integers(8, 60)))
        for _ in range(int(rng.integers(1, 3))):
            words.insert(int(rng.integers(0, len(words) + 1)), cues[rng.integers(len(cues))])
        out.append((b" ".join(words), 0))
    return out


def fit(negatives: list[bytes], rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Trains on four fifths of the rows, calibrates on the rest."""
    rows = [*notices(negatives), *((p, 0) for p in negatives)]
    features = [_slots(_hashes(p)) for p, _ in rows]
    labels = np.array([y for _, y in rows])
    held = np.arange(len(rows)) % 5 == 4
    k = len(FAMILIES)
    weights, bias = np.zeros((DIMENSIONS, k)), np.zeros(k)
    sizes = np.array([len(f) for f in features])
    flat, owner = np.concatenate(features), np.repeat(np.arange(len(rows)), sizes)
    train = ~held[owner]
    flat_t, owner_t = flat[train], owner[train]
    norm = np.sqrt(np.maximum(1, sizes))[:, None]
    used, place = np.unique(flat, return_inverse=True)
    place_t = place[train]
    w, g2 = np.zeros((len(used), k)), np.zeros((len(used), k))
    used_rows = (~held)[:, None]
    truth = np.eye(k)[labels]

    def scores() -> np.ndarray:
        out = np.zeros((len(rows), k))
        order = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        filled = sizes > 0
        out[filled] = np.add.reduceat(w[place], order[filled], axis=0)
        return out / norm + bias

    for _ in range(rounds):
        s = scores()
        p = np.exp(s - s.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - truth) * used_rows / max(1, (~held).sum())
        grad = np.zeros_like(w)
        np.add.at(grad, place_t, (d / norm)[owner_t])
        grad += decay * w
        g2 += grad * grad
        w -= rate * grad / (np.sqrt(g2) + 1e-8)
        bias -= rate * d.sum(axis=0)
    weights[used] = w
    s = scores()[held]
    best = (np.inf, 1.0)
    for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0):
        x = s / t
        loss = float(np.mean(np.log(np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1)) - (x - x.max(axis=1, keepdims=True))[np.arange(len(x)), labels[held]])) if len(x) else 0.0
        best = min(best, (loss, t))
    return Model(weights, bias, best[1])


# Words that prose and notices share; prose is trained with some strewn in.
_CUES = frozenset(
    b"license licensed mit apache gpl gnu bsd mozilla cc creative commons copyright rights permission redistribution redistribute spdx-license-identifier domain copy".split()
)
_CUE_PATTERN = re.compile(rb"(?i)licen|gpl|copyright|permission|redistribut|all rights|domain|spdx|copy of")
#: Opening paragraphs with one of these are no negatives. In small letters two of them are words of prose.
_NO_NEGATIVE = _CUE_PATTERN.pattern.decode() + r"|creative commons|apache|gnu|mozilla|(?-i:\b(?:CC|MIT)\b)"


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("doc_id").to_pylist(), binary(batch.column("text"))):
                rows += [(i, *found) for found in m.notices(text or b"")]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.binary())
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            arrays[-1] = arrays[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in OUT.split(", ")])

    return run


def sample_negatives(docs: DataFrame, most: int = NEGATIVES) -> list[bytes]:
    """Up to ``most`` paragraphs without a cue word that are like no template, by the hash of the doc_id."""
    templates = [_Template(t) for ts in TEMPLATES.values() for t in ts]
    lines = docs.select(F.xxhash64("doc_id", F.lit(4)).alias("h"), F.get(F.split("text", "\n"), F.lit(0)).alias("p"))
    # a share of the documents that holds some times as many, so that no task sends more than its part
    share = min(1.0, 8.0 * most / max(1, docs.count()))
    lines = lines.filter(F.pmod(F.col("h"), F.lit(1 << 40)) < int(share * (1 << 40)))
    picked = lines.filter("p is not null").filter(~F.col("p").rlike(_NO_NEGATIVE)).filter(F.col("p").rlike(r"\S+\s+\S+\s+\S+"))
    found = [r["p"].encode() for r in picked.orderBy("h", "p").limit(most).collect()]
    have = [gram_hash(_hashes(p), 2) for p in found]
    return [p for p, h in zip(found, have) if not any(np.isin(t.pairs, h).mean() >= CONFIRM for t in templates)]


def scan(docs: DataFrame, negatives: int = NEGATIVES) -> DataFrame:
    """One row for each paragraph with a licence notice: ``doc_id, paragraph, family, probability, confirmed, text``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(sample_negatives(texts, negatives)))
    return texts.mapInArrow(_scan(model), OUT)
