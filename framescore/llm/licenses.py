"""Licence scans by a trained paragraph classifier.

Paragraphs are lines. A sparse logistic regression over word n-grams, one curve a family, is fitted on drawn
variants of the families' template sentences against paragraphs of the corpus itself (a bounded sample). A paragraph
whose best calibrated probability is too low is unknown. Predictions are then confirmed by comparison with the family's
templates: the share of a template's word pairs that the paragraph has, or of the paragraph's that a template has.

A paragraph none of whose n-grams is in the model has the intercepts alone as its margins, which is unknown for every
family; most paragraphs are settled by that test, without losing any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_place, text_of

#: How licences commonly announce themselves.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "This software is distributed under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Except where otherwise noted, content is available under CC BY-SA 4.0.",
        "This page is dedicated to the public domain under CC0 1.0.",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright by the authors. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}
UNKNOWN = "unknown"
DRAWN = 200  # variants of each template
NEGATIVES = 6_000  # distinct paragraphs of the corpus, at most
NEGATIVE_DOCS = 2_000  # documents, about, from whose whole texts these are drawn
NEGATIVE_LENGTH = 4_000  # characters; longer paragraphs are scanned like any other, but not drawn
STEPS, RATE, STILL = 300, 2.0, 2e-4
LEAST_PROBABILITY, LEAST_SHARE = 0.5, 0.6
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(w: list[str]) -> list[tuple[str, ...]]:
    return [*zip(w), *zip(w, w[1:], strict=False), *zip(w, w[1:], w[2:], strict=False)]


class _Sparse:
    """0-1 rows as lists of their columns."""

    def __init__(self, rows: list[list[int]], columns: int):
        self.lengths = np.array([len(r) for r in rows])
        self.columns, self.index = columns, np.array([i for r in rows for i in r], dtype=np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.lengths)

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, weights=w[self.index], minlength=len(self.lengths)) for w in dense.T], axis=1)

    def transposed_dot(self, dense: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.index, weights=d[self.row], minlength=self.columns) for d in dense.T], axis=1)


class Classifier:
    """One weight vector a family over the n-grams of the templates' variants."""

    def __init__(self, negatives: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.families = sorted(TEMPLATES)
        filler = np.array([x for t in negatives[:500] for x in words(t)] or ["text"], dtype=object)
        made = []
        for k, family in enumerate(self.families):
            for template in TEMPLATES[family]:
                w = words(template)
                for _ in range(DRAWN):
                    keep = [x for x in w if len(w) <= 3 or rng.random() > 0.08]
                    around = filler[rng.integers(0, len(filler), size=int(rng.integers(0, 12)))].tolist()
                    cut = int(rng.integers(0, len(around) + 1))
                    made.append((around[:cut] + keep + around[cut:], k))
        rows = [(words(t), -1) for t in negatives] + made
        vocabulary = sorted({g for family in TEMPLATES.values() for t in family for g in _grams(words(t))})
        self.index = {g: i for i, g in enumerate(vocabulary)}
        # a pair or a triple cannot be in the model unless its first word is
        self.first = {g[0] for g in vocabulary}
        y = np.array([k for _, k in rows])
        held = np.arange(len(rows)) % 5 == 0
        x = [self.active(w) for w, _ in rows]
        target = (y[:, None] == np.arange(len(self.families))).astype(float)
        self.weight = np.zeros((len(vocabulary), len(self.families)))
        self.bias = np.full(len(self.families), -3.0)
        a, t = _Sparse([r for r, h in zip(x, held, strict=True) if not h], len(vocabulary)), target[~held]
        for _ in range(STEPS):
            error = 1 / (1 + np.exp(-(a.dot(self.weight) + self.bias))) - t
            step = a.transposed_dot(error) / len(t) + 1e-5 * self.weight
            self.weight -= RATE * step
            self.bias -= RATE * error.mean(axis=0)
            if np.abs(step).max() < STILL:
                break
        # calibrated on the held-out rows: a slope and an intercept that make the margin a probability
        self.slope = [_platt(m, q) for m, q in zip((_Sparse([r for r, h in zip(x, held, strict=True) if h], len(vocabulary)).dot(self.weight) + self.bias).T, target[held].T, strict=True)]
        self.pairs = {f: [set(zip(words(t), words(t)[1:], strict=False)) for t in TEMPLATES[f]] for f in self.families}

    def active(self, w: list[str]) -> list[int]:
        get = self.index.get
        return sorted({i for g in _grams(w) if (i := get(g)) is not None})

    def margins(self, w: list[str]) -> np.ndarray:
        """By family, the intercept and the weights of the distinct n-grams of w that are in the model."""
        return self.weight[self.active(w)].sum(axis=0) + self.bias

    def predict(self, paragraph: str) -> tuple[str, float, float]:
        """(family, probability, share of the nearest template). Families tie by name."""
        w = words(paragraph)
        if self.first.isdisjoint(w):
            return UNKNOWN, 0.0, 0.0
        margin = self.margins(w)
        p = [1 / (1 + np.exp(-(a + b * m))) for (a, b), m in zip(self.slope, margin, strict=True)]
        best = int(np.argmax(p))
        if p[best] < LEAST_PROBABILITY:
            return UNKNOWN, float(p[best]), 0.0
        own = set(zip(w, w[1:], strict=False))
        share = max(len(own & t) / max(1, min(len(t), max(len(own), 3))) for t in self.pairs[self.families[best]])
        return (self.families[best] if share >= LEAST_SHARE else UNKNOWN), float(p[best]), share


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, w = np.stack((np.ones(len(margin)), margin.astype(float)), axis=1), np.array([0.0, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(2) * 0.1, a.T @ (p - y) + 0.1 * (w - [0, 1]))
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fitted against at most NEGATIVES paragraphs that name no licence, the first by hash among the distinct ones of about
    NEGATIVE_DOCS documents drawn by hash; which ones does not depend on the order of rows."""
    cue = r"(?i)licen[cs]|copyright|rights reserved|spdx|public domain|creative commons|redistribut|permission|\bcc\b"
    drawn = docs.filter(hash_place(3, F.col(id_col).cast("string")) < NEGATIVE_DOCS / max(1, docs.count()))
    lines = drawn.select(F.explode(F.split(text_of(text_col), "\n")).alias("line")).filter((F.char_length("line") <= NEGATIVE_LENGTH) & F.col("line").rlike(r"\S") & ~F.col("line").rlike(cue)).distinct()
    return Classifier(sorted(r.line for r in lines.orderBy(F.xxhash64("line"), "line").limit(NEGATIVES).collect()))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classifier: Classifier | None = None) -> DataFrame:
    """One row per row of docs: doc_id, families (those found, by name, comma-joined), n_paragraphs, n_licensed, found.

    found has (paragraph, family, probability, share) of each confirmed paragraph; paragraph counts lines from 0. Null
    or empty text has no licence and no paragraph; lines without a word are none. Ids may be null or repeat; an empty
    table gives no rows; further columns are ignored.
    """
    model = classifier or fit(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the templates

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for frame in frames:
            out = []
            for doc, text in frame.itertuples(index=False, name=None):
                count, found = 0, []
                for k, line in enumerate(text.split("\n")):
                    if line and not line.isspace():
                        count += 1
                        family, p, share = m.predict(line)
                        if family != UNKNOWN:
                            found.append({"paragraph": k, "family": family, "probability": p, "share": share})
                out.append((doc, ",".join(sorted({x["family"] for x in found})), count, len(found), found))
            yield pd.DataFrame(out, columns=["doc_id", "families", "n_paragraphs", "n_licensed", "found"])

    d = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_of(text_col).alias("t"))
    kind = "doc_id string, families string, n_paragraphs long, n_licensed long, found array<struct<paragraph:int,family:string,probability:double,share:double>>"
    return d.mapInPandas(run, kind).withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
