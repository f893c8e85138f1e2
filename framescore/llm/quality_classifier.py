"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are runs of character classes (three in a row), repeated words, and word and line lengths, so that they say how
a text is written and not in what language. A bounded labelled sample gives inverse document frequencies, a truncated
singular-value decomposition, and the labelled vectors, which are broadcast. Every document's exact cosine with every
labelled vector is computed in blocks; the nearest NEIGHBOURS vote, weighted by similarity; a logistic curve fitted to
leave-one-out votes of the sample makes the vote a probability.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_place, text_of

SAMPLE = 2_000  # labelled rows of each class
LATENT = 48
NEIGHBOURS = 25
SHARPNESS = 6
FOLDS, FOLD = 4, 2
THRESHOLD = 0.7
BLOCK = 256
_CLASSES = 13
_LENGTHS = 24
TERMS = _CLASSES**3 + 2 * _LENGTHS + 2


@functools.cache
def _class_of() -> np.ndarray:
    """Class of each code point of the basic plane: letters by case, digits, spaces, feeds, and kinds of marks."""
    out = np.full(1 << 16, 12, dtype=np.int64)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))
        out[c] = {"Ll": 0, "Lu": 1, "Lo": 2, "Lm": 2, "Lt": 1, "Nd": 3, "Zs": 4, "Po": 9, "Pd": 9, "Ps": 9, "Pe": 9, "Pi": 9, "Pf": 9, "Sm": 10, "Sc": 10, "Sk": 10, "So": 10}.get(kind, 11 if kind[0] == "C" else 12)
    for chars, k in ((".", 5), (",;:", 6), ("!?", 7), ("#*$%&|<>@^~=_", 8)):
        out[[ord(c) for c in chars]] = k
    out[10] = 11
    out[9] = 4
    return out


def terms(text: str) -> np.ndarray:
    """Counts of the terms of a whole text."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    c = _class_of()[np.minimum(points, 0xFFFF)]
    c = c[np.flatnonzero(np.diff(c, prepend=-1))]  # runs
    out = np.zeros(TERMS)
    if len(c) >= 3:
        out[: _CLASSES**3] = np.bincount((c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:], minlength=_CLASSES**3)
    words, at = text.split(), _CLASSES**3
    if words:
        out[at] = sum(map(str.__eq__, words, words[1:]))
        out[at + 1] = len(words) - len(set(zip(words, words[1:], strict=False))) - 1
        out[at + 2 : at + 2 + _LENGTHS] = np.bincount(np.minimum(list(map(len, words)), _LENGTHS - 1), minlength=_LENGTHS)
    lengths = np.array([len(x) for x in text.split("\n")])
    out[at + 2 + _LENGTHS :] = np.bincount(np.minimum(np.log2(lengths + 1).astype(int), _LENGTHS - 1), minlength=_LENGTHS)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _leading_axes(x: np.ndarray, k: int) -> np.ndarray:
    """The k leading right singular vectors, by subspace iteration from a seeded start."""
    q = np.linalg.qr(np.random.default_rng(4).standard_normal((x.shape[1], min(k + 16, *x.shape))))[0]
    for _ in range(8):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :k].astype(np.float32)


class Voter:
    """The fitted space, labelled vectors and calibration."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.1
        x = _unit(np.log1p(counts) * self.idf)
        self.axes = _leading_axes(x, LATENT)
        self.points = _unit(x @ self.axes).astype(np.float32)
        self.labels = labels.astype(np.float32)
        vote = self._vote(self.points, leave_out=True)
        self.curve = _logistic(vote, labels)

    def _vote(self, points: np.ndarray, leave_out: bool = False) -> np.ndarray:
        out = np.empty(len(points))
        for at in range(0, len(points), BLOCK):
            cosine = points[at : at + BLOCK] @ self.points.T
            if leave_out:
                cosine[np.arange(len(cosine)), at + np.arange(len(cosine))] = -1
            k = min(NEIGHBOURS, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** SHARPNESS + 1e-9
            out[at : at + BLOCK] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return out

    def score(self, counts: np.ndarray) -> np.ndarray:
        vote = self._vote(_unit(_unit(np.log1p(counts) * self.idf).astype(np.float32) @ self.axes))
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * vote)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and slope by Newton steps, with a small ridge."""
    a, w = np.stack((np.ones(len(x)), x), axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(2) * 0.1, a.T @ (p - y) + 0.1 * w)
    return w


def _held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == FOLD, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Voter | None:
    """A voter from about `sample` labelled rows of each class outside the held-out fold; None without labels."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~_held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("y"))
    share = {r.y: sample / r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return None
    place = hash_place(4, F.col("_id").cast("string"))
    drawn = known.filter(place < F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("y")))
    drawn = drawn.distinct().orderBy(place, "_id", "y").limit(4 * sample)  # by hash, so that reruns draw the same
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("t")).join(F.broadcast(drawn), "_id").select(F.col("_id").cast("string").alias("id"), "y", "t")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "y": frame["y"], "terms": [terms(t).astype("<f4").tobytes() for t in frame["t"]]})

    found = texts.mapInPandas(run, "id string, y int, terms binary")
    rows = sorted(found.orderBy(F.xxhash64("id", "terms"), "id", "y").limit(8 * sample).collect())
    if not rows:
        return None
    return Voter(np.stack([np.frombuffer(r.terms, dtype="<f4") for r in rows]).astype(float), np.array([r.y for r in rows], dtype=float))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, voter: Voter | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null text is empty, and empty texts are scored like any other. Without a labelled row every score is 0.5. Labels
    other than 0 and 1 and labels of unknown documents are not used. Ids may be null or repeat; an empty table gives no
    rows; further columns are ignored.
    """
    voter = voter or fit(docs, labels, id_col, text_col, label_col)
    sent = docs.sparkSession.sparkContext.broadcast(voter)  # bounded by SAMPLE, LATENT and TERMS
    d = docs.select(F.col(id_col).cast("string").alias("doc_id"), _held_out(id_col).alias("held_out"), text_of(text_col).alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = sent.value
        for frame in frames:
            score = np.full(len(frame), 0.5)
            for at in range(0, len(frame) if v else 0, BLOCK):
                score[at : at + BLOCK] = v.score(np.stack([terms(t) for t in frame["t"].iloc[at : at + BLOCK]]))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "score": score, "predicted": (score >= threshold).astype(int)})

    found = d.mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
