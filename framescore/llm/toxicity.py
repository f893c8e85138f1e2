"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learnt: of a bounded sample of labelled rows, every word and every beginning of a word (four to eight
letters, for languages that inflect and compound) gets the log odds of its documents being toxic. Features are the
densities of words of several strengths, how near they are to words of the second person, capitals, punctuation, and
how often words are disguised. Sampled documents are read with a lexicon learnt without their own fold; the margins of
trees that have not seen them calibrate the score.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, Isotonic
from .common import hash_place, materialise, text_of

FOLDS, FOLD, THRESHOLD = 5, 0, 0.5
#: Labelled rows of each class; terms of the lexicon, those of most toxic documents first.
SAMPLE, LEXICON = 6_000, 40_000
PARTS, LEAST_DOCS, LEAST_ODDS = 5, 2, 1.0
STEMS = range(4, 9)
LEVELS = (2.0, 3.5, 5.0, 6.5, 8.0)
NEAR = 5
#: Kinds of tokens a worker remembers, and characters of them.
KNOWN, KNOWN_CHARS = 500_000, 20_000_000
#: Words of the second person in the corpus's languages, and marks that stand for letters.
SECOND = frozenset("you your yours yourself yourselves ur du dich dir dein deine deinen deinem deiner euch euer eure tu te toi ton tes vous votre vos tú ti tus contigo vosotros vosotras usted ustedes".split())
_DISGUISE = str.maketrans("013457@$!€", "oieastasie")
_EDGES = re.compile(r"^[^\w@$]+|[^\w@$]+$|^_+|_+$")
_JOINTS = "-'’"
_AROUND = ".,;:!?#*%&<>|^~+=/()[]{}\"'`“”„«»¡¿…-–—"
_SYMBOLS = re.compile(r"[#*$%&@<>|^~]")
_STRETCHED = re.compile(r"(.)\1{2,}")
_FIELDS = 10  # word, strength, second person, letters, capitals, all capitals, exclamation, question, symbols, disguised
NAMES = [*(f"share_{t}" for t in LEVELS), *(f"count_{t}" for t in LEVELS), "strongest", "mean_strength", "distinct", "words", "second", "near_second", "capitals", "loud", "loud_hits", "exclamation", "question", "symbols", "disguised", "disguised_hits"]


def _terms(word: str) -> Iterator[str]:
    """The word, and its beginnings as stems."""
    yield word
    for k in STEMS:
        if len(word) > k:
            yield word[:k] + "-"


def _plain(token: str) -> tuple[str, bool]:
    """The token's letters in lower case, and whether something else stands between them."""
    core = token.strip(_AROUND)
    if core.isalpha():
        return core.lower(), False
    core = _EDGES.sub("", token)
    if core.isalpha():
        return core.lower(), False
    if not any(map(str.isalpha, core)):
        return "", False
    joined = core.lower().translate(_DISGUISE)
    letters = "".join(filter(str.isalpha, joined))
    return letters, any(not c.isalpha() and c not in _JOINTS for c in core)


def _variants(word: str) -> Iterator[str]:
    """A word without stretched letters, and without accents."""
    if _STRETCHED.search(word):
        yield _STRETCHED.sub(r"\1", word)
    if not word.isascii():
        yield "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


class Tokens(dict):
    """token -> its kind, a row of `table`, worked out when the token is first seen. Tokens alike in all fields share one."""

    def __init__(self, strength: dict[str, float]):
        super().__init__()
        self.words = {t: x for t, x in strength.items() if t[-1:] != "-"}
        self.stems = {t[:-1]: x for t, x in strength.items() if t[-1:] == "-"}
        self.heads = {t[: STEMS[0]] for t in self.stems}  # most words begin like none of them
        self.kinds: dict[tuple, int] = {}
        self.table, self.filled, self.chars = np.zeros((0, _FIELDS)), 0, 0

    def __missing__(self, token: str) -> int:
        row = self._row(token)
        at = self[token] = self.kinds.setdefault(row, len(self.kinds))
        self.chars += len(token)
        return at

    def _of(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        if word[: STEMS[0]] in self.heads:
            for k in STEMS:
                if len(word) <= k:
                    break
                found = max(found, self.stems.get(word[:k], 0.0))
        return found

    def _row(self, token: str) -> tuple:
        word, hidden = _plain(token)
        strength = self._of(word) if word else 0.0
        if word and not strength:
            for v in _variants(word):
                if v != word and (strength := self._of(v)):
                    hidden = True
                    break
        second = word in SECOND
        if token.isalpha():
            capitals = 0 if token == word else sum(map(str.isupper, token))
            return True, strength, second, len(token), capitals, len(token) > 1 and capitals == len(token), 0, 0, 0, hidden
        letters, capitals = sum(map(str.isalpha, token)), sum(map(str.isupper, token))
        return bool(word), strength, second, letters, capitals, letters > 1 and capitals == letters, token.count("!"), token.count("?"), len(_SYMBOLS.findall(token)), hidden

    def features(self, text: str) -> np.ndarray:
        """The features of a whole text."""
        if len(self) > KNOWN or self.chars > KNOWN_CHARS:
            self.clear()
            self.kinds.clear()
            self.filled = self.chars = 0
        tokens = text.split()
        at = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if self.filled < len(self.kinds):
            if len(self.table) < len(self.kinds):
                self.table = np.concatenate((self.table, np.zeros((len(self.kinds), _FIELDS))))
            self.table[self.filled : len(self.kinds)] = list(islice(self.kinds, self.filled, None))
            self.filled = len(self.kinds)
        t = self.table[at]
        words = max(1.0, t[:, 0].sum())
        s = t[:, 1]
        hits = np.flatnonzero(s >= LEVELS[1])
        second = np.flatnonzero(t[:, 2])
        near = 0.0
        if len(hits) and len(second):
            k = np.searchsorted(second, hits)
            gap = np.minimum(np.abs(second[np.minimum(k, len(second) - 1)] - hits), np.abs(hits - second[np.maximum(k - 1, 0)]))
            near = float((gap <= NEAR).mean())
        over = [float((s >= x).sum()) for x in LEVELS]
        total = t.sum(axis=0)
        of_hits = (lambda c: float(t[hits, c].mean())) if len(hits) else lambda c: 0.0
        return np.array([*(n / words for n in over), *np.log1p(over), s.max(initial=0), s.sum() / words, np.log1p(len({tokens[k].lower() for k in hits})), np.log1p(words), total[2] / words, near, total[4] / max(1.0, total[3]), total[5] / words, of_hits(5), *(total[6:10] / words), of_hits(9)])


class Model:
    """The lexicon's strengths, the trees and the calibration; `certain` instead where labels are all alike or missing."""

    def __init__(self, strength: dict[str, float], trees: Boosted | None, curve: Isotonic | None, certain: float = 0.0):
        self.strength, self.trees, self.curve, self.certain = strength, trees, curve, certain

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.certain)
        m = self.trees.margin(x)
        return 0.999 * self.curve(m) + 0.001 / (1 + np.exp(-m))  # keeps the order within a pool


def _held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == FOLD, F.lit(False))


def _strengths(counts: list[tuple[str, np.ndarray]], held: np.ndarray, without: int | None = None) -> dict[str, float]:
    """Log odds of terms from documents by class and fold, one fold left out; those of LEAST_ODDS or more."""
    use = np.ones(PARTS)
    if without is not None:
        use[without] = 0
    clean, toxic = held @ use
    if not counts or not clean or not toxic:
        return {}
    n = np.stack([c for _, c in counts]) @ use
    odds = np.log((n[:, 1] + 0.5) / (toxic - n[:, 1] + 0.5)) - np.log((n[:, 0] + 0.5) / (clean - n[:, 0] + 0.5))
    return {w: float(x) for (w, _), x, m in zip(counts, odds, n[:, 1], strict=True) if x >= LEAST_ODDS and m >= LEAST_DOCS}


def _counted(drawn: DataFrame, lexicon: int) -> list[tuple[str, np.ndarray]]:
    """(term, documents by class and fold) of terms that toxic documents have more often: at most `lexicon` of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held: dict[tuple[str, int], int] = {}
            for y, fold, text in zip(frame["y"], frame["fold"], frame["t"], strict=True):
                words = {_plain(x)[0] for x in set(text.split())}
                for term in {t for w in words if len(w) > 2 for t in _terms(w)}:
                    held[term, y * PARTS + fold] = held.get((term, y * PARTS + fold), 0) + 1
            yield pd.DataFrame({"term": pd.Series([t for t, _ in held], dtype=object), "cell": np.array([c for _, c in held], dtype=np.int64), "n": np.fromiter(held.values(), dtype=np.int64)})

    cells = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * PARTS)]
    found = drawn.select("y", "fold", "t").mapInPandas(run, "term string, cell long, n long").groupBy("term").agg(*cells)
    toxic, clean = (sum((F.col(f"c{y * PARTS + k}") for k in range(PARTS)), start=F.lit(0)) for y in (1, 0))
    found = found.filter((toxic >= LEAST_DOCS) & (toxic > 2 * clean * F.lit(1.0) * _balance(drawn)))
    return [(r[0], np.array(r[1:], dtype=float).reshape(2, PARTS)) for r in found.orderBy(toxic.desc(), "term").limit(lexicon).collect()]


def _balance(drawn: DataFrame) -> float:
    n = {r.y: r.n for r in drawn.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    return n.get(1, 0) / max(1, n.get(0, 0))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, lexicon: int = LEXICON) -> Model:
    """A model from about `sample` labelled rows of each class outside the held-out fold, drawn by hash of their ids."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~_held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).distinct()
    share = {r.y: min(1.0, sample / r.n) for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return Model({}, None, None)
    place = hash_place(13, F.col("_id").cast("string"))
    kept = known.filter(place < F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("y"))).orderBy(place, "_id", "y").limit(4 * sample)
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("t")).join(F.broadcast(kept), "_id")
    drawn = materialise(texts.select(F.col("_id").cast("string").alias("id"), "y", F.pmod(F.xxhash64(F.lit("fold"), F.col("_id").cast("string")), F.lit(PARTS)).cast("int").alias("fold"), "t"))
    counts = _counted(drawn, lexicon)
    held = np.zeros((2, PARTS))
    for r in drawn.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect():
        held[r.y, r.fold] = r.n
    if not held.sum(axis=1).all():
        return Model({}, None, None, float(held[1].sum() > 0))
    sent = docs.sparkSession.sparkContext.broadcast([_strengths(counts, held, k) for k in range(PARTS)])  # bounded by lexicon

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = [Tokens(s) for s in sent.value]
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "y": frame["y"], "fold": frame["fold"], "x": [tokens[k].features(t).tobytes() for k, t in zip(frame["fold"], frame["t"], strict=True)]})

    made = drawn.mapInPandas(run, "id string, y int, fold int, x binary")
    rows = sorted(made.orderBy(F.xxhash64("id", "x"), "id", "y").limit(8 * sample).collect(), key=lambda r: (r.id, r.y, bytes(r.x)))
    x, y, fold = np.stack([np.frombuffer(r.x) for r in rows]), np.array([r.y for r in rows], dtype=float), np.array([r.fold for r in rows])
    margin = np.zeros(len(y))
    for k in range(PARTS):
        if (fold == k).any() and (fold != k).any():
            margin[fold == k] = Boosted(x[fold != k], y[fold != k]).margin(x[fold == k])
    weight = np.where(y == 1, 1 / share.get(1, 1.0), 1 / share.get(0, 1.0))
    return Model(_strengths(counts, held), Boosted(x, y), Isotonic(margin, y, weight))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, features.

    Null text is empty, and empty texts are scored like any other. Without a labelled row every score is 0; with labels
    of one kind it is that kind. Labels other than 0 and 1 and labels of unknown documents are not used. Ids may be null
    (then never held out) or repeat; an empty table gives no rows; further columns are ignored.
    """
    model = model or fit(docs, labels, id_col, text_col, label_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LEXICON and TREES
    d = docs.select(F.col(id_col).cast("string").alias("doc_id"), _held_out(id_col).alias("held_out"), text_of(text_col).alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(sent.value.strength)
        for frame in frames:
            x = np.stack([tokens.features(t) for t in frame["t"]])
            score = np.clip(sent.value.score(x), 0, 1)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "score": score, "predicted": (score >= threshold).astype(int), "features": list(x)})

    found = d.mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int, features array<double>")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
