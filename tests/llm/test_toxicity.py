"""Toxicity: features by hand, calibration against brute force, held-out accuracy, and tables with nothing to learn from."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from framescore.llm import toxicity as t
from framescore.llm.boosting import Boosted, Isotonic

SCHEMA = "doc_id long, text string, lang string, source string, y int, fold int, x string, id string, t string, score double, predicted int, term string"
CLASH = ("en", "s", 1, 2, "x", "i", "t", 0.5, 1, "w")


def frames(spark, rows, labels):
    return spark.createDataFrame([(i, x, *CLASH) for i, x in rows], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def corpus(seed: int, n: int):
    """Clean and toxic texts in two made-up languages; one inflects its insults, so that few of their forms repeat."""
    r = random.Random(seed)
    plain = {k: ["".join(r.choice(s) for _ in range(r.randint(1, 4))) for _ in range(400)] for k, s in (("a", ["tha", "or", "en", "ing", "st"]), ("b", ["ção", "lu", "mé", "ra", "vi"]))}
    insult = {"a": lambda: r.choice(["grubbler", "snotwick", "mudbrain"]), "b": lambda: "xórgü" + r.choice(plain["b"]) + r.choice(plain["b"])}
    out = []
    for i in range(n):
        k, toxic = r.choice("ab"), r.random() < 0.25
        words = [r.choice(plain[k]) for _ in range(r.randint(30, 200))]
        if toxic:
            for _ in range(r.randint(3, 7)):
                w = insult[k]()
                words.insert(r.randrange(len(words)), "you " + r.choice([w, w.upper() + "!!", w + ",", w.capitalize()]))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_held_out_accuracy(spark):
    made = corpus(1, 900)
    docs, labels = frames(spark, [(i, x) for i, x, _ in made] + [(None, "a text"), (5000, None), (5001, ""), (5002, "w" * 30000), (3, made[3][1])], [(i, 1, y) for i, _, y in made] + [(None, 1, 1), (77777, 0, 1), (4, 1, 7), (5, 1, None)])
    got = t.score_toxicity(docs, labels).collect()
    assert len(got) == 905 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and len(r.features) == len(t.NAMES) for r in got)
    want = {i: y for i, _, y in made}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in [*want, 5000, 5001, 5002] if zlib.crc32(str(i).encode()) % 5 == 0}
    seen = [r for r in held if r.doc_id in want]
    assert sum(r.predicted == want[r.doc_id] for r in seen) >= 0.98 * len(seen)
    assert {r.predicted for r in got if r.doc_id in (5000, 5001, 5002)} == {0}
    assert sorted(map(str, got)) == sorted(map(str, t.score_toxicity(docs.repartition(7), labels.repartition(3)).collect()))  # reruns agree


def test_held_out_labels_teach_nothing(spark):
    made = corpus(2, 300)
    flip = [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in made]
    docs, labels = frames(spark, [(i, x) for i, x, _ in made], [(i, 1, y) for i, _, y in made])
    score = lambda known: sorted((r.doc_id, r.score) for r in t.score_toxicity(docs, known).collect())
    assert score(labels) == score(spark.createDataFrame(flip, labels.schema))


def test_nothing_to_learn_from(spark):
    docs, none = frames(spark, [(1, "a"), (2, None)], [])
    assert {r.score for r in t.score_toxicity(docs, none).collect()} == {0.0}
    docs, alike = frames(spark, [(k, "some words") for k in range(9)], [(k, 1, 1) for k in range(9)])
    assert {r.score for r in t.score_toxicity(docs, alike).collect()} == {1.0}
    empty, labels = frames(spark, [], [(1, 1, 1)])
    assert t.score_toxicity(empty, labels).count() == 0


def test_features_by_hand():
    x = dict(zip(t.NAMES, t.Tokens({"idiot": 9.0, "fool-": 5.5}).features("You IDIOT!! he saw the 1d10t and foolishly idiooot ok ok ok ok ok ok ok ok yes"), strict=True))
    assert x["words"] == np.log1p(18) and x["strongest"] == 9.0 and x["second"] == 1 / 18
    assert x["count_8.0"] == np.log1p(3) and x["count_5.0"] == np.log1p(4) and x["share_6.5"] == 3 / 18
    assert x["near_second"] == 0.5  # IDIOT and 1d10t stand within five words of You
    assert x["loud_hits"] == 0.25 and x["disguised_hits"] == 0.5 and x["exclamation"] == 2 / 18


def test_remembered_tokens_are_bounded(monkeypatch):
    monkeypatch.setattr(t, "KNOWN", 50)
    tokens, fresh = t.Tokens({"bad": 6.0}), t.Tokens({"bad": 6.0})
    texts = [" ".join(f"w{k}x{j}" for j in range(40)) + " bad" for k in range(30)]
    assert all((tokens.features(x) == t.Tokens({"bad": 6.0}).features(x)).all() for x in texts) and len(tokens) <= 50 + 41
    assert (fresh.features("") == 0).all() or fresh.features("")[t.NAMES.index("words")] == np.log1p(1)


@pytest.mark.parametrize("seed", range(4))
def test_isotonic_is_the_best_rising_curve(seed):
    r = np.random.default_rng(seed)
    x, y, w = r.random(40), (r.random(40) < 0.5).astype(float), r.random(40) + 0.1
    order = np.argsort(x)
    x, y, w = x[order], y[order], w[order]
    # the least-squares rising fit is max over starts of min over ends of the weighted means
    best = np.array([max(min((y[a : b + 1] @ w[a : b + 1]) / w[a : b + 1].sum() for b in range(k, 40)) for a in range(k + 1)) for k in range(40)])
    curve = Isotonic(x, y, w)
    pools = np.split(np.arange(40), np.flatnonzero(np.diff(best) > 1e-12) + 1)
    assert np.allclose(curve.y, [best[p[0]] for p in pools]) and np.allclose(curve.x, [(x[p] @ w[p]) / w[p].sum() for p in pools])
    assert (np.diff(curve(np.linspace(-1, 2, 200))) >= 0).all()


def test_boosted_trees_learn_an_interaction():
    r = np.random.default_rng(5)
    x = r.integers(0, 4, size=(3000, 4)).astype(float)
    y = ((x[:, 0] >= 2) != (x[:, 1] >= 1)).astype(float)
    assert ((Boosted(x[:2000], y[:2000]).margin(x[2000:]) > 0) == y[2000:]).mean() > 0.99
    assert np.isfinite(Boosted(np.zeros((3, 2)), np.array([0.0, 1.0, 1.0])).margin(np.ones((2, 2)))).all()
