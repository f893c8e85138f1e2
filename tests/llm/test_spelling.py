"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from framescore.llm import spelling as s

SCHEMA = "doc_id long, text string, word string, n long, m int, part int, key string, mid string, id string, t string, root string"
CLASH = ("w", 1, 2, 3, "k", "m", "i", "t", "r")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *CLASH) for i, t in rows], SCHEMA)


def edited(w: str, alphabet: str) -> set[str]:
    cut = [(w[:k], w[k:]) for k in range(len(w) + 1)]
    out = {a + b[1:] for a, b in cut if b} | {a + c + b for a, b in cut for c in alphabet} | {a + c + b[1:] for a, b in cut if b for c in alphabet}
    return out - {w}


def counts(rows) -> Counter:
    out = Counter()
    for i, t in rows:
        for w in RUN.findall(t or ""):
            w = re.sub("[A-Z]", lambda x: x[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= 7:
                out[w] += 1
    return out


def brute(n: dict) -> set:
    alphabet = "".join(sorted(set("".join(n))))
    near = {w: [x for x in edited(w, alphabet) if x in n] for w in n}
    form = {}
    for w, xs in near.items():
        if xs:
            best = min(xs, key=lambda x: (-n[x], x))
            if n[best] >= 10 * n[w]:
                form[w] = best
    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def rows_of(df) -> set:
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def vocabulary(seed: int, n: int, alphabet: str, sizes: range) -> dict:
    r = random.Random(seed)
    out = {"".join(r.choice(alphabet) for _ in range(r.choice(sizes))): 2 for _ in range(n // 4)}
    while len(out) < n:
        w = r.choice(list(out))
        k, kind = r.randrange(len(w)), r.randrange(3)
        w = w[:k] + ("" if kind == 0 else r.choice(alphabet)) + w[k + (kind != 1) :]
        if len(w) >= 7:
            out[w] = r.choice([2, 3, 3, 30, 31, 400, 5000])
    return out


@pytest.mark.parametrize(("seed", "alphabet", "sizes", "cell"), [(1, "ab", range(7, 10), 4096), (2, "abcé", range(7, 12), 16), (3, "aÿ", range(20, 23), 7), (4, "abcdefgh", range(7, 30), 4096)])
def test_variants_of_counts(spark, seed, alphabet, sizes, cell):
    n = vocabulary(seed, 250, alphabet, sizes)
    assert rows_of(s.variants_of_counts(spark.createDataFrame(list(n.items()), "word string, n long"), cell=cell)) == brute(n)


def test_chain_of_forms_and_very_long_words(spark):
    long = "xy" * 5000
    n = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 19999, long: 3, long + "z": 40, long[:5000] + long[5001:]: 2, "z" * 7: 5}
    got = {r.word: r for r in s.variants_of_counts(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert {w: r.root for w, r in got.items() if w[0] == "a"} == dict.fromkeys(["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"], "abcdefghij") | {"abcdefghijk": "abcdefghijk"}  # the last is not ten times as frequent
    assert got[long].form == long + "z" and got[long].n_near == 2 and got[long + "z"].n_near == 1


def test_documents(spark):
    r = random.Random(9)
    base = ["particular", "Particular", "PARTICULARÉ", "étésétés", "ÉTÉSÉTÉS", "naïveté", "a×b÷cdefgh", "short", "wordword", "wordwore"]
    rows = [(k, " ".join(r.choice(base) + r.choice(["", ".", "-x", "1", "Ā", "’s", "\n"]) for _ in range(300))) for k in range(60)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (None, None), (70, ""), (71, None), (72, "\U0001f600particular\U0001f600"), (73, "particulars " * 20000)]
    n = counts(rows)
    assert len(n) > 15
    got = rows_of(s.spelling_variants(frame(spark, rows)))
    assert got == brute({w: k for w, k in n.items() if k >= 2})
    assert any(x[1] for x in got)
    assert s.spelling_variants(frame(spark, [])).count() == 0
    assert s.spelling_variants(frame(spark, [(1, None), (2, "abc")])).count() == 0


def test_counts_are_passed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(s, "HELD", 3)
    rows = [(k, "alphabet betabeta gammagam deltadel alphabet") for k in range(40)]
    assert {r.word: r.n for r in s.word_counts(frame(spark, rows)).collect()} == counts(rows)


def test_search_skips_ranges():
    """Rows are made only below ranges within one edit: of 4,096 lists of six letters a word visits few."""
    mids = sorted("".join(x) for x in np.array(np.meshgrid(*[list("abcd")] * 6)).reshape(6, -1).T)
    a, b = s._search(np.zeros(len(mids), dtype=np.int64), mids, np.arange(len(mids)))
    assert len(a) == len(mids) * 6 * 3 and all(sum(p != q for p, q in zip(mids[x], mids[y], strict=True)) == 1 for x, y in zip(a[:500], b[:500], strict=True))
