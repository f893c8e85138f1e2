"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing
column names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescore.llm import exact_dedup, language_id, licenses, mixing, packing, private_data, quality_classifier, quality_rules, simhash, token_counts, tokens
from framescore.llm.common import WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t string, fp long, h long, name long, size long, n long, pos int, kept boolean, _id long, _times int, _copy int, _sha_of string, _sha string, row string, key string, times int, copies long, sha string"
CLASH = ("x", "y", 1, 2, 3, 4, 5, 6, True, 7, 8, 9, "z", "z", "r", "k", 1, 2, "s")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None, *CLASH) for i, t, lang, source in rows], SCHEMA)


def prose(seed: int, n: int, vocabulary: str = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon") -> str:
    r = random.Random(seed)
    words = [r.choice(vocabulary.split()) + r.choice(["", "s", "ed", "ing", "er"]) + r.choice("abcdefgh") for _ in range(n)]
    return " ".join(w + ("." if k % 9 == 8 else "") + ("\n" if k % 40 == 39 else "") for k, w in enumerate(words)) + "."


@pytest.fixture(scope="module")
def rows():
    a, b, long = prose(1, 120), prose(2, 90), prose(3, 9000)
    texts = [a, a.upper(), b, b, long, long[:-5] + "other", "", None, " \n\t", "Hi", "ÄÖ été", "ÄÖ ÉTÉ", "word " * 70, a.replace("alpha", "alpho"), "\U0001f600 x\U0001f600", a + "!", "1" * 9000, "9 " * 3000]
    out = [(k, t, ["en", "de", None][k % 3], ["s1", None, "s2", "ä"][k % 4]) for k, t in enumerate(texts)]
    out += [out[2], (None, b, "en", "s1"), (None, None, None, None), (2, "another text under a used id", "en", "s2")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("block", [7, 4096])
def test_exact_dedup(docs, rows, empty, block):
    want, groups = Counter(), defaultdict(list)
    for i, t, *_ in rows:
        groups[fold(t)].append(i)
    for i, t, *_ in rows:
        ids = groups[fold(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want[(i, keep, len(ids), keep == i, hashlib.sha256(fold(t).encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in exact_dedup.exact_duplicates(docs, block=block).collect())
    assert got == want
    assert exact_dedup.exact_duplicates(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs, block=block)
    assert kept.columns == docs.columns
    assert Counter(fold(r.text) for r in kept.collect()) == Counter(groups.keys())


def test_exact_dedup_of_repeated_rows(spark):
    long = prose(8, 3000)
    d = frame(spark, [(1, "a", "en", "s")] * 3 + [(2, long, "en", "s")] * 2 + [(3, long.upper(), "en", "s"), (4, "b", "en", "s")] * 2)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(d).collect())
    assert got == Counter({(1, 1, 3, True): 3, (2, 3, 4, False): 2, (3, 3, 4, True): 2, (4, 4, 2, True): 2})
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(d).collect()) == [1, 3, 4]


def brute_quality(t):
    w, lines = re.findall(WORD, t or ""), [x for x in (t or "").split("\n") if re.search(WORD, x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if windows[g] > 1 for j in range(3)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_rules(docs, rows, empty):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(docs).collect())
    assert got == Counter((i, *brute_quality(t)) for i, t, *_ in rows)
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_by_line(spark):
    good = prose(4, 200)
    junk = "\n".join(["home | news | contact | about us and more | shop"] * 3 + ["### $$$ %%% &&& *** word.", "Please enable javascript now."])
    d = frame(spark, [(1, good, None, None), (2, good + "\n" + junk, None, None), (3, "\n".join(prose(k, 5).replace(" ", " | ") for k in range(40)), None, None)])
    r = {x.doc_id: x for x in quality_rules.quality_rules(d).collect()}
    assert r[1].kept and r[1].n_lines_removed == 0 and r[1].clean_text == "\n".join(x for x in good.split("\n") if x.strip())
    assert r[2].kept and r[2].n_lines_removed == 5 and r[2].clean_text == r[1].clean_text
    assert not r[3].kept and not r[3].base_failed


def test_windows_that_share_a_hash(spark):
    d = spark.sql("SELECT split(w, ' ') AS w, array(7L, 7L, 7L, 7L) AS windows, n FROM VALUES ('a b c a b c', 6), ('a b c d e f', 0), ('a a a a b c', 4) AS v(w, n)")
    assert all(r.n == r.got for r in d.select("n", quality_rules._covered("windows", "w").alias("got")).collect())


def test_furniture_phrases(spark):
    lines = {"Read more.": False, "I want to read more of it.": True, "» WEITERLESEN!": False, "Please enable JavaScript now.": False, "Wir möchten weiterlesen.": True, "Suivez-nous.": False, "Accept cookies.": False, "We unaccept cookiesx.": True, "Política de privacidad.": False, "Sign in the box here.": True}
    d = frame(spark, [(k, x, None, None) for k, x in enumerate(lines)])
    assert {x.doc_id: x.n_lines_removed == 0 for x in quality_rules.quality_rules(d).collect()} == dict(enumerate(lines.values()))
    whole = frame(spark, [(1, "\n".join(lines), None, None)])
    assert quality_rules.quality_rules(whole).first().clean_text.split("\n") == [x for x, ok in lines.items() if ok]


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer
    import public_tokenizers

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs).collect()
    by_sequence, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert 0 < p.length <= 1024
        by_sequence[p.sequence_id].append((p.offset, p.length))
    last = max(by_sequence)
    assert sorted(by_sequence) == list(range(last + 1))
    for s, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or s == last
    wanted = Counter()
    for i, t, *_ in rows:
        x = np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        wanted[(i, len(x))] += 1
        documents[(i, len(x))].append(x)
    assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == wanted
    sums = {(i, a, n, zlib.crc32(x[a : a + n].tobytes())) for (i, _), xs in documents.items() for x in xs for p in pieces if p.doc_id == i and p.doc_tokens == len(x) for a, n in [(p.start, p.length)]}
    assert all((p.doc_id, p.start, p.length, p.ids_crc32) in sums for p in pieces)
    assert sum(p.length for p in pieces) == sum(n * k for (_, n), k in wanted.items())
    assert packing.pack(empty).count() == 0


def test_long_runs_are_encoded_as_by_the_reference(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [c * 3_000_000 for c in (" ", "\n", "a")] + ["x" + " \t" * 800_000 + "y <|endoftext|>"]
    want = [np.array([*reference.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for t in texts]
    d = frame(spark, [(k, t, None, None) for k, t in enumerate(texts)])
    found = defaultdict(list)
    for p in packing.pack(d).collect():
        found[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    assert {k: sorted(x) for k, x in found.items()} == {k: [(a, n, zlib.crc32(x[a : a + n].tobytes()), len(x)) for a, n, *_ in sorted(found[k])] for k, x in enumerate(want)}
    counts = Counter()
    for r in token_counts.token_counts(d).collect():
        counts[r.doc_id] += r.n_tokens
    assert counts == {k: len(x) - 1 for k, x in enumerate(want)}


def test_ids_of_a_large_vocabulary(spark, tmp_path):
    import base64

    ranks = [bytes([b]) for b in range(256)] + [b"%06d" % k for k in range(70_000)]
    path = tmp_path / "wide.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(x) + b" %d" % k for k, x in enumerate(ranks)))
    # the last rank stands for a whole text, which is one piece
    got = packing.pack(frame(spark, [(1, "069999", None, None)]), vocabulary=str(path)).collect()
    ids = tokens.encoder(str(path)).ids("069999")
    assert [(r.length, r.ids_crc32) for r in got] == [(len(ids) + 1, zlib.crc32(np.append(ids, 0).astype("<u4").tobytes()))] and max(ids) == 70_255


def test_token_counts_match_offsets(docs, rows, empty):
    from tokenizers import Tokenizer
    import public_tokenizers

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = tokens.encoder(tokens.vocabulary_path())
    for t in ("héllo  wörld\n\n\n\tx", "\U0001f600 x", prose(5, 50)):
        e = reference.encode(t, add_special_tokens=False)
        assert e.ids == enc.ids(t).tolist()
        ends = enc.byte_ends(enc.ids(t))
        assert ends[-1] == len(t.encode())
        if t.isascii():
            assert [b for _, b in e.offsets] == ends.tolist()
    got = defaultdict(list)
    for r in token_counts.token_counts(docs).collect():
        got[r.doc_id].append(r)
    for i, t, *_ in rows:
        if i not in (None, 2):
            mine = got[i]
            assert sum(r.n_tokens for r in mine) == len(reference.encode(t or "", add_special_tokens=False).ids)
            assert sorted(r.section for r in mine if r.section >= 0) == list(range((t or "").count("\n") + 1))
            for r in mine:
                if r.section >= 0:
                    assert (t or "")[r.first_char : r.end_char] == (t or "").split("\n")[r.section]
    assert token_counts.token_counts(empty).count() == 0


def test_added_tokens_in_a_text(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = tokens.encoder(tokens.vocabulary_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\n  y", "<|endoftext|", "é\n<|endoftext|>é"]
    for t in texts:
        assert enc.ids(t).tolist() == reference.encode(t, add_special_tokens=False).ids
        assert enc.byte_ends(enc.ids(t))[-1] == len(t.encode())
    d = frame(spark, [(k, t, None, None) for k, t in enumerate(texts)])
    want = {k: np.array([*reference.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for k, t in enumerate(texts)}
    assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.pack(d).collect()} == {k: (len(x), zlib.crc32(x.tobytes())) for k, x in want.items()}
    counts = Counter()
    for r in token_counts.token_counts(d).collect():
        counts[r.doc_id] += r.n_tokens
    assert counts == {k: len(x) - 1 for k, x in want.items()}


def test_token_counts_by_brute_force(spark, docs, rows):
    from tokenizers import Tokenizer
    import public_tokenizers

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {i: len(reference.id_to_token(i)) for i in range(50_257)}  # a byte is one character of a token's name
    want = Counter()
    for i, t, *_ in rows:
        text, at, spans = (t or "").encode(), 0, []
        for line in text.split(b"\n"):
            spans.append((at, at + len(line)))
            at += len(line) + 1
        n, crossing, at = Counter(), Counter(), 0
        for token in reference.encode(t or "", add_special_tokens=False).ids:
            end = at + lengths[token]
            held = [(min(b, end) - max(a, at), -k) for k, (a, b) in enumerate(spans) if min(b, end) > max(a, at)] if len(spans) < 400 else None
            assert held is not None
            k = -max(held)[1] if held else -1
            n[k] += 1
            crossing[k] += len(held) > 1
            at = end
        want.update((i, k, n[k], crossing[k]) for k in range(-1, len(spans)) if k >= 0 or n[k])
    assert Counter((r.doc_id, r.section, r.n_tokens, r.n_crossing) for r in token_counts.token_counts(docs).collect()) == want


def test_attribution_rule():
    ends = np.array([2, 5, 9, 10])  # tokens [0,2) [2,5) [5,9) [9,10)
    section, crossing = token_counts.attribute(ends, np.array([0, 4, 4, 7]), np.array([4, 4, 7, 9]))
    assert section.tolist() == [0, 0, 2, -1] and crossing.tolist() == [False, True, True, False]


def test_token_counts_of_sections(spark):
    d = spark.sql("SELECT 1 AS doc_id, 'title words body text here' AS text, array(named_struct('start', 0, 'end', 11), named_struct('start', 12, 'end', 26)) AS parts UNION ALL SELECT 2, 'abc', null")
    got = {(r.doc_id, r.section): r.n_tokens for r in token_counts.token_counts(d, sections_col="parts").collect()}
    assert got[(1, 0)] > 0 and got[(1, 1)] > 0 and (2, -1) in got


def brute_components(texts, distance=4):
    fps = [(i, simhash.fingerprint(t or "")) for i, t in texts]
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= distance:
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        x = least.get(root(k))
        least[root(k)] = i if x is None else x if i is None else min(x, i)
    return Counter((i, f"{fp:016x}", least[root(k)]) for k, (i, fp) in enumerate(fps))


def test_simhash(docs, rows, empty):
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == brute_components([(i, t) for i, t, *_ in rows])
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.fingerprint("A b  c") == simhash.fingerprint("a\tB c")


def test_near_duplicates_of_repeated_ids(spark):
    a, b = prose(11, 60), prose(12, 60)
    d = frame(spark, [(3, a, None, None), (5, a, None, None), (5, b, None, None), (5, b, None, None), (None, b, None, None), (None, None, None, None), (9, " ", None, None), (9, "", None, None)])
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    found = sorted(((r.doc_id, (r.text or "").strip()) for r in kept.collect()), key=str)
    assert found == sorted([(3, a), (5, b), (9, "")], key=str)
    assert simhash.drop_near_duplicates(d.limit(0)).count() == 0


def test_hot_keys_are_joined_without_a_shuffle(spark):
    from framescore.llm.common import spread_join

    left = spark.range(4000).selectExpr("CASE WHEN id < 3000 THEN 0 ELSE id END AS k", "id AS v")
    groups = left.groupBy("k").count().withColumn("w", F.col("k") * 2)
    got = spread_join(left, groups, ["k"], "count", 4000)
    assert Counter(tuple(r) for r in got.select("k", "v", "w").collect()) == Counter((0 if v < 3000 else v, v, 0 if v < 3000 else 2 * v) for v in range(4000))
    some = spread_join(left, groups.filter("k % 2 = 0"), ["k"], "count", 4000, "left")
    assert some.count() == 4000 and some.filter("w IS NULL").count() == 500


def test_simhash_crowded_cells(spark):
    r = np.random.default_rng(0)
    fps = {0}
    for _ in range(600):
        base = int(r.choice(list(fps))) if r.random() < 0.7 else int(r.integers(0, 1 << 63))
        for b in r.integers(0, 63, 3):
            base ^= 1 << int(b)
        fps.add(base)
    fps = sorted(fps)
    from framescore.llm.components import connected_components

    d = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {x.node: x.root for x in connected_components(simhash.links(d, cell=8)).collect()}
    a = np.array(fps, dtype=np.uint64)
    label = np.arange(len(a))
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    while True:
        after = np.where(near, label[None, :], len(a)).min(axis=1)
        if (after == label).all():
            break
        label = after
    assert [roots.get(x, x) for x in fps] == [fps[k] for k in label]


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(WORD, t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, *_ in rows)
    assert all(r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == sum((Counter({r.doc_id: r.taken // r.size}) for r in got if r.taken), Counter())
    assert mixing.mixed_documents(empty).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    open_, fixed, total = dict(order), {}, sum(n for _, n in order)
    while open_:
        unit = (total - sum(fixed.values())) / sum(weight[s] for s in open_)
        over = [s for s, n in open_.items() if unit * weight[s] > cap * n]
        if not over:
            return fixed | {s: unit * weight[s] for s in open_}
        fixed |= {s: float(cap * open_.pop(s)) for s in over}
    return fixed


def best_sum(sizes, counts, budget):
    reach = {0}
    for s, c in zip(sizes, counts, strict=True):
        reach = {x + k * s for x in reach for k in range(c + 1) if x + k * s <= budget}
    return max(reach)


def test_targets(spark):
    r = random.Random(5)
    for n in (0, 1, 3, 40):
        names = [None, "a", "Z", "ä", "\U0001f600", "\uffff"][:n] + [f"s{k}" for k in range(n - 6)]
        sizes = [(s, r.choice([0, 1, 7, 50, 1000, 10**6])) for s in names]
        got = {x.source: x.target for x in mixing.with_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        assert got == pytest.approx(brute_targets(sizes))
    t = brute_targets([("b", 10), (None, 100), ("a", 1000)])
    assert t["a"] + t["b"] + t[None] == pytest.approx(1110) and t["b"] == 30
    assert t["a"] / t[None] == pytest.approx(5)


def test_taken_is_the_best_sum_of_each_source(spark):
    r = random.Random(6)
    rows = [(k, "w " * r.choice([0, 3, 5, 11, 12, 40, 90]), "en", r.choice(["a", "a", "b", "c", None])) for k in range(90)]
    rows.append((900, "w " * 70_000, "en", "c"))
    by_source = defaultdict(list)
    for _, t, _, s in rows:
        by_source[s].append(len(t) // 2)
    goal = brute_targets([(s, sum(x)) for s, x in by_source.items()])
    taken = defaultdict(int)
    for (_, _, _, s), x in zip(rows, sorted(mixing.mix(frame(spark, rows)).collect(), key=lambda x: x.doc_id), strict=True):
        assert x.source_size == sum(by_source[s]) and x.target == pytest.approx(goal[s]) and 0 <= x.taken <= 3 * x.size
        taken[s] += x.taken
    for s, sizes in by_source.items():
        whole, rest = divmod(round(goal[s]), sum(sizes))
        assert taken[s] == whole * sum(sizes) + best_sum(sizes, [1] * len(sizes), rest)


def test_fit_is_the_best_sum(monkeypatch):
    r = np.random.default_rng(1)
    for core in (4, 64, 1 << 14):
        monkeypatch.setattr(mixing, "CORE", core)
        for _ in range(200):
            sizes = np.unique(r.integers(0, 40, 6))
            counts = r.integers(1, 5, len(sizes))
            budget = int(r.integers(0, int((sizes * counts).sum()) + 1))
            take = mixing.fit(sizes, counts, budget)
            assert ((0 <= take) & (take <= counts)).all()
            assert int((take * sizes).sum()) == best_sum(sizes.tolist(), counts.tolist(), budget)


def test_fit_of_very_long_documents():
    def taken(sizes, budget, counts=None):
        sizes = np.array(sizes)
        counts = np.ones_like(sizes) if counts is None else np.array(counts)
        take = mixing.fit(sizes, counts, budget)
        assert ((0 <= take) & (take <= counts)).all()
        return int((take * sizes).sum())

    assert taken([200000, 200001, 200002], 220000) == 200002
    assert taken(range(70000, 72000, 100), 90000) == 71900
    assert taken([0, 200001, 200002, 300000], 400003) == 400003
    assert taken([200000, 200001], 199999) == 0 and taken([70000], 70000) == 70000
    assert taken([70000, 75000], 80000) == 75000 and taken([66000, 67000], 200000, [3, 3]) == 200000
    assert taken([70000, 1], 10**9 * 70000 - 60000, [10**9, 5]) == (10**9 - 1) * 70000 + 5  # no sum comes nearer
    assert taken([70001, 70003, 70007], 10**14 + 17, [10**9] * 3) == 10**14 + 17
    r = np.random.default_rng(4)

    def best(sizes, budget):
        reach = {0}
        for s in sizes.tolist():
            reach |= {x + s for x in reach if x + s <= budget}
        return max(reach)

    cases = [(x, int(r.integers(0, 400_000))) for x in (np.unique(r.integers(66_000, 250_000, 8)) for _ in range(20))]
    assert all(taken(x, budget) == best(x, budget) for x, budget in cases if budget < x.sum())


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits)))) % 10 == 0


def brute_base(t):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(out))


def test_private_data(spark, docs, rows, empty):
    more = [
        "mail a@b.c_d@e.f and x..y@z-1.example.com, a@b", "ips 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 9.9.9", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 5 5", "call +1 (555) 010-9999 or +49 30 1234567 or +1-2",
        "é\U0001f600 q@r.st \U0001f600 10.0.0.1 token = \"49ab8b03847754d938118ecf003181de2dc09b88\" end", "ssn: 123-45-6789, phone: 555-010-9999 and order no. 1234 5678 9012", "write to jane.doe [at] mail [dot] org now", "a" * 20000 + " 1 2 3 4 5 6" * 4000,
    ]
    d = frame(spark, [*rows, *[(100 + k, t, None, None) for k, t in enumerate(more)]])
    got = private_data.find_private_data(d).collect()
    want = Counter((i, hashlib.sha256(brute_base(t).encode()).hexdigest(), *[brute_base(t).count(k + ":") for k, _ in BASE]) for i, t in [*[(i, t) for i, t, *_ in rows], *[(100 + k, t) for k, t in enumerate(more)]])
    assert Counter((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    spans = {r.doc_id: r.spans for r in got}
    assert "secret:" in spans[104] and "ssn:" in spans[105] and "phone:" in spans[105] and "email:" in spans[106]
    assert spans[105].count(":") == 4  # the order number is left alone
    assert private_data.find_private_data(empty).count() == 0
    hidden = {r.doc_id: r.text for r in private_data.redact(frame(spark, [(1, more[4], None, None), (2, "plain", None, None), (3, None, None, None)])).collect()}
    assert "q@r.st" not in hidden[1] and "49ab" not in hidden[1] and hidden[2] == "plain" and hidden[3] is None


def test_redaction_by_rows(spark):
    texts = [(None, "write to q@r.st now"), (7, "call +1 (555) 010-9999"), (7, "nothing here at all"), (7, None), (8, ""), (9, "a@b.cd 4111 1111 1111 1111\U0001f600 x@y.zz")]
    d = frame(spark, [(i, t, None, None) for i, t in texts])
    got = Counter((r.doc_id, r.text) for r in private_data.redact(d).collect())
    want = Counter()
    for i, t in texts:
        for a, b in sorted({(m.start(), m.end()) for _, p in BASE for m in re.finditer(p, t or "")} if t and i != 8 else set(), reverse=True):
            t = t[:a] + "█" * (b - a) + t[b:]
        want[(i, t)] += 1
    assert got == want
    assert private_data.redact(d.limit(0)).count() == 0


def test_boosted_trees_learn():
    r = np.random.default_rng(2)
    x = r.integers(0, 10, (600, 4)).astype(float)
    y = ((x[:, 0] > 5) & (x[:, 2] < 4)).astype(float)
    trees = private_data.boost(x, y, 15)
    margin = sum(private_data.RATE * private_data._leaf(t, x) for t in trees)
    assert ((margin > 0) == (y == 1)).mean() > 0.98


LANGS = {"en": "the of and that with for this house river light", "de": "der die und nicht mit für das haus fluß licht", "fr": "le la et que pour avec ce maison rivière lumière"}


def test_language(spark, docs, empty):
    rows = [(k, prose(k, 60, LANGS[lang]), lang, None) for k, lang in enumerate(list(LANGS) * 60)]
    rows += [(900, None, "en", None), (901, "123 !!", "de", None), (902, "", None, None), (903, "x" * 300_000, "en", None)]
    found = {r.doc_id: r for r in language_id.identify(frame(spark, rows)).collect()}
    held = [(found[k].lang_pred, lang) for k, _, lang, _ in rows if k < 900 and zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(found[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, *_ in rows)
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert [found[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in found.values())
    assert language_id.identify(empty).count() == 0
    assert language_id.identify(docs).count() == docs.count()
    kept = language_id.drop_undetermined(frame(spark, rows))
    assert Counter((r.doc_id, r.text, r.lang) for r in kept.collect()) == Counter((k, t, found[k].lang_pred) for k, t, *_ in rows if found[k].lang_pred != "und")
    assert kept.columns == docs.columns
    assert language_id.drop_undetermined(empty).count() == 0
    lettered = sum(any(c.isalpha() for c in r.text or "") for r in docs.collect())
    assert language_id.drop_undetermined(docs).count() == lettered


def test_partial_matching_is_a_distribution():
    t = language_id.Trees({"a": [b"abracadabra arcade"], "b": [b"banana bandana"]})
    for context in (b"abr", b"   ", b"zzz", b"nan"):
        before = t.bits(context)
        p = sum(2.0 ** -(t.bits(context + bytes([c])) - before) for c in range(256))
        assert (p < 1 + 1e-3).all() and (p > 0.5).all()


def brute_bits(samples, text, order=3):
    """Code length of text under the context tree of samples, symbol by symbol."""
    seen = defaultdict(Counter)
    for x in samples:
        x = b" " * order + x
        for k in range(order, len(x)):
            for n in range(order + 1):
                seen[x[k - n : k]][x[k]] += 1
    bits, y = 0.0, b" " * order + text
    for k in range(order, len(y)):
        for n in range(order, -1, -1):
            c = seen.get(y[k - n : k])
            if c and y[k] in c:
                bits -= np.log2(c[y[k]] / (sum(c.values()) + len(c)))
                break
            if c:
                bits -= np.log2(len(c) / (sum(c.values()) + len(c)))
        else:
            bits += 8.0
    return bits


def test_partial_matching_code_lengths():
    samples = {"a": [b"abracadabra arcade", b"cab"], "b": ["bañana bandana".encode(), b"x" * 40, b""], "c": [b"zz top"]}
    t = language_id.Trees(samples)
    assert language_id.Trees({"a": [b"ab"]}).bits(b"a")[0] == pytest.approx(1.0)
    for text in (b"", b"abra", b"banana arcade", "ñ\U0001f600 zz".encode(), b"top zz" * 50, bytes(range(1, 200))):
        assert t.bits(text) == pytest.approx([brute_bits(samples[k], text) for k in "abc"], rel=1e-5)
    assert (language_id.Trees(samples, max_nodes=2).bits(b"abra") > t.bits(b"abra") - 1e-6)[0]


def test_quality_classifier(spark, docs, empty):
    good = [(k, prose(k, 80), None, None) for k in range(0, 160)]
    bad = [(k, " ".join(w + "$$$ ###" for w in prose(k, 40).split()) if k % 2 else "Und " * 60, None, None) for k in range(160, 280)]
    labels = spark.createDataFrame([(k, int(k < 160), 0) for k, *_ in good + bad] + [(None, 1, 0), (5000, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    d = frame(spark, good + bad + [(990, None, None, None), (991, "", None, None)])
    found = {r.doc_id: r for r in quality_classifier.score_quality(d, labels).collect()}
    held = [(found[k].predicted, int(k < 160)) for k in range(280) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in found.values())
    assert all(found[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(280))
    assert quality_classifier.score_quality(empty, labels).count() == 0
    none = quality_classifier.score_quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_votes_by_brute_force():
    counts = np.stack([quality_classifier.terms(prose(k, 40) if k % 3 else "$$ " * k + "x " * k) for k in range(90)])
    labels = np.array([int(k % 3 > 0) for k in range(90)], dtype=float)
    v = quality_classifier.Voter(counts, labels)
    unit = lambda x: x / max(np.linalg.norm(x), 1e-9)
    for t in (prose(200, 50), "", "$$ $$ x", "und so " * 300):
        x = unit(unit(np.log1p(quality_classifier.terms(t)) * v.idf).astype(np.float32) @ v.axes)
        near = sorted(((float(x @ p), y) for p, y in zip(v.points, v.labels, strict=True)), key=lambda z: -z[0])[: quality_classifier.NEIGHBOURS]
        weight = [max(c, 0) ** quality_classifier.SHARPNESS + 1e-9 for c, _ in near]
        vote = sum(w * y for w, (_, y) in zip(weight, near, strict=True)) / sum(weight)
        assert v.score(quality_classifier.terms(t)[None])[0] == pytest.approx(1 / (1 + np.exp(-(v.curve[0] + v.curve[1] * vote))), abs=1e-3)


def test_license_margins_by_brute_force():
    m = licenses.Classifier([prose(k, 12) for k in range(60)])
    for t in ("Licensed under the Apache License, Version 2.0.", "the the license the license", "", "Nothing of it. GPL version 3"):
        w = re.findall(r"[^\W_]+", t.lower())
        grams = {tuple(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)}
        want = m.bias + sum((m.weight[i] for g, i in m.index.items() if g in grams), np.zeros(len(m.families)))
        assert m.margins(licenses.words(t)) == pytest.approx(want)
        family, p, _ = m.predict(t)
        if family != licenses.UNKNOWN:
            chances = [1 / (1 + np.exp(-(a + b * x))) for (a, b), x in zip(m.slope, want, strict=True)]
            assert m.families[int(np.argmax(chances))] == family and p == pytest.approx(max(chances))


def test_sparse_rows():
    x = licenses._Sparse([[0, 2], [], [1]], 3)
    dense = np.array([[1, 0, 1], [0, 0, 0], [0, 1, 0]], dtype=float)
    w, e = np.arange(6.0).reshape(3, 2), np.arange(6.0, 12).reshape(3, 2)
    assert (x.dot(w) == dense @ w).all() and (x.transposed_dot(e) == dense.T @ e).all()


def test_draws_do_not_depend_on_the_order_of_rows(spark, docs):
    again = docs.orderBy(F.desc("text"))
    assert licenses.fit(docs).weight.tolist() == licenses.fit(again).weight.tolist()
    a, b = language_id.fit(docs), language_id.fit(again)
    assert a.languages == b.languages and a.cost.tolist() == b.cost.tolist()


def test_licenses(spark, docs, empty):
    plain = [(k, prose(k, 80), None, None) for k in range(40)]
    marked = [(100, plain[0][1] + "\nLicensed under the Apache License, Version 2.0.", None, None), (101, "Released under the MIT License.", None, None), (102, "a\nThis work is licensed under the GNU General Public License, version 3.\nAll rights reserved.", None, None), (103, "We talked about the license to fish under the bridge.", None, None), (104, None, None, None)]
    found = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, plain + marked)).collect()}
    assert all(found[k].families == "" for k in range(40))
    assert [found[k].families for k in range(100, 105)] == ["apache", "mit", "gpl,reserved", "", ""]
    assert found[102].found[0].paragraph == 1 and found[104].n_paragraphs == 0
    assert licenses.scan_licenses(empty).count() == 0
    assert licenses.scan_licenses(docs).count() == docs.count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer
    import public_tokenizers

    rows = [(k, prose(k % 30, 60, LANGS[["en", "de", "fr"][k % 3]]), ["en", "de", "fr"][k % 3], f"s{k % 4}") for k in range(60)]
    rows += [(k, rows[k - 200][1].replace(" ", "  "), "en", "s9") for k in range(200, 204)] + [(90, "12 34", "en", "s1"), (91, None, None, None), (5, prose(77, 50, LANGS["en"]), "en", "s1"), (None, prose(78, 50, LANGS["de"]), "de", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept[name] = docs.collect()
    plain = lambda name: Counter((r.doc_id, r.text) for r in kept[name])
    lettered = [(i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or "")]
    assert plain("language") == Counter(lettered)
    groups = defaultdict(list)
    for i, t in lettered:
        groups[fold(t)].append((i is not None, i, t))
    exact = [max(g)[1:] for g in groups.values()]
    assert plain("exact_dedup") == Counter(exact)
    fps, near = [(simhash.fingerprint(t), i is None, i, t) for i, t in exact], []
    left = list(range(len(fps)))
    while left:
        group, todo = [left.pop(0)], [0]
        at = 0
        while at < len(group):
            hit = [k for k in left if (fps[k][0] ^ fps[group[at]][0]).bit_count() <= 4]
            left = [k for k in left if k not in hit]
            group += hit
            at += 1
        near.append(min((fps[k][1], fps[k][2] if fps[k][2] is not None else 0, k) for k in group)[2])
        del todo
    assert plain("near_dedup") == Counter((fps[k][2], fps[k][3]) for k in near)
    assert len(kept["near_dedup"]) < len(exact) < len(lettered)
    size = lambda t: len(re.findall(WORD, t))
    source, of = {}, defaultdict(list)
    for r in kept["near_dedup"]:
        source[(r.doc_id, r.text)] = r.source
        of[r.source].append(size(r.text))
    goal, took = brute_targets([(s, sum(x)) for s, x in of.items()]), defaultdict(int)
    for r in kept["mix"]:
        took[source[(r.doc_id, r.text)]] += size(r.text)
    for s, x in of.items():
        whole, rest = divmod(round(goal[s]), sum(x))
        assert took[s] == whole * sum(x) + best_sum(x, [1] * len(x), rest)
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in kept["mix"]:
        x = np.array([*reference.encode(r.text, add_special_tokens=False).ids, 0], dtype="<u4")
        want[(r.doc_id, len(x))] += len(x)
    got = Counter()
    for p in kept["pack"]:
        got[(p.doc_id, p.doc_tokens)] += p.length
    assert got == want
    assert sorted(p.sequence_id * 1024 + p.offset for p in kept["pack"]) == sorted(np.cumsum([0, *[p.length for p in sorted(kept["pack"], key=lambda p: (p.sequence_id, p.offset))]])[:-1].tolist())
    assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["pack"])


def test_shared_folder(spark, docs):
    from types import SimpleNamespace

    from framescore.llm import common

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_dir(cluster)
    import os

    common.materialise(docs.limit(1))
    assert os.path.isdir(common.stage_dir(spark))
    common.remove_stages(spark)
    assert not os.path.exists(common.stage_dir(spark))
