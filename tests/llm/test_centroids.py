"""Centroid clustering against brute force in Python's own integers."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from framescore.llm import centroids as c

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v array<int>, cluster string, distance string, place int, inertia long"
CLASH = ("x", [1], "k", "d", 2, 9)


def whole(x: float) -> int:
    return int(x) * 1024 if abs(x) >= 2**53 else math.floor(x * 1024)


def brute(rows, k=8, rounds=10, n=64):
    kept = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and len(v) == n and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest())
    cs = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(cs))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(cs)):
            if mine := [v for (_, v), o in zip(kept, of, strict=True) if o == j]:
                cs[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    done = [(i, *near(v)) for i, v in kept]
    sums = Counter()
    for _, d, j in done:
        sums[j] += d
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in cs]
    return Counter((i, j, d, sums[j], sum(sums.values()), sha[j]) for i, d, j in done)


def got(df):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def vectors(seed: int, n: int, grid: bool = False):
    r = random.Random(seed)
    draw = (lambda: r.choice([-1.0, 0.0, 0.5])) if grid else (lambda: float(np.float32(r.gauss(0, 0.2))))
    return [(k, [draw() for _ in range(64)]) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, *CLASH) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("grid", [False, True])
def test_clusters_as_brute_force(spark, grid):
    rows = vectors(1, 150, grid)
    rows += [(3, rows[7][1]), (None, rows[9][1]), (900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [])]
    rows += [(1000 + k, rows[0][1]) for k in range(60)]  # a hot vector
    assert got(c.cluster(frame(spark, rows))) == brute(rows)


def test_few_vectors_and_none(spark):
    rows = vectors(2, 3)
    assert got(c.cluster(frame(spark, rows))) == brute(rows)
    assert c.cluster(frame(spark, [])).count() == 0
    assert c.cluster(frame(spark, [(1, [0.0]), (2, None)])).count() == 0


def test_components_beyond_64_bits(spark):
    """An outlier keeps all others exact; a distance that no long holds is null."""
    rows = vectors(3, 40) + [(500, [1e30] + [0.0] * 63), (501, [-2.0**20] * 64)]
    found = {r.vec_id: r for r in c.cluster(frame(spark, rows)).collect()}
    want = {k[0]: k for k in brute(rows)}
    assert {i: r.cluster for i, r in found.items()} == {i: w[1] for i, w in want.items()}
    assert all(r.distance == (want[i][2] if want[i][2] < 2**63 else None) for i, r in found.items())


@pytest.mark.parametrize("k", [1, 2, 3, 17, 300])
def test_tree_finds_the_smallest_number_among_the_nearest(k):
    r = np.random.default_rng(k)
    points = r.integers(-3, 4, size=(k, 5))  # many equal distances and equal centroids
    x = r.integers(-4, 5, size=(400, 5))
    all_ = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
    number, best = c.Tree(points).nearest(x)
    assert (number == all_.argmin(axis=1)).all() and (best == all_.min(axis=1)).all()
    number, best = c.Tree(points.astype(object) * 10**12).nearest(x.astype(object) * 10**12)
    assert (number == all_.argmin(axis=1)).all() and (best == all_.min(axis=1).astype(object) * 10**24).all()


def test_tree_skips_nodes():
    """Centroids far apart: a search opens a small part of the nodes."""
    points = np.arange(256)[:, None] * 1000 * np.ones((1, 4), dtype=np.int64)
    tree, opened = c.Tree(points), 0
    real = c.squares

    def counted(x, y):
        nonlocal opened
        opened += len(x)
        return real(x, y)

    c.squares = counted
    try:
        number, _ = tree.nearest(points + 3)
    finally:
        c.squares = real
    assert (number == np.arange(256)).all() and opened < 256 * 40
