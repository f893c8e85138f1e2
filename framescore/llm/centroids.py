"""Clusters of vectors around centroids, in exact integers, by a vantage-point tree over the centroids.

Each round the driver builds the tree over the centroids (their number and length bound it) and broadcasts it. Each
vector then searches it best-first: of the nodes whose bound it knows it opens the nearest, and it stops when the
nearest bound is beyond its best distance. A bound that equals the best distance is opened too, since an equally near
centroid with a smaller number wins. Bounds are floats with slack and only say what to skip; distances that decide are
sums of squared integers. The searches of a batch run side by side, each with its own order.

Vectors never move: a round is one scan of the written table, and only sums and counts by centroid are shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 8, 10, 64, 1024, 3
LEAF = 2
#: Bounds held at once by a batch of searches, one for each vector and node.
BOUNDS = 1 << 20
#: Components below this are summed up in 64-bit integers: 64 squared differences stay below 2**62.
EXACT = 1 << 27
SLACK = 1e-9


class Tree:
    """A vantage-point tree over the rows of centroids.

    A node is (vantage, children) or (None, members); a child is (node, least, greatest distance of its points from the
    vantage point).
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(centroids)))

    def _build(self, members: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append((None, members))
        if len(members) > LEAF:
            first, rest = members[0], members[1:]
            far = np.sqrt(squares(self.centroids[rest], self.centroids[first]).astype(float))
            order = np.argsort(far, kind="stable")
            half = len(order) // 2
            parts = [order[:half], order[half:]]
            self.nodes[at] = (first, [(self._build(np.sort(rest[p])), far[p].min(), far[p].max()) for p in parts])
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row of x, the smaller number if several are."""
        number, best = np.zeros(len(x), dtype=np.int64), squares(x, self.centroids[0])
        step = max(1, BOUNDS // len(self.nodes))
        for at in range(0, len(x), step):
            self._search(x[at : at + step], number[at : at + step], best[at : at + step])
        return number, best

    def _search(self, x: np.ndarray, number: np.ndarray, best: np.ndarray) -> None:
        rows = np.arange(len(x))  # those that still search
        bound = np.full((len(x), len(self.nodes)), np.inf)
        bound[:, self.root] = 0.0
        while len(rows):
            node = bound[rows].argmin(axis=1)
            near = np.sqrt(best[rows].astype(float))
            going = bound[rows, node] <= near * (1 + SLACK) + SLACK  # inclusive
            rows, node = rows[going], node[going]
            for k in np.unique(node):
                mine = rows[node == k]
                low, (vantage, below) = bound[mine, k], self.nodes[k]
                bound[mine, k] = np.inf
                for c in below if vantage is None else [vantage]:
                    d = squares(x[mine], self.centroids[c])
                    wins = (d < best[mine]) | ((d == best[mine]) & (c < number[mine]))
                    best[mine[wins]], number[mine[wins]] = d[wins], c
                if vantage is not None:
                    d = np.sqrt(d.astype(float))
                    for child, least, most in below:
                        bound[mine, child] = np.maximum(low, np.maximum(least - d, d - most) - SLACK * (1 + d + most))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact in either kind of integers."""
    gap = x - y
    return (gap * gap).sum(axis=1)


def integers(raw: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): 64-bit integers where all are small, else Python's own."""
    with np.errstate(over="ignore"):
        scaled = np.floor(raw * scale)
    if np.abs(scaled).max(initial=0) < EXACT:
        return scaled.astype(np.int64)
    out = np.empty(raw.shape, dtype=object)
    out.flat = [math.floor(x * scale) if abs(x) < 1e200 else int(x) * scale for x in raw.flat]
    return out


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS) -> DataFrame:
    """(id, v): vectors with exactly that many components, none null, infinite or not a number."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter((F.size("v") == components) & F.coalesce(fine, F.lit(False)))


def _rank(id_col: str, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)


def _spread(centroids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in one kind of integers: 64-bit ones only where neither has a component beyond EXACT."""
    small = x.dtype != object and all(abs(c) < EXACT for c in centroids.flat)
    return (centroids.astype(np.int64), x) if small else (centroids.astype(object), x.astype(object))


def _assigned(frame: pd.DataFrame, centroids: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c, x = _spread(centroids, integers(np.stack(frame["v"].to_list()), scale))
    return x, *Tree(c).nearest(x)


def fit(kept: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """The centroids after `rounds` rounds over a written table (id, v); fewer where there are fewer vectors.

    They start as the vectors first by hash of their id, of one id those first by value. A round that moves none ends
    the work, since all later ones would repeat it.
    """
    first = kept.orderBy(_rank("id", seed), "v").limit(clusters).collect()
    centroids = np.array([[int(c) for c in row] for row in integers(np.array([r.v for r in first], dtype=float), scale)], dtype=object)
    for _ in range(rounds if len(first) else 0):
        sent = kept.sparkSession.sparkContext.broadcast(centroids)  # bounded by clusters x components

        def run(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            sums, held = np.zeros(sent.value.shape, dtype=object), np.zeros(len(sent.value), dtype=np.int64)
            for frame in frames:
                x, number, _ = _assigned(frame, sent.value, scale)
                for c in np.unique(number):
                    mine = x[number == c]
                    sums[c] += mine.sum(axis=0).astype(object)
                    held[c] += len(mine)
            full = np.flatnonzero(held)
            if len(full):
                n = sums.shape[1]
                yield pd.DataFrame({"cluster": np.repeat(full, n), "place": np.tile(np.arange(n), len(full)), "total": [str(v) for v in sums[full].flat], "held": np.repeat(held[full], n)})

        found = kept.select("v").mapInPandas(run, "cluster int, place int, total string, held long")
        moved = centroids.copy()
        for r in found.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("held").alias("held")).collect():
            moved[r.cluster, r.place] = int(r.total) // r.held  # floors; clusters x components rows
        sent.unpersist()
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids


def assign(kept: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(id, cluster, distance): the nearest centroid and the squared distance; null where no long can hold it."""
    sent = kept.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            _, number, far = _assigned(frame, sent.value, scale)
            yield pd.DataFrame({"id": frame["id"], "cluster": number, "distance": [str(d) for d in far]})

    found = kept.withColumn("id", F.col("id").cast("string")).mapInPandas(run, "id string, cluster int, distance string")
    return found.select(F.col("id").cast(kept.schema["id"].dataType).alias("id"), "cluster", F.expr("try_cast(distance AS bigint)").alias("distance"))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid.

    Vectors of another length, or with a component that is null, infinite or not a number, are left out. Rows repeating
    an id each count, as do equal vectors; a null id is hashed as the word null. With fewer vectors than clusters there
    are as many centroids as vectors; an empty table gives no rows. Components of any size are exact, but a distance
    that no long can hold is null and left out of the sums. Further columns are ignored.
    """
    kept = materialise(kept_vectors(vectors, id_col, vector_col, components))
    centroids = fit(kept, clusters, rounds, scale, seed)
    if not len(centroids):
        centroids = np.zeros((1, components), dtype=object)
    done = materialise(assign(kept, centroids, scale))
    sums = {r.cluster: int(r.total or 0) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    names = [",".join(map(str, c)) for c in centroids]
    rows = [(k, str(sums.get(k, 0)), str(sum(sums.values())), hashlib.sha256(name.encode()).hexdigest(), name.split(",")) for k, name in enumerate(names)]
    shown = done.sparkSession.createDataFrame(rows, "cluster int, ci string, i string, centroid_sha256 string, centroid array<string>")  # one row a centroid
    fits = lambda c: F.expr(f"try_cast({c} AS bigint)")
    out = done.join(F.broadcast(shown), "cluster")
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", fits("ci").alias("cluster_inertia"), fits("i").alias("inertia"), "centroid_sha256", "centroid")
