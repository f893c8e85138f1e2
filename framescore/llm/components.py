"""Connected components of a set of links, as rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, spread_join


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable; one row for each node of edges (a, b).

    Alternates large-star and small-star steps, each of which only shortens links towards the smallest neighbour, until
    every node hangs on its root. Rows never grow beyond two per link; each round is written, so a lost executor
    costs one round at most. The links of a hub, as the root of a large component becomes, stay where they are and get
    its least neighbour by broadcast.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rows = now.count()
    while True:
        both = materialise(now.union(now.select("b", "a")), 2 * rows)
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")), rows)
        met = spread_join(both, least, ["a"], "n", 2 * rows).filter("b > a")
        large = materialise(met.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), 2 * rows)
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), rows)
        met = spread_join(large, least, ["a"], "n", 2 * rows).filter("b <> m")
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = materialise(small.filter("a <> b").distinct(), 2 * rows)
        if _same(now, after):
            break
        now = after
    return after.select(F.col("a").alias("node"), F.col("b").alias("root")).union(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _same(x: DataFrame, y: DataFrame) -> bool:
    """Whether two sets of links are equal, by their size and two sums over hashes of their rows."""
    mark = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))]
    return x.agg(*mark).first() == y.agg(*mark).first()
