"""Corpus-level queries: counts and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAMMA = 0.25


def query_counts(found: DataFrame, correct: int) -> DataFrame:
    """(system_id, query_id, tp, fp, fn) with zeros for systems that answer a query with nothing.

    found: (query_id, doc_id, system_id, a), a the rank of the assessment, 0 for none; only rank `correct` is right. Both
    queries and submissions are few.
    """
    gold = found.filter(F.col("a") == correct).select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = found.filter("a > 0").groupBy("query_id", "system_id").agg(F.sum((F.col("a") == correct).cast("long")).alias("tp"), F.sum((F.col("a") != correct).cast("long")).alias("fp"))
    all_ = found.select("query_id").distinct().crossJoin(found.select("system_id").distinct())
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    d = all_.join(hits, ["query_id", "system_id"], "left").join(gold, "query_id", "left")
    return d.select("system_id", "query_id", zero("tp").alias("tp"), zero("fp").alias("fp"), (zero("n") - zero("tp")).alias("fn"))


def linear_score(counts: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """Mean over queries of the clipped, penalised share of correct answers."""
    one = F.greatest((F.col("tp") - gamma * F.col("fp")) / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)), F.lit(0.0))
    return counts.groupBy("system_id").agg(F.avg(one).alias("linear"))
