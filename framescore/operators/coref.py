"""Coreference clusters of canonical argument strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def singletons(coref: DataFrame) -> DataFrame:
    """Unclustered CASes get a cluster of their own, named by a hash of the document and the CAS."""
    own = F.concat(F.lit("s"), F.md5(F.concat_ws("|", "doc_id", "cas", F.col("cas_start").cast("string"), F.col("cas_end").cast("string"))))
    return coref.withColumn("coref_id", F.coalesce("coref_id", own))


def inconsistent(coref: DataFrame, on: list[str]) -> DataFrame:
    """CASes with several cluster ids, or both with and without one."""
    counts = coref.groupBy(*on).agg(F.count_distinct("coref_id").alias("ids"), F.max(F.col("coref_id").isNull()).alias("without"))
    return counts.filter((F.col("ids") > 1) | ((F.col("ids") > 0) & F.col("without")))


def first_id(coref: DataFrame, on: list[str], order: str) -> DataFrame:
    """The lax reading: the first id of each CAS."""
    return coref.filter("coref_id IS NOT NULL").groupBy(*on).agg(F.min_by("coref_id", order).alias("coref_id"))


def merge(baseline: DataFrame, additional: DataFrame, on: tuple[str, ...] = ("cas",)) -> DataFrame:
    """(doc_id, *on, coref_id): baseline ids stay; each further CAS joins the cluster that holds most of its clustermates
    (ties: the smaller id), else a new one, `new0`, `new1` and so on in the order of their first CASes, beyond any such id
    of the baseline's document. CASes without a cluster on either side have none.

    The CASes of a cluster that the baseline lacks all see the same clustermates, and the first to join only adds to its
    own side; so a cluster decides once, and no order has to be walked through. A CAS in several further clusters
    belongs to the first.
    All of it is one grouping by CAS and windows inside a document.
    """
    key, none = ["doc_id", *on], F.lit(None).cast("string")
    sides = baseline.select(*key, F.col("coref_id").alias("_b"), none.alias("_c")).unionByName(additional.select(*key, none.alias("_b"), F.col("coref_id").alias("_c")))
    d = sides.groupBy(*key).agg(F.min("_b").alias("_b"), F.min("_c").alias("_c"))
    cluster = Window.partitionBy("doc_id", "_c")
    mates = F.count("_b").over(Window.partitionBy("doc_id", "_c", "_b"))
    d = d.withColumn("_n", mates).withColumn("_to", F.min(F.when(F.col("_b").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_b").alias("b")))).over(cluster)["b"])
    d = d.withColumn("_f", F.min(F.struct(*on)).over(cluster))
    used = F.max(F.regexp_extract("_b", "^new([0-9]{1,17})$", 1).try_cast("long")).over(Window.partitionBy("doc_id"))
    d = d.withColumn("_u", used).withColumn("_new", F.col("_b").isNull() & F.col("_c").isNotNull() & F.col("_to").isNull())
    place = F.dense_rank().over(Window.partitionBy("doc_id", "_new").orderBy("_f")) + F.coalesce("_u", F.lit(-1))
    fresh = F.when(F.col("_new"), F.concat(F.lit("new"), place.cast("string")))
    joined = F.when(F.col("_c").isNotNull(), F.coalesce("_to", fresh))
    return d.select(*key, F.coalesce("_b", joined).alias("coref_id"))


def registered(coref: DataFrame, key: DataFrame, on: tuple[str, ...] = ("cas", "cas_start", "cas_end")) -> DataFrame:
    """coref with a cluster of its own, as `singletons` names it, for each CAS of an assessed row of the key that coref does
    not know; CASes that it knows without a cluster stay so."""
    cas = ["doc_id", *on]
    new = key.filter("is_assessed").select(*cas).distinct().join(coref.select(*cas), cas, "left_anti")
    return coref.select(*cas, "coref_id").unionByName(singletons(new.withColumn("coref_id", F.lit(None).cast("string"))).select(*cas, "coref_id"))
