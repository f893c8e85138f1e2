"""Predicates over responses and their assessments, and the filters made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from framescore.functions.scalars import is_temporal, is_timex

FIELDS = ("aet", "aer", "cas_ok", "bf_ok")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def acceptable(field: str) -> Column:
    return _true(F.col(field).isin("C", "I"))


def correct_up_to_inexact() -> Column:
    out = _true(F.col("a_realis") == F.col("realis")) & F.col("is_assessed")
    for f in FIELDS:
        out = out & acceptable(f)
    return out


def completely_correct() -> Column:
    out = _true(F.col("a_realis") == F.col("realis")) & F.col("is_assessed")
    for f in FIELDS:
        out = out & _true(F.col(f) == "C")
    return out


def linkable_for_gold() -> Column:
    return correct_up_to_inexact() & F.col("realis").isin("Actual", "Other")


def linkable_for_system() -> Column:
    return F.col("realis").isin("Actual", "Other")


def probable_inference() -> Column:
    return (F.size("aaj") > 0) | (F.size("pj") > 1)


def filter_key(key: DataFrame, coref: DataFrame, assessed: Column, unassessed: Column) -> tuple[DataFrame, DataFrame]:
    """Rows passing the predicate of their kind, and the coreference entries of CASes that still occur."""
    kept = key.filter((F.col("is_assessed") & assessed) | (~F.col("is_assessed") & unassessed))
    on = ["doc_id", "cas", "cas_start", "cas_end"]
    return kept, coref.join(kept.select(*on).distinct(), on, "left_semi")


def valid_types_and_roles(rows: DataFrame, roles: DataFrame, always: list[str], keep: bool = True) -> DataFrame:
    """Rows whose role their type knows, or (keep=False) the others. roles: (event_type, role), an ontology."""
    types = roles.select("event_type").distinct()
    more = types.select("event_type", F.explode(F.array(*map(F.lit, always))).alias("role"))
    known = roles.select("event_type", "role").union(more).distinct()
    return rows.join(known, ["event_type", "role"], "left_semi" if keep else "left_anti")


#: Words that join several arguments in one string.
CONJUNCTIONS = ("and", "or", "both", "And", "Or")


def suspicious(key: DataFrame) -> DataFrame:
    """Correct responses that may be mistakes of assessment, with the reason."""
    joins = F.arrays_overlap(F.split("cas", " "), F.array(*map(F.lit, CONJUNCTIONS)))
    reasons = F.filter(
        F.array(
            F.when(joins, "conjunction"),
            F.when(is_temporal(F.col("role")) & ~is_timex(F.col("cas")), "invalid time"),
            F.when((F.col("role") == "Place") & (F.col("cas_ok") == "I"), "inexact place"),
        ),
        lambda x: x.isNotNull(),
    )
    return key.filter(correct_up_to_inexact()).select("*", F.explode(reasons).alias("reason"))


def restrict(key: DataFrame, docs: DataFrame, types: list[str], counts: Observation | None = None) -> DataFrame:
    """Rows of listed types in listed documents that hold no assessed row; documents left without rows are gone.

    counts gets, in the same pass, the rows of the key (`rows`), those outside the listed documents (`unlisted`), in
    listed ones with an assessed row (`assessed`), of other types in the rest (`other_type`), and those kept (`kept`).
    """
    open_docs = key.groupBy("doc_id").agg(F.max("is_assessed").alias("any")).filter("NOT any").select("doc_id")
    if counts is None:
        return key.join(docs, "doc_id", "left_semi").join(open_docs, "doc_id", "left_semi").filter(F.col("event_type").isin(*types))
    marked = key.join(docs.select("doc_id").distinct().withColumn("_l", F.lit(True)), "doc_id", "left").join(open_docs.withColumn("_o", F.lit(True)), "doc_id", "left")
    listed, open_, typed = F.col("_l").isNotNull(), F.col("_o").isNotNull(), F.coalesce(F.col("event_type").isin(*types), F.lit(False))
    why = F.when(~listed, "unlisted").when(~open_, "assessed").when(~typed, "other_type").otherwise("kept")
    marked = marked.withColumn("_why", why).observe(counts, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("_why") == w).alias(w) for w in ("unlisted", "assessed", "other_type", "kept")])
    return marked.filter("_why = 'kept'").select(*key.columns)
