"""Set operations over stores of responses and of assessments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from framescore.functions import ident

from . import coref
from .invariants import enforced
from .ranks import with_ordinal


def pool(stores: DataFrame, keys: list[str]) -> DataFrame:
    """Union of several systems' responses: the highest confidence with its metadata; on a tie the first store's.

    stores: keys, response_id, confidence, metadata, store_ordinal.
    """
    first = Window.partitionBy(*keys, "response_id").orderBy(F.desc("confidence"), "store_ordinal")
    return stores.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*keys, "response_id", "confidence", "metadata")


def merge_disjoint(first: DataFrame, second: DataFrame, overwrite: bool = False, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(merged, clashing documents); with overwrite the second store replaces documents of the first. strict: reading the
    merged store fails where documents clash and are not overwritten."""
    clash = first.select("doc_id").distinct().join(second.select("doc_id").distinct(), "doc_id", "left_semi")
    kept = first.join(clash, "doc_id", "left_anti") if overwrite else first
    return enforced(kept.unionByName(second), clash, "stores have no document in common", strict and not overwrite), clash


def fresh_corpus_frames(first: DataFrame, second: DataFrame, base: int = 0x10000) -> DataFrame:
    """The second corpus linking; ids that the first uses too get new hexadecimal ones, by rank of the id."""
    clash = second.select("corpus_frame_id").distinct().join(first.select("corpus_frame_id").distinct(), "corpus_frame_id", "left_semi")
    new = with_ordinal(clash, ["corpus_frame_id"], "_o").select("corpus_frame_id", F.hex(F.lit(base + 1) + F.col("_o")).alias("new_id"))
    named = second.join(new, "corpus_frame_id", "left").withColumn("corpus_frame_id", F.coalesce("new_id", "corpus_frame_id"))
    return named.drop("new_id")


def add_unassessed(key: DataFrame, responses: DataFrame, counts: Observation | None = None) -> DataFrame:
    """(response_id, is_assessed): the key with responses that it does not hold. counts gets, in the same pass, how many
    rows the key had (`known`) and how many are new (`added`)."""
    new = responses.select("response_id").distinct().join(key.select("response_id"), "response_id", "left_anti")
    if counts is not None:
        both = key.select("response_id", "is_assessed", F.lit(0).alias("_new")).unionByName(new.select("response_id", F.lit(False).alias("is_assessed"), F.lit(1).alias("_new")))
        return both.observe(counts, F.count_if(F.col("_new") == 0).alias("known"), F.count_if(F.col("_new") == 1).alias("added")).drop("_new")
    return key.select("response_id", "is_assessed").unionByName(new.withColumn("is_assessed", F.lit(False)))


def with_fallback(key: DataFrame, fallback: DataFrame) -> DataFrame:
    """The key's assessed rows, and rows that only the fallback assesses."""
    own, other = key.filter("is_assessed"), fallback.filter("is_assessed")
    return own.unionByName(other.join(own.select("response_id"), "response_id", "left_anti"))


def merge_assessments(baseline: DataFrame, additional: DataFrame, keys: list[str] = ("response_id",)) -> DataFrame:
    """The baseline's rows win; a response stays unassessed if neither store assesses it. keys: response_id, and columns that
    follow from it by which the stores may lie already.

    A response's rows rank: the baseline's that are assessed, the additional ones that are, the baseline's, the additional.
    Those of the best rank stay; rows without an id are equal to no other, and rows of which it isn't known whether they are
    assessed are left out.
    """
    side = lambda d, n: d.withColumn("_rank", F.when(F.col("is_assessed"), n).otherwise(n + 2))
    both = side(baseline, 0).unionByName(side(additional, 1))
    best = F.min("_rank").over(Window.partitionBy(*keys))
    return both.withColumn("_best", best).filter("is_assessed IS NOT NULL AND (_rank = _best OR response_id IS NULL)").drop("_rank", "_best")


CAS = ("cas", "cas_start", "cas_end")


def merge_stores(baseline: DataFrame, additional: DataFrame, own: DataFrame, other: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, CAS, *fields, coref_id): merge_assessments with the clusters of both stores merged: the baseline's ids stay
    and the other's CASes are carried into them. own, other: (doc_id, CAS, coref_id) of the two stores; fields hold
    response_id and is_assessed."""
    cas = ["doc_id", *CAS]
    key = merge_assessments(baseline.select(*cas, *fields), additional.select(*cas, *fields), ["doc_id", "response_id"])
    return key.join(coref.merge(own, other, CAS), cas, "left").select(*cas, *fields, "coref_id")


def fallback_store(key: DataFrame, fallback: DataFrame, own: DataFrame, other: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, CAS, *fields, coref_id): with_fallback, each CAS with its cluster in the key's store, else the fallback's."""
    cas = ["doc_id", *CAS]
    rows = with_fallback(key.select(*cas, *fields), fallback.select(*cas, *fields))
    ids = lambda d, name: d.select(*cas, F.col("coref_id").alias(name))
    d = rows.join(ids(own, "_own"), cas, "left").join(ids(other, "_other"), cas, "left")
    return d.select(*cas, *fields, F.coalesce("_own", "_other").alias("coref_id"))


def merge_query_responses(stores: DataFrame, keys: list[str], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts) of query responses: union of systems, and the one assessment that is given. strict: reading the
    merged rows fails where several are given; else the first in order holds."""
    grouped = stores.groupBy(*keys).agg(F.array_sort(F.collect_set("system_id")).alias("systems"), F.array_sort(F.collect_set("assessment")).alias("given"))
    given = F.coalesce(F.get("given", F.lit(0)), F.lit("UNASSESSED"))
    if strict:
        message = F.concat(F.lit("one assessment a query response: "), F.to_json(F.struct(*keys, "given")))
        given = F.when(F.size("given") > 1, F.raise_error(message).cast("string")).otherwise(given)
    return grouped.select(*keys, F.array_join("systems", ",").alias("systems"), given.alias("assessment")), grouped.filter(F.size("given") > 1)


def import_ids(linking: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(linking under our ids, rows with unknown ids). ids: (system_id, foreign_id, response_id)."""
    joined = linking.withColumnRenamed("response_id", "foreign_id").join(ids, ["system_id", "foreign_id"], "left")
    return joined.filter("response_id IS NOT NULL").drop("foreign_id"), joined.filter("response_id IS NULL").drop("response_id")


def collapsed_frames(linking: DataFrame) -> DataFrame:
    """(system_id, doc_id, frame_id, new_id): frames with the very same responses go by the first of their ids."""
    keys = ["system_id", "doc_id"]
    sets = linking.groupBy(*keys, "frame_id").agg(F.array_sort(F.collect_set("response_id")).alias("members"))
    return sets.select(*keys, "frame_id", F.min("frame_id").over(Window.partitionBy(*keys, "members")).alias("new_id"))


def import_corpus_linking(corpus: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corpus linking under the frames' new ids, references to frames that are not there). frames: of collapsed_frames."""
    on = ["system_id", "doc_id", "frame_id"]
    d = corpus.join(frames, on, "left")
    here = d.filter("new_id IS NOT NULL").select("system_id", "corpus_frame_id", "doc_id", F.col("new_id").alias("frame_id")).distinct()
    return here, d.filter("new_id IS NULL").select(*corpus.columns)


def converted_ids(rows: DataFrame) -> DataFrame:
    """Rows of another layout under identifiers of this one; old_response_id keeps theirs."""
    return rows.withColumnRenamed("response_id", "old_response_id").withColumn("response_id", ident.response_id())


def renamed_documents(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows, of responses, assessments or coreference, under other document ids (doc_id, new_id); responses' identifiers
    follow. A document that is not renamed keeps its id."""
    d = rows.join(names.select("doc_id", F.col("new_id").alias("_new")), "doc_id", "left").withColumn("doc_id", F.coalesce("_new", "doc_id")).drop("_new")
    return d.withColumn("response_id", ident.response_id()) if "response_id" in rows.columns else d
