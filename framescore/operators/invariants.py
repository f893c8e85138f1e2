"""Invariants that stop a job where they fail, checked inside its own plan.

Every operator with an invariant takes `strict`. Strict: reading its result fails with the invariant's name, how many
rows break it and the first of them. Lenient: offending rows are left as they are or left out, as the operator says, and
the violations can be had as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of an assessment that must agree where a response is assessed more than once.
ASSESSMENT = ("is_assessed", "aet", "aer", "cas_ok", "bf_ok", "a_realis", "mention_type")


def enforced(rows: DataFrame, violations: DataFrame, invariant: str, strict: bool = True) -> DataFrame:
    """rows; if strict, reading them fails where violations is not empty. Violations are reduced to one row, their number
    and the first of them in order, which is broadcast to the rows: nothing is computed before rows are read."""
    if not strict:
        return rows
    shown = F.to_json(F.struct(*[F.col(c) for c in violations.columns]))
    told = violations.select(shown.alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_first"))
    message = F.concat(F.lit(f"{invariant}: "), F.col("_n").cast("string"), F.lit(" violations, first "), F.col("_first"))
    guard = told.select(F.when(F.col("_n") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)).alias("_fine"))
    return rows.crossJoin(F.broadcast(guard)).filter("_fine").select(*rows.columns)


def required(value: Column, invariant: str, *shown: str) -> Column:
    """value; reading a row in which it is null fails, naming the row's columns `shown`."""
    return F.coalesce(value, F.raise_error(F.concat(F.lit(f"{invariant}: "), F.to_json(F.struct(*shown)))).cast("string"))


def conflicting_assessments(key: DataFrame) -> DataFrame:
    """(response_id, assessments): responses that the key assesses in different ways; equal rows are one assessment."""
    fields = [c for c in ASSESSMENT if c in key.columns]
    return key.groupBy("response_id").agg(F.count_distinct(F.struct(*fields)).alias("assessments")).filter("assessments > 1")


def one_assessment(key: DataFrame, strict: bool = True) -> DataFrame:
    """(response_id, assessment fields), one row a response. Lenient: of different ones the first in order of the fields,
    assessed ones before others."""
    fields = [c for c in ASSESSMENT if c in key.columns]
    order = F.struct((~F.col("is_assessed")).alias("_open"), *fields)
    found = key.groupBy("response_id").agg(F.min(order).alias("_a"), F.count_distinct(F.struct(*fields)).alias("_n"))
    if strict:
        wrong = F.raise_error(F.concat(F.lit("one assessment a response: "), F.col("response_id")))
        found = found.withColumn("response_id", F.when(F.col("_n") > 1, wrong).otherwise(F.col("response_id")))
    return found.select("response_id", *[F.col("_a")[c].alias(c) for c in fields])


def assessed_responses(responses: DataFrame, key: DataFrame, how: str = "inner", strict: bool = True) -> DataFrame:
    """responses with the fields of their assessment; how: inner, or left for those that the key does not hold too."""
    return responses.join(one_assessment(key, strict), "response_id", how)


def missing_from_key(responses: DataFrame, key: DataFrame) -> DataFrame:
    """(response_id): responses without an assessed row of the key."""
    return responses.select("response_id").distinct().join(key.filter("is_assessed").select("response_id"), "response_id", "left_anti")


def completely_assessed(responses: DataFrame, key: DataFrame, strict: bool = True) -> DataFrame:
    """responses, each of which the key must assess. Lenient: those that it assesses."""
    if not strict:
        return responses.join(key.filter("is_assessed").select("response_id").distinct(), "response_id", "left_semi")
    return enforced(responses, missing_from_key(responses, key), "every response is assessed")


def outside_gold(gold: DataFrame, predicted: DataFrame, by: list[str]) -> DataFrame:
    """(*by, item): predicted items that gold does not have."""
    return predicted.select(*by, "item").distinct().join(gold.select(*[c for c in by if c in gold.columns], "item").distinct(), [*[c for c in by if c in gold.columns], "item"], "left_anti")
