"""Operators over tables that lie by document: nothing is shuffled, nothing is read or kept twice."""

import os

import pytest
from pyspark.sql import functions as F

from framescore.functions import ident
from framescore.operators import align, linking, pipelines
from framescore.operators import preprocess as P
from framescore.operators.stages import bucketed, stage_path, written
from framescore.sources import scans

CLASS = ["doc_id", "event_type", "role", "realis", "canon"]


def rows(spark):
    d = spark.range(64).select(
        F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("system_id"), F.concat(F.lit("D"), (F.col("id") % 8).cast("string")).alias("doc_id"), F.lit("Life.Die").alias("event_type"), F.lit("Victim").alias("role"),
        F.concat(F.lit("e"), (F.col("id") % 3).cast("string")).alias("cas"), F.lit(0).alias("cas_start"), F.lit(5).alias("cas_end"), F.col("id").cast("int").alias("bf_start"), (F.col("id") + 1).cast("int").alias("bf_end"),
        F.array(F.struct(F.lit(0).alias("start"), F.lit(9).alias("end"))).alias("pj"), F.array().cast("array<struct<start:int,end:int>>").alias("aaj"), F.when(F.col("id") % 5 == 0, "Generic").otherwise("Actual").alias("realis"),
        (F.col("id") / 64).alias("confidence"), F.lit("c").alias("canon"),
    )
    return bucketed(d.repartition(4, "doc_id").withColumn("response_id", ident.response_id()), 4, "doc_id")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_keep_best_is_one_pass(spark, no_broadcast):
    d = rows(spark)
    links = d.filter("realis = 'Actual' OR bf_start = 10").select("system_id", "doc_id", F.lit("f").alias("frame_id"), "response_id")
    kept = linking.keep_best(d, links, CLASS)
    assert shuffles(kept) == 0
    own = links.join(d.filter("bf_start = 10"), "response_id", "left_semi").select("system_id", "doc_id", "response_id")  # generic: best of its frame, not of its class
    best = d.groupBy("system_id", *CLASS).agg(F.max_by("response_id", "confidence").alias("response_id")).select("system_id", "doc_id", "response_id")
    assert sorted(kept.collect()) == sorted(best.union(own).collect())


def test_alignment_joins_by_document(spark, no_broadcast):
    d = rows(spark)
    judged = d.select(*CLASS, "response_id", (F.col("bf_start") % 3 == 0).alias("right")).distinct()
    near = align.align(d, judged, F.col("right"), CLASS, ["doc_id", "response_id"])
    assert shuffles(near) == 1  # the few systems
    assert sorted(near.collect()) == sorted(align.align(d, judged, F.col("right"), CLASS).collect())


def test_a_chain_keeps_its_last_tables_only(spark):
    r = rows(spark)
    judged = dict(is_assessed=F.lit(True), aet=F.lit("C"), aer=F.lit("C"), cas_ok=F.when(F.col("bf_start") % 4 == 1, "W").otherwise("C"), bf_ok=F.lit("C"), a_realis=F.col("realis"), mention_type=F.lit("NAME"))
    t = {
        "responses": r.select("system_id", *P.ROW, "response_id", "confidence"), "key": r.select(*P.ROW, "response_id").withColumns(judged),
        "linking": r.filter("realis = 'Actual'").select("system_id", "doc_id", F.lit("f").alias("frame_id"), "response_id"), "canonical": r.select("doc_id", "cas", "cas_start", "cas_end", "canon").distinct(),
    }
    folder = os.path.dirname(stage_path(spark)).removeprefix("file:")
    steps = P.chain(2015, neutralise_realis=True, neutralise_coref=True)
    before = len(os.listdir(folder))
    near = P.applied(t, steps, lambda d: bucketed(d, 4, "doc_id"))
    assert len(os.listdir(folder)) - before == 4
    far = P.applied(t, steps, written)
    for n in t:
        assert near[n].count() == far[n].count() and sorted(map(str, near[n].select(*far[n].columns).collect())) == sorted(map(str, far[n].collect()))


def test_violations_of_a_kb_are_found_in_one_pass(spark):
    made = [(":A", "type", ":T", 0.5), (":A", "type", ":U", 0.5), (":B", "type", ":T", 1.5), (":B", "mention", None, 0.5), (":C", "argument", ":D", None), (None, "type", ":T", 0.5), (None, "mention", None, 0.0), (":E", None, "x", 0.5)]
    d = written(spark.createDataFrame(made, "subject string, kind string, object string, confidence double"))
    found = pipelines.kb_violations(d)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 1
    want = [(":A", "several types"), (":A", "no mention"), (":B", "confidence out of range"), *[(s, c) for s in (":C", ":D", ":E", ":T", ":U", None) for c in ("no type", "no mention")], (None, "confidence out of range")]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_repeated_assertions_go_before_the_shuffle(spark):
    line = "\t".join((":Entity_1", "type", "PER", "0.{}00"))
    d = spark.createDataFrame([(3, line.format(3)), (1, line.format(9)), (2, line.format(1))], "line_no long, line string")
    found = scans.kb_assertions(d)
    assert [(r.line_no, r.subject, r.confidence) for r in found.collect()] == [(1, ":Entity_1", 0.9)]
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
