"""Chains of rewritings over all of a scorer's inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framescore.functions import ident
from framescore.operators import preprocess as P

KEY = "doc_id string, event_type string, role string, cas string, cas_start int, cas_end int, bf_start int, bf_end int, pj array<struct<start:int,end:int>>, aaj array<struct<start:int,end:int>>, realis string, is_assessed boolean, aet string, aer string, cas_ok string, bf_ok string, a_realis string, mention_type string, name string"
GOOD = (True, "C", "C", "C", "C")


def row(name, event="Life.Die", role="Victim", cas="x", bf=0, realis="Actual", judged=GOOD, a_realis="Actual"):
    kind = "NAME" if judged[3] else None
    return ("D", event, role, cas, 0, 5, bf, bf + 1, [(0, 9)], [], realis, *judged, a_realis if judged[3] else None, kind, name)


def inputs(spark, rows):
    key = spark.createDataFrame(rows, KEY).withColumn("response_id", ident.response_id())
    responses = key.select(F.lit("s").alias("system_id"), *P.ROW, "response_id", F.lit(0.5).alias("confidence"))
    linking = key.filter("realis <> 'Generic'").select(F.lit("s").alias("system_id"), "doc_id", F.concat(F.lit("f"), F.substring("name", 1, 1)).alias("frame_id"), "response_id")
    canonical = key.select("doc_id", "cas", "cas_start", "cas_end", F.col("cas").alias("canon")).distinct()
    return {"responses": responses, "key": key, "linking": linking, "canonical": canonical}


def left(t):
    names = {r.response_id: r.name for r in t["key"].collect()}
    return sorted(names.values()), sorted(names[r.response_id] for r in t["responses"].collect()), sorted((r.frame_id, names[r.response_id]) for r in t["linking"].collect())


def test_order_of_a_chain():
    names = lambda *a, **k: [f.__name__ for f in P.chain(*a, **k)]
    assert names(2014) == ["fixed_masks", "no_broken_times", "no_implied_injuries", "most_specific_times"]
    assert names(2015, neutralise_realis=True, neutralise_coref=True) == ["all_actual", "no_broken_times", "no_implied_injuries", "most_specific_times", "rewriting"]
    with pytest.raises(ValueError):
        P.chain(2015, neutralise_coref=True)


def test_masks_injuries_and_times(spark):
    rows = [
        row("a die", cas="e"), row("a injure", "Life.Injure", cas="e", judged=(True, "W", None, None, None)), row("b injure", "Life.Injure", cas="q"),
        row("c day", role="Time", cas="1990-05-03"), row("c month", role="Time", cas="1990-05-xx"), row("c other", role="Time", cas="1990-06-xx", bf=3), row("c broken", role="Time", cas="May", bf=4),
    ]
    t = P.applied(inputs(spark, rows), P.chain(2014))
    kept = ["a die", "b injure", "c broken", "c day", "c other"]
    assert left(t)[:2] == (kept, kept)
    by = {r.name: r for r in t["key"].collect()}
    assert by["c other"].cas == "1990-06-XX" and by["c broken"].cas_ok == "W" and by["c day"].cas_ok == "C"


def test_realis_merges_rows_and_frames(spark):
    rows = [row("a other", realis="Other", a_realis="Other", judged=(True, "C", "C", "I", "C")), row("b actual"), row("c generic", realis="Generic", bf=7, judged=(False, None, None, None, None))]
    t = P.applied(inputs(spark, rows), [P.all_actual])
    key = t["key"].collect()
    assert {(r.realis, r.a_realis, r.cas_ok) for r in key} == {("Actual", "Actual", "I"), ("Actual", None, None)}  # the replaced row's assessment prevails
    assert t["responses"].count() == 2
    assert [(r.frame_id,) for r in t["linking"].collect()] == [("fa",)]  # two frames became equal


def test_neutral_coref(spark):
    wrong = (True, "C", "C", "W", "C")
    rows = [row("a right", bf=3), row("b same filler", cas="y", bf=3, judged=wrong), row("c other filler", cas="z", bf=8, judged=wrong), row("d lost", role="Agent", cas="q", judged=wrong)]
    t = P.applied(inputs(spark, rows), [P.neutral_coref])
    ids = {r.name: r.response_id for r in t["key"].collect()}
    assert len(ids) == 4 and [r.response_id for r in t["responses"].collect()] == [ids["a right"]]
    assert {r.frame_id for r in t["linking"].collect()} == {"fa"} and {r.response_id for r in t["linking"].collect()} == {ids["a right"]}
