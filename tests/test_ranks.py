"""Ordinals of tables larger than Spark's range sample, files in a global order, and bootstraps by arrays of draws."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framescore.operators import scores as S
from framescore.operators import stores
from framescore.operators.ranks import with_ordinal
from framescore.sources import sinks


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def keyed(spark, n: int):
    """Rows in no order, with columns that a count does not need."""
    name = F.md5(F.col("id").cast("string"))
    return spark.range(n).select(name.alias("unit"), F.repeat(name, F.lit(5)).alias("text"), (F.col("id") % 7).alias("code"), F.when(F.col("id") % 3 == 0, F.lit("note")).alias("metadata"))


@pytest.mark.parametrize("n", [4, 16, 211])
def test_ordinals_of_many_rows_with_further_columns(spark, partitions, n):
    partitions(n)
    got = with_ordinal(keyed(spark, 50_000), ["unit"], "place")
    want = sorted(hashlib.md5(str(k).encode()).hexdigest() for k in range(50_000))
    assert [(r.place, r.unit, r.text) for r in got.orderBy("place").collect()] == [(k, u, u * 5) for k, u in enumerate(want)]
    assert got.filter("code = 3").count() == got.filter("code = 3").select("place").distinct().count()  # read again, in part


def test_ordinals_by_several_columns_and_of_nothing(spark):
    d = keyed(spark, 3_000)
    got = with_ordinal(d, ["code", F.desc("unit")], "place").orderBy("place").select("code", "unit").collect()
    assert got == sorted(d.select("code", "unit").collect(), key=lambda r: (r.code, [-ord(c) for c in r.unit]))
    assert with_ordinal(d.limit(0), ["unit"], "place").count() == 0
    assert [r.place for r in with_ordinal(d.limit(1), ["unit"], "place").collect()] == [0]


def test_quote_file_of_many_documents(spark, partitions):
    partitions(16)
    regions = spark.range(40_000).select(F.concat(F.lit("D"), F.col("id") % 20_000).alias("doc_id"), (F.col("id") % 900).cast("int").alias("start"), (F.col("id") % 900 + 9).cast("int").alias("end"))
    got = sinks.quote_file(regions).orderBy("line_no").collect()
    assert [r.line_no for r in got] == list(range(40_001)) and got[0].line == "20000"
    assert [r.line for r in got[1::2]] == sorted(f"D{k}" for k in range(20_000)) and all("-" in r.line for r in got[2::2])


def test_query_store_file_of_many_responses(spark, partitions, tmp_path):
    """A line a response, after a comment line where it has metadata; the order survives writing and reading."""
    partitions(16)
    d = keyed(spark, 20_000).select(
        F.concat(F.lit("q"), "code").alias("query_id"), F.col("unit").alias("doc_id"), F.array(F.lit("b"), F.lit("a")).alias("systems"),
        F.array(F.struct(F.lit(7).alias("start"), F.lit(9).alias("end")), F.struct(F.lit(1).alias("start"), F.lit(3).alias("end"))).alias("pj"), F.when(F.col("code") == 1, "CORRECT").alias("assessment"), "metadata",
    )
    want = []
    for r in sorted(d.collect(), key=lambda r: (r.query_id, r.doc_id)):
        want += ["#note"] * (r.metadata is not None) + [f"{r.query_id}\t{r.doc_id}\ta,b\t1-3,7-9\t{r.assessment or 'UNASSESSED'}"]
    lines = sinks.query_store_file(d)
    assert [r.line for r in lines.orderBy("line_no").collect()] == want and lines.select("line_no").distinct().count() == len(want)
    sinks.write_file(lines, str(tmp_path / "store"))
    assert [x for f in sorted((tmp_path / "store").glob("part-*")) for x in f.read_text().splitlines()] == want


def test_fresh_ids_of_many_clashing_frames(spark):
    first = spark.range(9_000).select(F.concat(F.lit("c"), F.lpad("id", 6, "0")).alias("corpus_frame_id"), F.lit("d").alias("doc_id"))
    second = first.withColumn("doc_id", F.lit("e")).unionByName(spark.createDataFrame([("only", "e")], "corpus_frame_id string, doc_id string"))
    got = {r.corpus_frame_id for r in stores.fresh_corpus_frames(first, second).collect()}
    assert got == {f"{0x10001 + k:X}" for k in range(9_000)} | {"only"}


def test_resampling_equals_weighting_by_draws(spark, partitions):
    partitions(7)
    r = random.Random(4)
    rows = [(f"u{k:03}", s, r.randrange(9), r.randrange(5)) for k in range(60) for s in ("a", "b") if r.random() < 0.8]
    counts = spark.createDataFrame(rows, "unit string, system_id string, tp long, fp long")
    units = sorted({u for u, *_ in rows})
    n = len(units)
    times = Counter((b, units[int(hashlib.md5(f"5|{b}|{k}".encode()).hexdigest()[:8], 16) % n]) for b in range(1_000) for k in range(n))
    want = Counter()
    for u, s, tp, fp in rows:
        for b in range(1_000):
            want[b, s] += times[b, u] * (tp - 0.25 * fp)
    drawn = S.drawn_samples(counts.select("unit").distinct(), "unit", 1_000, seed=5)
    assert Counter({(b, x.unit): k for x in drawn.collect() for b, k in Counter(x.samples).items()}) == times
    got = S.bootstrapped(counts, drawn, "unit", ["system_id"], {"x": F.sum(F.col("times") * (F.col("tp") - 0.25 * F.col("fp")))})
    assert {(x.sample, x.system_id): x.x for x in got.collect()} == {k: v for k, v in want.items() if any(times[k[0], u] for u, s, *_ in rows if s == k[1])}


def test_draws_are_not_shuffled_one_by_one(spark):
    """One exchange of gathered arrays; the draws of a unit are spread out above the join, below the partial sums."""
    counts = keyed(spark, 500).select("unit", "code")
    drawn = S.drawn_samples(counts.select("unit").distinct(), "unit", 100)
    plan = S.bootstrapped(counts, drawn, "unit", ["code"], {"n": F.sum("times")})._jdf.queryExecution().optimizedPlan().toString()
    top = plan.index("Generate explode")
    assert plan.index("Aggregate [sample") < top < plan.index("Join Inner")


def test_draws_are_dealt_over_tasks_of_a_bounded_size(spark, monkeypatch):
    """More units make more tasks, not larger ones, which would spill."""
    import re

    monkeypatch.setattr(S, "DRAWS_A_TASK", 1_000, raising=False)
    units = spark.range(100).select(F.col("id").cast("string").alias("unit"))
    drawn = S.drawn_samples(units, "unit", 200)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Range \(0, 20000, step=1, splits=Some\(20\)\)", plan)
    assert sum(len(r.samples) for r in drawn.collect()) == 20_000
