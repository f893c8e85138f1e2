"""Tables written between steps are planned by their rows, not by the size of their files."""

import pytest
from pyspark.sql import functions as F

from framescore.operators.stages import bucketed, written

#: Rows of few values: some kilobytes as files, some 20 MB in memory, twice what Spark broadcasts by itself.
ROWS = 300_000


@pytest.mark.parametrize("keep", [written, lambda d: bucketed(d.repartition(4, "doc_id"), 4, "doc_id")], ids=["written", "bucketed"])
def test_a_table_of_repeated_values_is_not_gathered_in_the_driver(spark, keep):
    d = spark.range(ROWS, numPartitions=4).select(F.concat(F.lit("D"), (F.col("id") % 100).cast("string")).alias("doc_id"), F.lit("Life.Die").alias("event_type"), F.lit("Victim").alias("role"))
    kept = keep(d)
    assert kept.count() == ROWS
    joined = kept.groupBy("doc_id").count().join(kept, "doc_id")
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_a_small_table_is_still_broadcast(spark):
    small = written(spark.range(10).withColumn("name", F.lit("x")))
    plan = spark.range(ROWS).join(small, "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("rows", [0, 3])
def test_rows_and_columns_come_back(spark, rows):
    d = spark.range(3).filter(F.col("id") < rows).select("id", F.when(F.col("id") == 1, "a").alias("name"), F.array(F.struct(F.lit(1).alias("start"))).alias("pj"))
    back = written(d)
    assert back.dtypes == d.dtypes
    assert sorted(back.collect()) == sorted(d.collect())
