"""Ordinals over a whole table, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import written

_LOW = (1 << 33) - 1


def with_ordinal(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """rows with their place, from 0, in the order, which should be total.

    Rows are dealt by ranges and sorted inside them, and written once with their range and their place in it: bounds of
    ranges are drawn from a sample, so two readings of an unwritten table would be dealt by different bounds. The sizes
    of the ranges, one row each, are summed up in a window and joined back by broadcast.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = written(sorted_.select("*", F.spark_partition_id().alias("_ordinal_range"), F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW)).alias("_ordinal_at")))
    before = Window.orderBy("_ordinal_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = placed.groupBy("_ordinal_range").agg(F.count(F.lit(1)).alias("_ordinal_n")).select("_ordinal_range", F.coalesce(F.sum("_ordinal_n").over(before), F.lit(0)).alias("_ordinal_base"))
    return placed.join(F.broadcast(base), "_ordinal_range").withColumn(name, F.col("_ordinal_base") + F.col("_ordinal_at")).drop("_ordinal_range", "_ordinal_at", "_ordinal_base")
