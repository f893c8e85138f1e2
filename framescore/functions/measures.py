"""Arithmetic of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))


def precision_recall_f(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1; 0 where undefined."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def nist_percentile(values: Column, p: float | Column) -> Column:
    """The p-th percentile of a sorted array: between neighbours of rank p (n + 1), clamped to the ends."""
    n = F.size(values)
    rank = F.lit(p) * (n + 1)
    low = F.floor(rank).cast("int")
    at = lambda i: F.get(values, F.greatest(F.lit(0), F.least(n - 1, i)))
    return at(low - 1) + (F.least(F.greatest(rank, F.lit(1.0)), n.cast("double")) - F.greatest(F.lit(1), F.least(n, low))) * (at(low) - at(low - 1))
