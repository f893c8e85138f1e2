"""Scores from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescore.functions.measures import nist_percentile, precision_recall_f, ratio

from .ranks import with_ordinal

BETA = 0.25
LAMBDA = 0.5
#: Draws that a task of `drawn_samples` sorts: some 64 bytes each.
DRAWS_A_TASK = 1 << 22


def with_f(counts: DataFrame) -> DataFrame:
    return counts.select("*", *precision_recall_f(F.col("tp"), F.col("fp"), F.col("fn")))


def breakdown(alignment: DataFrame, kinds: dict[str, Column], by: list[str] = ("system_id",)) -> DataFrame:
    """(*by, kind, key, tp, fp, fn) for several groupings in one pass."""
    from .align import cells

    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in kinds.items()])
    return cells(alignment.select(*by, "cell", F.inline(pairs)), [*by, "kind", "key"])


def argument_score_2015(doc_counts: DataFrame, beta: float = BETA) -> DataFrame:
    """Corpus argument score: documents clipped at 0, over the number of key classes; precision and recall in percent."""
    gained = F.sum(F.greatest(F.col("tp") - beta * F.col("fp"), F.lit(0.0)))
    tp, fp, wanted = F.sum("tp"), F.sum("fp"), F.sum(F.col("tp") + F.col("fn"))
    return doc_counts.groupBy("system_id").agg((100 * ratio(gained, wanted)).alias("score"), (100 * ratio(tp, tp + fp)).alias("precision"), (100 * ratio(tp, wanted)).alias("recall"))


def doc_argument_score_2015(doc_counts: DataFrame, beta: float = BETA) -> DataFrame:
    """Unclipped score of each document; scaled is null where the key has nothing."""
    raw = F.col("tp") - beta * F.col("fp")
    wanted = F.col("tp") + F.col("fn")
    return doc_counts.select("system_id", "doc_id", raw.alias("score"), F.when(wanted > 0, raw / wanted).alias("scaled"))


def linear_score_2016(doc_counts: DataFrame, beta: float = BETA, by: list[str] = ("system_id",), counts: bool = False) -> DataFrame:
    """100 times the documents' clipped scores over the key's size, 1 at least; with counts the sums of tp, fp and fn too."""
    gained = F.sum(F.greatest(F.col("tp") - beta * F.col("fp"), F.lit(0.0)))
    wanted = F.sum(F.col("tp") + F.col("fn"))
    sums = [F.sum(x).alias(x) for x in ("tp", "fp", "fn")] if counts else []
    return doc_counts.groupBy(*by).agg(*sums, (100 * gained / F.greatest(wanted, F.lit(1))).alias("linear"))


def doc_linear_score_2016(doc_counts: DataFrame, beta: float = BETA) -> DataFrame:
    gained = F.greatest(F.col("tp") - beta * F.col("fp"), F.lit(0.0))
    return doc_counts.select("system_id", "doc_id", (100 * gained / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).alias("linear"))


def what_if(counts: DataFrame) -> DataFrame:
    """Change of a system's F1 if one class had perfect precision, recall or both.

    counts: (system_id, key, tp, fp, fn), one row a class.
    """
    f = lambda tp, fp, fn: ratio(2 * tp, 2 * tp + fp + fn)
    over = lambda c: F.sum(c).over(Window.partitionBy("system_id"))
    d = counts.select("*", over("tp").alias("a"), over("fp").alias("b"), over("fn").alias("c"))
    now = f(F.col("a"), F.col("b"), F.col("c"))
    gain = lambda tp, fp, fn: f(tp, fp, fn) - now
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return d.select(
        "system_id", "key", gain(a, b - F.col("fp"), c).alias("perfect_precision"), gain(a + F.col("fn"), b, c - F.col("fn")).alias("perfect_recall"),
        gain(a + F.col("fn"), b - F.col("fp"), c - F.col("fn")).alias("perfect_both"),
    )


def drawn_samples(units: DataFrame, unit: str, samples: int, seed: int = 0) -> DataFrame:
    """(unit, samples): bootstrap samples, each of as many units as there are, drawn by a seeded hash. Each unit has the
    numbers of the samples that draw it, as often as they do; its array has about `samples` numbers.

    units: distinct units. Unit ordinals follow the units' order. The draws are a range of samples times units numbers,
    dealt over tasks of at most DRAWS_A_TASK; those of a task are gathered by unit, which sorts them in memory, before they
    are shuffled.
    """
    ranked = with_ordinal(units.select(unit), [unit], "ordinal")  # written, so counting reads it
    n = max(1, ranked.count())
    tasks = max(units.sparkSession.sparkContext.defaultParallelism, -(-samples * n // DRAWS_A_TASK))
    numbers = units.sparkSession.range(0, samples * n, 1, tasks).select(F.expr(f"CAST(id div {n} AS INT)").alias("sample"), (F.col("id") % n).alias("k"))
    hashed = F.md5(F.concat(F.lit(f"{seed}|"), F.col("sample").cast("string"), F.lit("|"), F.col("k").cast("string")))
    picked = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") % F.lit(n)
    lists = numbers.select("sample", picked.alias("ordinal")).groupBy("ordinal").agg(F.collect_list("sample").alias("samples"))
    return ranked.join(lists, "ordinal", "left").select(unit, F.coalesce("samples", F.array().cast("array<int>")).alias("samples"))


def draws(units: DataFrame, unit: str, samples: int, seed: int = 0) -> DataFrame:
    """(sample, unit, times): the same draws, one row for each sample and unit that it draws."""
    each = drawn_samples(units, unit, samples, seed).select(F.explode("samples").alias("sample"), unit).withColumn("sample", F.col("sample").cast("long"))
    return each.groupBy("sample", unit).agg(F.count(F.lit(1)).alias("times"))


def resampled(unit_counts: DataFrame, drawn: DataFrame, unit: str) -> DataFrame:
    """unit_counts with sample and times, a row for each draw of its unit. drawn: of drawn_samples.

    Units are joined once, with their arrays; a row's draws are spread out only where it lies, right before they are
    summed up, and never shuffled.
    """
    rows = unit_counts.join(drawn, unit)
    each = rows.select(*unit_counts.columns, F.explode("samples").alias("sample"))
    return each.withColumns({"sample": F.col("sample").cast("long"), "times": F.lit(1).cast("long")})


def bootstrapped(unit_counts: DataFrame, drawn: DataFrame, unit: str, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """(sample, *by, *measures) over resampled units; measures aggregate unit rows weighted by `times`. drawn: of
    drawn_samples."""
    return resampled(unit_counts, drawn, unit).groupBy("sample", *by).agg(*[c.alias(k) for k, c in measures.items()])


def percentiles(samples: DataFrame, by: list[str], value: str, points: list[float]) -> DataFrame:
    """(*by, p, value) at each point. One group holds one value a sample."""
    sorted_ = samples.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("v"))
    return sorted_.select(*by, F.inline(F.array(*[F.struct(F.lit(p).alias("p"), nist_percentile(F.col("v"), p).alias("value")) for p in points])))
