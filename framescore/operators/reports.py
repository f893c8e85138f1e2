"""Summaries over systems, annotators and the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scores import resampled

#: Assessment fields compared between annotators.
FIELDS = ("aet", "aer", "bf_ok", "cas_ok", "a_realis", "mention_type")


def confusion(pairs: DataFrame, inexact_is_correct: bool = False) -> DataFrame:
    """(field, left_label, right_label, n) over rows with l_<field> and r_<field>, both present."""
    norm = lambda c: F.when(c == "I", "C").otherwise(c) if inexact_is_correct else c
    fields = F.array(*[F.struct(F.lit(f).alias("field"), norm(F.col(f"l_{f}")).alias("left_label"), norm(F.col(f"r_{f}")).alias("right_label")) for f in FIELDS])
    long = pairs.select(F.inline(fields)).filter("left_label IS NOT NULL AND right_label IS NOT NULL")
    return long.groupBy("field", "left_label", "right_label").agg(F.count(F.lit(1)).alias("n"))


def agreement(matrix: DataFrame) -> DataFrame:
    """(field, n, accuracy) of a confusion matrix."""
    return matrix.groupBy("field").agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("left_label") == F.col("right_label"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


def annotator_pairs(left: DataFrame, right: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Responses assessed by both, without those of a baseline."""
    side = lambda d, p: d.filter("is_assessed").select("response_id", *[F.col(f).alias(f"{p}_{f}") for f in FIELDS])
    both = side(left, "l").join(side(right, "r"), "response_id")
    return both if baseline is None else both.join(baseline.select("response_id"), "response_id", "left_anti")


def overlap_counts(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """(both, left_only, right_only) of two sets of keys."""
    a, b = left.select(on).distinct().withColumn("_l", F.lit(1)), right.select(on).distinct().withColumn("_r", F.lit(1))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    l, r = F.col("_l").isNotNull(), F.col("_r").isNotNull()  # noqa: E741
    return a.join(b, on, "full").agg(count(l & r).alias("both"), count(l & ~r).alias("left_only"), count(~l & r).alias("right_only"))


def system_overlap(found: DataFrame, human: DataFrame | Column, prefix: int, item: tuple[str, ...] | list[str] = ("item",)) -> DataFrame:
    """(system_id, total, sole, with_human, other_team): an id is sole if no other team's system has it.

    found: (system_id, *item); teams are the first `prefix` characters of a system's name. human: (*item), or a condition on
    found's columns, which spares a join. Each id is grouped once, with its systems.
    """
    given = F.max(human) if isinstance(human, Column) else F.lit(False)
    d = found.groupBy(*item).agg(F.collect_set("system_id").alias("_s"), given.alias("_h"))
    if not isinstance(human, Column):
        d = d.drop("_h").join(human.select(*item).distinct().withColumn("_h", F.lit(True)), [*item], "left")
    teams = F.size(F.array_distinct(F.transform("_s", lambda x: F.substring(x, 1, prefix))))
    d = d.select(F.explode("_s").alias("system_id"), teams.alias("teams"), F.coalesce("_h", F.lit(False)).alias("h"))
    count = lambda c: F.sum(c.cast("long"))
    return d.groupBy("system_id").agg(F.count(F.lit(1)).alias("total"), count(F.col("teams") == 1).alias("sole"), count(F.col("h")).alias("with_human"), count(F.col("teams") > 1).alias("other_team"))


def found_by_teams(found: DataFrame, prefix: int, item: tuple[str, ...] | list[str] = ("item",)) -> DataFrame:
    """(teams, n): how many ids are found by how many teams. found: (system_id, *item)."""
    d = found.groupBy(*item).agg(F.size(F.collect_set(F.substring("system_id", 1, prefix))).cast("long").alias("teams"))
    return d.groupBy("teams").agg(F.count(F.lit(1)).alias("n"))


def leaderboard(scores: DataFrame, baseline: str, value: str = "score") -> DataFrame:
    """Rank of each system, and its lead over the baseline where positive. One row a system; scores are made once."""
    d = scores.withColumn("_b", F.max(F.when(F.col("system_id") == baseline, F.col(value))).over(Window.partitionBy()))
    rank = F.row_number().over(Window.orderBy(F.desc(value), "system_id"))
    return d.select("system_id", value, rank.cast("long").alias("rank"), F.when(F.col(value) > F.col("_b"), F.col(value) - F.col("_b")).alias("lead"))


def team_summary(scores: DataFrame, prefix: int, value: str = "score") -> DataFrame:
    """The best system of each team, and whether it is a median of the teams (two for an even number)."""
    best = scores.groupBy(F.substring("system_id", 1, prefix).alias("team")).agg(F.max_by("system_id", F.struct(value, "system_id")).alias("system_id"), F.max(value).alias("best"))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy("best", "team"))
    middle = (rank == F.floor((n + 1) / 2)) | (rank == F.ceil((n + 1) / 2))
    return best.select("team", "system_id", "best", (middle & (n > 3)).alias("median"))


def label_scores(matrix: DataFrame) -> DataFrame:
    """(field, label, tp, fp, fn) of each label of a confusion matrix, the left annotator taken as the key."""
    n, l, r = F.col("n"), F.col("left_label"), F.col("right_label")  # noqa: E741
    cell = lambda label, c, k: F.struct(label.alias("label"), c.alias("cell"), k.alias("k"))
    rows = F.when(l == r, F.array(cell(l, F.lit("TP"), n))).otherwise(F.array(cell(l, F.lit("FN"), n), cell(r, F.lit("FP"), n)))
    count = lambda c: F.sum(F.when(F.col("cell") == c, F.col("k")).otherwise(0)).alias(c.lower())
    return matrix.select("field", F.inline(rows)).groupBy("field", "label").agg(count("TP"), count("FP"), count("FN"))


#: Parts of the ids around a system: its own, human ones, those of other teams and of its own team's other systems.
PARTS = ("own", "own_human", "own_other", "own_human_other", "same_team", "human_other", "other", "human")


def overlap_partition(found: DataFrame, human: DataFrame, prefix: int) -> DataFrame:
    """(system_id, *PARTS): in how many of the ids that anybody found each system, humans, systems of other teams and other
    systems of its own team meet. found: (system_id, item); human: (item).

    An id is first reduced to the teams and systems that found it, so that a system's counts outside its own ids are
    differences of totals, and no system meets every id.
    """
    d = found.distinct().withColumn("team", F.substring("system_id", 1, prefix))
    h = human.select("item").distinct().withColumn("h", F.lit(True))
    by_item = d.groupBy("item").agg(F.count_distinct("team").alias("teams")).join(h, "item", "full")
    flagged = by_item.select("item", F.coalesce("teams", F.lit(0)).alias("teams"), F.coalesce("h", F.lit(False)).alias("h"))
    count = lambda c: F.sum(c.cast("long"))
    alone, many, hum = F.col("teams") == 1, F.col("teams") > 1, F.col("h")
    own = d.join(flagged, "item").groupBy("system_id", "team").agg(
        count(alone & ~hum).alias("own"), count(alone & hum).alias("own_human"), count(many & ~hum).alias("own_other"), count(many & hum).alias("own_human_other")
    )
    # by team: ids that it has, alone or with others
    team = d.select("team", "item").distinct().join(flagged, "item").groupBy("team").agg(
        count(alone & ~hum).alias("ta"), count(alone & hum).alias("tah"), count(many & ~hum).alias("tm"), count(many & hum).alias("tmh")
    )
    all_ = flagged.agg(count((F.col("teams") > 0) & ~hum).alias("o"), count((F.col("teams") > 0) & hum).alias("oh"), count((F.col("teams") == 0) & hum).alias("h0"))
    d = own.join(team, "team").crossJoin(all_)
    return d.select(
        "system_id", "own", "own_human", "own_other", "own_human_other", (F.col("ta") - F.col("own")).alias("same_team"),
        (F.col("oh") - F.col("tah") - F.col("own_human_other")).alias("human_other"), (F.col("o") - F.col("ta") - F.col("own_other")).alias("other"),
        (F.col("h0") + F.col("tah") - F.col("own_human")).alias("human"),
    )


def recall_pivot(key: DataFrame, found: DataFrame, on: list[str], systems: list[str] | None = None) -> DataFrame:
    """(*on, a_realis, cases, and for each system its realises or N, and <system>_cas, its strings): what each submission
    made of every correct class.

    key: (*on, a_realis, cas) of correct responses; found: (system_id, *on, realis, cas). A class of several assessed
    realises has a row for each. Realises and strings are sorted sets, joined by commas and by bars. systems: the columns,
    in order; without them those of the data, which are collected: submissions are few.
    """
    if systems is None:
        systems = sorted(r.system_id for r in found.select("system_id").distinct().collect())
    joined = lambda c, by: F.array_join(F.array_sort(F.collect_set(c)), by)
    right = key.groupBy(*on, "a_realis").agg(joined("cas", "|").alias("cases"))
    own = found.groupBy("system_id", *on).agg(joined("realis", ",").alias("r"), joined("cas", "|").alias("c"))
    wide = own.groupBy(*on).pivot("system_id", systems).agg(F.first("r").alias("r"), F.first("c").alias("c"))
    d = right.join(wide, on, "left")
    cells = [c for s in systems for c in (F.coalesce(F.col(f"`{s}_r`"), F.lit("N")).alias(s), F.coalesce(F.col(f"`{s}_c`"), F.lit("")).alias(f"{s}_cas"))]
    return d.select(*on, "a_realis", "cases", *cells)


def leaderboards(scores: DataFrame, by: list[str], baseline: str, value: str) -> DataFrame:
    """(*by, system_id, value, rank, lead) of each group: by type, by role; lead over the baseline only where positive."""
    base = scores.filter(F.col("system_id") == baseline).select(*by, F.col(value).alias("_b"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), "system_id"))
    lead = F.when(F.col(value) > F.col("_b"), F.col(value) - F.col("_b"))
    return scores.join(base, by, "left").select(*by, "system_id", value, rank.cast("long").alias("rank"), lead.alias("lead"))


def single_type_frames(linking: DataFrame, responses: DataFrame) -> DataFrame:
    """(event_type, n): frames all of whose responses are of one type."""
    types = linking.join(responses.select("response_id", "event_type").distinct(), "response_id").groupBy("doc_id", "frame_id").agg(F.count_distinct("event_type").alias("k"), F.min("event_type").alias("event_type"))
    return types.filter("k = 1").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def observed(alignment: DataFrame, observers: dict) -> dict[str, DataFrame]:
    """Tables of plug-in observers by name: functions from an aligned table, or from frames, to a table."""
    return {name: observer(alignment) for name, observer in observers.items()}


def results(unit_counts: DataFrame, writers: dict, drawn: DataFrame | None = None, unit: str = "doc_id") -> dict[str, DataFrame]:
    """Tables of result writers by name: functions from unit rows with a weight `times` to a table by `sample`. Plain results
    are those of one sample, 0, that has every unit once; with drawn (unit, samples) they are bootstrapped."""
    rows = unit_counts.withColumns({"sample": F.lit(0).cast("long"), "times": F.lit(1).cast("long")}) if drawn is None else resampled(unit_counts, drawn, unit)
    return {name: writer(rows) for name, writer in writers.items()}
