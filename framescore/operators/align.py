"""Alignment of system output with the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescore.functions import ident

from .invariants import required


def _ranked(responses: DataFrame, by: list[str]) -> DataFrame:
    """responses with their place _n in their group."""
    group = Window.partitionBy(*by)
    peers = F.count(F.lit(1)).over(group.orderBy(F.desc("confidence")).rangeBetween(Window.currentRow, Window.currentRow))
    d = responses.withColumn("_peers", peers).withColumn("_old", F.when(F.col("_peers") > 1, ident.old_id()))
    first = F.row_number().over(group.orderBy(F.desc("confidence"), F.desc("_old"), F.desc("response_id")))
    return d.withColumn("_n", first).drop("_peers", "_old")


def best_response(responses: DataFrame, by: list[str]) -> DataFrame:
    """The most confident response of each group; of equals the one with the greater old identifier, which is worked out
    for equals only. Both windows use one shuffle."""
    return _ranked(responses, by).filter("_n = 1").drop("_n")


def canonicalised(rows: DataFrame, canonical: DataFrame, how: str = "strict") -> DataFrame:
    """rows with canon, the first CAS of their CAS's cluster. A row without a cluster fails the job (how: strict), is left
    out (optional), or keeps its own CAS (lax)."""
    on = ["doc_id", "cas", "cas_start", "cas_end"]
    own = F.concat("cas", F.lit("@"), F.col("cas_start").cast("string"), F.lit("-"), F.col("cas_end").cast("string"))
    if how not in ("strict", "optional", "lax"):
        raise ValueError(f"how must be strict, optional or lax, not {how}")
    joined = rows.join(canonical.select(*on, "canon"), on, "inner" if how == "optional" else "left")
    if how == "strict":
        return joined.withColumn("canon", required(F.col("canon"), "every CAS has a cluster", *on))
    return joined.withColumn("canon", F.coalesce("canon", own)) if how == "lax" else joined


def flagged(assessed: DataFrame, correct: DataFrame | Column) -> DataFrame:
    """assessed with `right`: correct is a condition on its columns, or a table of correct responses' ids."""
    if isinstance(correct, Column):
        return assessed.withColumn("right", F.coalesce(correct, F.lit(False)))
    ids = correct.select("response_id", F.lit(True).alias("right"))
    return assessed.join(ids, "response_id", "left").withColumn("right", F.coalesce("right", F.lit(False)))


def key_classes(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Each equivalence class of the key and whether a response of it is correct. judged: as `flagged` returns it."""
    return judged.groupBy(*keys).agg(F.max("right").alias("class_correct"))


def align(responses: DataFrame, assessed: DataFrame, correct: DataFrame | Column, keys: list[str], ids: list[str] = ("response_id",)) -> DataFrame:
    """(system_id, *keys, cell): TP, FP, FN or unassessed; a wrong best response of a correct class is FP and FN.

    responses and assessed hold the key columns; correct: as for `flagged`, a condition spares two joins. Each
    of the key's correct classes is found or missed by every submission. ids: what names a response; with doc_id among
    them, and among the keys, tables that lie by document are not shuffled.
    """
    best = best_response(responses, ["system_id", *keys]).select("system_id", *keys, "response_id")
    judged = flagged(assessed, correct)
    known = judged.select(*ids, F.lit(True).alias("known"), "right")
    best = best.join(known, [*ids], "left").select("system_id", *keys, F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("right", F.lit(False)).alias("right"), F.lit(True).alias("found"))
    classes = key_classes(judged, keys).filter("class_correct")
    wanted = classes.crossJoin(F.broadcast(responses.select("system_id").distinct()))
    both = wanted.join(best, ["system_id", *keys], "full")
    found = F.col("found").isNotNull()
    cells = (
        F.when(F.col("class_correct").isNull(), F.array(F.lit("FP")))
        .when(~found, F.array(F.lit("FN")))
        .when(F.col("right"), F.array(F.lit("TP")))
        .when(F.col("known"), F.array(F.lit("FP"), F.lit("FN")))
        .otherwise(F.array(F.lit("unassessed")))
    )
    return both.select("system_id", *keys, F.explode(cells).alias("cell"))


def cells(alignment: DataFrame, by: list[str | Column]) -> DataFrame:
    """tp, fp and fn by group; unassessed classes count as false positives."""
    count = lambda *of: F.sum(F.col("cell").isin(*of).cast("long"))
    return alignment.groupBy(*by).agg(count("TP").alias("tp"), count("FP", "unassessed").alias("fp"), count("FN").alias("fn"))


def counted(responses: DataFrame, assessed: DataFrame, correct: DataFrame | Column, keys: list[str], by: list[str], systems: DataFrame | None = None) -> DataFrame:
    """(system_id, *by, tp, fp, fn): the sums of `cells` over `align`, without a row for each class and system.

    by: some of the keys. What a submission missed is the number of the key's correct classes less those that it found
    right or answered with an unassessed response; no class is paired with a submission. Groups without a cell have no
    row. systems: (system_id), else those of the responses.
    """
    best = best_response(responses, ["system_id", *keys]).select("system_id", *keys, "response_id")
    judged = flagged(assessed, correct)
    known = judged.select("response_id", F.col("right").alias("_right"))
    classes = key_classes(judged, keys).filter("class_correct").drop("class_correct")
    own = best.join(known, "response_id", "left").join(classes.withColumn("_wanted", F.lit(True)), keys, "left")
    right, unknown = F.coalesce("_right", F.lit(False)), F.col("_right").isNull() & F.col("_wanted").isNotNull()
    count = lambda c: F.sum(c.cast("long"))
    found = own.groupBy("system_id", *by).agg(count(right).alias("tp"), count(~right).alias("fp"), count(right | unknown).alias("_met"))
    wanted = classes.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).crossJoin(responses.select("system_id").distinct() if systems is None else systems)
    both = wanted.join(found, ["system_id", *by], "full").na.fill(0, ["tp", "fp", "_met", "_n"])
    return both.select("system_id", *by, "tp", "fp", (F.col("_n") - F.col("_met")).alias("fn")).filter("tp + fp + fn > 0")


def _best_judged(judged: DataFrame, keys: list[str]) -> DataFrame:
    """The best response of each class and system, with `wanted`: whether any response of the class is right. One sort
    serves all windows, and one shuffle by any of the keys."""
    d = _ranked(judged, [*keys, "system_id"]).withColumn("wanted", F.max("right").over(Window.partitionBy(*keys)))
    return d.filter("_n = 1").select("system_id", *keys, "known", "right", "wanted")


def align_judged(judged: DataFrame, keys: list[str], systems: DataFrame) -> DataFrame:
    """`align` of responses that have their judgements, without a join: (system_id, *keys, cell).

    judged: responses of all systems with keys, known (the key assesses it) and right; rows may repeat. Every response of
    the key is among them. systems: (system_id), all submissions.
    """
    own = F.map_from_entries(F.collect_list(F.struct("system_id", F.struct("known", "right"))))
    classes = _best_judged(judged, keys).groupBy(*keys).agg(F.max("wanted").alias("wanted"), own.alias("_own"))
    d = classes.crossJoin(F.broadcast(systems)).withColumn("_r", F.col("_own")[F.col("system_id")])
    right, known, found = F.col("_r.right"), F.col("_r.known"), F.col("_r").isNotNull()
    cells = (
        F.when(~F.col("wanted"), F.when(found, F.array(F.lit("FP"))))
        .when(~found, F.array(F.lit("FN")))
        .when(right, F.array(F.lit("TP")))
        .when(known, F.array(F.lit("FP"), F.lit("FN")))
        .otherwise(F.array(F.lit("unassessed")))
    )
    return d.select("system_id", *keys, F.explode(cells).alias("cell"))


def counted_judged(judged: DataFrame, keys: list[str], by: list[str], systems: DataFrame) -> DataFrame:
    """`counted` of responses that have their judgements, without a join: (system_id, *by, tp, fp, fn). judged and systems:
    as for `align_judged`."""
    d = _best_judged(judged, keys)
    lead = F.row_number().over(Window.partitionBy(*keys).orderBy("system_id")) == 1
    right, met = F.col("right"), F.col("right") | (F.col("wanted") & ~F.col("known"))
    count = lambda c: F.sum(c.cast("long"))
    d = d.withColumn("_lead", lead & F.col("wanted"))
    found = d.groupBy("system_id", *by).agg(count(right).alias("tp"), count(~right).alias("fp"), count(met).alias("met"), count(F.col("_lead")).alias("n"))
    own = F.map_from_entries(F.collect_list(F.struct("system_id", F.struct("tp", "fp", "met"))))
    groups = found.groupBy(*by).agg(F.sum("n").alias("_n"), own.alias("_own")).crossJoin(F.broadcast(systems)).withColumn("_r", F.col("_own")[F.col("system_id")])
    zero = lambda c: F.coalesce(F.col(f"_r.{c}"), F.lit(0).cast("long"))
    return groups.select("system_id", *by, zero("tp").alias("tp"), zero("fp").alias("fp"), (F.col("_n") - zero("met")).alias("fn")).filter("tp + fp + fn > 0")


def exact_match(key: DataFrame, test: DataFrame, on: list[str]) -> DataFrame:
    """(*on, cell) of two sets of rows under full equality."""
    left = key.select(*on).distinct().withColumn("_k", F.lit(1))
    right = test.select(*on).distinct().withColumn("_t", F.lit(1))
    cell = F.when(F.col("_k").isNull(), "FP").when(F.col("_t").isNull(), "FN").otherwise("TP")
    return left.join(right, on, "full").select(*on, cell.alias("cell"))


def two_sided(left: DataFrame, right: DataFrame, key: list[str], item: str) -> DataFrame:
    """Sorted items of either side under each key, and which sides have it."""
    side = lambda d, name: d.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(item)), ",").alias(name))
    both = side(left, "left_items").join(side(right, "right_items"), key, "full")
    where = F.when(F.col("right_items").isNull(), "left").when(F.col("left_items").isNull(), "right").otherwise("both")
    return both.select(*key, F.coalesce("left_items", F.lit("")).alias("left_items"), F.coalesce("right_items", F.lit("")).alias("right_items"), where.alias("sides"))


def response_orders() -> dict[str, list]:
    """Orders of responses by name. Fillers go by their place, as they have no text here; ids by their characters."""
    return {"event": ["event_type"], "role": ["role"], "filler": ["bf_start", "bf_end"], "cas": ["cas", "cas_start", "cas_end"], "old_id": [ident.old_id()], "id": ["response_id"]}


def by_justification(responses: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, place): classes of each document by their earliest response, which is the first by its justifications in
    order, its filler, its CAS and its realis; then by the keys."""
    realis = F.when(F.col("realis") == "Actual", 0).when(F.col("realis") == "Generic", 1).otherwise(2)
    at = F.struct(F.array_sort("pj").alias("pj"), "bf_start", "bf_end", "cas_start", "cas_end", realis.alias("r"))
    first = responses.groupBy(*keys).agg(F.min(at).alias("_first"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("_first", *[k for k in keys if k != "doc_id"]))
    return first.select(*keys, place.cast("long").alias("place"))
