"""Groupings of responses or of their classes: bridge tables (…, doc_id, frame_id, item)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescore.functions.measures import ratio

from .align import best_response
from .invariants import enforced, outside_gold


def lift(bridge: DataFrame, to_class: DataFrame | None, frame_keys: list[str]) -> DataFrame:
    """Frames of responses as frames of classes. to_class: (response_id, item), with doc_id where tables lie by document; none
    where bridge has the items."""
    items = bridge if to_class is None else bridge.join(to_class, [c for c in ("doc_id", "response_id") if c in to_class.columns])
    return items.select(*frame_keys, "item").distinct()


def lower(bridge: DataFrame, to_class: DataFrame, frame_keys: list[str]) -> DataFrame:
    """Frames of classes as frames of the responses in them."""
    return bridge.join(to_class, "item").select(*frame_keys, "response_id").distinct()


def left_incomplete(bridge: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """Classes that no frame holds."""
    return classes.select(*keys, "item").distinct().join(bridge, [*keys, "item"], "left_anti")


def same_sets(bridge: DataFrame, keys: list[str], frame: str, item: str, order: str | None = None) -> DataFrame:
    """Frames with equal members merge under the smallest id, or under the first by `order`; (*keys, frame, item)."""
    sets = bridge.groupBy(*keys, frame).agg(F.array_sort(F.collect_set(item)).alias("members"), F.min(order or frame).alias("_first"))
    named = sets.groupBy(*keys, "members").agg(F.min_by(frame, F.struct("_first", frame)).alias(frame))
    return named.select(*keys, frame, F.explode("members").alias(item))


def frame_lines(bridge: DataFrame, keys: list[str], frame: str, item: str, separator: str = " ") -> DataFrame:
    """Each frame's members, sorted and joined."""
    return bridge.groupBy(*keys, frame).agg(F.array_join(F.array_sort(F.collect_set(item)), separator).alias("members"))


def same_type_frames(responses: DataFrame) -> DataFrame:
    """The baseline: one frame for each event type of a document, over Actual and Other."""
    return responses.filter(F.col("realis").isin("Actual", "Other")).select("system_id", "doc_id", F.col("event_type").alias("frame_id"), "response_id").distinct()


def linked(responses: DataFrame, strategy: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Frames by a linking strategy: a function from responses to (system_id, doc_id, frame_id, response_id)."""
    return strategy(responses).select("system_id", "doc_id", "frame_id", "response_id").distinct()


def keep_best(responses: DataFrame, linking: DataFrame, keys: list[str]) -> DataFrame:
    """The best response of each (frame, class), and of each class among generic ones; all others go.

    responses holds the class columns keys. A response is kept if it is best in any of its frames. Generic ones are a frame
    more of the same pass, as a union would be shuffled.
    """
    own = ["system_id", "doc_id", "response_id"]
    framed = responses.join(linking.select(*own, "frame_id", F.lit(False).alias("_linked")), own, "left")
    among = F.array_compact(F.array("_linked", F.when(F.col("realis") == "Generic", True)))
    framed = framed.withColumn("_generic", F.explode(among)).withColumn("frame_id", F.when(~F.col("_generic"), F.col("frame_id")))
    return best_response(framed, ["system_id", "_generic", "frame_id", *keys]).select(*own).distinct()


def _dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows, shuffled by `by`: groups and windows by these and more columns need no further shuffle."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by) if by else rows


def link_f1(gold: DataFrame, predicted: DataFrame, systems: DataFrame | None = None, by: list[str] = ("doc_id",), strict: bool = False, lies: bool = False) -> DataFrame:
    """(system_id, *by, n_gold, n_predicted, precision, recall, link_f1) of groupings of classes; frames may overlap.

    gold: (*by, frame_id, item), with system_id if it differs between systems; predicted: (system_id, *by, frame_id, item),
    its items among gold's. systems (system_id): all submissions, where gold has none, so that one that links
    nothing gets zeros; without it, those that link anything.
    An item's neighbours are the other members of its frames. Items in one gold and one predicted frame, nearly all, take
    their counts from the sizes of the two frames and of what they share, so large frames are never expanded into pairs;
    the others expand their own neighbours only. strict: reading the scores fails where a predicted item is not gold's;
    else such items are passed over. lies: both tables are in equal buckets by some of `by` and are not shuffled again.
    """
    dealt = (lambda d, by: d) if lies else _dealt
    own = "system_id" in gold.columns
    pk, gk = ["system_id", *by], [*(["system_id"] if own else []), *by]
    g, p = gold.select(*gk, "frame_id", "item").distinct(), predicted.select(*pk, "frame_id", "item").distinct()
    counted_over = lambda d, name, *of: d.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*of)))
    gs = counted_over(counted_over(dealt(g, by), "gs", *gk, "frame_id"), "gn", *gk, "item").withColumnRenamed("frame_id", "gf")
    ps = counted_over(counted_over(dealt(p, by), "ps", *pk, "frame_id"), "pn", *pk, "item").withColumnRenamed("frame_id", "pf")
    both = counted_over(dealt(ps.join(gs, [*gk, "item"]), by), "both", *pk, "gf", "pf")
    g_one = gs.select(*gk, "item").distinct()
    simple = both.filter("gn = 1 AND pn = 1").select(*pk, "item", (F.col("both") - 1).alias("tp"), (F.col("ps") - F.col("both")).alias("fp"), (F.col("gs") - F.col("both")).alias("fn"))
    many = both.filter("NOT (gn = 1 AND pn = 1)").select(*pk, "item").distinct()

    def neighbours(bridge: DataFrame, on: list[str], flag: str) -> DataFrame:
        mine = many.join(bridge, [*on, "item"])
        other = bridge.withColumnRenamed("item", "other")
        return mine.join(other, [*on, "frame_id"]).filter("other <> item").select(*pk, "item", "other").distinct().withColumn(flag, F.lit(1))

    pairs = neighbours(g, gk, "_g").join(neighbours(p, pk, "_p"), [*pk, "item", "other"], "full")
    has = lambda c: F.col(c).isNotNull()
    counted = pairs.groupBy(*pk, "item").agg(F.sum((has("_g") & has("_p")).cast("long")).alias("tp"), F.sum((~has("_g")).cast("long")).alias("fp"), F.sum((~has("_p")).cast("long")).alias("fn"))
    counted = many.join(counted, [*pk, "item"], "left").na.fill(0, ["tp", "fp", "fn"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    alone = (tp + fp + fn) == 0
    scored = simple.unionByName(counted).select(*pk, F.when(alone, 1.0).otherwise(ratio(tp, tp + fp)).alias("p"), F.when(alone, 1.0).otherwise(ratio(tp, tp + fn)).alias("r"), F.when(alone, 1.0).otherwise(ratio(2 * tp, 2 * tp + fp + fn)).alias("f"))
    found = scored.groupBy(*pk).agg(F.count(F.lit(1)).alias("n_predicted"), F.sum("p").alias("p"), F.sum("r").alias("r"), F.sum("f").alias("f"))
    wanted = g_one.groupBy(*gk).agg(F.count(F.lit(1)).alias("n_gold"))
    if not own:
        wanted = wanted.crossJoin(F.broadcast(predicted.select("system_id").distinct() if systems is None else systems))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    scores = wanted.join(found, pk, "left").select(
        *pk, "n_gold", F.coalesce("n_predicted", F.lit(0).cast("long")).alias("n_predicted"),
        zero(F.col("p") / F.col("n_predicted")).alias("precision"), zero(F.col("r") / F.col("n_gold")).alias("recall"), zero(F.col("f") / F.col("n_gold")).alias("link_f1"),
    )
    return enforced(scores, outside_gold(gold, predicted, pk), "predicted items are gold's", strict)


def link_measures_2016(times: Column | None = None) -> dict[str, Column]:
    """Aggregates over documents' link scores: precision weighs by predicted arguments, recall and F by gold ones, and all
    three are divided by the arguments on either side, which are gold's, since the predicted ones are among them."""
    w = F.lit(1) if times is None else times
    mean = lambda c, n: F.sum(w * F.col(c) * F.col(n)) / F.sum(w * F.col("n_gold"))
    return {"link_precision": mean("precision", "n_predicted"), "link_recall": mean("recall", "n_gold"), "link_f1": mean("link_f1", "n_gold")}


def link_aggregate_2016(links: DataFrame, by: list[str]) -> DataFrame:
    return links.groupBy(*by).agg(*[c.alias(k) for k, c in link_measures_2016().items()])


def with_first(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")
