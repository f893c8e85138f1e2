"""Rewritings of all of a scorer's inputs, in the order of the evaluations.

Inputs are a dict of tables: `responses` (system_id, the columns ROW, response_id, confidence), `key` (ROW, response_id, the
assessment columns), `linking` (system_id, doc_id, frame_id, response_id) and `canonical` (doc_id, cas, cas_start, cas_end,
canon). A rewriting is a function from such a dict to another; any function of that kind may be put into a chain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framescore.functions import ident

from .align import canonicalised
from .filters import correct_up_to_inexact
from .linking import same_sets
from .pipelines import neutralise_coref_errors
from .stages import removed, written
from .transforms import broken_times_wrong, fix_lowercase_masks, implied_injuries, less_specific

Inputs = dict[str, DataFrame]
Rewriting = Callable[[Inputs], Inputs]
ROW = ["doc_id", "event_type", "role", "cas", "cas_start", "cas_end", "bf_start", "bf_end", "pj", "aaj", "realis"]


def applied(inputs: Inputs, rewritings: Iterable[Rewriting], keep: Callable[[DataFrame], DataFrame] = written) -> Inputs:
    """The inputs after all rewritings in order; the tables that one changes are written, so that plans do not grow with the
    chain, and those before them are removed. keep: writes a table, `stages.bucketed` by document where all inputs lie so;
    then nothing is shuffled."""

    def step(tables: Inputs, f: Rewriting) -> Inputs:
        new = {n: d if d is tables.get(n) else keep(d) for n, d in f(tables).items()}
        for n, d in tables.items():
            if not any(d is x for x in new.values()):
                removed(d)
        return new

    return reduce(step, rewritings, {n: keep(d) for n, d in inputs.items()})


def mapping_rule(rule: Callable[[DataFrame], DataFrame], key_too: bool = True) -> Rewriting:
    """A rewriting from a rule that makes, of the key alone, a table (response_id, new_id): responses that become the
    key's response new_id, or go if that is null. It holds for output and linking, and for the key unless key_too is off.
    A table with doc_id is of responses and new_id in one document, and is joined by document."""

    def rewriting(t: Inputs) -> Inputs:
        found = rule(t["key"])
        doc = [c for c in found.columns if c == "doc_id"]
        on = [*doc, "response_id"]
        gone = found.filter("new_id IS NULL").select(*on)
        to = found.filter("new_id IS NOT NULL").join(t["key"].select(*ROW, F.col("response_id").alias("new_id")), [*doc, "new_id"])
        drop = lambda d: d.join(gone, on, "left_anti")

        def moved(d: DataFrame) -> DataFrame:
            """d with the rows that its responses become; left joins, as a union would be shuffled."""
            there, none = to.select(*on, F.struct(*ROW).alias("_to")), gone.distinct().withColumn("_gone", F.lit(True))
            rows = d.join(there, on, "left").join(none, on, "left").filter("_to IS NOT NULL OR _gone IS NULL")
            new = [c for c in ROW if c not in doc]
            hit = [F.when(F.col("_to").isNotNull(), F.col(f"_to.{c}")).otherwise(F.col(c)).alias(c) for c in new]
            return rows.select(*[c for c in d.columns if c not in new], *hit, F.col("response_id").alias("_old"))

        key = moved(t["key"]) if key_too else t["key"].withColumn("_old", F.col("response_id"))
        return _renumbered(t | {"responses": moved(t["responses"]), "key": key, "linking": drop(t["linking"])}, key_too, doc)

    return rewriting


def _renumbered(t: Inputs, key_too: bool = True, doc: list[str] = ("doc_id",)) -> Inputs:
    """Identifiers of changed rows, which carry their old one as _old: equal responses keep the higher confidence, equal
    rows of the key the assessment of a changed row, then any other; frames that become equal merge. doc: doc_id, or
    nothing where a row's document may change."""
    new = lambda d: d.drop("response_id").withColumn("response_id", ident.response_id())
    responses, key = new(t["responses"]), new(t["key"])
    first = Window.partitionBy(*doc, "response_id").orderBy(~F.col("is_assessed"), F.col("_old") == F.col("response_id"), "_old")
    links = t["linking"].withColumnRenamed("response_id", "_old")
    for name, side in {"_r": responses, "_k": key}.items() if key_too else {"_r": responses}.items():
        links = links.join(side.select(*doc, "_old", F.col("response_id").alias(name)).distinct(), [*doc, "_old"], "left")
    links = links.select("system_id", "doc_id", "frame_id", F.explode(F.array_compact(F.array(*["_r", "_k"][: 1 + key_too]))).alias("response_id"))
    key = key.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_old")
    merged = same_sets(links.distinct(), ["system_id", "doc_id"], "frame_id", "response_id")
    responses = responses.groupBy("system_id", *ROW, "response_id").agg(F.max("confidence").alias("confidence"))
    return t | {"responses": responses, "key": key, "linking": merged}


def _changed(t: Inputs, change: Callable[[DataFrame], DataFrame]) -> Inputs:
    keep = lambda d: change(d.withColumn("_old", F.col("response_id")))
    return _renumbered(t | {"responses": keep(t["responses"]), "key": keep(t["key"])})


def all_actual(t: Inputs) -> Inputs:
    """Every realis becomes Actual, assessed ones too."""
    actual = lambda d, c: d.withColumn(c, F.when(F.col(c).isNotNull(), "Actual"))
    return _changed(t | {"key": actual(t["key"], "a_realis")}, lambda d: actual(d, "realis"))


def fixed_masks(t: Inputs) -> Inputs:
    return _changed(t, fix_lowercase_masks)


def no_broken_times(t: Inputs) -> Inputs:
    return t | {"key": broken_times_wrong(t["key"])}


def _without(t: Inputs, banned: Callable[[DataFrame], DataFrame]) -> Inputs:
    """Output, key and linking without the rows (doc_id, response_id) that `banned` finds in the key."""
    gone = banned(t["key"])
    rest = {n: t[n].join(gone, ["doc_id", "response_id"], "left_anti").select(*t[n].columns) for n in ("responses", "key", "linking")}
    return t | rest


def no_implied_injuries(t: Inputs) -> Inputs:
    keys = ["doc_id", "event_type", "role", "realis", "canon"]

    def banned(key: DataFrame) -> DataFrame:
        d = canonicalised(key, t["canonical"], "lax")
        return d.join(implied_injuries(d, keys), keys, "left_semi").select("doc_id", "response_id")

    return _without(t, banned)


def most_specific_times(t: Inputs) -> Inputs:
    on = ["doc_id", "event_type", "role", "realis", "cas"]
    return _without(t, lambda key: key.join(less_specific(key), on, "left_semi").select("doc_id", "response_id"))


def _coref_rule(key: DataFrame) -> DataFrame:
    to, gone = neutralise_coref_errors(key, key, key.filter(correct_up_to_inexact()), ["doc_id", "response_id"])
    return to.unionByName(gone.withColumn("new_id", F.lit(None).cast("string")))


neutral_coref = mapping_rule(_coref_rule, key_too=False)


def chain(year: int, neutralise_realis: bool = False, neutralise_coref: bool = False) -> list[Rewriting]:
    """The rewritings of an evaluation in order. Neutralising coreference needs neutralised realis; masks were mended in
    2014 only."""
    if neutralise_coref and not neutralise_realis:
        raise ValueError("coreference can be neutralised only where realis is")
    steps = [all_actual] * neutralise_realis + [fixed_masks] * (year == 2014)
    return [*steps, no_broken_times, no_implied_injuries, most_specific_times, *[neutral_coref] * neutralise_coref]
