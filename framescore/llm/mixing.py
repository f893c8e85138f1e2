"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact size. A source whose target is r sizes and a rest takes r whole copies; for the rest, an
even share over all sizes and then a bounded-knapsack dynamic programme say how many documents of each size are taken
once more, so that no other choice comes nearer to the target from below. Which ones is settled by a seeded hash, so
reruns agree.

Sources are a table like any other: their weights come from a distributed ordinal, their targets from a few rounds of one
aggregation. A source's fit needs one row per distinct size and runs in its own task, so its group is bounded by the
longest document. Choosing k of a group's documents ranks them inside hash buckets, so that a group holding a third of
all rows is spread over many tasks.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, boxed, materialise, text_of, unboxed

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 7
#: Hash buckets of a (source, size) group.
BUCKETS = 1024
#: Words that the first dynamic programme may give back; each next one WIDER times as many, up to the whole budget.
CORE = 1 << 14
WIDER = 8


def with_targets(sources: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sources (source, source_size) with their target: the total shared by weight, none above cap times its size, the
    excess shared anew. Sources by code point, null last, take the weights in turn.

    The share of one weight only grows from round to round, so the capped sources of a round stay capped, and a round
    needs no more than two sums.
    """
    void = F.col("source").isNull()
    ranged = sources.repartitionByRange(void, F.col("source")).sortWithinPartitions(void, "source")
    ranged = materialise(ranged.withColumn("place", F.monotonically_increasing_id()))
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("base"))  # one row a partition
    placed = ranged.withColumn("part", part).join(parts, "part")
    turn = ((F.col("base") + within) % len(weights) + 1).cast("int")
    weighed = materialise(placed.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn).alias("weight")))
    total, weight = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    unit, held = total / weight if weight else 0.0, 0
    while True:
        over = F.lit(unit) * F.col("weight") > cap * F.col("source_size")
        n, capped, weight = weighed.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == held or not weight:
            return weighed.select("source", "source_size", F.when(over, cap * F.col("source_size")).otherwise(F.lit(unit) * F.col("weight")).cast("double").alias("target"))
        unit, held = (total - cap * capped) / weight, n


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take for the greatest sum within budget: bounded knapsack over reachable sums, counts in
    binary parts. Each reachable sum keeps the step that reached it first, so memory follows the number of sums."""
    take, steps = counts * 0, []
    reach, first = np.zeros(1, dtype=np.int64), np.full(1, -1, dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        n, part = int(min(counts[i], budget // sizes[i])) if sizes[i] else 0, 1
        while n > 0 and reach[-1] < budget:
            part = min(part, n)
            new = reach + part * int(sizes[i])
            new = new[new <= budget]
            new = new[reach[np.searchsorted(reach, new).clip(max=len(reach) - 1)] != new]
            order = np.argsort(np.concatenate((reach, new)), kind="stable")
            reach = np.concatenate((reach, new))[order]
            first = np.concatenate((first, np.full(len(new), len(steps))))[order]
            steps.append((int(i), part))
            n, part = n - part, part * 2
        if reach[-1] == budget:
            break
    at = int(reach[-1])
    while at:
        i, part = steps[first[np.searchsorted(reach, at)]]
        take[i] += part
        at -= part * int(sizes[i])
    return take


def residues(sizes: np.ndarray, counts: np.ndarray, base: int) -> tuple[np.ndarray, list]:
    """For each remainder by base the step of `steps` (size number, copies) that first reached it, -1 for 0 and -2 where no
    choice of documents has it."""
    first, steps = np.full(base, -2, dtype=np.int64), []
    first[0] = -1
    for i, (s, n) in enumerate(zip(sizes.tolist(), np.minimum(counts, base).tolist(), strict=True)):
        part = 1
        while n > 0 and (first == -2).any():
            part = min(part, n)
            first[(first == -2) & np.roll(first > -2, part * s % base)] = len(steps)
            steps.append((i, part))
            n, part = n - part, part * 2
    return first, steps


def by_remainder(sizes: np.ndarray, counts: np.ndarray, even: np.ndarray, budget: int, pivot: int) -> tuple[int, np.ndarray | None]:
    """(goal, choice): the greatest number within budget whose remainder by the pivot's size is that of a reachable sum, and
    a choice with that sum: the even share, more of other sizes for the remainder, and as many of the pivot's as fit."""
    base, other = int(sizes[pivot]), np.flatnonzero(np.arange(len(sizes)) != pivot)
    first, _ = residues(sizes[other], counts[other], base)
    goal = next(x for x in range(budget, budget - base, -1) if first[x % base] > -2)
    found = even.copy()
    found[pivot] = 0
    first, steps = residues(sizes[other], (counts - even)[other], base)
    at = (goal - int((found * sizes).sum())) % base
    if first[at] == -2:
        return goal, None
    while at:
        i, part = steps[first[at]]
        found[other[i]] += part
        at = (at - part * int(sizes[other[i]])) % base
    found[pivot] = (goal - int((found * sizes).sum())) // base
    return goal, found if 0 <= found[pivot] <= counts[pivot] else None


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that their sizes add up to the greatest sum within budget.

    An even share over the sizes is taken; some of it, from the shortest documents on, is then given back, and the exact
    dynamic programme over these and the documents not taken fills the budget again. If that falls short, the remainders
    of reachable sums by the commonest sizes bound the sum from above and may give a choice that reaches the bound. Else
    ever more is given back, until nothing is left: then the programme was over all documents and the whole budget.
    """
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    real = np.flatnonzero((sizes > 0) & (counts > 0))
    take = counts * 0
    if not len(real):
        return take
    unit = gcd(*sizes[real].tolist())
    s, c, budget = sizes[real] // unit, counts[real], int(budget) // unit
    total = sum(a * b for a, b in zip(s.tolist(), c.tolist(), strict=True))
    if budget >= total:
        take[real] = c
        return take
    even, due = np.zeros_like(c), 0
    for i in np.argsort(-s, kind="stable").tolist():  # what a size can't take of its share goes to shorter ones
        due += int(c[i]) * int(s[i]) * budget
        even[i] = min(int(c[i]), due // (total * int(s[i])))
        due -= int(even[i]) * total * int(s[i])
    core, goal, order = CORE, budget, np.argsort(s, kind="stable")
    while True:
        back, left = np.zeros_like(c), min(core, budget)
        for i in order.tolist():
            back[i] = min(int(even[i]), left // int(s[i]))
            left -= int(back[i]) * int(s[i])
            if left < s[i] and core < budget:
                break
        if core >= budget:
            back = even.copy()
        kept = even - back
        room = budget - int((kept * s).sum())
        found = kept + knapsack(s, c - kept, room)
        best = int((found * s).sum())
        if best < goal == budget and core < budget:  # no sum may be the budget, or only one far from the even share
            tried = [by_remainder(s, c, even, budget, i) for i in np.argsort(-c, kind="stable")[:3].tolist()]
            goal = min(x for x, _ in tried)
            found = next((y for x, y in tried if x == goal and y is not None), found)
            best = int((found * s).sum())
        if best >= goal or core >= budget:
            take[real] = found
            return take
        core *= WIDER


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Every row of docs with its source, size, and a hash of id and text with its bucket."""
    ident = F.col(id_col).cast("string")
    h = F.xxhash64(F.lit(seed), ident, text_of(text_col))
    return boxed(docs, id=ident, source=F.col(source_col).cast("string"), size=F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long"), h=h, hb=F.pmod(h, F.lit(BUCKETS)).cast("int"))


def _taken(d: DataFrame, weights: tuple, cap: int) -> DataFrame:
    """d (source, size, id, h, hb, ...) with source_size, target, and how often each row is taken."""
    # null is a source of its own
    d = d.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    cells = materialise(d.groupBy("key", "source", "size", "hb").agg(F.count(F.lit(1)).alias("n")))
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = with_targets(sources, weights, cap).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")

    def take(frame: pd.DataFrame) -> pd.DataFrame:
        size, goal = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        whole, rest = divmod(int(round(goal)), size) if size else (0, 0)
        frame["whole"] = whole
        frame["k"] = fit(frame["size"].to_numpy(), frame["n"].to_numpy(), rest)
        return frame[["key", "size", "whole", "k", "source_size", "target"]]

    histogram = cells.groupBy("key", "size").agg(F.sum("n").alias("n")).join(goals, "key")
    fitted = histogram.groupBy("key").applyInPandas(take, "key string, size long, whole long, k long, source_size long, target double")
    upto = Window.partitionBy("key", "size").orderBy("hb")
    plan = cells.select("key", "size", "hb", (F.sum("n").over(upto) - F.col("n")).alias("before")).join(fitted, ["key", "size"])
    plan = materialise(plan)
    ranked = d.withColumn("rank", F.row_number().over(Window.partitionBy("key", "size", "hb").orderBy("h", "id")))
    once_more = (F.col("before") + F.col("rank") <= F.col("k")).cast("long")
    return ranked.join(plan, ["key", "size", "hb"]).withColumn("times", F.col("whole") + once_more)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken.

    size is the number of words (null text: 0). taken is a multiple of size, cap times it at most; a source's taken
    words are the greatest sum of sizes that does not exceed its rounded target. Null is a source of its own. Rows
    repeating an id count and are taken one by one; which of equal rows is taken is no matter. An empty table gives no
    rows; further columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    d = materialise(_sized(docs, id_col, text_col, source_col, seed).drop("row"))
    return _taken(d, weights, cap).select(F.col("id").cast(kind).alias("doc_id"), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken; a document without words is not taken.

    Rows are taken one by one, also where ids are null or repeat, and keep all their columns, whatever their names. An
    empty table stays empty.
    """
    taken = _taken(_sized(docs, id_col, text_col, source_col, seed), weights, cap).filter("times > 0 AND size > 0")
    return unboxed(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")))
