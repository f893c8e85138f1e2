"""Exact dedup by deterministic block naming.

Texts are cut into fixed-size blocks. Sorted distinct blocks get integer names; then, level by level, adjacent pairs of
names get names of their own until one name stands for the whole text. Two texts have the same (level, name) exactly
if they are equal: names are given to contents, never to hashes. A 64-bit hash only routes blocks to partitions; min and
max of the contents under a hash prove that it stands for one content, and the (in practice empty) rest is named by
content.

Only the blocks' first shuffle moves text, after a map-side reduction that sends one block per content and task. All
later rounds move integers; there are ceil(log2(blocks of the longest text)) of them. Names that many rows share, as of
empty texts or a block of site furniture, are joined by broadcast, so no task holds all their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii, materialise, spread_join, stay_among, text_of

BLOCK = 4096


def block_identity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, sha, level, name, copies) for each distinct (id, normalised text): sha is the SHA-256 of the normalised text,
    copies the number of rows that repeat both."""
    base = docs.select(F.col(id_col).alias("id"), fold_ascii(text_of(text_col)).alias("t"))
    cut = F.when(F.octet_length("t") <= block, F.array("t")).otherwise(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{block}}}+"), F.lit(0)))
    cut = base.select("id", F.sha2("t", 256).alias("sha"), cut.alias("blocks"))
    pieces = cut.select("id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "blk")).withColumn("h", F.xxhash64("blk"))

    by_hash = pieces.groupBy("h").agg(F.min("blk").alias("lo"), F.max("blk").alias("hi"), F.count(F.lit(1)).alias("held")).sortWithinPartitions("h")
    by_hash = materialise(by_hash.select("h", (F.col("lo") == F.col("hi")).alias("sole"), F.monotonically_increasing_id().alias("name"), "held"), docs.count(), 20_000)
    total = by_hash.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    placed = materialise(pieces.drop("blk"))  # a file a task: this reads the texts
    named = spread_join(placed, by_hash.filter("sole").drop("sole"), ["h"], "held", total).select("id", "sha", "n", "pos", F.col("name") * 2)
    shared = by_hash.filter("NOT sole").select("h")
    if not shared.isEmpty():  # two contents under one hash: these are named by content
        rest = pieces.join(F.broadcast(shared) if shared.count() < 1000 else shared, "h", "left_semi")
        names = materialise(rest.groupBy("blk").agg(F.lit(1).alias("one")).sortWithinPartitions("blk").select("blk", (F.monotonically_increasing_id() * 2 + 1).alias("name")))
        named = named.union(rest.join(names, "blk").select("id", "sha", "n", "pos", "name"))
    return _pair_up(materialise(named.toDF("id", "sha", "n", "pos", "name"), total).withColumn("copies", F.lit(1).cast("long")))


def _pair_up(now: DataFrame) -> DataFrame:
    """Names adjacent pairs until each document has one name. An odd last name pairs with -1."""
    level, (most, rows) = 0, now.agg(F.coalesce(F.max("n"), F.lit(1)), F.count(F.lit(1))).first()
    done = now.filter("n = 1").groupBy("id", "sha", F.lit(0).alias("level"), "name").agg(F.sum("copies").alias("copies"))
    now = now.filter("n > 1")
    while most > 1:
        side = lambda odd: F.coalesce(F.max(F.when(F.col("pos") % 2 == odd, F.col("name"))), F.lit(-1))
        pairs = now.groupBy("id", "sha", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.expr("pos div 2").alias("pos")).agg(side(0).alias("a"), side(1).alias("b"), F.sum(F.when(F.col("pos") % 2 == 0, F.col("copies"))).alias("copies"))
        pairs = materialise(pairs, rows)
        names = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("held")).sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("name"), "held")
        now = materialise(spread_join(pairs, materialise(names, rows), ["a", "b"], "held", rows).select("id", "sha", "n", "pos", "name", "copies"), rows)
        level, most = level + 1, (most + 1) // 2
        done = done.union(now.filter("n = 1").select("id", "sha", F.lit(level).alias("level"), "name", "copies"))
        now = now.filter("n > 1")
    return done


def _groups(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """The columns of exact_duplicates and copies, one row for each distinct (id, normalised text)."""
    rows = docs.count()
    ident = materialise(block_identity(docs, id_col, text_col, block), rows)
    groups = ident.groupBy("level", "name").agg(F.max("id").alias("keep"), F.sum("copies").alias("size"), F.count(F.lit(1)).alias("held"))
    groups = materialise(groups.filter("size > 1"), rows)
    size = F.coalesce("size", F.lit(1).cast("long"))
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
    return spread_join(ident, groups, ["level", "name"], "held", rows, "left").select(
        F.col("id").alias("doc_id"), keep.alias("keep_id"), size.alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"), "copies"
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is the empty text, and empty texts are equal to each
    other. The row with the largest id stays. Rows repeating an id and its text each count in group_size, and kept is
    true of all of them if theirs is the largest id; one id with different texts is several documents. A null id is
    smaller than any other. An empty table gives no rows; further columns are ignored.
    """
    found = _groups(docs, id_col, text_col, block)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names; of rows repeating an id and its text,
    one. An empty table stays empty."""
    stay = _groups(docs.select(id_col, text_col), id_col, text_col, block).filter("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "copies")
    return stay_among(docs, stay, id_col, F.sha2(fold_ascii(text_of(text_col)), 256))
