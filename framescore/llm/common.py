"""Shared helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters that the contracts fold, and the white space that separates words.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
#: Keys held by more than this share of a table's rows are joined by broadcast; there are at most HOT such keys.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII text takes the much faster lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash_place(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) by the hash of cols, for seeded draws."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / float(1 << 40)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where it is unset on a local master (tests) a new local one is made and
    set; on a cluster, whose machines do not share local folders, that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stage_dir(spark: SparkSession) -> str:
    """Where this application's stages are written."""
    return f"{shared_dir(spark)}/stages-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, rows: int | None = None, per_file: int = 1_000_000, codec: str = "zstd") -> DataFrame:
    """Writes df in the shared folder and reads it back: cuts lineage, survives lost executors, and lets every later
    read see the same rows. rows: an upper bound of their number, for which files of per_file rows are written instead
    of one for each of many small partitions. Results are lazy and read these files, so they stay until the caller has
    written the results and calls remove_stages."""
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{uuid.uuid4().hex}"
    df = df if rows is None else df.coalesce(max(8, -(-rows // per_file)))
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stages(spark: SparkSession) -> None:
    """Deletes all stages that this application has written; DataFrames that read them can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """Each row of docs as one struct `row`, with further columns whose names can't clash with those of docs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])


def unboxed(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups, one row for each key, also where a few keys hold most rows.

    n: the column of groups with the number of rows of the key, dropped; total: the number of rows. Keys with more than
    total / HOT rows, at most HOT of them, are broadcast, so that their rows stay where they are; the other keys are
    shuffled, and none of them is a task's whole load. rows should be a written table: it is read twice.
    """
    hot, cold = F.col(n) > max(1.0, total / HOT), F.col(n) <= max(1.0, total / HOT)
    few = F.broadcast(groups.filter(hot).drop(n))
    rest = rows.join(few.select(*on), on, "left_anti").join(groups.filter(cold).drop(n), on, how)
    return rows.join(few, on).unionByName(rest)


def stay_among(docs: DataFrame, stay: DataFrame, id_col: str, text_hash: Column) -> DataFrame:
    """The rows of docs whose (id, text hash) is in stay (id, sha, copies); of rows that repeat both, one.

    No row is looked up by its id alone, so ids may be null or repeat.
    """
    own = boxed(docs, id=F.col(f"`{id_col}`"), sha=text_hash)

    def among(found: DataFrame) -> DataFrame:
        return own.join(found, own["id"].eqNullSafe(found["id"]) & (own["sha"] == found["sha"]), "left_semi")

    if stay.filter("copies > 1").isEmpty():
        return unboxed(among(stay))
    return unboxed(among(stay.filter("copies = 1")).unionByName(among(stay.filter("copies > 1")).dropDuplicates(["id", "sha"])))
