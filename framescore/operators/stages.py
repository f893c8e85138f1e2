"""Tables written between the steps of long plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


def stage_path(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir, under stages-<application>. Only on a local master may that setting
    be missing; a local folder is then made and set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/stages-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def remove_stages(spark: SparkSession) -> None:
    """Deletes all that this application has written there; DataFrames that read it can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_path(spark)).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """df, written in the shared folder and read back: what follows plans over one scan, computes nothing again, and
    survives lost executors. The files stay for the lazy results that read them, until `remove_stages`."""
    return _saved(df.write, df.sparkSession)


def bucketed(df: DataFrame, n: int, *by: str) -> DataFrame:
    """df, written in the shared folder in n buckets by `by`, and read back: joins, groups and windows over these columns and
    others need no shuffle. df should lie so already (repartition(n, *by), or made of tables that are bucketed so), else its
    tasks write a file for each bucket.

    Two settings of the session are changed: joins may use buckets by some of their columns, and buckets are read as such.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    return _saved(df.write.bucketBy(n, *by), spark)


def removed(df: DataFrame) -> None:
    """Deletes the files of a table of `written` or `bucketed`, which nothing may read any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _saved(writer: DataFrameWriter, spark: SparkSession) -> DataFrame:
    """The table that writer writes. Plans know the number of its rows, not only the size of its files: those of a few
    repeated values are far smaller than the rows in memory, and the driver would gather them all for a broadcast.

    One setting of the session is changed: plans use the numbers of rows that the catalog knows.
    """
    name = f"stage_{uuid.uuid4().hex}"
    writer.format("parquet").option("path", stage_path(spark)).saveAsTable(name)
    spark.conf.set("spark.sql.cbo.planStats.enabled", "true")
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")  # reads footers
    return spark.table(name)
