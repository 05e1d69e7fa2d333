"""Session settings and the two ways Quarry cuts lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Applied only where the caller's session has not set them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with Quarry's defaults; ``conf`` keys use ``__`` for the dots of Spark's names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` through the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``. Only a session without one, as in local tests, gets a
    temporary folder; a cluster must name a shared one. The data survive the loss of executors, unlike a local checkpoint.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="quarry-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=eager)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, for a table that is written once and read several times."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
    return f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results, such as one of ``shared_folder`` that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of one or two numbers up to which a counted side of a join is broadcast, some 10 MB.
FEW = 500_000


def settled(rows: DataFrame, few: int = FEW) -> DataFrame:
    """The rows, worked out once, with a broadcast hint if they are counted to be few; else the same join shuffles."""
    done = checkpoint(rows)
    return F.broadcast(done) if done.limit(few + 1).count() <= few else done


def numbered(df: DataFrame, key: str, order: str, name: str = "k") -> DataFrame:
    """The rows with their number, from 1, within a key in an order, without one task for all rows of a key.

    Rows are dealt out by ranges of key and order, counted per range and key, and numbered within these; the counts of the ranges before
    are added. Rows with equal key and order are numbered in any order.
    """
    ranged = checkpoint(df.repartitionByRange(key, order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_range")) - F.col("_n")
    offsets = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n")).withColumn("_before", before).select(F.col(key).alias("_key"), F.col("_range").alias("_r"), "_before")
    inner = F.row_number().over(Window.partitionBy("_range", key).orderBy(order))
    joined = ranged.withColumn("_i", inner).join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(name, F.col("_before") + F.col("_i")).drop("_range", "_i", "_key", "_r", "_before")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan dealt out to all cores where the scan has fewer partitions than these, as a small or single-file table has.

    Only for plans without a shuffle, and before Python work that costs more than moving its input. A large table is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
