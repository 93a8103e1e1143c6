"""Reading and landing tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root`` (a file or a directory of part files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Gives a scan at least one partition for each core, for operators whose work per byte is high.

    A scan that already has enough partitions (any input beyond a few splits) is returned as it is,
    so that no shuffle is added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only where it is unset in a local session (tests) a temporary folder of this machine is taken; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="graphloom-")
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``: computed once, kept in the shared folder, survives lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


_LANDED: list[str] = []


def release_landed(spark: SparkSession) -> int:
    """Deletes the tables that ``land`` wrote in this process; for when the frames that read them are no longer used.

    Checkpoints are removed by Spark itself where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    n = 0
    while _LANDED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_LANDED.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def free_shuffles(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark deletes the shuffle files of a plan that ended only then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def land(df: DataFrame, label: str, partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet below the shared folder and reads it back (columnar, prunable)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    _LANDED.append(path)
    return spark.read.schema(df.schema).parquet(path)
