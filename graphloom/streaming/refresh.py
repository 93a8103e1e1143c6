"""Incremental corpus refresh as a stream: new files are micro-batches, texts are kept once by hash.

The batch function is idempotent: a replayed batch finds its hashes already stored. The checkpoint gives the
progress, so an interrupted run goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.text import normalize_semantic_text, text_hash


def store_new_texts(batch: DataFrame, target: str, text: str) -> None:
    """Appends the texts of a batch whose hash is not stored yet."""
    spark = batch.sparkSession
    fresh = batch.select(text_hash(text).alias("text_hash"), normalize_semantic_text(text).alias("normalized_text")).where(F.col("normalized_text") != "").dropDuplicates(["text_hash"])
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        fresh = fresh.join(spark.read.parquet(target).select("text_hash"), "text_hash", "left_anti")
    fresh.write.mode("append").parquet(target)


def refresh_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, text: str = "text", glob: str = "*.parquet", files_per_batch: int = 64) -> StreamingQuery:
    """Takes all files that arrived since the last run, then stops."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(lambda batch, _: store_new_texts(batch, target, text)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Events counted in time windows, late rows accepted up to the watermark. Works on streams and tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
