"""JSON and JSON-lines sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents with a declared schema; no inference pass."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped. A bad row fails the read, or with ``strict`` off stays as ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_variant_lines(spark: SparkSession, path: str) -> DataFrame:
    """(payload VARIANT, source_file): rows of any shape; bad rows have a null payload."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.expr("try_parse_json(value)").alias("payload"), F.col("_metadata.file_path").alias("source_file"))


def without_errors(df: DataFrame, node_type: str = "node_type") -> DataFrame:
    """Collected rows without the ones that only record an error of the collection."""
    return df.where(F.coalesce(F.col(node_type), F.lit("")) != "collection_error")


def write_layers(df: DataFrame, path: str, layer: str = "graph_layer") -> None:
    """One directory for each layer; only the written layers are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(layer).parquet(path)
