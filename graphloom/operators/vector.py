"""Vectors as arrays: normalization, similarity, top-k, and scores of documents from their segments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def dot(a: Column, b: Column) -> Column:
    """Inner product in the JVM, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def top_k(vectors: DataFrame, query: list[float], k: int, decimals: int = 6) -> DataFrame:
    """The k vectors (id, embedding) nearest to the query; ties by the smaller id. A bounded heap for each task."""
    scored = vectors.select("id", F.round(cosine(F.col("embedding"), literal_vector(query)), decimals).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def scan_top_k(vectors: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """Exact nearest vectors of a block of queries: (query_no, id, score). Each task multiplies its Arrow batches
    with the block and keeps k for each query; the tasks' lists are merged by one bounded window."""
    unit = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-30)
    shared = vectors.sparkSession.sparkContext.broadcast(unit.astype(np.float32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["embedding"].to_numpy()).astype(np.float32)
            s = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)) @ q.T
            keep = np.argsort(-s, axis=0, kind="stable")[:k]
            yield pd.DataFrame({"query_no": np.tile(np.arange(q.shape[0]), keep.shape[0]), "id": batch["id"].to_numpy()[keep.ravel()], "score": np.take_along_axis(s, keep, axis=0).ravel().astype(float)})

    found = vectors.select("id", "embedding").mapInPandas(run, f"query_no int, id {vectors.schema['id'].dataType.simpleString()}, score double")
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def document_scores(segments: DataFrame, k: int = 2) -> DataFrame:
    """(parent, score): the mean of the k best segment scores of ``segments`` (parent, score)."""
    order = Window.partitionBy("parent").orderBy(F.desc("score"))
    return segments.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("parent").agg(F.avg("score").alias("score"))


def group_top_k(scored: DataFrame, group: str, k: int) -> DataFrame:
    """The k best rows (id, score) of each group; limited on the map side."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shape_report(vectors: DataFrame, dimensions: Column) -> DataFrame:
    """One row: how many vectors are null, of the wrong length, not finite, not of unit length."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.count_if(v.isNull()).alias("n_null"),
        F.count_if(v.isNotNull() & (F.size(v) != dimensions)).alias("n_wrong_size"),
        F.count_if(v.isNotNull() & ~finite).alias("n_not_finite"),
        F.count_if(v.isNotNull() & finite & (F.abs(F.sqrt(dot(v, v)) - 1) > 1e-3)).alias("n_not_unit"),
    )


def hashing_encoder(dimensions: int = 64):
    """A deterministic encoder without a model: signed hashes of words, at unit length. Stands where a neural
    encoder (any ``Iterator[Series] -> Iterator[Series]``) is plugged in."""

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: _hashed(t or "", dimensions))

    return encode


def _hashed(text: str, dimensions: int) -> list[float]:
    v = np.zeros(dimensions)
    for word in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        v[h % dimensions] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32).tolist()


@dataclass(frozen=True)
class ModelProfile:
    """How texts are given to an encoder, and the shape of its vectors."""

    name: str
    dimensions: int
    query_format: str = "{text}"
    passage_format: str = "{text}"

    def _format(self, pattern: str, text: Column) -> Column:
        before, _, after = pattern.partition("{text}")
        return F.concat(F.lit(before), F.coalesce(text, F.lit("")), F.lit(after))

    def as_query(self, text: Column) -> Column:
        return self._format(self.query_format, text)

    def as_passage(self, text: Column) -> Column:
        return self._format(self.passage_format, text)

    def usable(self, v: Column) -> Column:
        """Whether a vector has the shape of the profile and only finite numbers."""
        return F.coalesce((F.size(v) == self.dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


# Sizes and prefixes of the two profiles.
PROFILES = {
    "base": ModelProfile("base", 768, "query: {text}", "passage: {text}"),
    "large": ModelProfile("large", 1024, "Instruct: Given a search query, retrieve relevant passages that answer the query\nQuery: {text}"),
}


def joined_vectors(vectors: DataFrame, nodes: DataFrame, layers: list[str] | None = None, node_types: list[str] | None = None, modules: list[str] | None = None) -> DataFrame:
    """Vectors (id, embedding) of the nodes that the filters keep, with what ranking needs of the node."""
    keep = nodes
    for column, values in (("graph_layer", layers), ("node_type", node_types)):
        keep = keep.where(F.col(column).isin(*values)) if values else keep
    if modules:
        keep = keep.where(F.coalesce(F.arrays_overlap("modules", F.array(*[F.lit(m) for m in modules])), F.lit(False)))
    return vectors.select("id", "embedding").join(keep.select("id", "node_type", "title"), "id")
