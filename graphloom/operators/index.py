"""Layer indexes as Parquet tables, a manifest that tells what must be rebuilt, and staleness checks."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import run_tokens, runs_of, text_of
from graphloom.sources.tables import free_shuffles

SCHEMA_VERSION = "1"
#: Bounds of a worker's memory: words counted together, different words kept, rows of a batch.
RUNS_AT_ONCE, RUNS_KEPT, ROWS = 1_000_000, 200_000, 50_000


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def layer_signatures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_layer, n_nodes, n_edges, content): counts and an order-free hash of each layer's content.

    Row hashes are summed as decimals: no sort and no list of a layer's rows."""
    digest = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    n = nodes.groupBy("graph_layer").agg(F.count(F.lit(1)).alias("n_nodes"), digest("id", "node_type", "title", "search_text").alias("h1"))
    e = edges.groupBy("graph_layer").agg(F.count(F.lit(1)).alias("n_edges"), digest("source", "target", "type").alias("h2"))
    joined = n.join(e, "graph_layer", "full_outer")
    return joined.select("graph_layer", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.sha2(F.concat_ws("|", F.col("h1").cast("string"), F.col("h2").cast("string")), 256).alias("content"))


def rebuild_decisions(current: DataFrame, manifest: DataFrame, model: str, force: bool = False) -> DataFrame:
    """(graph_layer, action): skip a layer whose content, schema version and model are as indexed, rebuild others, drop the gone."""
    m = manifest.select("graph_layer", F.col("content").alias("m_content"), F.col("schema_version").alias("m_schema"), F.col("model").alias("m_model"), F.lit(True).alias("indexed"))
    same = (F.col("content") == F.col("m_content")) & (F.col("m_schema") == SCHEMA_VERSION) & (F.col("m_model") == model)
    action = F.when(F.col("content").isNull(), "drop").when(F.lit(force) | F.col("indexed").isNull() | ~F.coalesce(same, F.lit(False)), "rebuild").otherwise("skip")
    return current.select("graph_layer", "content").join(m, "graph_layer", "full_outer").select("graph_layer", action.alias("action"))


class _Vocabulary(dict):
    """The number of each run of a text; at it, the numbers of the run's tokens."""

    def __init__(self) -> None:
        self.terms: dict[str, int] = {}
        self.flat, self.starts = array("i"), array("q", [0])

    def __missing__(self, run: str) -> int:
        self.flat.extend([self.terms.setdefault(t, len(self.terms)) for t in run_tokens(run)])
        self.starts.append(len(self.flat))
        self[run] = at = len(self)
        return at


def _counted(words: _Vocabulary, runs: list[array], ids: pa.Array) -> Iterator[pa.RecordBatch]:
    """The postings of the nodes with these runs, by term and node: one sort of numbers orders and counts them."""
    starts, at = np.asarray(words.starts), np.concatenate([np.asarray(r, dtype=np.int32) for r in runs])
    sizes = (starts[1:] - starts[:-1])[at]
    tokens = np.asarray(words.flat)[gather_ranges(starts[:-1][at], sizes)]
    lengths = np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, runs)])])  # tokens of each node
    terms = pa.array(list(words.terms), pa.string())
    terms = terms.take(order := pc.array_sort_indices(terms))
    rank = np.empty(len(terms), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(terms))
    key = rank[tokens] * len(runs) + np.repeat(np.arange(len(runs)), lengths)
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    times, key = np.diff(first, append=len(key)), key[first]
    for i in range(0, len(key), ROWS):
        term, node = np.divmod(key[i : i + ROWS], len(runs))
        columns = {"id": ids.take(pa.array(node)), "term": terms.take(pa.array(term)), "dl": pa.array(lengths[node], pa.int32()), "tf": pa.array(times[i : i + ROWS], pa.int64())}
        yield pa.RecordBatch.from_pydict(columns)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, runs, ids, n = _Vocabulary(), [], [], 0
    for batch in batches:
        begun = 0
        for i, text in enumerate(batch.column("text").to_pylist(), 1):
            runs.append(array("i", map(words.__getitem__, runs_of(text))))
            n += len(runs[-1])
            if i == batch.num_rows or n >= RUNS_AT_ONCE:
                ids.append(batch.column("id").slice(begun, i - begun))
                begun = i
            if n >= RUNS_AT_ONCE:
                yield from _counted(words, runs, pa.concat_arrays(ids))
                runs, ids, n = [], [], 0
                if len(words) > RUNS_KEPT:
                    words = _Vocabulary()
    if runs:
        yield from _counted(words, runs, pa.concat_arrays(ids))


def layer_postings(nodes: DataFrame) -> DataFrame:
    """(id, term, dl, tf), each node's in one row of ``nodes``: counted where the row is, nothing is shuffled. By term in
    stretches of ``RUNS_AT_ONCE`` words of a partition."""
    texts = nodes.select("id", F.concat_ws(" ", text_of("title"), text_of("search_text")).alias("text"))
    return texts.mapInArrow(_posted, "id string, term string, dl int, tf bigint")


def build_index(nodes: DataFrame, edges: DataFrame, path: str, model: str = "none", force: bool = False) -> DataFrame:
    """Writes nodes, edges and postings of the layers that changed, partitioned by layer, then the manifest. Other
    layers' partitions stay. Edges without an end fail the build.

    The frames are read several times. Each of their partitions becomes a file in each of its layers, nodes by id, edges
    by source, postings in stretches by term; so a term is found in each file by the statistics of its pages, and no task
    holds all postings of a frequent term."""
    spark = nodes.sparkSession
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    if ends.join(nodes.select("id"), "id", "left_anti").limit(1).count():
        raise ValueError("the graph has edges whose ends are missing")
    signatures = layer_signatures(nodes, edges)
    current = signatures.collect()  # a handful of layers, as all that follows from them
    decisions = rebuild_decisions(spark.createDataFrame(current, signatures.schema), read_manifest(spark, path), model, force)
    decided = decisions.collect()
    layers = [r["graph_layer"] for r in decided if r["action"] == "rebuild"]
    free_shuffles(spark)
    if layers:
        keep = F.col("graph_layer").isin(*layers)
        changed = nodes.where(keep)
        for name, df, key in (("nodes", changed, "id"), ("edges", edges.where(keep), "source")):
            df.sortWithinPartitions("graph_layer", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("graph_layer").parquet(f"{path}/{name}")
        for layer in layers:  # one at a time: their order is that of the workers, where a write of several would sort again
            folder = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("graph_layer", layer)
            layer_postings(changed.where(F.col("graph_layer") == layer)).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings/{folder}")
    _write_json(spark, f"{path}/manifest.json", [{**r.asDict(), "schema_version": SCHEMA_VERSION, "model": model} for r in current])
    return spark.createDataFrame(decided, decisions.schema)


def _write_json(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """One small file, written beside and renamed by the file system of the path."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, temporary = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = target.getFileSystem(conf)
    out = fs.create(temporary, True)
    out.write(bytearray("\n".join(json.dumps(r, sort_keys=True) for r in rows).encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(temporary, target)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = "graph_layer string, n_nodes bigint, n_edges bigint, content string, schema_version string, model string"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.json")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{path}/manifest.json")


def stale_layers(nodes: DataFrame, edges: DataFrame, path: str, model: str = "none") -> DataFrame:
    return rebuild_decisions(layer_signatures(nodes, edges), read_manifest(nodes.sparkSession, path), model).where("action <> 'skip'")


def indexed_layer(spark: SparkSession, path: str, name: str, layers: list[str]) -> DataFrame:
    """An index table with only the partitions of the asked layers."""
    return spark.read.parquet(os.path.join(path, name)).where(F.col("graph_layer").isin(*layers))


def refresh_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(table, graph_layer, n_files, bytes): statistics of the files of an index as they lie, written beside the manifest;
    no content is read or rebuilt."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    stats = files.select(F.regexp_extract("path", r"/([^/]+)/graph_layer=", 1).alias("table"), F.regexp_extract("path", r"graph_layer=([^/]+)/", 1).alias("graph_layer"), "length")
    rows = stats.groupBy("table", "graph_layer").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))
    _write_json(spark, f"{path}/metadata.json", [r.asDict() for r in rows.orderBy("table", "graph_layer").collect()])  # tables times layers
    return rows


def write_vectors(vectors: DataFrame, nodes: DataFrame, path: str) -> None:
    """Vectors (id, segment_index, embedding) of indexed nodes, partitioned by layer, roots (segment 0) and segments in one table."""
    placed = vectors.join(nodes.select("id", "graph_layer"), "id")
    placed.withColumn("kind", F.when(F.col("segment_index") == 0, "root").otherwise("segment")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_layer").parquet(f"{path}/vectors")
