"""Data-quality checks: every check is one row (validation, subject, status, code, message, details).

A check over data is one aggregate; the checks of an artifact are a union of one-row frames.
"""

from __future__ import annotations

import importlib.metadata
import os
import shutil
import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import EXCLUDED_EDGES, MASTER_EDGES, orphan_edges

SCHEMA = "validation string, subject string, status string, code string, message string, details map<string,string>"
OK, WARNING, ERROR = "OK", "WARNING", "ERROR"
MOJIBAKE = r"[├┬�]|Ã[\u0080-¿]"


def report(rows: DataFrame) -> DataFrame:
    """One row: overall status and counts. FAILED with any error, else PASSED_WITH_WARNINGS with any warning."""
    errors, warnings = F.count_if(F.col("status") == ERROR), F.count_if(F.col("status") == WARNING)
    return rows.agg(
        F.when(errors > 0, "FAILED").when(warnings > 0, "PASSED_WITH_WARNINGS").otherwise("PASSED").alias("status"),
        F.count_if(F.col("status") == OK).alias("n_ok"), warnings.alias("n_warnings"), errors.alias("n_errors"),
    )


def check(df: DataFrame, validation: str, subject: str, measure: Column, bad: str, code: str, failing: str = ERROR, ok_code: str | None = None, message: str = "") -> DataFrame:
    """One row about one aggregate: ``failing`` when the measure is not zero (``bad`` names it in the details)."""
    m = df.agg(F.coalesce(measure, F.lit(0)).cast("bigint").alias("m"))
    wrong = F.col("m") != 0
    return m.select(
        F.lit(validation).alias("validation"), F.lit(subject).alias("subject"), F.when(wrong, failing).otherwise(OK).alias("status"),
        F.when(wrong, code).otherwise(ok_code or code).alias("code"), F.lit(message or bad).alias("message"), F.create_map(F.lit(bad), F.col("m").cast("string")).alias("details"),
    )


def row(spark: SparkSession, validation: str, subject: str, status: str, code: str, message: str, **details) -> DataFrame:
    return spark.createDataFrame([(validation, subject, status, code, message, {k: str(v) for k, v in details.items()})], SCHEMA)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of rows that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def duplicate_sample(df: DataFrame, key: str, size: int = 10) -> DataFrame:
    """One row: how many keys repeat, and the first of them in order."""
    twice = repeated(df, [key])
    first = twice.orderBy(key).limit(size).select(F.lit(0).cast("bigint").alias("n"), F.col(key).cast("string").alias("key"))
    counted = twice.groupBy().agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(None).cast("string").alias("key"))
    return counted.unionByName(first).agg(F.sum("n").alias("n_duplicates"), F.array_sort(F.collect_list("key")).alias("sample"))


def validate_graph(nodes: DataFrame, edges: DataFrame, layer: str, expected_nodes: int | None = None, expected_edges: int | None = None) -> DataFrame:
    """Checks of one layer: ids, ends, forbidden and repeated edges, layer of nodes, stubs, stated counts, seeds of the master graph."""
    spark = nodes.sparkSession
    v = "graph"
    parts = [
        check(nodes, v, layer, F.count_if(F.col("id").isNull() | (F.col("id") == "") | F.col("node_type").isNull()), "invalid_nodes", "GRAPH_INVALID_NODES"),
        check(repeated(nodes.where("id IS NOT NULL"), ["id"]), v, layer, F.count(F.lit(1)), "duplicate_ids", "GRAPH_DUPLICATE_NODE_IDS", ok_code="GRAPH_UNIQUE_NODE_IDS"),
        check(edges, v, layer, F.count_if(F.col("source").isNull() | F.col("target").isNull() | F.col("type").isNull()), "invalid_edges", "GRAPH_INVALID_EDGES"),
        check(orphan_edges(edges, nodes), v, layer, F.count(F.lit(1)), "orphan_edges", "GRAPH_ORPHAN_EDGES", ok_code="GRAPH_NO_ORPHAN_EDGES"),
        check(edges, v, layer, F.count_if(F.col("type").isin(*EXCLUDED_EDGES)), "forbidden_edges", "GRAPH_FORBIDDEN_EDGES", ok_code="GRAPH_NO_FORBIDDEN_EDGES"),
        check(repeated(edges, ["source", "target", "type"]), v, layer, F.count(F.lit(1)), "duplicate_edges", "GRAPH_DUPLICATE_EDGES", WARNING),
        check(nodes, v, layer, F.count_if(F.col("node_type") == "physical_table_stub"), "stubs", "GRAPH_PHYSICAL_STUBS", WARNING),
    ]
    if "graph_layer" in nodes.columns and layer != "master":
        parts.append(check(nodes, v, layer, F.count_if(F.col("graph_layer") != layer), "other_layer", "GRAPH_NODE_LAYER_MISMATCH"))
    for df, stated, name in ((nodes, expected_nodes, "nodes"), (edges, expected_edges, "edges")):
        if stated is not None:
            parts.append(check(df, v, layer, F.count(F.lit(1)) - stated, f"{name}_beyond_stated", "GRAPH_STATS_MISMATCH", ok_code="GRAPH_STATS_VALID"))
    if layer == "master":
        parts.append(check(edges, v, layer, F.count_if(~F.col("type").isin(*MASTER_EDGES)), "unexpected_types", "MASTER_UNEXPECTED_EDGE_TYPES"))
        parts.append(check(nodes, v, layer, F.when(F.count_if(F.col("node_type").isin("business_entity", "business_attribute", "validated_rule")) == 0, 1).otherwise(0), "without_seeds", "MASTER_WITHOUT_BUSINESS_SEEDS", WARNING, "MASTER_BUSINESS_SEEDS"))
        parts.append(check(nodes, v, layer, F.when(F.count(F.lit(1)) == 0, 1).otherwise(0), "empty", "MASTER_EMPTY", WARNING))
    parts.append(check(nodes, v, layer, F.lit(0), "nodes", "GRAPH_COUNTS"))
    del spark
    return union(parts)


def validate_environment_catalog(resources: DataFrame, projections: DataFrame) -> DataFrame:
    """Repeated resource names, and module projections that name unknown resources.

    ``resources`` (name), ``projections`` (module_id, resources ARRAY)."""
    names = resources.select(F.lower(F.trim("name")).alias("name"))
    wanted = projections.select("module_id", F.explode("resources").alias("name")).select("module_id", F.lower(F.trim("name")).alias("name"))
    return union([
        check(repeated(names, ["name"]), "environment", "resources", F.count(F.lit(1)), "duplicates", "ENVIRONMENT_RESOURCE_DUPLICATES"),
        check(wanted.join(names.distinct(), "name", "left_anti"), "environment", "modules", F.count(F.lit(1)), "unknown", "ENVIRONMENT_MODULE_UNKNOWN_RESOURCES"),
        check(projections, "environment", "modules", F.when(F.count(F.lit(1)) == 0, 1).otherwise(0), "missing", "ENVIRONMENT_MODULES_MISSING", WARNING),
    ])


def validate_vectors(vectors: DataFrame, expected: DataFrame, subject: str) -> DataFrame:
    """Coverage of the expected ids and shape of the vectors. ``vectors`` (id, embedding, dimensions), ``expected`` (id)."""
    shape = F.count_if(F.col("embedding").isNull() | (F.size("embedding") != F.col("dimensions")))
    missing = expected.select("id").distinct().join(vectors.select("id").distinct(), "id", "left_anti")
    beyond = vectors.select("id").distinct().join(expected.select("id").distinct(), "id", "left_anti")
    return union([
        check(vectors, "index", subject, shape, "wrong_shape", "INDEX_SEMANTIC_VECTOR_SHAPE"),
        check(missing, "index", subject, F.count(F.lit(1)), "without_vector", "INDEX_SEMANTIC_ROOT_COVERAGE", WARNING),
        check(beyond, "index", subject, F.count(F.lit(1)), "unknown_ids", "INDEX_SEMANTIC_UNKNOWN_IDS"),
    ])


def validate_index(nodes: DataFrame, edges: DataFrame, posted: DataFrame, subject: str) -> DataFrame:
    """Index tables of a layer: postings for every node with text, ends of edges, module lists."""
    with_text = nodes.where(F.concat_ws(" ", "title", "search_text").rlike("[A-Za-z0-9_]{3,}"))
    return union([
        check(with_text.join(posted.select("id").distinct(), "id", "left_anti"), "index", subject, F.count(F.lit(1)), "without_postings", "INDEX_FTS_COVERAGE", WARNING),
        check(posted.select("id").distinct().join(nodes.select("id"), "id", "left_anti"), "index", subject, F.count(F.lit(1)), "unknown_postings", "INDEX_FTS_QUERY"),
        check(orphan_edges(edges, nodes), "index", subject, F.count(F.lit(1)), "orphan_edges", "INDEX_ORPHAN_EDGES"),
        check(nodes, "index", subject, F.count_if(F.exists(F.coalesce("modules", F.array().cast("array<string>")), lambda m: m.isNull() | (m == ""))), "blank_modules", "INDEX_ORPHAN_MODULES"),
    ])


def validate_results(results: DataFrame, max_characters: int) -> DataFrame:
    """Search results (query_id, context, characters, ids ARRAY, n_without_source), each row checked."""
    v, s = "result", "results"
    return union([
        check(results, v, s, F.count_if(F.coalesce(F.trim("context"), F.lit("")) == ""), "empty", "SEARCH_RESULT_CONTEXT"),
        check(results, v, s, F.count_if(F.size("ids") == 0), "without_items", "SEARCH_RESULT_EMPTY", WARNING, "SEARCH_RESULT_ITEMS"),
        check(results, v, s, F.count_if(F.col("characters") != F.length("context")), "mismatch", "SEARCH_RESULT_CHARACTER_MISMATCH", ok_code="SEARCH_RESULT_CHARACTER_COUNT"),
        check(results, v, s, F.count_if(F.col("characters") > max_characters), "exceeded", "SEARCH_RESULT_BUDGET_EXCEEDED", ok_code="SEARCH_RESULT_BUDGET"),
        check(results, v, s, F.count_if(F.size("ids") != F.size(F.array_distinct("ids"))), "duplicates", "SEARCH_RESULT_DUPLICATES", ok_code="SEARCH_RESULT_UNIQUE_ITEMS"),
        check(results, v, s, F.sum("n_without_source"), "without_source", "SEARCH_RESULT_MISSING_SOURCES", WARNING),
        check(results, v, s, F.count_if(F.col("context").rlike(MOJIBAKE)), "garbled", "SEARCH_RESULT_ENCODING", WARNING),
    ])


def validate_files(spark: SparkSession, folder: str, required: dict[str, bool], prefix: str = "FILE") -> DataFrame:
    """Existence and size of the files of a folder; ``required`` maps a name to whether it must be there."""
    out = []
    for name, must in required.items():
        path = os.path.join(folder, name)
        if not os.path.exists(path):
            out.append(row(spark, "files", name, ERROR if must else OK, f"{prefix}_MISSING" if must else f"{prefix}_NOT_REQUIRED", "not found", path=path))
        elif os.path.isfile(path) and not os.path.getsize(path):
            out.append(row(spark, "files", name, ERROR, f"{prefix}_EMPTY", "empty", path=path))
        else:
            out.append(row(spark, "files", name, OK, f"{prefix}_EXISTS", "found", path=path))
    return union(out)


def validate_json_lines(spark: SparkSession, path: str, prefix: str = "FILE") -> DataFrame:
    """Bad lines of a JSON-lines file are counted, not raised."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return check(lines, "files", path, F.count_if(F.expr("try_parse_json(value)").isNull()), "bad_lines", f"{prefix}_INVALID_JSONL", ok_code=f"{prefix}_VALID_JSONL")


def validate_environment(spark: SparkSession, work_dir: str, least_free: int = 1 << 30) -> DataFrame:
    """Versions, packages, output encoding, writable folder and free disk of this machine."""
    v, out = "environment", []
    out.append(row(spark, v, "python", OK if sys.version_info >= (3, 10) else ERROR, "PYTHON_VERSION", sys.version.split()[0]))
    missing = [p for p in ("pyspark", "pyarrow", "pandas", "numpy") if not _installed(p)]
    out.append(row(spark, v, "packages", ERROR if missing else OK, "PYTHON_DEPENDENCIES", ", ".join(missing) or "all found"))
    out.append(row(spark, v, "spark", OK, "SPARK_VERSION", spark.version))
    encoding = (getattr(sys.stdout, "encoding", None) or "").lower()
    out.append(row(spark, v, "stdout", OK if "utf" in encoding else WARNING, "STDOUT_ENCODING", encoding or "unknown"))
    writable = os.path.isdir(work_dir) and os.access(work_dir, os.W_OK)
    out.append(row(spark, v, "folder", OK if writable else ERROR, "WORK_DIRECTORY_WRITABLE" if writable else "WORK_DIRECTORY", work_dir))
    free = shutil.disk_usage(work_dir).free if os.path.isdir(work_dir) else 0
    out.append(row(spark, v, "disk", OK if free >= least_free else WARNING, "DISK_SPACE", f"{free} bytes free"))
    return union(out)


def _installed(name: str) -> bool:
    try:
        importlib.metadata.version(name)
    except importlib.metadata.PackageNotFoundError:
        return False
    return True


def validate_module(spark: SparkSession, module: dict, folder: str) -> DataFrame:
    """The definition of a module: required fields, a configured source, the files it names."""
    v, name = "module", str(module.get("id") or folder)
    filled = lambda x: any(filled(y) for y in (x.values() if isinstance(x, dict) else x)) if isinstance(x, (dict, list, tuple)) else bool(str(x or "").strip())
    parts = [row(spark, v, name, OK if filled(module.get(f)) else ERROR, f"MODULE_{f.upper()}", f"{f} is {'given' if filled(module.get(f)) else 'missing'}") for f in ("id", "name")]
    sources = filled(module.get("sources"))
    parts.append(row(spark, v, name, OK if sources else WARNING, "MODULE_SOURCES", "configured" if sources else "no source configured"))
    files = {f: True for f in module.get("files") or []}
    return union([*parts, validate_files(spark, folder, files, "MODULE_FILE")] if files else parts)


def validate_bundle(nodes: DataFrame, edges: DataFrame, layers: list[str]) -> DataFrame:
    """The checks of every layer (``graph_layer`` of nodes and edges), codes with the layer as prefix, and layers nobody expects."""
    parts = []
    for layer in layers:
        checked = validate_graph(nodes.where(F.col("graph_layer") == layer), edges.where(F.col("graph_layer") == layer), layer)
        parts.append(checked.withColumn("code", F.concat(F.lit(f"{layer.upper()}_"), "code")))
    parts.append(check(nodes, "bundle", "layers", F.count_if(F.col("graph_layer").isNull() | ~F.col("graph_layer").isin(*layers)), "nodes_of_unknown_layers", "BUNDLE_UNKNOWN_LAYERS"))
    return union(parts)
