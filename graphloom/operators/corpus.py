"""The text corpus: segments and distinct texts, incremental refresh by hash, embedding cache, run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import normalize_semantic_text, text_hash

# Order of layers in a run, and of resources within the service layer.
LAYER_ORDER = ("service", "master", "business", "physical", "analytics", "security")
SERVICE_ORDER = ("environment_resource", "rest_resource", "rest_operation")


def eligible_nodes(nodes: DataFrame, types: dict[str, list[str]]) -> DataFrame:
    """Nodes whose type is embedded in their layer, with a deterministic order of work."""
    keep = F.lit(False)
    for layer, names in types.items():
        keep = keep | ((F.col("graph_layer") == layer) & F.col("node_type").isin(*names))
    layer = F.array_position(F.array(*[F.lit(x) for x in LAYER_ORDER]), F.col("graph_layer"))
    service = F.array_position(F.array(*[F.lit(x) for x in SERVICE_ORDER]), F.col("node_type"))
    return nodes.where(keep).withColumns({"layer_order": layer, "type_order": service})


def distinct_texts(docs: DataFrame, text: Column) -> DataFrame:
    """(text_hash, normalized_text, n_uses): every distinct normalized text once, keyed by its hash."""
    hashed = docs.select(text_hash(text).alias("text_hash"), normalize_semantic_text(text).alias("normalized_text"))
    return hashed.groupBy("text_hash").agg(F.first("normalized_text").alias("normalized_text"), F.count(F.lit(1)).alias("n_uses"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "id", content: str = "content_hash") -> DataFrame:
    """(key, status): reused, changed, new or removed; one co-partitioned full join."""
    a = old.select(F.col(key), F.col(content).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(F.col(key), F.col(content).alias("_new"), F.lit(True).alias("_in_new"))
    status = F.when(F.col("_in_old").isNull(), "new").when(F.col("_in_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "reused").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest version of each key of both; the fresh row wins a tie."""
    both = stored.withColumn("_side", F.lit(0)).unionByName(fresh.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), F.desc("_side"))
    return both.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).drop("_rank", "_side")


def sweep(stored: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows that the current snapshot still has."""
    return stored.join(seen.select(*keys).distinct(), keys, "left_semi")


def unreferenced(texts: DataFrame, uses: DataFrame, key: str = "text_hash") -> DataFrame:
    """Texts that nothing refers to any more."""
    return texts.join(uses.select(key).distinct(), key, "left_anti")


def pending_embeddings(texts: DataFrame, cache: DataFrame, model: str, profile: str) -> DataFrame:
    """Texts without a vector of this model and profile; nulls never match."""
    done = cache.where((F.col("model_name") == model) & (F.col("embedding_profile_version") == profile) & F.col("embedding").isNotNull()).select("text_hash").distinct()
    return texts.join(done, "text_hash", "left_anti")


def reusable_embeddings(texts: DataFrame, cache: DataFrame, model: str, profile: str) -> DataFrame:
    """One row: cached vectors of the texts and whether they agree in dimension."""
    hit = cache.where((F.col("model_name") == model) & (F.col("embedding_profile_version") == profile)).join(texts.select("text_hash").distinct(), "text_hash", "left_semi")
    return hit.agg(F.count(F.lit(1)).alias("n"), F.min("dimensions").alias("least"), F.max("dimensions").alias("most"), (F.min("dimensions") == F.max("dimensions")).alias("consistent"))


def vectorize(texts: DataFrame, cache: DataFrame, encoder, model: str, profile: str, dimensions: int) -> DataFrame:
    """The cache with vectors of all texts: only pending texts are encoded. The encoder is an Arrow UDF of text."""
    fresh = pending_embeddings(texts, cache, model, profile).select(
        "text_hash", F.lit(model).alias("model_name"), F.lit(profile).alias("embedding_profile_version"), F.lit(dimensions).alias("dimensions"), encoder(F.col("normalized_text")).alias("embedding")
    )
    checked = fresh.withColumn("embedding", F.when(F.size("embedding") == F.col("dimensions"), F.col("embedding")))
    return cache.select(*checked.columns).unionByName(checked)


def latest_run(runs: DataFrame, priority: tuple[str, ...] = ("running", "interrupted", "failed", "completed")) -> DataFrame:
    """For each signature the run to go on with: by status, then the latest update."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("status")), F.lit(0)), F.lit(99))
    order = Window.partitionBy("signature").orderBy(place, F.desc("updated_at"), "run_id")
    return runs.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).drop("_rank")


def signature(files: DataFrame, group: list[str]) -> DataFrame:
    """(group, signature): a hash of the ordered descriptors of all files of a group."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in files.columns if c not in group])))
    return files.groupBy(*group).agg(F.sha2(F.to_json(rows), 256).alias("signature"))


def dedup_counters(docs: DataFrame, text: Column) -> DataFrame:
    """One row: segments, distinct texts and how many repetitions they save."""
    return docs.agg(F.count(F.lit(1)).alias("n_segments"), F.count_distinct(text_hash(text)).alias("n_unique")).withColumn("n_deduplicated", F.col("n_segments") - F.col("n_unique"))


def reuse_by_content(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with their stored vector, rows that must be computed): vectors are taken over where layer, node and content hash, or
    whatever ``keys`` name, are the same. A key that is stored several times gives its vector once."""
    once = stored.where(F.col("embedding").isNotNull()).groupBy(*keys).agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding"))
    return wanted.join(once, keys), wanted.join(once.select(*keys), keys, "left_anti")


def eligible_counts(nodes: DataFrame, types: dict[str, list[str]]) -> DataFrame:
    """(graph_layer, node_type, n, n_without_text) of the nodes that are embedded."""
    return eligible_nodes(nodes, types).groupBy("graph_layer", "node_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.trim("search_text"), F.lit("")) == "").alias("n_without_text")
    )


def next_chunk(texts: DataFrame, after: str, size: int, key: str = "text_hash") -> DataFrame:
    """The next ``size`` texts behind a key, in its order: resumable work in deterministic chunks."""
    return texts.where(F.col(key) > after).orderBy(key).limit(size)


# States of a run and what may follow each.
RUN_STATES = {"running": ("running", "interrupted", "failed", "completed"), "interrupted": ("running", "failed"), "failed": ("running",), "completed": ()}


def run_states(log: DataFrame) -> DataFrame:
    """(run_id, status, n_steps, n_invalid, updated_at): the state of each run after its log (run_id, seq, status, at) of bounded length.

    The log is append-only; a step that may not follow the state before is counted and ignored."""
    allowed = F.create_map(*[x for state, after in RUN_STATES.items() for x in (F.lit(state), F.array(*[F.lit(a) for a in after]).cast("array<string>"))])
    steps = F.array_sort(F.collect_list(F.struct("seq", "status", "at")))
    start = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).cast("bigint").alias("n_invalid"), F.lit(None).cast("timestamp").alias("updated_at"))

    def follow(state: Column, step: Column) -> Column:
        valid = F.when(state["status"].isNull(), step["status"] == "running").otherwise(F.coalesce(F.array_contains(F.element_at(allowed, state["status"]), step["status"]), F.lit(False)))
        moved = F.struct(step["status"].alias("status"), state["n_invalid"].alias("n_invalid"), step["at"].cast("timestamp").alias("updated_at"))
        return F.when(valid, moved).otherwise(F.struct(state["status"].alias("status"), (state["n_invalid"] + 1).alias("n_invalid"), state["updated_at"].alias("updated_at")))

    folded = log.groupBy("run_id").agg(steps.alias("steps")).withColumn("s", F.aggregate("steps", start, follow))
    return folded.select("run_id", "s.status", F.size("steps").cast("bigint").alias("n_steps"), "s.n_invalid", "s.updated_at")


def collection_stats(rows: DataFrame, kind: Column) -> DataFrame:
    """(kind, n, n_errors) of collected rows; errors are rows of type ``collection_error``."""
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("node_type") == "collection_error").alias("n_errors"))
