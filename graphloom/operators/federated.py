"""Federated retrieval: seeds in the routing graph, bridges to the layers, fallbacks, expansions, one merge.

All steps take many queries at once, keyed by ``query_id``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEEDS, SEED_FLOOR = 12, 0.10
FALLBACK_ROOTS, COLUMNS_EACH, QUESTIONS_EACH, OPERATIONS_EACH, OPERATION_CANDIDATES = 3, 5, 2, 3, 16
# Bridge types that each kind of seed follows, with the added score.
BRIDGES = {
    "business_attribute": (("mapped_to_attribute", "uses_column"), 0.90),
    "business_entity": (("mapped_to_entity", "uses_table", "uses_column"), 0.85),
    "validated_rule": (("uses_table", "uses_column"), 0.90),
}


def master_seeds(scores: DataFrame) -> DataFrame:
    """(query_id, id, node_type, seed_rank, seed_score) of ``scores`` (query_id, id, node_type, title, score): at most 12, none
    below a tenth of the best; the score is one over the rank."""
    whole, order = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy(F.desc("score"), "title", "id")
    ranked = scores.withColumn("seed_rank", F.row_number().over(order)).where(F.col("seed_rank") <= SEEDS)
    near = ranked.withColumn("best", F.max("score").over(whole)).where(F.col("score") >= SEED_FLOOR * F.col("best"))
    return near.select("query_id", "id", "node_type", "seed_rank", (1.0 / F.col("seed_rank")).alias("seed_score"))


def routes(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, node, score, reason): what the seeds lead to, the best score of each node."""
    itself = seeds.select("query_id", F.col("id").alias("node"), (1.0 + F.col("seed_score")).alias("score"), F.lit("seed").alias("reason"))
    ends = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "type").unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"), "type"))
    parts = [itself]
    attributes = seeds.where(F.col("node_type") == "business_attribute")
    parents = edges.where(F.col("type") == "has_attribute").select(F.col("target").alias("id"), F.col("source").alias("node"))
    parts.append(attributes.join(parents, "id").select("query_id", "node", (0.95 + F.col("seed_score")).alias("score"), F.lit("attribute_parent").alias("reason")))
    for kind, (types, base) in BRIDGES.items():
        step = ends.where(F.col("type").isin(*types)).select(F.col("a").alias("id"), F.col("b").alias("node"))
        parts.append(seeds.where(F.col("node_type") == kind).join(step, "id").select("query_id", "node", (base + F.col("seed_score")).alias("score"), F.lit("bridge").alias("reason")))
    found = reduce(DataFrame.unionByName, parts)
    variant = ends.where(F.col("type") == "environment_variant_of").select(F.col("a").alias("node"), F.col("b").alias("other"))
    varied = found.join(variant, "node").select("query_id", F.col("other").alias("node"), F.greatest(F.lit(0.70), 0.82 * F.col("score")).alias("score"), F.lit("environment_variant").alias("reason"))
    order = Window.partitionBy("query_id", "node").orderBy(F.desc("score"), "reason")
    return found.unionByName(varied).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).drop("_rank")


def fallback_roots(routed: DataFrame, roots: DataFrame, queries: DataFrame, layers: list[str]) -> DataFrame:
    """(query_id, node, score, reason): for layers that no route reaches, their 3 best roots by similarity.

    ``routed`` (query_id, graph_layer), ``roots`` (query_id, graph_layer, node, similarity), ``queries`` (query_id)."""
    wanted = queries.select("query_id").distinct().withColumn("graph_layer", F.explode(F.array(*[F.lit(x) for x in layers])))
    missing = wanted.join(routed.select("query_id", "graph_layer").distinct(), ["query_id", "graph_layer"], "left_anti")
    order = Window.partitionBy("query_id", "graph_layer").orderBy(F.desc("similarity"), "node")
    best = roots.join(missing, ["query_id", "graph_layer"], "left_semi").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= FALLBACK_ROOTS)
    return best.select("query_id", "graph_layer", "node", (0.70 + 0.20 * F.col("similarity")).alias("score"), F.lit("fallback").alias("reason"))


def expand_children(parents: DataFrame, edges: DataFrame, similarity: DataFrame, edge_type: str, each: int, base: float, reason: str, candidates: int | None = None) -> DataFrame:
    """(query_id, node, score, reason): for each parent (query_id, node) its ``each`` most similar children.

    ``similarity`` (query_id, node, similarity, title). ``candidates`` bounds the children that are scored, by title,
    before similarity is looked up; both limits act on the map side."""
    links = edges.where(F.col("type") == edge_type).select(F.col("source").alias("node"), F.col("target").alias("child"))
    linked = parents.select("query_id", "node").distinct().join(links, "node")
    scored = linked.join(similarity.select("query_id", F.col("node").alias("child"), "similarity", "title"), ["query_id", "child"], "left")
    if candidates:
        first = Window.partitionBy("query_id", "node").orderBy(F.col("similarity").isNull().asc(), F.desc_nulls_last("similarity"), "title", "child")
        scored = scored.withColumn("_c", F.row_number().over(first)).where(F.col("_c") <= candidates).drop("_c")
    order = Window.partitionBy("query_id", "node").orderBy(F.desc_nulls_last("similarity"), "title", "child")
    top = scored.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= each)
    return top.select("query_id", F.col("child").alias("node"), (base + 0.20 * F.coalesce("similarity", F.lit(0.0))).alias("score"), F.lit(reason).alias("reason"))


def expand_physical(routed: DataFrame, edges: DataFrame, similarity: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node, score, reason) in the physical layer: routed tables and columns, parent tables of routed columns,
    the most similar columns of tables without a routed column, tables that foreign keys reach."""
    typed = routed.join(nodes.select(F.col("id").alias("node"), "node_type"), "node")
    tables, columns = typed.where(F.col("node_type") == "physical_table"), typed.where(F.col("node_type") == "physical_column")
    contains = edges.where(F.col("type") == "contains_column").select(F.col("source").alias("table"), F.col("target").alias("node"))
    explicit = columns.join(contains, "node").select("query_id", F.col("table").alias("node")).distinct()
    parent = explicit.select("query_id", "node", F.lit(0.90).alias("score"), F.lit("parent_table").alias("reason"))
    direct = typed.where(F.col("node_type").isin("physical_table", "physical_column")).select("query_id", "node", F.lit(0.95).alias("score"), F.lit("bridge").alias("reason"))
    plain = tables.select("query_id", "node").join(explicit, ["query_id", "node"], "left_anti")
    semantic = expand_children(plain, edges, similarity, "contains_column", COLUMNS_EACH, 0.70, "semantic_column")
    reach = tables.select("query_id", "node").unionByName(parent.select("query_id", "node")).distinct()
    keys = edges.where(F.col("type") == "foreign_key_to").select(F.col("source").alias("node"), F.col("target").alias("other"))
    foreign = reach.join(keys, "node").select("query_id", F.col("other").alias("node"), F.lit(0.82).alias("score"), F.lit("foreign_key").alias("reason")).distinct()
    return reduce(DataFrame.unionByName, [direct, parent, semantic, foreign])


def merge_candidates(parts: list[DataFrame]) -> DataFrame:
    """(query_id, node, score, reason, priority, rank): each node once, by priority, then score.

    Priorities: 0 business, 1 routed, 2 bridge or fallback, 3 others; ``parts`` have query_id, node, score, reason, priority."""
    every = reduce(DataFrame.unionByName, parts)
    best = Window.partitionBy("query_id", "node").orderBy("priority", F.desc("score"), "reason")
    once = every.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") == 1).drop("_rank")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("priority", F.desc("score"), "node")))


def expand_analytics(routed: DataFrame, edges: DataFrame, similarity: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node, score, reason) in the analytics layer: routed subject areas, and of each its most similar questions.

    Questions point to their subject by ``answered_by``; ``similarity`` (query_id, node, similarity, title)."""
    subjects = routed.join(nodes.where(F.col("node_type") == "subject_area").select(F.col("id").alias("node")), "node", "left_semi").select("query_id", "node").distinct()
    direct = subjects.select("query_id", "node", F.lit(0.95).alias("score"), F.lit("bridge").alias("reason"))
    asked = edges.where(F.col("type") == "answered_by").select(F.col("target").alias("source"), F.col("source").alias("target"), "type")
    return direct.unionByName(expand_children(subjects, asked, similarity, "answered_by", QUESTIONS_EACH, 0.65, "semantic_question"))
