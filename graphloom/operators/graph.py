"""The property graph: merging nodes and edges, resolving references, layers, routing graph, propagation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import merge_text, normalize_text

# Default weights of edge types, 0.6 for others.
EDGE_WEIGHTS = {
    "contains_column": 1.0, "foreign_key_to": 1.0, "incoming_foreign_key_from": 0.9, "uses_table": 1.0, "uses_column": 1.0, "answered_by": 1.0,
    "has_operation": 0.95, "parent_of": 0.85, "environment_variant_of": 1.0, "mapped_to_entity": 1.0, "mentions_table": 0.8, "mentions_entity": 0.7,
    "related_by_alias": 0.75, "has_attribute": 1.0, "mapped_to_attribute": 1.0,
}
DEFAULT_WEIGHT = 0.6
# Layer of each node type.
NODE_LAYERS = {
    "business_entity": "business", "business_attribute": "business", "validated_rule": "business", "functional_section": "business",
    "physical_table": "physical", "physical_table_stub": "physical", "physical_column": "physical",
    "subject_area": "analytics", "business_question": "analytics",
    "rest_resource": "service", "rest_operation": "service", "environment_resource": "service",
}
CORE_TYPES = ("business_entity", "business_attribute", "validated_rule")
MASTER_EDGES = ("has_attribute", "mapped_to_entity", "mapped_to_attribute", "uses_table", "uses_column", "environment_variant_of")
EXCLUDED_EDGES = ("mentions_entity", "related_by_alias", "incoming_foreign_key_from")


def edge_weight(edge_type: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in EDGE_WEIGHTS.items() for x in kv])
    return F.coalesce(weights[edge_type], F.lit(DEFAULT_WEIGHT))


def node_layer(node_type: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in NODE_LAYERS.items() for x in kv])[node_type]


def merge_nodes(sources: list[DataFrame], scalars: list[str], lists: list[str]) -> DataFrame:
    """Nodes of several sources (id, load_seq, confidence_score, search_text, ...) as one row for each id:
    lists united in order, the first non-empty scalar, the greatest confidence, texts joined in load order.

    One aggregate; the struct of (load_seq, value) makes the outcome independent of partition order."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    first = lambda c: F.min(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct("load_seq", F.col(c).alias("v"))))["v"].alias(c)
    gathered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("load_seq", F.coalesce(F.col(c), F.array().cast("array<string>")).alias("v")))), lambda s: s["v"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("load_seq", F.coalesce("search_text", F.lit("")).alias("v")))), lambda s: s["v"])
    return every.groupBy("id").agg(
        *[first(c) for c in scalars],
        *[F.array_distinct(F.filter(F.flatten(gathered(c)), lambda v: v.isNotNull() & (v != ""))).alias(c) for c in lists],
        F.max("confidence_score").alias("confidence_score"),
        merge_text(F.array_join(texts, " ")).alias("search_text"),
    )


def merge_edges(edges: DataFrame, nodes: DataFrame | None = None, keep_all_evidence: bool = False) -> DataFrame:
    """One edge for each (source, target, type), the last loaded wins; edges without an end are dropped.

    ``keep_all_evidence`` keeps the evidence of all of them as a list in load order."""
    keys = ["source", "target", "type"]
    last = F.max_by("weight", "load_seq").alias("weight")
    if keep_all_evidence:
        evidence = F.transform(F.array_sort(F.collect_list(F.struct("load_seq", "evidence"))), lambda s: s["evidence"]).alias("evidence")
    else:
        evidence = F.max_by("evidence", "load_seq").alias("evidence")
    merged = edges.groupBy(*keys).agg(last, evidence)
    if nodes is not None:
        merged = with_both_ends(merged, nodes)
    return merged


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
    right = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    return left.select(*edges.columns).unionByName(right.select(*edges.columns)).distinct()


def resolve_references(references: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, stubs) of references (source_table, source_column, target_table, target_column): targets that no
    table has become stub nodes, so that every reference has its edge whatever the order of loading."""
    known = tables.select(F.upper("table_name").alias("target_table")).distinct()
    wanted = references.withColumn("target_table", F.upper("target_table"))
    stubs = wanted.select("target_table").distinct().join(known, "target_table", "left_anti").select(
        F.concat(F.lit("physical_table:"), "target_table").alias("id"), F.lit("physical_table_stub").alias("node_type"), F.col("target_table").alias("table_name")
    )
    edges = wanted.select(
        F.concat(F.lit("physical_table:"), F.upper("source_table")).alias("source"), F.concat(F.lit("physical_table:"), "target_table").alias("target"),
        F.lit("foreign_key_to").alias("type"), edge_weight(F.lit("foreign_key_to")).alias("weight"), "source_column", "target_column",
    )
    return edges, stubs


def match_names(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """(left_id, right_id): nodes of the same normalized name; those of the same module only, where there are such.

    ``left`` and ``right`` have id, modules and the named column."""
    a = left.select(F.col("id").alias("left_id"), F.col("modules").alias("left_modules"), normalize_text(left_name).alias("key")).where(F.col("key") != "")
    b = right.select(F.col("id").alias("right_id"), F.col("modules").alias("right_modules"), normalize_text(right_name).alias("key")).where(F.col("key") != "")
    pairs = a.join(b, "key").withColumn("same", F.coalesce(F.arrays_overlap("left_modules", "right_modules"), F.lit(False)))
    best = F.max("same").over(Window.partitionBy("left_id"))
    return pairs.withColumn("any_same", best).where(F.col("same") | ~F.col("any_same")).select("left_id", "right_id").distinct()


def bridge(df: DataFrame, source: Column, values: Column, targets: DataFrame, target_name: str, edge_type: str) -> DataFrame:
    """Edges from each row of ``df`` to the nodes that an array of names mentions."""
    named = df.select(source.alias("source"), F.explode(values).alias("name")).select("source", F.upper(F.trim("name")).alias("name")).where(F.col("name") != "").distinct()
    ids = targets.select(F.upper(F.trim(target_name)).alias("name"), F.col("id").alias("target")).distinct()
    return named.join(ids, "name").select("source", "target", F.lit(edge_type).alias("type"), edge_weight(F.lit(edge_type)).alias("weight"))


def split_layers(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their layer (others dropped) and the edges whose ends share a layer, excluded types removed."""
    layered = nodes.withColumn("graph_layer", node_layer(F.col("node_type"))).where(F.col("graph_layer").isNotNull())
    ends = layered.select("id", "graph_layer")
    kept = (
        edges.where(~F.col("type").isin(*EXCLUDED_EDGES))
        .join(ends.select(F.col("id").alias("source"), F.col("graph_layer").alias("source_layer")), "source")
        .join(ends.select(F.col("id").alias("target"), F.col("graph_layer").alias("target_layer")), "target")
    )
    return layered, kept.where(F.col("source_layer") == F.col("target_layer")).withColumn("graph_layer", F.col("source_layer"))


def master_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The routing graph: core nodes, what bridge edges tie to them, and environment variants of the included."""
    core = nodes.where(F.col("node_type").isin(*CORE_TYPES)).select("id")
    bridges = edges.where(F.col("type").isin(*MASTER_EDGES))
    seed = core.select(F.col("id").alias("seed"))
    touching = bridges.join(seed, bridges["source"] == seed["seed"], "left_semi").unionByName(bridges.join(seed, bridges["target"] == seed["seed"], "left_semi")).distinct()
    included = core.unionByName(touching.select(F.col("source").alias("id"))).unionByName(touching.select(F.col("target").alias("id"))).distinct()
    variants = bridges.where(F.col("type") == "environment_variant_of")
    seen = included.withColumnRenamed("id", "seen")
    extra = variants.join(seen, variants["source"] == seen["seen"], "left_semi").unionByName(variants.join(seen, variants["target"] == seen["seen"], "left_semi")).distinct()
    final_edges = touching.unionByName(extra).distinct()
    final_ids = included.unionByName(extra.select(F.col("source").alias("id"))).unionByName(extra.select(F.col("target").alias("id"))).distinct()
    return nodes.join(final_ids, "id", "left_semi"), final_edges


def adjacency(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, with a flag for the reverse one."""
    weight = F.coalesce("weight", F.lit(DEFAULT_WEIGHT)).alias("weight")
    forward = edges.select(F.col("source").alias("from_id"), F.col("target").alias("to_id"), "type", weight, F.lit(False).alias("reverse"))
    return forward.unionByName(edges.select(F.col("target").alias("from_id"), F.col("source").alias("to_id"), "type", weight, F.lit(True).alias("reverse")))


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 2, decay: float = 0.68) -> DataFrame:
    """Scores that seeds (id, score) spread over at most ``hops`` edges: each edge multiplies by decay and weight,
    a node takes the best over seeds and paths.

    One join and one max for each hop. Weights are not negative, so the best path of each length is enough;
    parallel edges are reduced to the strongest beforehand, and seeds merge into one score for each node, which
    keeps the frontier at one row for each node."""
    strongest = adjacency(edges).groupBy("from_id", "to_id").agg(F.max("weight").alias("weight"))
    front = seeds.groupBy(F.col("id").alias("node")).agg(F.max("score").alias("score"))
    reached = []
    for _ in range(hops):
        front = front.join(strongest, front["node"] == strongest["from_id"]).groupBy(F.col("to_id").alias("node")).agg(F.max(F.col("score") * decay * F.col("weight")).alias("score"))
        reached.append(front)
    return reduce(DataFrame.unionByName, reached).groupBy("node").agg(F.max("score").alias("graph_score"))


def expansion_paths(seeds: DataFrame, edges: DataFrame, hops: int = 2, decay: float = 0.68, keep: int = 3) -> DataFrame:
    """The best ``keep`` paths to each node: (node, rank, score, path of node ids)."""
    near = adjacency(edges).groupBy("from_id", "to_id").agg(F.max("weight").alias("weight"))
    front = seeds.select(F.col("id").alias("node"), "score", F.array("id").alias("path"))
    reached = []
    for _ in range(hops):
        step = front.join(near, front["node"] == near["from_id"]).where(~F.array_contains("path", F.col("to_id")))
        front = step.select(F.col("to_id").alias("node"), (F.col("score") * decay * F.col("weight")).alias("score"), F.array_append("path", F.col("to_id")).alias("path"))
        front = _best_paths(front, keep).drop("rank")
        reached.append(front)
    return _best_paths(reduce(DataFrame.unionByName, reached), keep)


def _best_paths(paths: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("node").orderBy(F.desc("score"), F.array_join("path", "\x1f"))
    return paths.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): counts by node type, edge type, module and layer, each in one pass."""
    n = F.count(F.lit(1)).alias("n")
    count = lambda df, kind, column: df.groupBy(column.alias("name")).agg(n).select(F.lit(kind).alias("kind"), "name", "n")
    parts = [
        count(nodes, "node_type", F.col("node_type")), count(edges, "edge_type", F.col("type")),
        count(nodes.select(F.explode("modules").alias("m")), "module", F.col("m")), count(nodes, "layer", node_layer(F.col("node_type"))).where("name IS NOT NULL"),
    ]
    return reduce(DataFrame.unionByName, parts)


def nodes_by_id(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the asked ids (id)."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def linked_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame, edge_type: str, parents: bool = False) -> DataFrame:
    """(origin, node columns): what edges of one type lead to from ``ids`` (id), children or parents."""
    here, there = ("target", "source") if parents else ("source", "target")
    step = edges.where(F.col("type") == edge_type).select(F.col(here).alias("origin"), F.col(there).alias("id"))
    return step.join(ids.select(F.col("id").alias("origin")).distinct(), "origin", "left_semi").join(nodes, "id")


def project_modules(resources: DataFrame, projection: DataFrame) -> DataFrame:
    """``resources`` (id, name, modules) with the modules that ``projection`` (name, module_id) gives to their name, beside their own."""
    given = projection.where(F.col("module_id").isNotNull()).groupBy(F.lower(F.trim("name")).alias("key")).agg(F.array_sort(F.collect_set("module_id")).alias("given"))
    own = F.coalesce("modules", F.array().cast("array<string>"))
    joined = resources.withColumn("key", F.lower(F.trim("name"))).join(given, "key", "left")
    return joined.withColumn("modules", F.array_sort(F.array_distinct(F.concat(own, F.coalesce("given", F.array().cast("array<string>")))))).drop("key", "given")


def variant_edges(documented: DataFrame, environment: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, environment nodes with inherited modules): documented resources (id, name, modules) and those of an environment (id, name)
    of the same normalized name."""
    key = normalize_text("name").alias("key")
    named = documented.select(F.col("id").alias("source"), "modules", key).where(F.col("key") != "")
    found = environment.select("id", "name", key).join(named, "key", "left")
    edges = found.where(F.col("source").isNotNull()).select("source", F.col("id").alias("target"), F.lit("environment_variant_of").alias("type"), edge_weight(F.lit("environment_variant_of")).alias("weight")).distinct()
    modules = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("modules", F.array().cast("array<string>"))))))
    return edges, found.groupBy("id", "name").agg(modules.alias("modules"))


def answered_edges(questions: DataFrame, subjects: DataFrame) -> DataFrame:
    """Edges from questions (id, subject) to the subject areas (id, name) that answer them, by normalized name."""
    asked = questions.select(F.col("id").alias("source"), normalize_text("subject").alias("key")).where(F.col("key") != "")
    named = subjects.select(F.col("id").alias("target"), normalize_text("name").alias("key")).where(F.col("key") != "")
    return asked.join(named, "key").select("source", "target", F.lit("answered_by").alias("type"), edge_weight(F.lit("answered_by")).alias("weight")).distinct()


def without_legacy(edges: DataFrame) -> DataFrame:
    """Edges without the types that earlier graphs held."""
    return edges.where(~F.col("type").isin(*EXCLUDED_EDGES))
