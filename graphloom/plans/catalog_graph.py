"""The property graph of the catalog tables: one node frame and one edge frame, from declared sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import confidence_score
from graphloom.operators.graph import bridge, edge_weight, resolve_references, with_both_ends
from graphloom.sources.files import without_errors
from graphloom.sources.tables import cut_lineage, read_table

#: Tables whose rows may be deleted.
DELETABLE = ("physical_table", "physical_column", "rest_resource")
NODE_COLUMNS = ["id", "node_type", "title", "name", "qualified_name", "object_name", "search_text", "modules", "aliases", "confidence_score", "source_type"]


def _node(df: DataFrame, node_type: str, **columns) -> DataFrame:
    base = {"node_type": F.lit(node_type), "name": F.lit(None).cast("string"), "qualified_name": F.lit(None).cast("string"), "object_name": F.lit(None).cast("string"),
            "aliases": F.array().cast("array<string>"), "confidence_score": F.lit(0.6), "source_type": F.lit("data_dictionary")} | columns
    # re-delivered and re-collected rows repeat key and content
    return df.select(*[base[c].alias(c) for c in NODE_COLUMNS]).dropDuplicates(["id"])


def live(spark, root: str, name: str) -> DataFrame:
    """The latest version of each row of a catalog table that is not deleted."""
    order = Window.partitionBy("id").orderBy(F.col("loaded_at").desc_nulls_last())
    latest = read_table(spark, root, name).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") == 1)
    return latest.where(F.col("deleted_at").isNull()).drop("_nth")


def documented_references(spark, root: str) -> DataFrame:
    """(source_table, source_column, target_table, target_column) of the joins of the rules, where both sides name a column."""
    joins = read_table(spark, root, "validated_rules").select(F.explode("joins").alias("j")).select(F.split(F.upper(F.trim("j.left")), "[.]").alias("l"), F.split(F.upper(F.trim("j.right")), "[.]").alias("r"))
    joins = joins.where((F.size("l") == 2) & (F.size("r") == 2))
    names = (("source_table", "l", 1), ("source_column", "l", 2), ("target_table", "r", 1), ("target_column", "r", 2))
    return joins.select(*[F.element_at(side, i).alias(n) for n, side, i in names]).distinct()


def nodes(spark, root: str) -> DataFrame:
    t = lambda name: live(spark, root, name) if name in DELETABLE else read_table(spark, root, name)
    c = F.col
    modules = F.array(c("module_id"))
    _, stubs = resolve_references(documented_references(spark, root), t("physical_table"))
    return reduce(DataFrame.unionByName, [
        _node(stubs.withColumn("module_id", F.lit(None).cast("string")), "physical_table_stub", id=c("id"), title=c("table_name"), name=c("table_name"), object_name=c("table_name"), search_text=c("table_name"), modules=F.array().cast("array<string>"), confidence_score=F.lit(0.3)),
        _node(t("physical_table"), "physical_table", id=c("id"), title=c("table_name"), name=c("table_name"), object_name=c("table_name"), search_text=F.concat_ws(" ", "table_name", "description"), modules=modules),
        _node(t("physical_column"), "physical_column", id=c("id"), title=F.concat_ws(".", "table_name", "name"), name=c("name"), qualified_name=F.concat_ws(".", "table_name", "name"), object_name=c("table_name"), search_text=F.concat_ws(" ", "table_name", "name", "description"), modules=modules),
        _node(t("rest_resource"), "rest_resource", id=c("id"), title=c("title"), name=c("name"), search_text=F.concat_ws(" ", "title", "description"), modules=modules, confidence_score=confidence_score("confidence"), source_type=c("source.source_type")),
        _node(t("rest_operation"), "rest_operation", id=c("id"), title=c("title"), search_text=F.concat_ws(" ", "title", "method", "endpoint_path", "description"), modules=modules, confidence_score=confidence_score("confidence"), source_type=c("source.source_type")),
        _node(t("validated_rules"), "validated_rule", id=F.concat(F.lit("validated_rule:"), "id"), title=c("name"), name=c("name"), search_text=F.concat_ws(" ", "name", "description"), modules=modules, confidence_score=confidence_score("confidence"), source_type=F.lit("validated_rule")),
        _node(t("entity_aliases"), "business_entity", id=F.concat(F.lit("business_entity:"), "entity_id"), title=c("name"), name=c("name"), search_text=F.concat_ws(" ", "name", "description"), modules=modules, aliases=F.coalesce("aliases", F.array().cast("array<string>")), source_type=F.lit("entity_map")),
        _node(without_errors(t("functional_section")), "functional_section", id=c("id"), title=F.coalesce("title", F.lit("")), search_text=F.concat_ws(" ", "title", "text"), modules=modules, confidence_score=confidence_score("confidence"), source_type=c("source.source_type")),
    ])


def edges(spark, root: str) -> DataFrame:
    """Edges of the catalog, each (source, target, type) once; the ends exist by the joins that make them, except the
    source of a foreign key, which ``graph`` checks."""
    t = lambda name: live(spark, root, name) if name in DELETABLE else read_table(spark, root, name)
    foreign, _ = resolve_references(documented_references(spark, root), t("physical_table"))
    tables = t("physical_table").select("id", "table_name").distinct()
    columns = t("physical_column").select("id", "table_name", "name", F.concat_ws(".", "table_name", "name").alias("full_name")).distinct()
    resources = t("rest_resource").select("id", "name", "parent_resource").distinct()
    rules, entities = t("validated_rules"), t("entity_aliases")
    key = lambda c: F.upper(F.trim(c))
    typed = lambda df, kind: df.select("source", "target", F.lit(kind).alias("type"), edge_weight(F.lit(kind)).alias("weight"))
    contains = columns.join(tables.select(F.col("id").alias("source"), "table_name"), "table_name").select("source", F.col("id").alias("target"))
    named = resources.select(F.col("id").alias("source"), key("name").alias("key"))
    operations = t("rest_operation").select(F.col("id").alias("target"), key("resource_name").alias("key")).distinct().join(named, "key")
    parents = resources.select(F.col("id").alias("target"), key("parent_resource").alias("key")).join(named, "key").where(F.col("source") != F.col("target"))
    rule_id, entity_id = F.concat(F.lit("validated_rule:"), "id"), F.concat(F.lit("business_entity:"), "entity_id")
    rule_names = rules.select(rule_id.alias("id"), F.col("id").alias("name")).distinct()
    parts = [
        foreign.select("source", "target", "type", "weight"), typed(contains, "contains_column"), typed(operations, "has_operation"), typed(parents, "parent_of"),
        bridge(rules, rule_id, F.col("tables"), tables, "table_name", "uses_table"), bridge(rules, rule_id, F.col("columns"), columns, "full_name", "uses_column"),
        bridge(entities, entity_id, F.col("tables"), tables, "table_name", "mapped_to_entity"), bridge(entities, entity_id, F.col("rest_resources"), resources, "name", "mapped_to_entity"),
        bridge(entities, entity_id, F.col("validated_rules"), rule_names, "name", "mapped_to_entity"),
        bridge(without_errors(t("functional_section")), F.col("id"), F.col("table_mentions"), tables, "table_name", "mentions_table"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def graph(spark, root: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, each computed once and kept in the shared folder: every graph operator reads them several times."""
    n = cut_lineage(nodes(spark, root))
    return n, cut_lineage(with_both_ends(edges(spark, root), n))
