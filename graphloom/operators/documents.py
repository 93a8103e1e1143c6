"""Texts made of nodes: for search, for vectors, for summaries, and the evidence shown with a result. All expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import normalize_space

# Fields that make the search text of each node type, in order.
SEARCH_FIELDS = {
    "physical_table": ("table_name", "description", "module_name", "sub_module"), "physical_column": ("table_name", "name", "description", "semantic_role"),
    "rest_resource": ("title", "name", "description"), "rest_operation": ("title", "method", "endpoint_path", "resource_name", "description"),
    "validated_rule": ("name", "description", "business_entity"), "business_entity": ("name", "description"), "functional_section": ("title", "guide_title", "page_title", "text"),
}
# Bounds of the text of an operation.
PARAMETERS, ATTRIBUTES, DESCRIPTION = 24, 32, 1200
# Fields a summary is drawn from, in order.
SUMMARY_FIELDS = ("description", "text", "summary", "search_text", "business_purpose", "meaning", "title", "qualified_name", "name")
EVIDENCE_KEYS = 6


def present(df: DataFrame, name: str) -> Column:
    """The column as text, null where the frame has none of that name."""
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def distinct_text(fields: list[Column], separator: str = " ") -> Column:
    """Non-blank fields in order, each text once, joined."""
    values = F.filter(F.array(*fields), lambda v: v.isNotNull() & (F.trim(v) != ""))
    return F.array_join(F.array_distinct(values), separator)


def search_text(df: DataFrame, node_type: str) -> Column:
    """The search text of rows of one type: its fields flattened, each text once, blanks collapsed."""
    return normalize_space(distinct_text([present(df, f) for f in SEARCH_FIELDS.get(node_type, ("title", "name", "description"))]))


def semantic_text(df: DataFrame) -> Column:
    """Title, qualified name, search text and summary, a line each."""
    return distinct_text([present(df, f) for f in ("title", "qualified_name", "search_text", "summary")], "\n")


def operation_text(df: DataFrame) -> Column:
    """Title, method and path, first parameters and attributes (arrays of names), and the start of the description."""
    names = lambda c, n: F.array_join(F.slice(F.col(c), 1, n), ", ") if c in df.columns else F.lit(None).cast("string")
    head = F.concat_ws(" ", present(df, "method"), present(df, "endpoint_path"))
    return F.concat_ws("\n", *[F.nullif(x, F.lit("")) for x in (present(df, "title"), head, names("parameters", PARAMETERS), names("attributes", ATTRIBUTES), F.left(present(df, "description"), F.lit(DESCRIPTION)))])


def summary_source(df: DataFrame) -> Column:
    """What a summary is drawn from: the textual fields, each text once."""
    return distinct_text([present(df, f) for f in SUMMARY_FIELDS], "\n")


def with_search_text(nodes: DataFrame, node_type: str) -> DataFrame:
    """Graph migration: search text and type made anew from the fields, whatever was stored."""
    return nodes.withColumn("node_type", F.lit(node_type)).withColumn("search_text", search_text(nodes, node_type))


def table_evidence(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, primary_key, grain, references): the payload of a table as evidence, with its first references by target.

    ``tables`` (id, primary_key, grain), ``edges`` with foreign keys (source, target). A table has a bounded number of keys."""
    keys = edges.where(F.col("type") == "foreign_key_to").select(F.col("source").alias("id"), "target").distinct()
    first = keys.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("target")), 1, EVIDENCE_KEYS).alias("references"))
    joined = tables.select("id", "primary_key", "grain").join(first, "id", "left")
    return joined.withColumn("references", F.coalesce("references", F.array().cast("array<string>")))


def configured(value: Column) -> Column:
    """Whether a list of configured values holds anything that is not blank."""
    return F.coalesce(F.exists(value, lambda v: v.isNotNull() & (F.trim(v) != "")), F.lit(False))


def public_fields(rows: DataFrame) -> DataFrame:
    """Rows without internal columns (a leading underscore)."""
    return rows.select(*[c for c in rows.columns if not c.startswith("_")])


