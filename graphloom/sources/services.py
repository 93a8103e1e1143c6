"""Service documentation and environment metadata as frames: operations, resources, attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import normalize_space, normalize_text, text_of

# HTTP methods, and words that titles start with instead.
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE")
TITLE_METHODS = {"get": "GET", "list": "GET", "create": "POST", "add": "POST", "update": "PATCH", "replace": "PUT", "delete": "DELETE", "remove": "DELETE"}
#: Shape of an environment's describe document.
DESCRIBE = (
    "Resources map<string, struct<title:string, attributes:array<struct<name:string,type:string,title:string,mandatory:boolean,queryable:boolean,maxLength:int>>,"
    " children:map<string, struct<title:string>>>>"
)


def http_method(title: Column, text: Column) -> Column:
    """The method a page documents, else what its title suggests."""
    stated = F.nullif(F.regexp_extract(text_of(text), rf"\b({'|'.join(METHODS)})\s+/", 1), F.lit(""))
    word = F.element_at(F.split(F.lower(normalize_space(title)), " "), 1)
    guess = F.create_map(*[F.lit(x) for kv in TITLE_METHODS.items() for x in kv])[word]
    return F.coalesce(stated, guess)


def endpoint_path(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text_of(text), rf"(?:{'|'.join(METHODS)})\s+(/\S+)", 1), F.lit(""))


def resource_of_path(path: Column) -> Column:
    """The path segment behind the version, or the last one that is no parameter."""
    versioned = F.nullif(F.regexp_extract(path, r"/(?:v?\d+(?:\.\d+)*|latest)/([A-Za-z][A-Za-z0-9_-]*)", 1), F.lit(""))
    plain = F.filter(F.split(path, "/"), lambda p: (p != "") & ~F.startswith(p, F.lit("{")))
    return F.coalesce(versioned, F.try_element_at(plain, F.lit(-1)))


def hierarchy(section_path: Column, ignored: tuple[str, ...] = ("rest endpoints", "all rest endpoints", "tasks", "overview")) -> Column:
    """The resource path of a page without the parts that name no resource, each once."""
    parts = F.transform(F.coalesce(section_path, F.array().cast("array<string>")), normalize_space)
    return F.array_distinct(F.filter(parts, lambda p: (p != "") & ~normalize_text(p).isin(*ignored)))


def table_rows(sections: DataFrame, marker: str) -> DataFrame:
    """(url, name, type, description, position) of the table rows in sections whose title or path holds ``marker``."""
    where = F.contains(F.lower(F.array_join("section_path", " ")), F.lit(marker))
    rows = sections.where(where).select("url", F.posexplode(F.flatten("tables")).alias("position", "row"))
    value = lambda *keys: F.coalesce(*[F.nullif(F.trim(F.col("row")[k]), F.lit("")) for k in keys])
    return rows.select("url", value("name", "parameter", "attribute", "column_1").alias("name"), value("type", "data_type").alias("type"), value("description", "column_3", "column_2").alias("description"), "position").where("name IS NOT NULL")


def operations(sections: DataFrame) -> DataFrame:
    """One row for each page (url, title, section_path, text, list_items, tables) that documents an operation."""
    text = F.concat_ws("\n", F.array_agg(F.concat_ws("\n", "text", F.array_join("list_items", "\n"))))
    pages = sections.groupBy("url").agg(F.min_by("title", "level").alias("title"), F.min_by("section_path", "level").alias("section_path"), text.alias("text"))
    found = pages.select("url", "title", http_method(F.col("title"), F.col("text")).alias("method"), endpoint_path(F.col("text")).alias("endpoint_path"), hierarchy(F.col("section_path")).alias("hierarchy"))
    named = found.withColumn("resource_name", F.coalesce(resource_of_path(F.col("endpoint_path")), F.try_element_at("hierarchy", F.lit(-1))))
    gather = lambda rows, name: rows.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name", "type", "description"))), lambda r: F.struct(r["name"].alias("name"), r["type"].alias("type"), r["description"].alias("description"))).alias(name))
    return named.join(gather(table_rows(sections, "parameter"), "parameters"), "url", "left").join(gather(table_rows(sections, "body"), "attributes"), "url", "left")


def resource_rollup(ops: DataFrame) -> DataFrame:
    """(resource_name, n_operations, methods, endpoints) of operations."""
    return ops.where("resource_name IS NOT NULL").groupBy("resource_name").agg(
        F.count(F.lit(1)).alias("n_operations"), F.array_sort(F.collect_set("method")).alias("methods"), F.array_sort(F.collect_set("endpoint_path")).alias("endpoints")
    )


def describe_resources(documents: DataFrame) -> DataFrame:
    """Nodes of an environment's describe documents (payload STRING): resources with attributes, children and flags."""
    parsed = documents.select(F.from_json("payload", DESCRIBE).alias("d")).select(F.explode("d.Resources").alias("name", "r"))
    name = lambda a: F.lower(a["name"])
    attributes = F.transform(
        F.coalesce("r.attributes", F.array().cast("array<struct<name:string,type:string,title:string,mandatory:boolean,queryable:boolean,maxLength:int>>")),
        lambda a: F.struct(a["name"].alias("name"), a["title"].alias("title"), a["type"].alias("type"), F.endswith(name(a), F.lit("_c")).alias("is_custom"), name(a).rlike("dff|eff|flex").alias("is_flexfield")),
    )
    return parsed.select(
        F.concat(F.lit("environment_resource:"), F.lower("name")).alias("id"), F.lit("environment_resource").alias("node_type"), "name", F.coalesce("r.title", "name").alias("title"),
        F.endswith(F.lower("name"), F.lit("_c")).alias("is_custom"), attributes.alias("attributes"), F.coalesce(F.map_keys("r.children"), F.array().cast("array<string>")).alias("children"),
    )


def select_resources(resources: DataFrame, names: list[str] | None = None, include: str | None = None, exclude: str | None = None, custom_only: bool = False, limit: int | None = None) -> DataFrame:
    """Resources by exact names, patterns or custom flag; a limit takes the first by name."""
    if names:
        resources = resources.where(F.lower("name").isin(*[n.lower() for n in names]))
    if include:
        resources = resources.where(F.col("name").rlike(f"(?i){include}"))
    if exclude:
        resources = resources.where(~F.col("name").rlike(f"(?i){exclude}"))
    if custom_only:
        resources = resources.where(F.col("is_custom") | F.exists("attributes", lambda a: a["is_custom"]))
    return resources.orderBy(F.lower("name"), "name").limit(limit) if limit else resources


def environment_stats(resources: DataFrame) -> DataFrame:
    """One row: resources, attributes, custom and flexfield attributes, children."""
    return resources.agg(
        F.count(F.lit(1)).alias("n_resources"), F.sum(F.size("attributes")).alias("n_attributes"), F.sum(F.size(F.filter("attributes", lambda a: a["is_custom"]))).alias("n_custom"),
        F.sum(F.size(F.filter("attributes", lambda a: a["is_flexfield"]))).alias("n_flexfields"), F.sum(F.size("children")).alias("n_children"),
    )
