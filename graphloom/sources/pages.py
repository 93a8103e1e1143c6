"""Collected pages: fetching into a landed table, and the documents read from it (guides, analytics, physical objects).

Pages are landed once as a table (key, url, html, error), keyed by the hash of the URL; every collector reads that
table, so collection is repeatable and a page is fetched once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import normalize_text, stable_id
from graphloom.operators.catalog import classify_page
from graphloom.sources.html import page_sections, toc_links

PAGE = "key string, url string, html string, error string"
RETRIES = 3


def url_key(url: Column) -> Column:
    return F.sha2(url, 256)


def missing_pages(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """URLs (url) that the landed pages do not hold yet."""
    return wanted.select("url").where(F.col("url").isNotNull()).distinct().withColumn("key", url_key(F.col("url"))).join(pages.where(F.col("error").isNull()).select("key"), "key", "left_anti")


def fetch_pages(wanted: DataFrame, fetch: Callable[[str], tuple[int, str, str]], pause: float = 0.0, retries: int = RETRIES) -> DataFrame:
    """Landed rows of ``wanted`` (url). ``fetch`` gives (status, content type, body) of a URL; 429 and 5xx are tried again, with
    growing pauses; anything but HTML and JSON is an error. Errors are rows, not exceptions."""
    def one(url: str) -> tuple[str | None, str | None]:
        error = None
        for attempt in range(retries):
            time.sleep(pause * (2**attempt if attempt else 1))
            try:
                status, kind, body = fetch(url)
            except OSError as problem:
                error = f"failed: {problem}"
                continue
            if status == 429 or status >= 500:
                error = f"status {status} after {attempt + 1} attempts"
                continue
            if status != 200:
                return None, f"status {status}"
            if not any(k in kind for k in ("html", "json")):
                return None, f"unexpected content type {kind}"
            return body, None
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [one(u) for u in batch["url"]]
            yield pd.DataFrame({"key": batch["key"], "url": batch["url"], "html": [g[0] for g in got], "error": [g[1] for g in got]})

    return wanted.select("url").distinct().withColumn("key", url_key(F.col("url"))).select("key", "url").mapInPandas(run, PAGE)


def error_rows(pages: DataFrame) -> DataFrame:
    """(id, node_type, url, text): a row of type ``collection_error`` for each page that could not be read."""
    return pages.where(F.col("error").isNotNull()).select(stable_id("collection_error", F.col("url")).alias("id"), F.lit("collection_error").alias("node_type"), "url", F.col("error").alias("text"))


def wanted_pages(contents: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """(page, url, label) of the links of contents pages (url, html) whose address has one of ``include`` and none of ``exclude``,
    without the ``known`` (url)."""
    links = toc_links(contents)
    address = F.lower("url")
    has = lambda parts: F.exists(F.array(*[F.lit(p.lower()) for p in parts]), lambda p: F.contains(address, p))
    links = links.where(has(include)) if include else links
    links = links.where(~has(exclude)) if exclude else links
    return links.join(known.select("url").distinct(), "url", "left_anti") if known is not None else links


def guide_sections(pages: DataFrame) -> DataFrame:
    """(id, node_type, url, title, level, section_path, text): one row for each section of guide pages with content."""
    s = page_sections(pages.where(F.col("html").isNotNull()).select("url", "html"))
    body = F.concat_ws("\n", F.nullif("text", F.lit("")), F.nullif(F.array_join("list_items", "\n"), F.lit("")))
    made = s.withColumn("text", body).where(F.col("text") != "")
    return made.select(stable_id("functional", F.col("url"), F.array_join("section_path", "/")).alias("id"), F.lit("functional_section").alias("node_type"), "url", "title", "level", "section_path", "text")


def analytics_pages(pages: DataFrame) -> DataFrame:
    """(id, node_type, url, title, text): pages of the analytics catalog as subject areas, questions or security."""
    s = page_sections(pages.where(F.col("html").isNotNull()).select("url", "html"))
    whole = s.groupBy("url").agg(F.min_by("title", "level").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "text"))), lambda x: x["text"]), "\n").alias("text"))
    kind = classify_page(F.col("title"), F.col("text"), F.col("url"))
    node_type = F.when(kind == "security", "security_page").when((kind == "analytics") & (F.endswith(F.trim("title"), F.lit("?")) | F.startswith(F.lower("title"), F.lit("how"))), "business_question").when(kind == "analytics", "subject_area").otherwise("excluded")
    return whole.select(stable_id("analytics", F.col("url")).alias("id"), node_type.alias("node_type"), "url", "title", "text")


def section_titled(sections: DataFrame, title: str) -> DataFrame:
    """Sections whose title is ``title``, without regard to case, accents and blanks."""
    return sections.where(normalize_text("title") == normalize_text(F.lit(title)))


def physical_objects(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, columns, foreign keys) of object pages (url, html): only objects of type TABLE.

    tables (table_name, description, primary_key), columns (table_name, name, datatype, description, position),
    keys (source_table, source_column, target_table)."""
    s = page_sections(pages.select("url", "html"))
    head = s.where("level = 1").select("url", F.upper(F.trim("title")).alias("table_name"), F.upper(F.regexp_extract("text", r"(?i)object type:\s*(\w+)", 1)).alias("kind"), F.regexp_replace(F.regexp_replace("text", r"(?i)object type:\s*\w+", ""), r"(?U)^\s+|\s+$", "").alias("description"))
    head = head.where(F.col("kind") == "TABLE").drop("kind")
    rows = lambda title: section_titled(s, title).select("url", F.posexplode(F.flatten("tables")).alias("position", "row")).join(head.select("url", "table_name"), "url")
    value = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col("row")[n]), F.lit("")) for n in names])
    key = rows("Primary Key").groupBy("table_name").agg(F.first(F.transform(F.split(value("columns", "column_2"), ","), lambda x: F.trim(x))).alias("primary_key"))
    columns = rows("Columns").select("table_name", F.upper(value("name", "column_1")).alias("name"), value("datatype", "column_2").alias("datatype"), value("comments", "description", "column_3").alias("description"), (F.col("position") + 1).alias("position")).where("name IS NOT NULL")
    foreign = rows("Foreign Keys").select(F.upper(value("table", "column_1")).alias("source_table"), F.upper(value("foreign_key_column", "column_3")).alias("source_column"), F.upper(value("foreign_table", "column_2")).alias("target_table")).where("target_table IS NOT NULL")
    return head.join(key, "table_name", "left").select("table_name", "description", "primary_key"), columns, foreign


def physical_manifest(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_name, n_columns, document): one JSON document for each table with its columns in order; a table has a bounded number of them."""
    listed = columns.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("position", "name", "datatype"))).alias("columns"))
    joined = tables.select("table_name", "description", "primary_key").join(listed, "table_name", "left")
    return joined.select("table_name", F.coalesce(F.size("columns"), F.lit(0)).alias("n_columns"), F.to_json(F.struct("table_name", "description", "primary_key", "columns")).alias("document"))


def discover(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(path, length, modified): the files below a folder, each once, in order of their path; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified")).distinct().orderBy("path")
