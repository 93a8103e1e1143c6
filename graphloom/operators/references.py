"""Orphan references: keys named by records whose target is missing, deleted or arrives later.

References and parent keys are co-partitioned by (kind, key), sorted inside each partition with the
parent first, and merged in one linear pass that carries the parent's validity interval forward to
the references behind it (a running window). No side is broadcast.

Skew: a key named by very many records is spread over as many slices as its count needs. The counts
are pre-aggregated; only keys above ``slice_rows`` references are listed, at most
``references / slice_rows`` of them, and only their parent rows are repeated, once for each slice.

Defined cases: null or blank references are no references; a null array or a null struct gives none;
names compare without regard to case and outer blanks; a record without ``loaded_at`` is compared as
if it was loaded after everything else; repeated rows count once; the first ``loaded_at`` of a key
counts, and its latest ``deleted_at`` if every stored version of the key is deleted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.tables import read_table

_BLANKS = r"^(?U)\s+|(?U)\s+$"
_FOREVER = "9999-12-31 00:00:00"


def name_key(name: Column) -> Column:
    """A name as compared: outer blanks and letter case removed."""
    return F.lower(F.regexp_replace(name, _BLANKS, ""))


def parent_intervals(df: DataFrame, kind: str, name: Column, loaded: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """(kind, key, born, gone) of each parent key: ``born`` its first load, ``gone`` null while it lives."""
    return (
        df.select(name_key(name).alias("key"), F.col(loaded).alias("born"), F.col(deleted).alias("gone"))
        .where(F.col("key").isNotNull() & (F.col("key") != ""))
        .groupBy("key")
        .agg(F.min("born").alias("born"), F.when(F.count("gone") == F.count(F.lit(1)), F.max("gone")).alias("gone"))
        .withColumn("kind", F.lit(kind))
        .select("kind", "key", "born", "gone")
    )


def references(df: DataFrame, table_name: str, record: str, field: str, kind: str, values: Column, loaded: str = "loaded_at") -> DataFrame:
    """One row per distinct (record, stored value) of the array ``values``."""
    return (
        df.select(F.col(record).alias("record_id"), F.col(loaded).alias("at"), F.explode(values).alias("ref_value"))
        .withColumn("key", name_key(F.col("ref_value")))
        .where(F.col("key").isNotNull() & (F.col("key") != ""))
        .groupBy("record_id", "ref_value", "key")
        .agg(F.min("at").alias("at"))
        .select(F.lit(table_name).alias("table_name"), "record_id", F.lit(field).alias("field_name"), "ref_value", F.lit(kind).alias("kind"), "key", "at")
    )


def merge_references(refs: DataFrame, parents: DataFrame, slice_rows: int = 200_000) -> DataFrame:
    """``refs`` with ``status``: valid, missing, late (target loaded later) or deleted."""
    hot = (
        refs.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > slice_rows)
        .select("kind", "key", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices"))
    )  # at most rows / slice_rows keys: its size is bounded, Spark's own size check decides on the broadcast
    sliced_refs = refs.join(hot, ["kind", "key"], "left").withColumn(
        "slice", F.when(F.col("slices").isNull(), 0).otherwise(F.pmod(F.xxhash64("record_id", "ref_value"), F.col("slices")).cast("int"))
    )
    sliced_parents = parents.join(hot, ["kind", "key"], "left").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slices"), F.lit(1)) - 1))
    )
    both = sliced_parents.select("kind", "key", "slice", F.lit(0).alias("side"), "born", "gone").unionByName(
        sliced_refs.select("table_name", "record_id", "field_name", "ref_value", "at", "kind", "key", "slice", F.lit(1).alias("side")), allowMissingColumns=True
    )
    merge = Window.partitionBy("kind", "key", "slice").orderBy("side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.coalesce(F.col("at"), F.lit(_FOREVER).cast(refs.schema["at"].dataType))
    return (
        both.withColumn("parents", F.count(F.when(F.col("side") == 0, 1)).over(merge))
        .withColumn("p_born", F.max("born").over(merge))
        .withColumn("p_gone", F.max("gone").over(merge))
        .where(F.col("side") == 1)
        .withColumn(
            "status",
            F.when(F.col("parents") == 0, "missing")
            .when(F.col("p_born") > at, "late")
            .when(F.col("p_gone") <= at, "deleted")
            .otherwise("valid"),
        )
        .select("table_name", "record_id", "field_name", "ref_value", "at", "status")
    )


def catalog_references(spark, root: str, slice_rows: int = 200_000) -> DataFrame:
    """Every reference of the catalog's rule and entity tables with its status."""
    rules, entities = read_table(spark, root, "validated_rules"), read_table(spark, root, "entity_aliases")
    columns, tables, resources = (read_table(spark, root, t) for t in ("physical_column", "physical_table", "rest_resource"))
    refs = reduce(
        DataFrame.unionByName,
        [
            references(rules, "validated_rules", "id", "joins.right", "column", F.col("joins.right")),
            references(entities, "entity_aliases", "entity_id", "tables", "table", F.col("tables")),
            references(entities, "entity_aliases", "entity_id", "rest_resources", "resource", F.col("rest_resources")),
        ],
    )
    parents = reduce(
        DataFrame.unionByName,
        [
            parent_intervals(columns, "column", F.concat_ws(".", "table_name", "name")),
            parent_intervals(tables, "table", F.col("table_name")),
            parent_intervals(resources, "resource", F.col("name")),
        ],
    )
    return merge_references(refs, parents, slice_rows)


def orphan_references(spark, root: str) -> DataFrame:
    found = catalog_references(spark, root).where(F.col("status") != "valid")
    return found.select("table_name", "record_id", "field_name", "ref_value").distinct()


def orphan_report(spark, root: str) -> DataFrame:
    """Orphans counted per table, field, month of the record's load and reason."""
    found = catalog_references(spark, root).where(F.col("status") != "valid")
    return found.groupBy("table_name", "field_name", F.date_format("at", "yyyy-MM").alias("month"), "status").agg(F.count(F.lit(1)).alias("n_refs"))
