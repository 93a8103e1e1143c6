"""Catalog derivation: column roles, grain, table rules and ranking candidates, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import documented_values

# Columns that record who changed a row and when.
AUDIT_COLUMNS = ("CREATED_BY", "CREATION_DATE", "LAST_UPDATED_BY", "LAST_UPDATE_DATE", "LAST_UPDATE_LOGIN")
# Start and end columns of an effective period.
PERIODS = (("START_DATE_ACTIVE", "END_DATE_ACTIVE"), ("EFFECTIVE_START_DATE", "EFFECTIVE_END_DATE"))


def column_roles(name: Column, datatype: Column, description: Column, primary_key: Column, is_reference: Column, audit: tuple[str, ...] = AUDIT_COLUMNS) -> Column:
    """Ordered roles of a column with their evidence: ARRAY<STRUCT<role, source, confidence>>."""
    text, kind = F.lower(F.coalesce(description, F.lit(""))), F.upper(F.coalesce(datatype, F.lit("")))
    ends = lambda *suffixes: _any(F.endswith(name, F.lit(s)) for s in suffixes)
    says = lambda *words: _any(F.contains(text, F.lit(w)) for w in words)
    reference = F.coalesce(is_reference, F.lit(False))
    documented, by_name, by_text = ("documentation", "high"), ("column_name_inference", "medium"), ("description_or_name_inference", "medium")
    rules = [
        ("primary_key", F.coalesce(F.array_contains(primary_key, name), F.lit(False)), documented),
        ("foreign_key", reference, documented),
        ("audit", name.isin(*audit), documented),
        ("optimistic_lock", name == "OBJECT_VERSION_NUMBER", documented),
        ("language", name.isin("LANGUAGE", "SOURCE_LANG"), documented),
        ("categorical_flag", ends("_FLAG"), by_name),
        ("status", ends("_STATUS", "_STATUS_CODE") | (name == "STATUS"), by_name),
        ("temporal", ends("_DATE", "_DATETIME") | F.contains(kind, F.lit("TIMESTAMP")) | (kind == "DATE"), ("datatype_or_name_inference", "medium")),
        ("identifier", ends("_ID") & ~reference, by_name),
        ("business_code", ends("_CODE") | (name == "CODE"), by_name),
        ("percentage", says("percent") | ends("_PERCENT", "_PERCENTAGE"), by_text),
        ("amount", says("amount") | ends("_AMOUNT", "_AMT"), by_text),
        ("quantity", says("quantity") | ends("_QUANTITY", "_QTY"), by_text),
        ("descriptive_attribute", name.isin("NAME", "DESCRIPTION") | ends("_NAME", "_DESCRIPTION"), by_name),
    ]
    entry = lambda role, source, confidence: F.struct(F.lit(role).alias("role"), source.alias("source"), confidence.alias("confidence"))
    found = F.filter(F.array(*[F.when(c, entry(r, F.lit(s), F.lit(f))) for r, c, (s, f) in rules]), lambda x: x.isNotNull())
    told = F.coalesce(description, F.lit("")) != ""
    fallback = F.array(entry("attribute", F.when(told, "documentation").otherwise("column_name_inference"), F.when(told, "medium").otherwise("low")))
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def classify_columns(columns: DataFrame, tables: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Columns (table_name, name, datatype, description) with their roles; ``tables`` gives primary keys,
    ``references`` (table_name, column_name) the columns that point elsewhere. The joins are co-partitioned by table."""
    keys = tables.groupBy("table_name").agg(F.first("primary_key", ignorenulls=True).alias("primary_key"))
    out = columns.join(keys, "table_name", "left")
    if references is not None:
        pointing = references.groupBy("table_name").agg(F.collect_set("column_name").alias("pointing"))
        out = out.join(pointing, "table_name", "left").withColumn("is_reference", F.array_contains("pointing", F.col("name"))).drop("pointing")
    else:
        out = out.withColumn("is_reference", F.lit(False))
    roles = column_roles(F.col("name"), F.col("datatype"), F.col("description"), F.col("primary_key"), F.col("is_reference"))
    return out.withColumn("role_evidence", roles).withColumns(
        {"semantic_role": F.col("role_evidence")[0]["role"], "semantic_roles": F.transform("role_evidence", lambda r: r["role"]), "documented_values": documented_values("description")}
    )


def result_grain(primary_key: Column) -> Column:
    """What one row of a table stands for, unknown without a key."""
    known = F.size(F.coalesce(primary_key, F.array().cast("array<string>"))) > 0
    return F.when(
        known,
        F.struct(
            F.concat(F.lit("One row for each combination of "), F.array_join(primary_key, ", "), F.lit(".")).alias("description"),
            primary_key.alias("grain_columns"), F.lit("primary_key").alias("uniqueness_source"), F.lit("high").alias("confidence"),
        ),
    ).otherwise(F.struct(F.lit(None).cast("string").alias("description"), F.array().cast("array<string>").alias("grain_columns"), F.lit(None).cast("string").alias("uniqueness_source"), F.lit("unknown").alias("confidence")))


def table_rules(tables: DataFrame, columns: DataFrame, references: DataFrame) -> DataFrame:
    """(table_name, rule_type, columns, confidence): eight kinds of rules of each table.

    One aggregate of column names for each table, then predicates on that array; no join of columns."""
    named = columns.groupBy("table_name").agg(
        F.collect_set("name").alias("names"),
        F.collect_set(F.when(F.endswith("name", F.lit("_FLAG")) & (F.coalesce("description", F.lit("")) != ""), F.col("name"))).alias("flags"),
        F.max(F.when((F.col("name") == "OBJECT_VERSION_NUMBER") & (F.coalesce("description", F.lit("")) != ""), True)).alias("lock_told"),
    )
    keyed = tables.groupBy("table_name").agg(F.first("primary_key", ignorenulls=True).alias("primary_key"), F.first("description", ignorenulls=True).alias("description"))
    pointing = references.groupBy("table_name").agg(F.collect_set("column_name").alias("pointing"))
    base = keyed.join(named, "table_name", "left").join(pointing, "table_name", "left")
    none = F.array().cast("array<string>")
    has = lambda *n: _all(F.array_contains(F.coalesce("names", none), F.lit(x)) for x in n)
    rule = lambda kind, cols, confidence: F.struct(F.lit(kind).alias("rule_type"), cols.alias("columns"), confidence.alias("confidence"))
    audits = F.array_sort(F.filter(F.coalesce("names", none), lambda n: n.isin(*AUDIT_COLUMNS)))
    single = [
        F.when(F.coalesce("description", F.lit("")) != "", rule("documented_business_context", none, F.lit("high"))),
        F.when(F.size(F.coalesce("primary_key", none)) > 0, rule("uniqueness", F.col("primary_key"), F.lit("high"))),
        F.when(has("OBJECT_VERSION_NUMBER"), rule("optimistic_locking", F.array(F.lit("OBJECT_VERSION_NUMBER")), F.when(F.coalesce("lock_told", F.lit(False)), "high").otherwise("medium"))),
        *(F.when(has(a, b), rule("effective_dating", F.array(F.lit(a), F.lit(b)), F.lit("medium"))) for a, b in PERIODS),
        F.when(has("LANGUAGE", "SOURCE_LANG"), rule("translation", F.array(F.lit("LANGUAGE"), F.lit("SOURCE_LANG")), F.lit("high"))),
        F.when(F.size(audits) > 0, rule("audit", audits, F.lit("high"))),
    ]
    each = lambda kind, column: F.transform(F.array_sort(F.coalesce(column, none)), lambda c: rule(kind, F.array(c), F.lit("high")))
    rules = F.concat(F.filter(F.array(*single), lambda r: r.isNotNull()), each("referential_integrity", F.col("pointing")), each("flag_domain", F.col("flags")))
    return base.select("table_name", F.inline(rules))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def ranking_candidates(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_name, purpose, column, partition_by, needs_partition): how the latest or current row may be found."""
    names = columns.groupBy("table_name").agg(F.collect_set("name").alias("names"))
    keys = tables.groupBy("table_name").agg(F.first("primary_key", ignorenulls=True).alias("primary_key"))
    none = F.array().cast("array<string>")
    base = names.join(keys, "table_name", "left").withColumn("primary_key", F.coalesce("primary_key", none))
    versions = F.array_sort(F.filter("names", lambda n: ((n == "VERSION_NUMBER") | F.endswith(n, F.lit("_VERSION_NUMBER")) | F.endswith(n, F.lit("_VERSION_NUM"))) & (n != "OBJECT_VERSION_NUMBER")))
    current = F.array_sort(F.filter("names", lambda n: F.endswith(n, F.lit("_FLAG")) & (F.startswith(n, F.lit("CURRENT_")) | F.startswith(n, F.lit("LATEST_")) | F.contains(n, F.lit("_CURRENT_")) | F.contains(n, F.lit("_LATEST_")))))

    def candidate(purpose: str, column: Column, partition: Column, needs: Column) -> Column:
        return F.struct(F.lit(purpose).alias("purpose"), column.alias("column"), partition.alias("partition_by"), needs.alias("needs_partition"))

    def versioned(v: Column) -> Column:
        partition = F.when(F.array_contains("primary_key", v), F.array_except("primary_key", F.array(v))).otherwise(none)
        return candidate("latest_business_version_candidate", v, partition, F.size(partition) == 0)

    updated = F.when(F.array_contains("names", F.lit("LAST_UPDATE_DATE")), F.array(candidate("most_recent_update_candidate", F.lit("LAST_UPDATE_DATE"), none, F.lit(True))))
    flags = F.transform(current, lambda c: candidate("current_record_candidate", c, none, F.lit(False)))
    found = F.concat(F.transform(versions, versioned), flags, F.coalesce(updated, F.array().cast("array<struct<purpose:string,column:string,partition_by:array<string>,needs_partition:boolean>>")))
    return base.select("table_name", F.inline(found))


# Markers of security pages and of analytical pages.
SECURITY_MARKERS = (" job role", " duty role", " data role", " abstract role", " secures access", " privilege", " security role")
ANALYTICS_MARKERS = (
    "subject area", "analysis", "analytics", "business question", "metric", "dimension", "fact folder", "presentation folder", "report", "dashboard",
)


def classify_page(title: Column, text: Column, url: Column) -> Column:
    """security, analytics or excluded: the first rule that holds."""
    from graphloom.functions.text import merge_text, normalize_text

    raw = merge_text(title, text, url)
    normalized, heading = normalize_text(raw), normalize_text(title)
    address = F.translate(normalize_text(url), "-_", "  ")
    padded, upper = F.concat(F.lit(" "), normalized), F.upper(raw)
    security = _any(F.contains(padded, F.lit(m)) for m in SECURITY_MARKERS) | F.contains(upper, F.lit("_JOB")) | F.contains(upper, F.lit("_DUTY")) | F.endswith(heading, F.lit(" duty")) | F.contains(normalized, F.lit("transaction analysis duty"))
    chapter = lambda *names: _any(F.contains(address, F.lit(n)) for n in names)
    return (
        F.when(security, "security").when(heading == "get help", "excluded")
        .when((heading == "overview") & chapter("subject areas chap", "business questions chap"), "analytics")
        .when((heading == "overview") & chapter("job roles chap", "duty roles chap"), "security").when(heading == "overview", "excluded")
        .when(_any(F.contains(normalized, F.lit(m)) for m in ANALYTICS_MARKERS), "analytics").when(F.length(normalized) >= 80, "analytics").otherwise("excluded")
    )
