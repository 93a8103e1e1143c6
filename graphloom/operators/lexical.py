"""Lexical retrieval: postings, BM25, keyword and title scores, and hybrid search with graph propagation.

Many queries run in one plan, keyed by ``query_id``. Query tokens meet the postings in one equi-join on
the term; postings never meet queries otherwise, so the cost follows the matching postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import node_keywords, normalize_text, tokenize
from graphloom.operators.graph import expand
from graphloom.sources.tables import cut_lineage

K1, B = 1.5, 0.75
BM25_WEIGHT, KEYWORD_WEIGHT, TITLE_WEIGHT = 0.58, 0.27, 0.15
GRAPH_WEIGHT, DECAY, HOPS, SEEDS = 0.42, 0.68, 2, 12
LEAST_CONFIDENCE = 0.35
# Words of a query that ask for auxiliary objects.
AUXILIARY_TERMS = (
    "archive", "archived", "arquivo", "historico", "historica", "history", "interface", "import", "importacao", "draft", "rascunho",
    "temporary", "temporaria", "temp", "staging", "stage",
)
# Boosts by node type; sources get theirs from the caller.
TYPE_BOOSTS = {
    "validated_rule": 1.30, "business_entity": 1.18, "physical_table": 1.15, "physical_column": 1.05, "business_question": 1.12,
    "subject_area": 1.10, "rest_resource": 1.06, "rest_operation": 1.03, "environment_resource": 1.10, "functional_section": 1.08,
}


def postings(docs: DataFrame, text: Column) -> DataFrame:
    """(id, term, tf, dl): how often each token stands in each document, and the length of the document."""
    tokens = docs.select("id", tokenize(text).alias("tokens"))
    exploded = tokens.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return exploded.groupBy("id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text: Column) -> DataFrame:
    """One row: number of documents (1 at least) and mean length (1 at least)."""
    return docs.select(F.size(tokenize(text)).alias("dl")).agg(
        F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_docs"), F.greatest(F.coalesce(F.avg("dl"), F.lit(1.0)), F.lit(1.0)).alias("avgdl")
    )


def posted_stats(posted: DataFrame, n_docs: int) -> DataFrame:
    """``corpus_stats`` from the postings and the number of documents, without tokenizing again."""
    n = max(n_docs, 1)
    return posted.agg(F.lit(n).cast("bigint").alias("n_docs"), F.greatest(F.coalesce(F.sum("tf"), F.lit(0)) / F.lit(n), F.lit(1.0)).alias("avgdl"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame, text: Column) -> DataFrame:
    """(query_id, term, qn): tokens of each query; a token that repeats counts as often."""
    return queries.select("query_id", F.explode(tokenize(text)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))


def bm25(posted: DataFrame, stats: DataFrame, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, bm25). ``stats`` is one row, taken as literals; frequencies are over all documents."""
    row = stats.first()
    n, avgdl = row["n_docs"], row["avgdl"]
    wanted = posted.join(terms.select("term").distinct(), "term", "left_semi")
    frequency = document_frequency(wanted).withColumn("idf", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weighted = terms.join(frequency, "term").select("query_id", "term", (F.col("idf") * F.col("qn")).alias("weight"))
    gain = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    return wanted.join(weighted, "term").groupBy("query_id", "id").agg(F.sum(gain).alias("bm25"))


def keyword_score(query_tokens: Column, query: Column, node_keywords: Column, aliases: Column) -> Column:
    """Shared keywords, 2.5 for each alias inside the query, 1.2 for each alias that contains it."""
    names = F.filter(F.transform(aliases, normalize_text), lambda a: a != "")
    shared = F.size(F.array_intersect(F.array_distinct(query_tokens), node_keywords))
    return shared + 2.5 * F.size(F.filter(names, lambda a: F.contains(query, a))) + 1.2 * F.size(F.filter(names, lambda a: F.contains(a, query)))


def title_score(query: Column, query_tokens: Column, title: Column, qualified: Column, name: Column) -> Column:
    """How well a title answers the query: the first case that holds."""
    t, q, n = normalize_text(title), normalize_text(qualified), normalize_text(name)
    distinct = F.array_distinct(query_tokens)
    overlap = F.size(F.array_intersect(distinct, F.array_distinct(tokenize(title))))
    return (
        F.when(t == "", 0.0).when((t == query) | ((q != "") & (q == query)) | ((n != "") & (n == query)), 30.0)
        .when(F.startswith(t, F.concat(query, F.lit("."))), 2.5).when(F.startswith(t, F.concat(query, F.lit(" "))), 2.5)
        .when(F.contains(t, query), 2.0).when(F.contains(query, t), 3.0)
        .otherwise(F.when(F.size(distinct) > 0, 1.5 * overlap / F.size(distinct)).otherwise(0.0))
    )


def auxiliary_penalty(node_type: Column, object_name: Column, query: Column, query_tokens: Column) -> Column:
    """Below 1 for interface, temporary, draft and archive tables that the query does not ask for."""
    name = F.upper(F.coalesce(object_name, F.lit("")))
    parts = F.split(name, "_")
    part = lambda *p: F.arrays_overlap(parts, F.array(*[F.lit(x) for x in p]))
    asked = ((name != "") & F.contains(query, normalize_text(name))) | F.arrays_overlap(query_tokens, F.array(*[F.lit(t) for t in AUXILIARY_TERMS]))
    return (
        F.when(~F.coalesce(node_type, F.lit("")).isin("physical_table", "physical_column") | asked, 1.0)
        .when(part("INTERFACE") | name.rlike("_(INT|GT|TMP|TEMP|STG)$"), 0.35).when(part("DRAFT"), 0.45).when(part("ARCHIVE", "HISTORY", "HIST"), 0.55).otherwise(1.0)
    )


def _boost(column: Column, boosts: dict[str, float]) -> Column:
    if not boosts:
        return F.lit(1.0)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv])[column], F.lit(1.0))


def direct_scores(nodes: DataFrame, queries: DataFrame, source_boosts: dict[str, float] | None = None, type_boosts: dict[str, float] | None = None) -> DataFrame:
    """(query_id, id, title, direct_score and its parts) of all nodes with a positive score.

    ``nodes``: id, node_type, title, qualified_name, name, object_name, aliases, search_text, confidence_score,
    source_type, and keywords where they are stored. Candidates are the nodes that share a term with the query, or whose names do:
    an alias or a title that holds the query shares its tokens, so the inverted lists find all of them."""
    text = F.concat_ws(" ", "title", "qualified_name", "name", "search_text", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "))
    posted = cut_lineage(postings(nodes, text))  # read for frequencies and for scores
    stats = posted_stats(posted, nodes.count())
    q = queries.select("query_id", normalize_text("text").alias("query"), tokenize("text").alias("query_tokens"))
    scored = bm25(posted, stats, query_terms(queries, F.col("text")))
    joined = scored.join(nodes, "id").join(q, "query_id")
    if "keywords" not in nodes.columns:  # of candidates only, written once, since several expressions read them
        joined = cut_lineage(joined.withColumn("keywords", node_keywords()).drop("search_text"))
    kw = keyword_score(F.col("query_tokens"), F.col("query"), F.coalesce("keywords", F.array().cast("array<string>")), F.concat(F.array("name", "qualified_name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    title = title_score(F.col("query"), F.col("query_tokens"), F.col("title"), F.col("qualified_name"), F.col("name"))
    penalty = auxiliary_penalty(F.col("node_type"), F.col("object_name"), F.col("query"), F.col("query_tokens"))
    factor = F.greatest(F.lit(LEAST_CONFIDENCE), F.coalesce("confidence_score", F.lit(0.6))) * _boost(F.col("source_type"), source_boosts or {}) * _boost(F.col("node_type"), TYPE_BOOSTS if type_boosts is None else type_boosts)
    base = BM25_WEIGHT * F.col("bm25") + KEYWORD_WEIGHT * F.col("keyword") + TITLE_WEIGHT * F.col("title_score")
    return (
        joined.withColumns({"keyword": kw.cast("double"), "title_score": title, "penalty": penalty, "factor": factor})
        .withColumn("direct_score", base * F.col("factor") * F.col("penalty"))
        .where(F.col("direct_score") > 0)
        .select("query_id", "id", "title", "node_type", "bm25", "keyword", "title_score", "penalty", "direct_score")
    )


def hybrid_search(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 20, hops: int = HOPS, node_types: list[str] | None = None, modules: list[str] | None = None, source_types: list[str] | None = None, source_boosts: dict[str, float] | None = None) -> DataFrame:
    """One query: direct scores, the best 12 as seeds, propagation, and the total in result order.

    Frequencies are over all nodes before the filters; propagation walks through nodes that the filters hide."""
    spark = nodes.sparkSession
    queries = spark.createDataFrame([(0, query)], "query_id int, text string")
    keep = F.lit(True)
    if node_types:
        keep = keep & F.col("node_type").isin(*node_types)
    if modules:
        keep = keep & F.coalesce(F.arrays_overlap("modules", F.array(*[F.lit(m) for m in modules])), F.lit(False))
    if source_types:
        keep = keep & F.col("source_type").isin(*source_types)
    visible = nodes.where(keep).select(F.col("id").alias("vid"), F.col("title").alias("vtitle"), F.col("node_type").alias("vtype"), F.col("object_name").alias("vobject"))
    direct = direct_scores(nodes, queries, source_boosts)
    direct = cut_lineage(direct.join(visible.select(F.col("vid").alias("id")), "id", "left_semi").select("id", "direct_score"))
    seeds = direct.orderBy(F.desc("direct_score"), "id").limit(SEEDS).select("id", F.col("direct_score").alias("score"))
    spread = expand(seeds, edges, hops, DECAY) if hops else spark.createDataFrame([], "node string, graph_score double")
    merged = direct.join(spread.withColumnRenamed("node", "id"), "id", "full_outer").join(visible.withColumnRenamed("vid", "id"), "id")
    normal, tokens = normalize_text(F.lit(query)), tokenize(F.lit(query))
    penalty = auxiliary_penalty(F.col("vtype"), F.col("vobject"), normal, tokens)
    total = F.round(F.coalesce("direct_score", F.lit(0.0)) + GRAPH_WEIGHT * F.coalesce("graph_score", F.lit(0.0)) * penalty, 6)
    ranked = merged.withColumn("total_score", total).where(F.col("total_score") > 0)
    order = [(normalize_text("vtitle") != normal).asc(), F.desc("total_score"), F.col("vtitle").asc(), F.col("id").asc()]
    top = ranked.orderBy(*order).limit(limit)
    return top.select("id", F.col("vtitle").alias("title"), F.round(F.coalesce("direct_score", F.lit(0.0)), 6).alias("direct_score"), F.round(F.coalesce("graph_score", F.lit(0.0)), 6).alias("graph_score"), "total_score")


def root_scores(posted: DataFrame, stats: DataFrame, terms: DataFrame, limit: int = 20) -> DataFrame:
    """The best ``limit`` documents of each query, scores scaled to 0..1 within that page (1 where all tie)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "id")
    page = bm25(posted, stats, terms).withColumn("bm25", F.round("bm25", 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    whole = Window.partitionBy("query_id")
    low, high = F.min("bm25").over(whole), F.max("bm25").over(whole)
    return page.withColumn("score", F.when(high > low, (F.col("bm25") - low) / (high - low)).otherwise(1.0))


def prefilter_children(edges: DataFrame, children: DataFrame, matches: DataFrame, k: int) -> DataFrame:
    """(source, id, rank): for each parent its k children, lexical matches first by score, then by title and id.

    ``edges`` (source, target), ``children`` (id, title), ``matches`` (id, score)."""
    linked = edges.select("source", F.col("target").alias("id")).distinct().join(children, "id").join(matches, "id", "left")
    order = Window.partitionBy("source").orderBy(F.col("score").isNull().asc(), F.desc_nulls_last("score"), "title", "id")
    return linked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("source", "id", "rank", "score")


def alias_contains_join(aliases: DataFrame, texts: DataFrame, least: int = 4) -> DataFrame:
    """(alias_id, id, n, weight): texts that hold an alias of at least ``least`` characters as whole words.

    No nested loop: an alias can only stand in a text that has its rarest word, so that word is joined first and
    the containment is checked on what is left."""
    plain = lambda c: F.trim(F.regexp_replace(normalize_text(c), "[^a-z0-9]+", " "))
    a = aliases.select("alias_id", plain("alias").alias("alias")).where(F.length("alias") >= least).distinct()
    t = texts.select("id", plain("text").alias("text"))
    text_words = t.select("id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    alias_words = a.select("alias_id", "alias", F.explode(F.array_distinct(F.split("alias", " "))).alias("word"))
    needed = text_words.join(alias_words.select("word").distinct(), "word", "left_semi")
    frequency = needed.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rarest = alias_words.join(frequency, "word", "left").groupBy("alias_id", "alias").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    pairs = rarest.join(needed, "word").join(t, "id").where(F.contains(F.concat(F.lit(" "), "text", F.lit(" ")), F.concat(F.lit(" "), "alias", F.lit(" "))))
    return pairs.groupBy("alias_id", "id").agg(F.count(F.lit(1)).alias("n")).withColumn("weight", F.least(F.lit(0.9), 0.55 + 0.08 * F.col("n")))


def module_bridge(nodes: DataFrame) -> DataFrame:
    """(module_id, id): one row for each module of each node, for filters by semi-join."""
    return nodes.select(F.explode("modules").alias("module_id"), "id").where(F.col("module_id").isNotNull()).distinct()


def in_modules(nodes: DataFrame, bridge: DataFrame, modules: list[str]) -> DataFrame:
    """Nodes of any of the modules, by the bridge table."""
    return nodes.join(bridge.where(F.col("module_id").isin(*modules)).select("id").distinct(), "id", "left_semi")
