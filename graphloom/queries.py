"""The registered core queries. ``graphloom.oracle`` has the SQL of those that SQL can state."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import catalog, checks, context, corpus, documents, federated, graph, index, lexical, references, rules, vector
from graphloom.plans import catalog_graph
from graphloom.sources import files, html, pages
from graphloom.sources.tables import cut_lineage, free_shuffles, land, read_table, shared_dir, spread

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _long(name: str, column=None):
    return (F.col(name) if column is None else column).cast("bigint").alias(name)


# scans and projections


@query
def scan_filter_project_lineitem(spark, root):
    return read_table(spark, root, "lineitem").where((F.col("l_quantity") > 45) & (F.col("l_discount") < 0.03)).select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query
def json_props_extract(spark, root):
    e = read_table(spark, root, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return e.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query
def collection_errors_dropped(spark, root):
    s = read_table(spark, root, "functional_section")
    return files.without_errors(s).groupBy("module_id").agg(_long("n", F.count_distinct("id")))


@query
def html_title_and_text(spark, root):
    """Titles and main text of pages built from the sections, page furniture left out."""
    s = read_table(spark, root, "functional_section").where("title IS NOT NULL").select("id", "title").distinct()
    page = F.concat(F.lit("<html><nav><a href='/x'>menu</a></nav><h1>"), F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</h1><p>body</p><footer>foot</footer></html>"))
    pages = s.select("id", page.alias("html"))
    return html.page_sections(pages).select("id", F.col("title"), "level", F.col("text").alias("body"))


@query
def html_links(spark, root):
    """Links of pages built from the sections of each guide, below the folder of the page, each once."""
    s = read_table(spark, root, "functional_section").select("guide_id", F.col("source.url").alias("url")).where("url IS NOT NULL").distinct()
    page = s.groupBy("guide_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("url")), lambda u: F.concat(F.lit("<li><a href='"), u, F.lit("#top'>x</a></li><li><a href='"), u, F.lit("'>y</a></li>"))), "").alias("body"))
    pages = page.select(F.concat(F.lit("https://docs.kb.example/"), "guide_id", F.lit("/toc.html")).alias("url"), F.concat(F.lit("<ul>"), "body", F.lit("</ul>")).alias("html"))
    return html.toc_links(pages).select("page", "url", "label")


@query
def url_parts_release(spark, root):
    d = read_table(spark, root, "documents").where("url IS NOT NULL")
    return d.select("doc_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.element_at(F.split(F.parse_url("url", F.lit("PATH")), "/"), -1).alias("file"), T.release_of(F.concat(F.lit("https://h/24b/"), F.col("guide_id"))).alias("release"))


# text


@query
def text_normalize_space(spark, root):
    return read_table(spark, root, "documents").select("doc_id", F.md5(T.normalize_space("text")).alias("h"))


@query
def text_normalize(spark, root):
    return read_table(spark, root, "documents").select("doc_id", T.normalize_text("title").alias("t"))


@query
def text_tokenize_counts(spark, root):
    t = _documents(spark, root).select(F.col("id").alias("doc_id"), T.tokenize("text").alias("t"))
    return t.select("doc_id", _long("n_tokens", F.size("t")), _long("n_distinct", F.size(F.array_distinct("t"))))


@query
def text_tokens_exploded(spark, root):
    s = read_table(spark, root, "lang_samples").select(F.col("sample_id").alias("id"), "text")
    return lexical.postings(s, F.col("text")).select("id", "term", _long("tf"), _long("dl"))


@query
def text_slugify_stable_id(spark, root):
    p = read_table(spark, root, "physical_table").select("table_name", "description").distinct()
    return p.select("table_name", T.slugify("description").alias("slug"), T.stable_id("table", F.col("table_name"), F.col("description")).alias("sid"))


@query
def text_merge_fields(spark, root):
    p = read_table(spark, root, "part")
    return p.select("p_partkey", T.merge_text(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")).alias("merged"))


@query
def text_mentions(spark, root):
    s = read_table(spark, root, "functional_section").where("text IS NOT NULL").select("id", "text").distinct()
    m = F.array_sort(T.mentions("text"))
    return s.select("id", F.md5("text").alias("h"), F.array_join(m, ",").alias("tables")).where(F.col("tables") != "")


@query
def text_documented_references(spark, root):
    r = read_table(spark, root, "validated_rules").select("id", F.explode("joins").alias("j")).select("id", F.concat(F.lit("The value references to "), "j.right", F.lit(" always.")).alias("t")).where("t IS NOT NULL").distinct()
    found = r.select("id", F.explode(T.documented_references("t")).alias("r"))
    return found.select("id", F.col("r.table").alias("table_name"), F.col("r.column").alias("column_name"))


@query
def text_confidence_score(spark, root):
    o = read_table(spark, root, "rest_operation")
    return o.groupBy("confidence").agg(F.max(T.confidence_score("confidence")).alias("score"), _long("n", F.count(F.lit(1))))


@query
def text_semantic_normalize(spark, root):
    return read_table(spark, root, "documents").select("doc_id", F.md5(T.normalize_semantic_text("text")).alias("h"))


@query
def text_sha256_dedupe(spark, root):
    d = corpus.dedup_counters(read_table(spark, root, "documents"), F.col("text"))
    return d.select(*[_long(c) for c in d.columns])


@query
def text_keywords_top30(spark, root):
    s = read_table(spark, root, "lang_samples")
    return s.select("sample_id", F.array_join(T.keywords(T.tokenize("text")), " ").alias("keywords"))


@query
def text_keywords_documents(spark, root):
    return _documents(spark, root).select(F.col("id").alias("doc_id"), F.array_join(T.keywords(T.tokenize("text")), " ").alias("keywords"))


@query
def text_tokens_documents(spark, root):
    return lexical.postings(_documents(spark, root), F.col("text")).select("id", "term", _long("tf"), _long("dl"))


@query
def text_truncate_summary(spark, root):
    return read_table(spark, root, "documents").select("doc_id", F.md5(T.truncate_summary("text")).alias("h"))


@query
def page_classifier(spark, root):
    d = read_table(spark, root, "documents")
    return d.select("doc_id", catalog.classify_page(F.col("title"), F.col("text"), F.col("url")).alias("kind"))


# catalog


def _references(spark, root):
    r = read_table(spark, root, "validated_rules").select(F.explode("joins").alias("j")).select(F.upper(F.trim("j.left")).alias("l"), F.upper(F.trim("j.right")).alias("r")).where("l IS NOT NULL AND r IS NOT NULL AND r <> ''")
    part = lambda c, i: F.element_at(F.split(c, "[.]"), i)
    return r.where((F.size(F.split("l", "[.]")) == 2) & (F.size(F.split("r", "[.]")) == 2)).select(part("l", 1).alias("table_name"), part("l", 2).alias("column_name"), part("r", 1).alias("target_table"), part("r", 2).alias("target_column")).distinct()


@query
def catalog_column_roles(spark, root):
    columns = read_table(spark, root, "physical_column").select("id", "table_name", "name", "datatype", "description").distinct()
    out = catalog.classify_columns(columns, read_table(spark, root, "physical_table"), _references(spark, root))
    return out.select("id", F.md5(F.coalesce("description", F.lit(""))).alias("h"), F.array_join("semantic_roles", ",").alias("roles"), F.col("semantic_role").alias("role"))


@query
def catalog_grain(spark, root):
    p = read_table(spark, root, "physical_table").select("table_name", "primary_key").distinct().withColumn("g", catalog.result_grain(F.col("primary_key")))
    return p.select("table_name", F.col("g.description").alias("grain"), F.col("g.confidence").alias("confidence"))


@query
def catalog_table_rules(spark, root):
    r = catalog.table_rules(read_table(spark, root, "physical_table"), read_table(spark, root, "physical_column"), _references(spark, root))
    return r.groupBy("rule_type").agg(_long("n_rules", F.count(F.lit(1))), _long("n_tables", F.count_distinct("table_name")), _long("n_columns", F.sum(F.size("columns"))))


@query
def catalog_ranking_rules(spark, root):
    """On the catalog with names turned to versions and flags, so that every kind of candidate occurs."""
    c = read_table(spark, root, "physical_column").select("table_name", F.regexp_replace(F.regexp_replace(F.regexp_replace("name", "_NO$", "_NUMBER"), "_FLG$", "_CURRENT_FLAG"), "^CHANGE_TS$", "LAST_UPDATE_DATE").alias("name")).distinct()
    out = catalog.ranking_candidates(read_table(spark, root, "physical_table"), c)
    return out.groupBy("purpose", "column").agg(_long("n", F.count(F.lit(1))))


@query
def rule_latest_version(spark, root):
    rule = rules.Rule("orders", [("o_orderstatus", "=", "O"), ("c_mktsegment", "=", "BUILDING")], [("customer", "o_custkey", "c_custkey")], ["o_custkey"], [("o_orderdate", True), ("o_orderkey", True)], ["o_custkey", "o_orderkey", "o_totalprice"])
    return rules.run_rule(rule, {t: read_table(spark, root, t) for t in ("orders", "customer")})


@query
def rule_latest_event(spark, root):
    rule = rules.Rule("events", [], [], ["user_id", "event_type"], [("ts", True), ("event_id", True)], ["user_id", "event_type", "event_id", "value"])
    return rules.run_rule(rule, {"events": read_table(spark, root, "events")})


@query
def rule_current_flag(spark, root):
    rule = rules.Rule("lineitem", [("l_linestatus", "=", "O"), ("l_returnflag", "IN", ["N", "R"])], [], [], [], ["l_orderkey", "l_linenumber", "l_quantity"])
    return rules.run_rule(rule, {"lineitem": read_table(spark, root, "lineitem")})


# graph


@query
def node_union_merge(spark, root):
    c = read_table(spark, root, "customer").select(F.concat(F.lit("nation:"), F.col("c_nationkey")).alias("id"), F.lit("party").alias("node_type"), F.lit(None).cast("string").alias("title"), F.array("c_mktsegment").alias("modules"), (F.col("c_custkey") + 1000).alias("load_seq"), F.lit(0.5).alias("confidence_score"), F.lit("").alias("search_text"))
    n = read_table(spark, root, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey")).alias("id"), F.lit("nation").alias("node_type"), F.col("n_name").alias("title"), F.array(F.lit("core")).alias("modules"), F.col("n_nationkey").cast("bigint").alias("load_seq"), F.lit(0.9).alias("confidence_score"), F.col("n_name").alias("search_text"))
    m = graph.merge_nodes([n, c], ["node_type", "title"], ["modules"])
    return m.select("id", "node_type", "title", F.array_join(F.array_sort("modules"), ",").alias("modules"), "confidence_score", "search_text")


@query
def edge_last_write_wins(spark, root):
    l = read_table(spark, root, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("source"), F.concat(F.lit("supplier:"), "l_suppkey").alias("target"), F.lit("mentions_table").alias("type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("load_seq"), F.col("l_quantity").alias("weight"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("evidence"))
    return graph.merge_edges(l)


@query
def reference_edges(spark, root):
    e, _ = graph.resolve_references(_references(spark, root).withColumnsRenamed({"table_name": "source_table", "column_name": "source_column"}), read_table(spark, root, "physical_table"))
    return e.select("source", "target", "source_column", "target_column", "weight")


@query
def reference_stubs(spark, root):
    r = _references(spark, root).withColumnsRenamed({"table_name": "source_table", "column_name": "source_column"})
    _, stubs = graph.resolve_references(r, read_table(spark, root, "physical_table").where("sub_module IS NOT NULL"))
    return stubs


@query
def edges_with_both_ends(spark, root):
    l = read_table(spark, root, "lineitem").select(F.concat(F.lit("order:"), "l_orderkey").alias("source"), F.concat(F.lit("part:"), "l_partkey").alias("target")).distinct()
    o = read_table(spark, root, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("order:"), "o_orderkey").alias("id"))
    p = read_table(spark, root, "part").where("p_size < 20").select(F.concat(F.lit("part:"), "p_partkey").alias("id"))
    return graph.with_both_ends(l, o.unionByName(p))


@query
def same_module_names(spark, root):
    r = read_table(spark, root, "rest_resource").select("id", "name", F.array("module_id").alias("modules")).distinct()
    o = read_table(spark, root, "rest_operation").select("id", "resource_name", F.array("module_id").alias("modules")).distinct()
    return graph.match_names(o, r, "resource_name", "name")


@query
def catalog_edges(spark, root):
    return catalog_graph.edges(spark, root).select("source", "target", "type", "weight")


@query
def module_overlap_filter(spark, root):
    n = catalog_graph.nodes(spark, root)
    return n.where(F.arrays_overlap("modules", F.array(F.lit("prc"), F.lit("tax")))).groupBy("node_type").agg(_long("n", F.count(F.lit(1))))


@query
def alias_contains(spark, root):
    a = read_table(spark, root, "entity_aliases").select(F.col("entity_id").alias("alias_id"), F.explode("aliases").alias("alias")).where("alias IS NOT NULL").distinct()
    x = read_table(spark, root, "validated_rules").where("description IS NOT NULL").select("id", F.col("description").alias("text")).distinct()
    return lexical.alias_contains_join(a, x).select("alias_id", "id", _long("n"), F.round("weight", 6).alias("weight"))


@query
def graph_layer_split(spark, root):
    _, e = graph.split_layers(*catalog_graph.graph(spark, root))
    return e.groupBy("graph_layer", "type").agg(_long("n", F.count(F.lit(1))))


@query
def graph_master(spark, root):
    _, e = graph.master_graph(*catalog_graph.graph(spark, root))
    return e.select("source", "target", "type")


@query
def graph_stats(spark, root):
    return graph.graph_stats(*catalog_graph.graph(spark, root))


@query
def graph_adjacency_degree(spark, root):
    a = graph.adjacency(catalog_graph.edges(spark, root))
    return a.groupBy("from_id").agg(_long("degree", F.count(F.lit(1))), F.round(F.sum("weight"), 4).alias("total"))


def _seeds(spark, root):
    return read_table(spark, root, "entity_aliases").select(F.concat(F.lit("business_entity:"), "entity_id").alias("id")).distinct().orderBy("id").limit(12).withColumn("score", F.lit(1.0))


@query
def graph_expand_1hop(spark, root):
    return graph.expand(_seeds(spark, root), catalog_graph.edges(spark, root), 1).select("node", F.round("graph_score", 6).alias("score"))


@query
def graph_expand_2hop(spark, root):
    return graph.expand(_seeds(spark, root), catalog_graph.edges(spark, root), 2).select("node", F.round("graph_score", 6).alias("score"))


@query
def graph_paths_top3(spark, root):
    return graph.expansion_paths(_seeds(spark, root), catalog_graph.edges(spark, root), 2).select("node", "rank", F.round("score", 6).alias("score"), F.array_join("path", " > ").alias("path"))


# retrieval


def _documents(spark, root):
    return spread(read_table(spark, root, "documents").select(F.col("doc_id").alias("id"), "text"))


def _sample_queries(spark, root):
    return read_table(spark, root, "lang_samples").select(F.col("sample_id").alias("query_id"), "text")


@query
def document_frequencies(spark, root):
    return lexical.document_frequency(lexical.postings(_documents(spark, root), F.col("text"))).select("term", _long("df"))


@query
def corpus_length(spark, root):
    s = lexical.corpus_stats(_documents(spark, root), F.col("text"))
    return s.select(_long("n_docs"), F.round("avgdl", 6).alias("avgdl"))


def _bm25(spark, root):
    d = _documents(spark, root)
    posted = cut_lineage(lexical.postings(d, F.col("text")))  # read for statistics, frequencies and scores
    return posted, lexical.posted_stats(posted, d.count()), lexical.query_terms(_sample_queries(spark, root), F.col("text"))


@query
def bm25_topk(spark, root):
    """The 10 best documents of each sample text as a query."""
    s = lexical.bm25(*_bm25(spark, root)).withColumn("score", F.round("bm25", 5))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("query_id", "id", "score", _long("rank"))


@query
def root_scores_minmax(spark, root):
    return lexical.root_scores(*_bm25(spark, root), limit=20).select("query_id", "id", _long("rank"), F.round("score", 4).alias("score"))


@query
def title_scores(spark, root):
    n = catalog_graph.nodes(spark, root)
    q, tokens = F.lit("ledger periods"), T.tokenize(F.lit("ledger periods"))
    s = lexical.title_score(q, tokens, F.col("title"), F.col("qualified_name"), F.col("name"))
    return n.select("id", F.round(s, 6).alias("score")).where("score > 0")


@query
def keyword_scores(spark, root):
    n = catalog_graph.nodes(spark, root).where("node_type = 'business_entity'")
    q = "delivery schedule and the stock count"
    kw = T.node_keywords()
    return n.select("id", F.round(lexical.keyword_score(T.tokenize(F.lit(q)), F.lit(q), kw, F.concat(F.array("name", "qualified_name"), "aliases")), 4).cast("double").alias("score")).where("score > 0")


@query
def auxiliary_penalties(spark, root):
    p = read_table(spark, root, "physical_table").select("table_name").distinct()
    return p.select("table_name", lexical.auxiliary_penalty(F.lit("physical_table"), F.col("table_name"), F.lit("open invoices"), T.tokenize(F.lit("open invoices"))).alias("penalty"))


@query
def evidence_groups(spark, root):
    n = catalog_graph.nodes(spark, root)
    return n.groupBy(context.evidence_group(F.col("node_type"), F.col("source_type")).alias("evidence_group")).agg(_long("n", F.count(F.lit(1))))


@query
def hybrid_search(spark, root):
    n, e = catalog_graph.graph(spark, root)
    return lexical.hybrid_search(n, e, "ledger periods of the budget version", 20)


@query
def direct_scores(spark, root):
    """Direct scores of all catalog nodes for two queries."""
    n = catalog_graph.nodes(spark, root)
    q = spark.createDataFrame([(1, "rate types"), (2, "stock count of the site directory")], "query_id int, text string")
    s = lexical.direct_scores(n, q)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("direct_score", 5)), "id")
    return s.withColumn("rank", F.row_number().over(order)).where("rank <= 50").select("query_id", "id", F.round("direct_score", 5).alias("score"), _long("rank"))


@query
def children_prefilter(spark, root):
    """For each resource 4 operations, those that name the approval history first."""
    e = catalog_graph.edges(spark, root).where("type = 'has_operation'")
    o = read_table(spark, root, "rest_operation").select("id", "title", F.col("description").alias("d")).distinct()
    hit = o.where(F.contains(F.lower("d"), F.lit("approval history"))).select("id", F.length("d").cast("double").alias("score"))
    return lexical.prefilter_children(e, o.select("id", "title"), hit, 4).select("source", "id", _long("rank"))


def _results(spark, root):
    n = catalog_graph.nodes(spark, root).where("node_type IN ('physical_table', 'business_entity', 'rest_resource', 'validated_rule')")
    number = F.length("id") * 37 % 101
    return n.select(F.element_at("modules", 1).alias("query_id"), "id", "title", "node_type", "source_type", (number / 101.0 + F.length("title") / 10.0).alias("score"), (F.length("id") * 53 % 97 / 97.0).alias("semantic"), context.evidence_group(F.col("node_type"), F.col("source_type")).alias("evidence_group"))


@query
def semantic_rerank(spark, root):
    return context.rerank(_results(spark, root)).select("query_id", "id", F.round("context_score", 5).alias("context_score"), _long("rank"), _long("search_rank"))


@query
def context_selection(spark, root):
    found = _results(spark, root)
    r = context.rerank(found).withColumn("summary", F.repeat(F.lit("x"), (F.length("id") * 7).cast("int"))).join(found.select("query_id", "id", "node_type", "source_type"), ["query_id", "id"])
    return context.select_context(r, 16, 4000)


def _semantic(nodes, query: str, dimensions: int = 64):
    """(id, semantic): cosine of the offline encoder's vectors of node texts and of the query."""
    encode = vector.hashing_encoder(dimensions)
    asked = nodes.sparkSession.range(1).select(encode(F.lit(query)).alias("v")).first()["v"]
    return nodes.select("id", vector.cosine(encode(F.concat_ws("\n", "title", "qualified_name", "search_text")), vector.literal_vector(list(asked))).alias("semantic"))


@query
def context_hybrid(spark, root):
    """A context of at most 6,000 characters for one query: hybrid search, semantic rerank, summaries, rendering."""
    asked = "ledger periods of the budget version"
    n, e = catalog_graph.graph(spark, root)
    hits = cut_lineage(lexical.hybrid_search(n, e, asked, context.over_fetch(20)))
    nodes = n.join(hits.select("id"), "id", "left_semi")
    results = hits.select("id", "title", F.col("total_score").alias("score")).join(nodes.select("id", "node_type", "source_type"), "id").join(_semantic(nodes, asked), "id").withColumn("query_id", F.lit(0))
    c = context.build_context(results, nodes.select("id", F.col("search_text").alias("text")), asked, 16, 6000)
    return c.select("query_id", _long("n_items"), _long("characters"), F.array_join("ids", ",").alias("ids"), F.md5("context").alias("h"))


@query
def texts_selected_relevant(spark, root):
    """Texts of at most 500 characters as they are, longer ones summarized for one query."""
    out = context.select_relevant(_documents(spark, root), "ledger periods of the budget version")
    return out.select(F.col("id").alias("doc_id"), _long("n_chars", F.length("summary")), F.md5("summary").alias("h"))


@query
def context_rendering(spark, root):
    """Sections of each guide rendered as one context, in order of their ids."""
    s = read_table(spark, root, "functional_section").select("guide_id", "id", "node_type", "title", F.col("source.source_type").alias("st")).distinct()
    rank = F.row_number().over(Window.partitionBy("guide_id").orderBy("id", F.coalesce("title", F.lit(""))))
    s = s.withColumn("rank", rank)
    item = context.render_item(F.col("rank"), F.col("node_type"), F.col("title"), F.col("st"), F.lit(0.5), F.lit(""))
    c = context.render_context(s.select(F.col("guide_id").alias("query_id"), "rank", item.alias("item")))
    return c.select("query_id", F.md5("context").alias("h"), _long("characters"))


@query
def segment_documents(spark, root):
    s = context.segment_documents(_documents(spark, root))
    return s.groupBy("id").agg(_long("n_segments", F.count(F.lit(1))), _long("longest", F.max(F.length("segment"))))


@query
def summaries_within_budget(spark, root):
    """Extractive summaries of at most 500 characters for one query: segments by maximal marginal relevance, fitted, in source order."""
    out = context.fit_budget(context.rank_segments(context.segment_documents(_documents(spark, root)), "ledger periods of the budget version"), 500)
    return out.select(F.col("parent").alias("doc_id"), _long("n_chars", F.length("summary")), F.md5("summary").alias("h"))


@query
def mmr_ranking(spark, root):
    """Vectors of each label ranked by maximal marginal relevance to the first vector."""
    e = read_table(spark, root, "embeddings")
    first = e.orderBy("vec_id").first()["embedding"]
    return context.mmr_rank(e.select(F.col("label").alias("parent"), F.col("vec_id").alias("segment_index"), "embedding"), list(first))


# vectors


def _first_vector(spark, root):
    return list(read_table(spark, root, "embeddings").orderBy("vec_id").first()["embedding"])


@query
def vector_topk_roots(spark, root):
    e = read_table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vector.top_k(e, _first_vector(spark, root), 10, 5)


def _vector_scores(spark, root):
    e = read_table(spark, root, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("parent"), F.round(vector.cosine(F.col("embedding"), vector.literal_vector(_first_vector(spark, root))), 5).alias("score"))


@query
def vector_segment_mean_top2(spark, root):
    return vector.document_scores(_vector_scores(spark, root), 2).select("parent", F.round("score", 4).alias("score"))


@query
def vector_group_topk(spark, root):
    return vector.group_top_k(_vector_scores(spark, root), "parent", 3).select("parent", "id", "score", _long("rank"))


@query
def vector_shape_check(spark, root):
    v = read_table(spark, root, "semantic_embeddings").select("vector_id", "embedding", "dimensions").dropDuplicates(["vector_id"])
    r = vector.shape_report(v, F.col("dimensions"))
    return r.select(*[_long(c) for c in r.columns])


@query
def vector_block_scan(spark, root):
    """Exact nearest vectors of a block of queries, the first vector of each label."""
    e = read_table(spark, root, "embeddings")
    block = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).orderBy("label").collect()
    import numpy as np

    found = vector.scan_top_k(e.select(F.col("vec_id").alias("id"), "embedding"), np.array([r["v"] for r in block], dtype=float), 5)
    return found.select("query_no", "id", F.round("score", 4).alias("score"), "rank")


# federated


def _entity_scores(spark, root):
    n = catalog_graph.nodes(spark, root).where("node_type IN ('business_entity', 'validated_rule')")
    return n.select(F.element_at("modules", 1).alias("query_id"), "id", "node_type", "title", (F.length("title") * 1.0 + F.length("id") / 100.0).alias("score"))


@query
def federated_seeds(spark, root):
    return federated.master_seeds(_entity_scores(spark, root)).select("query_id", "id", _long("seed_rank"), F.round("seed_score", 6).alias("seed_score"))


def _routes(spark, root):
    return federated.routes(federated.master_seeds(_entity_scores(spark, root)), catalog_graph.edges(spark, root))


@query
def federated_routes(spark, root):
    return _routes(spark, root).select("query_id", "node", F.round("score", 6).alias("score"), "reason")


@query
def federated_fallback(spark, root):
    routed = _routes(spark, root).join(catalog_graph.nodes(spark, root).select(F.col("id").alias("node"), graph.node_layer(F.col("node_type")).alias("graph_layer")), "node")
    r = read_table(spark, root, "rest_resource").select("id", "name").distinct()
    roots = r.select("id", "name", F.explode(F.array(*[F.lit(m) for m in ("prc", "pay", "tax")])).alias("query_id"))
    roots = roots.select("query_id", F.lit("service").alias("graph_layer"), F.col("id").alias("node"), F.round(F.length("name") / 40.0, 4).alias("similarity"))
    queries = spark.createDataFrame([("prc",), ("pay",), ("tax",)], "query_id string")
    return federated.fallback_roots(routed.where("graph_layer <> 'service'").select("query_id", "graph_layer"), roots, queries, ["service", "physical"]).select("query_id", "node", F.round("score", 6).alias("score"))


@query
def federated_candidates(spark, root):
    """Routes, physical expansion and service expansion merged by priority."""
    e, n = catalog_graph.edges(spark, root), catalog_graph.nodes(spark, root)
    routed = cut_lineage(_routes(spark, root))
    similarity = n.where("node_type IN ('physical_column', 'rest_operation')").select(F.explode(F.array(*[F.lit(m) for m in ("prc", "pay", "tax")])).alias("query_id"), F.col("id").alias("node"), F.round(F.length("title") / 60.0, 4).alias("similarity"), "title")
    physical = federated.expand_physical(routed, e, similarity, n)
    resources = routed.join(n.where("node_type = 'rest_resource'").select(F.col("id").alias("node")), "node", "left_semi")
    operations = federated.expand_children(resources, e, similarity, "has_operation", federated.OPERATIONS_EACH, 0.65, "semantic_operation", federated.OPERATION_CANDIDATES)
    parts = [routed.withColumn("priority", F.when(F.col("reason") == "seed", 0).otherwise(1)), physical.withColumn("priority", F.when(F.col("reason") == "bridge", 2).otherwise(3)), operations.withColumn("priority", F.lit(3))]
    return federated.merge_candidates(parts).select("query_id", "node", F.round("score", 6).alias("score"), "reason", _long("priority"), _long("rank"))


# corpus and index


def _snapshots(spark, root):
    d = read_table(spark, root, "documents").select("doc_id", "text")
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" changed"))).otherwise(F.col("text"))
    hashed = lambda df: df.select(F.col("doc_id").alias("id"), T.text_hash("text").alias("content_hash"))
    return hashed(d.where("doc_id % 10 <> 0")), hashed(d.where("doc_id % 11 <> 0").select("doc_id", changed.alias("text")))


@query
def corpus_snapshot_diff(spark, root):
    """Two states of the corpus, as a refresh sees them: some documents gone, some new, some changed."""
    return corpus.snapshot_diff(*_snapshots(spark, root))


@query
def corpus_unreferenced_texts(spark, root):
    old, new = _snapshots(spark, root)
    h = lambda df: df.select(F.col("content_hash").alias("text_hash")).distinct()
    return corpus.unreferenced(h(old), h(new))


@query
def corpus_upsert(spark, root):
    e = read_table(spark, root, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return corpus.upsert(e.where("event_type <> 'purchase'"), e, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query
def embedding_pending(spark, root):
    e = read_table(spark, root, "semantic_embeddings").select(F.col("normalized_text_hash").alias("text_hash"), "model_name", "embedding_profile_version", "embedding")
    return corpus.pending_embeddings(e.select("text_hash").distinct(), e, "kb-encoder-base", "profile-2")


@query
def embedding_reuse(spark, root):
    e = read_table(spark, root, "semantic_embeddings").select(F.col("normalized_text_hash").alias("text_hash"), "model_name", "embedding_profile_version", "dimensions")
    r = corpus.reusable_embeddings(e.select("text_hash"), e, "kb-encoder-base", "profile-2")
    return r.select(_long("n"), _long("least"), _long("most"), "consistent")


@query
def vectorize_texts(spark, root):
    """Vectors of the distinct document texts by the offline encoder, nothing cached yet."""
    t = corpus.distinct_texts(read_table(spark, root, "documents"), F.col("text"))
    empty = spark.createDataFrame([], "text_hash string, model_name string, embedding_profile_version string, dimensions int, embedding array<float>")
    v = corpus.vectorize(t, empty, vector.hashing_encoder(32), "hashing", "1", 32)
    return v.select("text_hash", _long("size", F.size("embedding")))


@query
def run_latest_by_status(spark, root):
    e = read_table(spark, root, "events")
    status = F.element_at(F.array(*[F.lit(s) for s in ("completed", "failed", "interrupted", "running")]), (F.col("event_id") % 4 + 1).cast("int"))
    runs = e.select(F.col("user_id").alias("signature"), F.col("event_id").alias("run_id"), status.alias("status"), F.col("ts").alias("updated_at"))
    return corpus.latest_run(runs).select("signature", "run_id", "status")


def _layered(spark, root):
    n, e = catalog_graph.graph(spark, root)
    return graph.split_layers(n, e)


@query
def index_rebuild_decisions(spark, root):
    """A manifest in which one layer is current, one has another model, one is gone and one was never built."""
    n, e = _layered(spark, root)
    now = cut_lineage(index.layer_signatures(n, e))
    m = now.where("graph_layer IN ('business', 'physical')").select("graph_layer", "content", F.lit(index.SCHEMA_VERSION).alias("schema_version"), F.when(F.col("graph_layer") == "business", "m1").otherwise("m0").alias("model"))
    gone = spark.createDataFrame([("security", "x", index.SCHEMA_VERSION, "m1")], "graph_layer string, content string, schema_version string, model string")
    return index.rebuild_decisions(now, m.unionByName(gone), "m1")


def _catalog_index(spark, root):
    """Builds the layer index of the catalog in the shared folder; its path.

    Only the columns of the index are read; the layers' joins leave no edge without its ends."""
    import uuid

    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    n = catalog_graph.nodes(spark, root).select("id", "node_type", "title", "search_text", "modules")
    n = land(n.withColumn("graph_layer", graph.node_layer(F.col("node_type"))).where(F.col("graph_layer").isNotNull()), "index-nodes", compression="zstd")
    free_shuffles(spark)
    _, e = graph.split_layers(n.drop("graph_layer"), catalog_graph.edges(spark, root))
    e = land(e.select("source", "target", "type", "weight", "graph_layer"), "index-edges", compression="zstd")
    free_shuffles(spark)
    index.build_index(n, e, path)
    return path


@query
def index_build(spark, root):
    """Builds the layer index in the shared folder and reads back what each layer holds."""
    p = spark.read.parquet(f"{_catalog_index(spark, root)}/postings").groupBy("graph_layer").agg(_long("n_nodes", F.count_distinct("id")), _long("n_tokens", F.sum("tf")))
    return p.select(F.col("graph_layer").cast("string").alias("graph_layer"), "n_nodes", "n_tokens")


@query
def layer_signature(spark, root):
    n = read_table(spark, root, "nation").select(F.col("n_regionkey").alias("g"), "n_nationkey", "n_name")
    return corpus.signature(n, ["g"])


@query
def stream_corpus_refresh(spark, root):
    """The documents table as a stream of files, texts stored once by hash; the state after the run."""
    import uuid

    from graphloom.streaming.refresh import refresh_stream

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = read_table(spark, root, "documents").schema
    source = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/documents.parquet")
    folder = source.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(source).isDirectory()
    refresh_stream(spark, f"{root}/documents.parquet" if folder else root, schema, f"{base}/texts", f"{base}/checkpoint", glob="*.parquet" if folder else "documents.parquet").awaitTermination()
    return spark.read.parquet(f"{base}/texts").select("text_hash")


# checks


@query
def check_duplicates(spark, root):
    d = checks.duplicate_sample(read_table(spark, root, "physical_column").select("id"), "id")
    return d.select(_long("n_duplicates"), F.array_join("sample", ",").alias("sample"))


@query
def check_orphans(spark, root):
    n, e = catalog_graph.nodes(spark, root), catalog_graph.edges(spark, root)
    return graph.orphan_edges(e.select("source", "target", "type"), n.where("node_type <> 'rest_resource'"))


@query
def check_graph(spark, root):
    n, e = catalog_graph.graph(spark, root)
    return checks.validate_graph(n, e, "all").select("subject", "status", "code")


@query
def check_environment_catalog(spark, root):
    r = read_table(spark, root, "rest_resource").select("name")
    p = read_table(spark, root, "entity_aliases").select("module_id", F.col("rest_resources").alias("resources"))
    c = checks.validate_environment_catalog(r, p)
    return c.select("status", "code", F.map_values("details")[0].alias("value"))


@query
def check_mojibake(spark, root):
    s = read_table(spark, root, "functional_section").select("id", "text").distinct()
    return s.where(F.col("text").rlike(checks.MOJIBAKE)).groupBy("id").agg(_long("n", F.count(F.lit(1))))


@query
def check_vectors(spark, root):
    v = read_table(spark, root, "semantic_embeddings").select(F.col("vector_id").alias("id"), "embedding", "dimensions").dropDuplicates(["id"])
    return checks.validate_vectors(v, v.select("id"), "vectors").select("status", "code")


# references


@query
def p5_found(spark, root):
    return references.orphan_references(spark, root)


@query
def p5_report(spark, root):
    return references.orphan_report(spark, root)


# documents of nodes


def _typed(spark, root):
    """Tables of the catalog with their node type and id."""
    for name, node_type, key in (("rest_resource", "rest_resource", "id"), ("rest_operation", "rest_operation", "id"), ("validated_rules", "validated_rule", "id"), ("entity_aliases", "business_entity", "entity_id"), ("functional_section", "functional_section", "id")):
        yield node_type, files.without_errors(read_table(spark, root, name)) if name == "functional_section" else read_table(spark, root, name), key


@query
def node_search_texts(spark, root):
    """Search texts made anew from the fields of each type, as a migration of the graph does."""
    parts = [documents.with_search_text(df, t).select(F.lit(t).alias("node_type"), F.col(key).alias("id"), F.md5("search_text").alias("h")).distinct() for t, df, key in _typed(spark, root)]
    return functools.reduce(lambda x, y: x.unionByName(y), parts)


@query
def node_semantic_texts(spark, root):
    n = catalog_graph.nodes(spark, root)
    return n.select("id", F.md5(documents.semantic_text(n)).alias("h"))


@query
def operation_texts(spark, root):
    o = read_table(spark, root, "rest_operation").select("id", "title", "method", "endpoint_path", "description").distinct()
    return o.select("id", F.md5(documents.operation_text(o)).alias("h"))


@query
def summary_sources(spark, root):
    o = read_table(spark, root, "functional_section").select("id", "text", "search_text", "title").distinct()
    return o.select("id", F.md5(documents.summary_source(o)).alias("h"))


@query
def table_evidence(spark, root):
    t = catalog_graph.live(spark, root, "physical_table").select("id", "primary_key", catalog.result_grain(F.col("primary_key"))["description"].alias("grain"))
    e = documents.table_evidence(t, catalog_graph.edges(spark, root))
    return e.select("id", F.array_join("primary_key", ",").alias("primary_key"), "grain", F.array_join("references", ",").alias("targets"))


@query
def profile_texts(spark, root):
    """Texts of the sample queries as the two model profiles take them."""
    q = read_table(spark, root, "lang_samples")
    parts = [q.select("sample_id", F.lit(k).alias("profile"), F.md5(p.as_query(F.col("text"))).alias("as_query"), F.md5(p.as_passage(F.col("text"))).alias("as_passage")) for k, p in sorted(vector.PROFILES.items())]
    return functools.reduce(lambda x, y: x.unionByName(y), parts)


@query
def canonical_json_hash(spark, root):
    """Hashes of rows as JSON with sorted keys."""
    n = read_table(spark, root, "nation")
    return n.select("n_nationkey", T.json_hash(F.col("n_regionkey"), F.col("n_name"), F.col("n_nationkey")).alias("h"))


@query
def configured_sources(spark, root):
    e = read_table(spark, root, "entity_aliases").groupBy("module_id").agg(F.max(documents.configured(F.col("tables")) | documents.configured(F.col("rest_resources"))).alias("configured"))
    return e


# joins of the graph


@query
def nodes_of_modules(spark, root):
    """Nodes of two modules by the bridge table."""
    n = catalog_graph.nodes(spark, root)
    return lexical.in_modules(n, lexical.module_bridge(n), ["prc", "tax"]).select("id", "node_type")


@query
def nodes_fetched(spark, root):
    return graph.nodes_by_id(catalog_graph.nodes(spark, root), _seeds(spark, root)).select("id", "node_type", "title")


@query
def resource_children(spark, root):
    n, e = catalog_graph.graph(spark, root)
    resources = n.where("node_type = 'rest_resource'").select("id")
    down = graph.linked_nodes(n, e, resources, "has_operation").select("origin", "id", F.lit("child").alias("kind"))
    return down.unionByName(graph.linked_nodes(n, e, resources, "parent_of", parents=True).select("origin", "id", F.lit("parent").alias("kind")))


@query
def module_projection(spark, root):
    """Modules of the resources, with those of the entities that name them."""
    r = catalog_graph.live(spark, root, "rest_resource").select("id", "name", F.array_compact(F.array("module_id")).alias("modules"))
    p = read_table(spark, root, "entity_aliases").select(F.explode("rest_resources").alias("name"), "module_id").where("trim(name) <> ''")
    return graph.project_modules(r, p).select("id", F.array_join("modules", ",").alias("modules"))


def _environment(spark, root):
    """Resources of an environment: the names that operations give."""
    o = read_table(spark, root, "rest_operation").where("resource_name IS NOT NULL").select(F.lower(F.trim("resource_name")).alias("name")).distinct()
    return o.select(F.concat(F.lit("environment_resource:"), "name").alias("id"), "name")


@query
def environment_variants(spark, root):
    documented = catalog_graph.live(spark, root, "rest_resource").select("id", "name", F.array("module_id").alias("modules"))
    e, _ = graph.variant_edges(documented, _environment(spark, root))
    return e


def _analytics(spark, root):
    """(subject areas, questions, edges): the subject areas of the entities, and a question of each entity to each of its areas."""
    e = read_table(spark, root, "entity_aliases").select("entity_id", "name", F.explode("subject_areas").alias("subject")).where("trim(subject) <> ''").distinct()
    subjects = e.select(F.concat(F.lit("subject_area:"), T.normalize_text("subject")).alias("id"), T.normalize_text("subject").alias("name")).distinct()
    questions = e.select(F.concat(F.lit("business_question:"), "entity_id").alias("id"), "name", "subject")
    return subjects, questions, graph.answered_edges(questions, subjects)


@query
def question_subjects(spark, root):
    return _analytics(spark, root)[2]


@query
def federated_analytics(spark, root):
    """For each subject area the two questions that a score, made from the length of their names, puts first."""
    subjects, questions, e = _analytics(spark, root)
    nodes = subjects.select("id", F.lit("subject_area").alias("node_type"))
    similarity = questions.select(F.lit("q").alias("query_id"), F.col("id").alias("node"), F.round(F.length("name") / 40.0, 4).alias("similarity"), F.col("name").alias("title")).distinct()
    out = federated.expand_analytics(subjects.select(F.lit("q").alias("query_id"), F.col("id").alias("node")), e, similarity, nodes)
    return out.select("node", F.round("score", 6).alias("score"), "reason")


@query
def graph_migrated_edges(spark, root):
    """Edges with legacy types among them, and without."""
    e = catalog_graph.edges(spark, root).withColumn("type", F.when(F.col("type") == "mentions_table", "mentions_entity").otherwise(F.col("type")))
    return graph.without_legacy(e).groupBy("type").agg(_long("n", F.count(F.lit(1))))


# corpus state


@query
def vectors_reused_by_content(spark, root):
    """Vectors of one profile taken over for the texts of the other, by model, hash and dimensions."""
    v = read_table(spark, root, "semantic_embeddings").select("vector_id", "model_name", F.col("normalized_text_hash").alias("content_hash"), "dimensions", "embedding_profile_version", "embedding").dropDuplicates(["vector_id"])
    keys = ["model_name", "content_hash", "dimensions"]
    wanted = v.where("embedding_profile_version = 'profile-2'").select("vector_id", *keys)
    reused, rest = corpus.reuse_by_content(wanted, v.where("embedding_profile_version <> 'profile-2'").select(*keys, "embedding"), keys)
    return reused.select("vector_id", F.lit("reused").alias("status")).unionByName(rest.select("vector_id", F.lit("pending").alias("status")))


@query
def eligible_node_counts(spark, root):
    n = catalog_graph.nodes(spark, root).withColumn("graph_layer", graph.node_layer(F.col("node_type")))
    c = corpus.eligible_counts(n, {"physical": ["physical_table", "physical_column"], "service": ["rest_resource", "rest_operation"], "business": ["business_entity", "validated_rule"]})
    return c.select("graph_layer", "node_type", _long("n"), _long("n_without_text"))


@query
def collection_counts(spark, root):
    s = read_table(spark, root, "functional_section")
    return corpus.collection_stats(s, F.col("module_id")).select("kind", _long("n"), _long("n_errors"))


@query
def run_log_states(spark, root):
    """The events of each user as the log of a run."""
    e = read_table(spark, root, "events")
    status = F.element_at(F.array(*[F.lit(x) for x in ("running", "interrupted", "failed", "completed")]), (F.col("event_id") % 4 + 1).cast("int"))
    log = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), status.alias("status"), F.col("ts").alias("at"))
    return corpus.run_states(log).select("run_id", "status", "n_steps", "n_invalid")


@query
def text_chunk(spark, root):
    """The first 100 texts behind a key, as a resumed run takes them."""
    t = corpus.distinct_texts(read_table(spark, root, "documents"), F.col("text"))
    return corpus.next_chunk(t.select("text_hash"), "8", 100)


@query
def index_metadata(spark, root):
    """Tables and layers of an index as its files lie."""
    return index.refresh_metadata(spark, _catalog_index(spark, root)).select("table", "graph_layer")


@query
def semantic_join(spark, root):
    """Vectors of the embeddings table joined to nodes, filtered by layer and module."""
    n = catalog_graph.nodes(spark, root).withColumn("graph_layer", graph.node_layer(F.col("node_type")))
    t = n.where("node_type = 'business_entity'").select("id", "node_type", "title", "modules", "graph_layer")
    v = read_table(spark, root, "embeddings").join(t.select("id", ((F.length("id") * 37 + F.length("title")) % 100).cast("bigint").alias("vec_id")), "vec_id").select("id", "embedding")
    return vector.joined_vectors(v, t, ["business"], None, ["prc", "tax"]).select("id", "title", _long("size", F.size("embedding")))


@query
def check_bundle(spark, root):
    n, e = _layered(spark, root)
    return checks.validate_bundle(n, e, ["business", "physical", "service", "analytics"]).select("subject", "status", "code")


# pages


def _object_pages(spark, root):
    """Object pages of the live tables and columns."""
    c = catalog_graph.live(spark, root, "physical_column")
    cell = lambda x: F.concat(F.lit("<td>"), F.replace(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</td>"))
    rows = c.select("table_name", "position", F.concat(F.lit("<tr>"), cell(F.col("name")), cell(F.col("datatype")), F.lit("</tr>")).alias("row"), "name").where("position IS NOT NULL")
    listed = rows.groupBy("table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "name", "row"))), lambda x: x["row"]), "").alias("rows"))
    t = catalog_graph.live(spark, root, "physical_table").select("table_name", F.coalesce(F.array_join("primary_key", ", "), F.lit("")).alias("pk")).distinct().join(listed, "table_name")
    page = F.concat(F.lit("<html><h1>"), "table_name", F.lit("</h1><p>Object type: TABLE</p><h2>Primary Key</h2><table><tr><th>Name</th><th>Columns</th></tr><tr><td>PK</td><td>"), "pk", F.lit("</td></tr></table><h2>Columns</h2><table><tr><th>Name</th><th>Datatype</th></tr>"), "rows", F.lit("</table></html>"))
    return t.select(F.concat(F.lit("https://docs.kb.example/"), "table_name", F.lit(".html")).alias("url"), page.alias("html"))


@query
def physical_object_columns(spark, root):
    """Columns read back from object pages."""
    _, c, _ = pages.physical_objects(_object_pages(spark, root))
    return c.select("table_name", "name", "datatype").distinct()


@query
def physical_manifest(spark, root):
    t, c, _ = pages.physical_objects(_object_pages(spark, root))
    m = pages.physical_manifest(t, c)
    return m.select("table_name", _long("n_columns"), F.array_join(F.from_json("document", "primary_key array<string>")["primary_key"], ",").alias("primary_key"))


@query
def pages_to_fetch(spark, root):
    """Addresses of the documents that the landed pages, those of the sections, do not hold."""
    landed = read_table(spark, root, "functional_section").select(F.col("source.url").alias("url")).where("url IS NOT NULL").distinct().withColumn("key", pages.url_key(F.col("url"))).withColumn("error", F.lit(None).cast("string"))
    return pages.missing_pages(read_table(spark, root, "documents").select("url"), landed).select("url", "key")


def queries() -> dict:
    return dict(QUERIES)
