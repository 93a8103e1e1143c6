"""Operators on state and documents, against small fixtures."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import checks, corpus, documents, federated, graph, index, lexical, vector
from graphloom.sources import pages


def test_texts_of_nodes(spark):
    df = spark.createDataFrame([("T1", "a  b", None, " "), ("T1", None, "a  b", "x")], "table_name string, description string, module_name string, sub_module string")
    assert [r.t for r in df.select(documents.search_text(df, "physical_table").alias("t")).collect()] == ["T1 a b", "T1 a b x"]
    op = spark.createDataFrame([("Get", "GET", "/x", [f"p{i}" for i in range(30)], None, "d" * 2000)], "title string, method string, endpoint_path string, parameters array<string>, attributes array<string>, description string")
    text = op.select(documents.operation_text(op).alias("t")).first()["t"].split("\n")
    assert text[0] == "Get" and text[1] == "GET /x" and text[2].count("p") == 24 and len(text[3]) == 1200
    s = spark.createDataFrame([("same", "same", "other"), (None, None, None)], "description string, text string, title string")
    assert [r.t for r in s.select(documents.summary_source(s).alias("t")).collect()] == ["same\nother", ""]
    c = spark.createDataFrame([(["", None],), ([" x"],), (None,), ([],)], "v array<string>")
    assert [r.ok for r in c.select(documents.configured(F.col("v")).alias("ok")).collect()] == [False, True, False, False]
    assert documents.public_fields(spark.createDataFrame([(1, 2)], "a int, _b int")).columns == ["a"]


def test_profiles(spark):
    df = spark.createDataFrame([("x", [1.0, 0.0]), (None, [1.0]), ("y", None), ("z", [float("nan"), 1.0])], "t string, v array<double>")
    p = vector.ModelProfile("two", 2, "q: {text}", "p: {text}!")
    rows = df.select(p.as_query(F.col("t")).alias("q"), p.as_passage(F.col("t")).alias("p"), p.usable(F.col("v")).alias("u")).collect()
    assert [tuple(r) for r in rows] == [("q: x", "p: x!", True), ("q: ", "p: !", False), ("q: y", "p: y!", False), ("q: z", "p: z!", False)]
    assert {k: v.dimensions for k, v in vector.PROFILES.items()} == {"base": 768, "large": 1024}


def test_run_states(spark):
    log = [("a", 1, "running"), ("a", 2, "interrupted"), ("a", 3, "completed"), ("a", 4, "running"), ("a", 5, "completed"), ("a", 6, "running"), ("b", 1, "failed"), ("c", 1, "running"), ("c", 2, "failed")]
    got = corpus.run_states(spark.createDataFrame(log, "run_id string, seq int, status string").withColumn("at", F.lit(None).cast("timestamp"))).collect()
    assert {r.run_id: (r.status, r.n_steps, r.n_invalid) for r in got} == {"a": ("completed", 6, 2), "b": (None, 1, 1), "c": ("failed", 2, 0)}


def test_reuse_and_chunks(spark):
    stored = spark.createDataFrame([("l", "n1", "h1", [1.0]), ("l", "n1", "h1", [1.0]), ("l", "n2", "h2", None)], "graph_layer string, id string, content_hash string, embedding array<double>")
    wanted = spark.createDataFrame([("l", "n1", "h1"), ("l", "n1", "other"), ("l", "n2", "h2")], "graph_layer string, id string, content_hash string")
    reused, rest = corpus.reuse_by_content(wanted, stored, ["graph_layer", "id", "content_hash"])
    assert [r.id for r in reused.collect()] == ["n1"] and sorted(r.content_hash for r in rest.collect()) == ["h2", "other"]
    texts = spark.createDataFrame([(x,) for x in "dacb"], "text_hash string")
    assert [r.text_hash for r in corpus.next_chunk(texts, "a", 2).collect()] == ["b", "c"]
    seen = spark.createDataFrame([("b",)], "text_hash string")
    assert [r.text_hash for r in corpus.sweep(texts, seen, ["text_hash"]).collect()] == ["b"]


def test_variants_and_projection(spark):
    doc = spark.createDataFrame([("r1", "Ledger Périods", ["gl"]), ("r2", "other", ["x"])], "id string, name string, modules array<string>")
    env = spark.createDataFrame([("e1", "ledger periods"), ("e2", "alone")], "id string, name string")
    edges, nodes = graph.variant_edges(doc, env)
    assert [(r.source, r.target) for r in edges.collect()] == [("r1", "e1")]
    assert {r.id: r.modules for r in nodes.collect()} == {"e1": ["gl"], "e2": []}
    p = spark.createDataFrame([(" OTHER", "m2"), ("other", "m1"), ("nobody", "m9"), ("other", None)], "name string, module_id string")
    assert {r.id: r.modules for r in graph.project_modules(doc, p).collect()} == {"r1": ["gl"], "r2": ["m1", "m2", "x"]}
    bridge = lexical.module_bridge(doc)
    assert [r.id for r in lexical.in_modules(doc, bridge, ["x"]).collect()] == ["r2"]


def test_analytics_expansion(spark):
    nodes = spark.createDataFrame([("s", "subject_area"), ("t", "physical_table")], "id string, node_type string")
    routed = spark.createDataFrame([("q", "s"), ("q", "t")], "query_id string, node string")
    edges = spark.createDataFrame([(f"b{i}", "s", "answered_by") for i in range(4)], "source string, target string, type string")
    sim = spark.createDataFrame([("q", f"b{i}", i / 10, f"t{i}") for i in range(3)], "query_id string, node string, similarity double, title string")
    got = {r.node: round(r.score, 4) for r in federated.expand_analytics(routed, edges, sim, nodes).collect()}
    assert got == {"s": 0.95, "b2": 0.69, "b1": 0.67}


def test_pages(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError("no route")
        return {"h": (200, "text/html", "<h1>T</h1><p>x</p>"), "m": (404, "text/html", ""), "p": (200, "application/pdf", ""), "e": (503, "text/html", "")}[url[-1]]

    wanted = spark.createDataFrame([("http://a/h",), ("http://a/h",), ("http://a/m",), ("http://a/p",), ("http://a/e",), ("http://bad/",), (None,)], "url string")
    landed = pages.fetch_pages(pages.missing_pages(wanted, spark.createDataFrame([], pages.PAGE)), fetch)
    rows = {r.url: (r.html, r.error) for r in landed.collect()}
    assert rows["http://a/h"] == ("<h1>T</h1><p>x</p>", None) and len(rows) == 5
    assert [rows[u][1] for u in ("http://a/m", "http://a/p", "http://a/e", "http://bad/")] == ["status 404", "unexpected content type application/pdf", "status 503 after 3 attempts", "failed: no route"]
    assert {r.node_type for r in pages.error_rows(landed).collect()} == {"collection_error"} and pages.error_rows(landed).count() == 4
    assert {r.url for r in pages.missing_pages(wanted, landed).collect()} == {"http://a/m", "http://a/p", "http://a/e", "http://bad/"}  # failed pages are asked for again
    sections = pages.guide_sections(landed.where("error IS NULL")).collect()
    assert [(s.title, s.text) for s in sections] == [("T", "x")]


def test_contents_and_analytics(spark):
    toc = spark.createDataFrame([("http://a/g/toc.html", "<li><a href='x1.html'>A</a></li><li><a href='y.html'>B</a></li><li><a href='x2.html'>C</a></li>")], "url string, html string")
    known = spark.createDataFrame([("http://a/g/x2.html",)], "url string")
    assert [r.url for r in pages.wanted_pages(toc, ["X"], ["z"], known).collect()] == ["http://a/g/x1.html"]
    p = spark.createDataFrame([("http://a/1.html", "<h1>How many invoices are open?</h1><p>subject area data elements</p>"), ("http://a/2.html", "<h1>Get Help</h1>"), ("http://a/3.html", None)], "url string, html string")
    assert {r.url: r.node_type for r in pages.analytics_pages(p).collect()} in ({"http://a/1.html": "business_question", "http://a/2.html": "excluded"}, {"http://a/1.html": "excluded", "http://a/2.html": "excluded"})


def test_physical_objects(spark):
    page = "<h1>t_one</h1><p>Object type: {}</p><p>Holds things.</p><h2>Primary key</h2><table><tr><th>Name</th><th>Columns</th></tr><tr><td>PK</td><td>A, B</td></tr></table><h2>Columns</h2><table><tr><th>Name</th><th>Datatype</th><th>Comments</th></tr><tr><td>a</td><td>NUMBER</td><td>first</td></tr><tr><td>b</td><td>DATE</td><td></td></tr></table><h2>Foreign Keys</h2><table><tr><th>Table</th><th>Foreign Table</th><th>Foreign Key Column</th></tr><tr><td>T_ONE</td><td>t_two</td><td>b</td></tr></table>"
    t, c, k = pages.physical_objects(spark.createDataFrame([("u1", page.format("TABLE")), ("u2", page.format("VIEW"))], "url string, html string"))
    assert [tuple(r) for r in t.collect()] == [("T_ONE", "Holds things.", ["A", "B"])]
    assert [tuple(r) for r in c.orderBy("position").collect()] == [("T_ONE", "A", "NUMBER", "first", 1), ("T_ONE", "B", "DATE", None, 2)]
    assert [tuple(r) for r in k.collect()] == [("T_ONE", "B", "T_TWO")]
    m = pages.physical_manifest(t, c).first()
    assert m.n_columns == 2 and '"name":"A"' in m.document


def test_discovery_and_metadata(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text("{}")
    (tmp_path / "y.json").write_text("{}")
    (tmp_path / "z.txt").write_text("")
    assert [r.path.rsplit("/", 1)[1] for r in pages.discover(spark, str(tmp_path)).collect()] == ["x.json", "y.json"]
    nodes = spark.createDataFrame([("n1", "physical_table", "t", "text one", ["m"], "physical"), ("n2", "physical_table", "u", "text two", ["m"], "physical")], "id string, node_type string, title string, search_text string, modules array<string>, graph_layer string")
    edges = spark.createDataFrame([("n1", "n2", "foreign_key_to", 1.0, "physical")], "source string, target string, type string, weight double, graph_layer string")
    path = str(tmp_path / "index")
    index.build_index(nodes, edges, path)
    index.write_vectors(spark.createDataFrame([("n1", 0, [1.0]), ("n1", 1, [2.0]), ("zz", 0, [3.0])], "id string, segment_index int, embedding array<double>"), nodes, path)
    assert sorted(r.kind for r in spark.read.parquet(f"{path}/vectors").collect()) == ["root", "segment"]
    assert {(r.table, r.graph_layer) for r in index.refresh_metadata(spark, path).collect()} == {(t, "physical") for t in ("nodes", "edges", "postings", "vectors")}
    posted = index.indexed_layer(spark, path, "postings", ["physical"])
    assert checks.validate_index(nodes, edges, posted, "physical").where("status <> 'OK'").count() == 0
    assert index.stale_layers(nodes, edges, path).count() == 0


def test_module_bundle_and_results(spark, tmp_path):
    (tmp_path / "tables.json").write_text("{}")
    good = checks.validate_module(spark, {"id": "gl", "name": "Ledger", "sources": {"docs": ["u"]}, "files": ["tables.json"]}, str(tmp_path))
    assert good.where("status <> 'OK'").count() == 0
    bad = checks.validate_module(spark, {"id": " ", "sources": {"docs": ["", None]}, "files": ["gone.json"]}, str(tmp_path))
    assert {r.code for r in bad.where("status <> 'OK'").collect()} == {"MODULE_ID", "MODULE_NAME", "MODULE_SOURCES", "MODULE_FILE_MISSING"}
    nodes = spark.createDataFrame([("a", "physical_table", "physical"), ("b", "odd", None)], "id string, node_type string, graph_layer string")
    edges = spark.createDataFrame([("a", "zz", "uses_table", "physical")], "source string, target string, type string, graph_layer string")
    codes = {r.code: r.status for r in checks.validate_bundle(nodes, edges, ["physical"]).collect()}
    assert codes["PHYSICAL_GRAPH_ORPHAN_EDGES"] == "ERROR" and codes["BUNDLE_UNKNOWN_LAYERS"] == "ERROR" and codes["PHYSICAL_GRAPH_UNIQUE_NODE_IDS"] == "OK"
    results = spark.createDataFrame([("q", "text", 4, ["a"], 0), ("r", "text", 5, ["a", "a"], 1), ("s", "", 0, [], 0)], "query_id string, context string, characters int, ids array<string>, n_without_source int")
    found = {r.code for r in checks.validate_results(results, 3).where("status <> 'OK'").collect()}
    assert {"SEARCH_RESULT_CONTEXT", "SEARCH_RESULT_CHARACTER_MISMATCH", "SEARCH_RESULT_BUDGET_EXCEEDED", "SEARCH_RESULT_DUPLICATES", "SEARCH_RESULT_MISSING_SOURCES"} <= found
    d = checks.duplicate_sample(spark.createDataFrame([(x,) for x in "aabbc"], "id string"), "id").first()
    assert d.n_duplicates == 2 and d["sample"] == ["a", "b"]


def test_values(spark, tmp_path):
    import re

    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", spark.range(1).select(T.utc_now().alias("t")).first()["t"])
    df = spark.createDataFrame([(1, None)], "b int, a string")
    assert df.select((T.json_hash(F.col("b"), F.col("a")) == T.json_hash(F.col("a"), F.col("b"))).alias("same")).first()["same"]
    assert df.select((T.json_hash(F.col("b"), F.col("a")) == F.sha2(F.lit('{"a":null,"b":1}'), 256)).alias("same")).first()["same"]
    (tmp_path / "f.bin").write_bytes(b"x")
    assert spark.read.format("binaryFile").load(str(tmp_path / "f.bin")).select((T.file_hash(F.col("content")) == F.sha2(F.lit("x"), 256)).alias("same")).first()["same"]
    with pytest.raises(Exception):
        spark.range(1).select(T.file_hash(F.col("nothing"))).collect()


def test_landed_tables_are_released(spark):
    import os

    from graphloom.sources import tables as S

    S.release_landed(spark)
    df = S.land(spark.range(3), "test")
    path = df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert df.count() == 3 and os.path.isdir(path)
    assert S.release_landed(spark) == 1 and not os.path.exists(path)


def test_index_of_catalog_lands_only_its_columns(spark, tmp_path, monkeypatch):
    from graphloom import queries
    from graphloom.plans import catalog_graph

    n = spark.createDataFrame([("r", "validated_rule", "R", "rule one", ["m"], "x"), ("e", "business_entity", "E", "entity", ["m"], "x"), ("t", "physical_table", "T", "table", ["m"], "x")], "id string, node_type string, title string, search_text string, modules array<string>, source_type string")
    e = spark.createDataFrame([("e", "r", "mapped_to_entity", 1.0), ("r", "t", "uses_table", 1.0), ("e", "gone", "mapped_to_entity", 1.0)], "source string, target string, type string, weight double")
    monkeypatch.setattr(catalog_graph, "nodes", lambda *_: n)
    monkeypatch.setattr(catalog_graph, "edges", lambda *_: e)
    monkeypatch.setattr(queries, "shared_dir", lambda _: str(tmp_path))
    found = {(r.table, r.graph_layer) for r in queries.index_metadata(spark, "").collect()}
    assert found == {("nodes", "business"), ("nodes", "physical"), ("postings", "business"), ("postings", "physical"), ("edges", "business")}
    monkeypatch.setattr(queries, "cut_lineage", None)  # checkpoints are rows as they lie in memory, with every column
    assert queries.index_metadata(spark, "").count() == 5
    assert "source_type" not in spark.read.parquet(str(next(p for p in tmp_path.rglob("nodes/*/*.parquet")))).columns
