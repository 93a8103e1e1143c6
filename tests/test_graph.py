import itertools

import pytest
from pyspark.sql import functions as F

from graphloom.operators import catalog, checks, corpus, federated, graph, index, lexical, rules


def test_merge_nodes_is_independent_of_order(spark):
    schema = "id string, title string, modules array<string>, load_seq long, confidence_score double, search_text string"
    a = spark.createDataFrame([("x", "", ["m1"], 1, 0.4, "one"), ("x", "Second", ["m2", "m1"], 2, 0.9, "two"), ("y", None, None, 3, None, None)], schema)
    for parts in ([a], [a.where("load_seq = 2"), a.where("load_seq <> 2")]):
        r = {x.id: x for x in graph.merge_nodes(parts, ["title"], ["modules"]).collect()}
        assert (r["x"].title, r["x"].modules, r["x"].confidence_score, r["x"].search_text) == ("Second", ["m1", "m2"], 0.9, "one two")
        assert r["y"].title is None and r["y"].modules == []


def test_edges_and_stubs(spark):
    e = spark.createDataFrame([("a", "b", "t", 1.0, 1, "x"), ("a", "b", "t", 0.5, 2, "y"), ("a", "z", "t", 1.0, 3, "q")], "source string, target string, type string, weight double, load_seq long, evidence string")
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    m = graph.merge_edges(e, n).collect()
    assert len(m) == 1 and m[0].evidence == "y" and m[0].weight == 0.5
    assert graph.merge_edges(e, n, keep_all_evidence=True).first()["evidence"] == ["x", "y"]
    assert {r.target for r in graph.orphan_edges(e, n).collect()} == {"z"}
    refs = spark.createDataFrame([("A", "C", "b1", "X"), ("A", "D", "GONE", "X")], "source_table string, source_column string, target_table string, target_column string")
    edges, stubs = graph.resolve_references(refs, spark.createDataFrame([("A",), ("B1",)], "table_name string"))
    assert edges.count() == 2 and [r.table_name for r in stubs.collect()] == ["GONE"]


def test_expansion_matches_brute_force(spark):
    rows = [("a", "b", 1.0), ("b", "c", 0.5), ("c", "d", 1.0), ("a", "c", 0.3), ("a", "b", 0.9)]
    e = spark.createDataFrame([(s, t, "t", w) for s, t, w in rows], "source string, target string, type string, weight double")
    seeds = spark.createDataFrame([("a", 2.0), ("d", 1.0)], "id string, score double")
    near: dict = {}
    for s, t, w in rows:
        for x, y in ((s, t), (t, s)):
            near[x, y] = max(w, near.get((x, y), 0))
    want: dict = {}
    for start, score in (("a", 2.0), ("d", 1.0)):
        for hops in (1, 2):
            for path in itertools.product("abcd", repeat=hops):
                v, at = score, start
                for p in path:
                    v *= 0.68 * near.get((at, p), 0)
                    at = p
                if v:
                    want[at] = max(want.get(at, 0), v)
    got = {r.node: r.graph_score for r in graph.expand(seeds, e, 2).collect()}
    assert got == pytest.approx(want)
    assert all(len(r.path) <= 3 for r in graph.expansion_paths(seeds, e, 2).collect())


def test_names_prefer_the_same_module(spark):
    left = spark.createDataFrame([("l1", "Ação", ["m1"]), ("l2", "acao", ["m9"]), ("l3", None, ["m1"])], "id string, name string, modules array<string>")
    right = spark.createDataFrame([("r1", "ACAO", ["m1"]), ("r2", "ação ", ["m2"])], "id string, label string, modules array<string>")
    got = {(r.left_id, r.right_id) for r in graph.match_names(left, right, "name", "label").collect()}
    assert got == {("l1", "r1"), ("l2", "r1"), ("l2", "r2")}


def test_layers_and_master(spark):
    n = spark.createDataFrame([("e", "business_entity", ["m"]), ("t", "physical_table", ["m"]), ("c", "physical_column", ["m"]), ("q", "other", ["m"])], "id string, node_type string, modules array<string>")
    e = spark.createDataFrame([("e", "t", "mapped_to_entity", 1.0), ("t", "c", "contains_column", 1.0), ("t", "c", "related_by_alias", 1.0)], "source string, target string, type string, weight double")
    nodes, edges = graph.split_layers(n, e)
    assert {r.id for r in nodes.collect()} == {"e", "t", "c"} and [r.type for r in edges.collect()] == ["contains_column"]
    mn, me = graph.master_graph(n, e)
    assert {r.id for r in mn.collect()} == {"e", "t"} and [r.type for r in me.collect()] == ["mapped_to_entity"]
    codes = {r.code: r.status for r in checks.validate_graph(n, e, "x").collect()}
    assert codes["GRAPH_FORBIDDEN_EDGES"] == "ERROR" and codes["GRAPH_NO_ORPHAN_EDGES"] == "OK"
    assert checks.report(checks.validate_graph(n, e, "x")).first()["status"] == "FAILED"


def test_catalog(spark):
    cols = spark.createDataFrame([("T", "T_ID", "NUMBER", "", ), ("T", "REF_ID", "NUMBER", None), ("T", "ACTIVE_FLAG", "VARCHAR2", "Y (Yes) or N (No)"), ("T", "LAST_UPDATE_DATE", "DATE", None), ("T", "A_VERSION_NUMBER", "NUMBER", None)], "table_name string, name string, datatype string, description string")
    tabs = spark.createDataFrame([("T", ["T_ID", "A_VERSION_NUMBER"], "told")], "table_name string, primary_key array<string>, description string")
    refs = spark.createDataFrame([("T", "REF_ID")], "table_name string, column_name string")
    roles = {r.name: r.semantic_roles for r in catalog.classify_columns(cols, tabs, refs).collect()}
    assert roles == {"T_ID": ["primary_key", "identifier"], "REF_ID": ["foreign_key"], "ACTIVE_FLAG": ["categorical_flag"], "LAST_UPDATE_DATE": ["audit", "temporal"], "A_VERSION_NUMBER": ["primary_key"]}
    kinds = {r.rule_type for r in catalog.table_rules(tabs, cols, refs).collect()}
    assert kinds == {"documented_business_context", "uniqueness", "audit", "referential_integrity", "flag_domain"}
    rank = {r.purpose: r for r in catalog.ranking_candidates(tabs, cols).collect()}
    assert rank["latest_business_version_candidate"].partition_by == ["T_ID"] and "most_recent_update_candidate" in rank
    page = spark.createDataFrame([("Buyer", "a job role", ""), ("Purchase Analysis", "", ""), ("Overview", "x", "")], "t string, x string, u string")
    assert [r[0] for r in page.select(catalog.classify_page(F.col("t"), F.col("x"), F.col("u"))).collect()] == ["security", "analytics", "excluded"]


def test_rules_keep_the_latest(spark):
    t = spark.createDataFrame([(1, 1, "A"), (1, 2, "A"), (2, 5, "B")], "k int, v int, s string")
    r = rules.run_rule(rules.Rule("t", [("s", "IN", ["A", "B"])], [], ["k"], [("v", True)]), {"t": t})
    assert sorted((x.k, x.v) for x in r.collect()) == [(1, 2), (2, 5)]


def test_bm25_and_hybrid_search(spark):
    schema = "id string, node_type string, title string, name string, qualified_name string, object_name string, search_text string, modules array<string>, aliases array<string>, keywords array<string>, confidence_score double, source_type string"
    n = spark.createDataFrame([("t1", "physical_table", "Invoice Lines", "Invoice Lines", None, "INVOICE_LINES", "lines of an invoice", ["m"], [], ["invoice"], 0.9, "s"), ("t2", "physical_table", "Hold Notes", None, None, "HOLD_NOTES_HISTORY", "notes", ["m"], [], [], 0.9, "s"), ("e1", "business_entity", "Bill", None, None, None, "bill", ["x"], ["invoice lines"], [], None, "s")], schema)
    e = spark.createDataFrame([("t1", "t2", "foreign_key_to", 1.0)], "source string, target string, type string, weight double")
    r = lexical.hybrid_search(n, e, "invoice lines").collect()
    assert r[0].id == "t1" and {x.id for x in r} == {"t1", "e1", "t2"} and [x.total_score for x in r if x.id == "t2"][0] > 0
    assert {x.id for x in lexical.hybrid_search(n, e, "invoice lines", modules=["x"]).collect()} == {"e1"}
    assert lexical.hybrid_search(n, e, "").count() == 0


def test_snapshot_and_cache(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", None)], "id string, content_hash string")
    b = spark.createDataFrame([("1", "x"), ("2", "z"), ("3", None), ("4", "q")], "id string, content_hash string")
    assert {r.id: r.status for r in corpus.snapshot_diff(a, b).collect()} == {"1": "reused", "2": "changed", "3": "reused", "4": "new"}
    assert {r.id: r.status for r in corpus.snapshot_diff(b, a).collect()}["4"] == "removed"
    runs = spark.createDataFrame([("s", "r1", "completed", 9), ("s", "r2", "failed", 1), ("s", "r3", "running", 0)], "signature string, run_id string, status string, updated_at int")
    assert corpus.latest_run(runs).first()["run_id"] == "r3"


def test_index_skips_unchanged_layers(spark, tmp_path):
    n = spark.createDataFrame([("a", "physical_table", "A", "alpha", ["m"], "physical"), ("b", "business_entity", "B", "beta", ["m"], "business")], "id string, node_type string, title string, search_text string, modules array<string>, graph_layer string")
    e = spark.createDataFrame([("a", "a", "t", 1.0, "physical")], "source string, target string, type string, weight double, graph_layer string")
    path = str(tmp_path / "index")
    assert {r.graph_layer: r.action for r in index.build_index(n, e, path).collect()} == {"physical": "rebuild", "business": "rebuild"}
    assert index.stale_layers(n, e, path).count() == 0
    changed = n.withColumn("title", F.when(F.col("id") == "b", "B2").otherwise(F.col("title")))
    assert [r.graph_layer for r in index.stale_layers(changed, e, path).collect()] == ["business"]
    with pytest.raises(ValueError):
        index.build_index(n, spark.createDataFrame([("a", "zz", "t", 1.0, "physical")], e.schema), path)


def test_index_postings_are_counted_in_place(spark, tmp_path, monkeypatch):
    texts = ["the Quick quick BROWN_Fox fox2 Fox2A HTTPServer aB", None, "", "x", "ﬁnance ½ ｆｕｌｌ　ｗｉｄｅ café cafe\u0301 naïve_Ünit №7 …dots…", "счёт й 𝐀𝐁c 表 e é", "__a__ AB12CD34 a1b2C3 _ i̇ße İx"]
    rows = [(f"n{i}", "t", "Title One", t, "physical" if i % 2 else "business") for i, t in enumerate(texts)]
    n = spark.createDataFrame(rows, "id string, node_type string, title string, search_text string, graph_layer string")
    monkeypatch.setattr(index, "RUNS_AT_ONCE", 7)
    expected = sorted(map(tuple, lexical.postings(n, F.concat_ws(" ", "title", "search_text")).select("id", "term", "dl", "tf").collect()))
    got = index.layer_postings(n)
    assert sorted(map(tuple, got.collect())) == expected
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    e = spark.createDataFrame([], "source string, target string, type string, weight double, graph_layer string")
    path = str(tmp_path / "index")
    index.build_index(n, e, path)
    assert sorted(map(tuple, index.indexed_layer(spark, path, "postings", ["business", "physical"]).select("id", "term", "dl", "tf").collect())) == expected
    monkeypatch.undo()
    index.build_index(n, e, path, force=True)
    for file in (tmp_path / "index" / "postings").rglob("*.parquet"):
        terms = [r.term for r in spark.read.parquet(str(file)).collect()]
        assert terms == sorted(terms)
    changed = n.withColumn("title", F.when(F.col("id") == "n0", "B2").otherwise(F.col("title")))
    assert {r.graph_layer: r.action for r in index.build_index(changed, e, path).collect()} == {"physical": "skip", "business": "rebuild"}
    with pytest.raises(ValueError):
        index.build_index(n, spark.createDataFrame([(None, "n1", "t", 1.0, "physical")], e.schema), path)


def test_federated_fan_out_is_bounded(spark):
    edges = spark.createDataFrame([("r", f"o{i}", "has_operation", 1.0) for i in range(200)], "source string, target string, type string, weight double")
    sim = spark.createDataFrame([("q", f"o{i}", float(i == 173), f"op {i}") for i in range(200)], "query_id string, node string, similarity double, title string")
    got = federated.expand_children(spark.createDataFrame([("q", "r")], "query_id string, node string"), edges, sim, "has_operation", 3, 0.65, "op", 16).collect()
    assert len(got) == 3 and max(got, key=lambda r: r.score).node == "o173"
