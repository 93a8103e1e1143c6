import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import context as C
from graphloom.operators import vector as V
from graphloom.sources import files, html
from graphloom.streaming.refresh import refresh_stream


def test_segments():
    assert C.split_text("First sentence here is long. Second sentence is here too. Ok.") == ["First sentence here is long.", "Second sentence is here too. Ok."]
    assert C.split_text(None) == [] and C.split_text("  ") == []
    words = [f"w{i}" for i in range(900)]
    long = C.split_text(" ".join(words))
    assert len(long) > 4 and all(len(x) <= 900 for x in long) and " ".join(long).split() == words
    assert C.split_text("A long enough sentence stands here.\n\nA LONG ENOUGH SENTENCE STANDS HERE.") == ["A long enough sentence stands here."]


def test_mmr_order_against_definition():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(7, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rel = np.round(x @ x[0], 6)
    chosen, left = [], list(range(7))
    while left:
        best = max(left, key=lambda i: (0.82 * rel[i] - 0.18 * max([x[i] @ x[j] for j in chosen], default=0.0), rel[i], -i))
        chosen.append(best)
        left.remove(best)
    assert C.mmr_order(x, rel) == chosen


def test_budget_fit_and_distribution(spark):
    r = spark.createDataFrame([(1, 0, "aaaa", 2), (1, 1, "bbbbbbbb", 1), (1, 2, "cc", 3)], "parent int, segment_index int, segment string, mmr_rank int")
    assert C.fit_budget(r, 11).first()["summary"] == "bbbbbbbb cc"
    assert C.fit_budget(r, 3).first()["summary"] == "cc"
    given = C.distribute([3.0, 1.0], [10, 100], 40)
    assert given[0] == 10 and sum(given) == 40


def test_selection_keeps_groups_and_budget():
    rows = [{"id": str(i), "rank": i, "score": s, "group": g, "fixed": 50, "summary_length": 300} for i, (s, g) in enumerate([(9, "a"), (8, "a"), (7, "a"), (2, "b"), (0.1, "c")])]
    got = C.select_within_budget(rows, 3, 2000)
    assert [r["group"] for r in got] == ["a", "a", "b"]
    assert C.select_within_budget(rows, 5, 200)[0]["id"] == "0" and C.select_within_budget([], 5, 100) == []


def test_rerank_preserves_the_first_and_groups(spark):
    rows = [("q", f"x{i}", f"t{i}", float(10 - i), 0.1 * (i % 3), "a" if i < 6 else "b") for i in range(8)]
    r = C.rerank(spark.createDataFrame(rows, "query_id string, id string, title string, score double, semantic double, evidence_group string")).collect()
    assert {"x0", "x1", "x2", "x3"} <= {x.id for x in r} and "b" in {x.evidence_group for x in r}


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 0.0]), (4, [0.0, 0.0])], "id long, embedding array<float>")
    assert [r.id for r in V.top_k(v, [1.0, 0.0], 2).collect()] == [1, 3]
    assert v.select(V.l2_normalize(F.col("embedding")).alias("u")).where("id = 2").first()["u"] == [0.0, 1.0]
    assert {r.id for r in V.scan_top_k(v, np.array([[1.0, 0.0]]), 2).collect()} == {1, 3}


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><a href='/n.html'>menu</a></nav><h1>Top</h1><p>Intro &amp; more</p><ul><li>one</li><li>two</li></ul><h2>Sub</h2><table><tr><th>Col Name</th><th></th></tr><tr><td>a</td><td>b</td></tr></table><script>x</script></body></html>"
    rows = html.page_sections(spark.createDataFrame([("u", page)], "url string, html string")).collect()
    assert [(r.title, r.level, r.section_path) for r in rows] == [("Top", 1, ["Top"]), ("Sub", 2, ["Top", "Sub"])]
    assert rows[0].text == "Intro & more" and rows[0].list_items == ["one", "two"] and rows[1].tables == [[{"col_name": "a", "column_2": "b"}]]
    toc = "<li><a href='a.html#x'>A</a></li><li><a href='a.html'>B</a></li><a href='http://other/c.html'>C</a><a href='../up.html'>D</a>"
    links = html.toc_links(spark.createDataFrame([("http://h/g/toc.html", toc)], "url string, html string")).collect()
    assert [(r.url, r.label) for r in links] == [("http://h/g/a.html", "A")]


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{bad\n')
    r = files.read_json_lines(spark, str(p), "a int", strict=False).collect()
    assert [x.a for x in r] == [1, None] and r[1]._corrupt_record == "{bad"


def test_stream_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, None), (4, "c")], "id int, text string")
    df.write.parquet(src)
    refresh_stream(spark, src, df.schema, out, str(tmp_path / "c1")).awaitTermination()
    df.write.mode("append").parquet(src)
    refresh_stream(spark, src, df.schema, out, str(tmp_path / "c1")).awaitTermination()
    refresh_stream(spark, src, df.schema, out, str(tmp_path / "c2")).awaitTermination()  # a lost checkpoint replays all
    assert spark.read.parquet(out).count() == 2


def test_summary_segments_by_relevance_and_redundancy(spark):
    first, other = "The ledger periods of the budget version.", "Freight and customs are paid by the supplier of the goods, " * 6
    s = spark.createDataFrame([(1, 0, other), (1, 1, first), (1, 2, first), (1, 3, "Budget approvals.")], "id long, segment_index int, segment string")
    rank = {r.segment_index: r.mmr_rank for r in C.rank_segments(s, "ledger periods of the budget version").collect()}
    assert rank[1] == 1 and rank[0] != 1 and sorted(rank.values()) == [1, 2, 3, 4]
    kept = C.fit_budget(C.rank_segments(s, "ledger periods of the budget version"), 60).first()["summary"]
    assert kept.startswith(first)


def test_shares_against_the_definition():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        weights, room, amount = rng.random(n) * 10, rng.integers(0, 50, n), int(rng.integers(0, 200))
        got = C._fill(weights, room, amount)
        assert got.sum() == min(amount, room.sum()) and (got >= 0).all() and (got <= room).all()
        open_ = np.flatnonzero(got < room)
        levels = got[open_] / np.maximum(weights[open_], 1e-6)
        full = got[got >= room] / np.maximum(weights[got >= room], 1e-6)
        if len(open_) and len(full):  # nobody that is full has more for its weight than those still open, but for rounding
            assert (got[open_] + 1 >= (full.max() * weights[open_]).astype(int) - 1).all() or levels.min() + 2 / weights[open_].min() >= full.max()


def test_context_keeps_the_budget(spark):
    texts = [(f"n{i}", f"The record {i} of the ledger is changed by the owner. " * (1 + i)) for i in range(30)]
    rows = [(q, f"n{i}", "physical_table" if i % 3 else "validated_rule", "data_dictionary", f"title {i}", float(40 - i), 0.1 * (i % 7)) for q in ("a", "b") for i in range(30)]
    results = spark.createDataFrame(rows, "query_id string, id string, node_type string, source_type string, title string, score double, semantic double")
    for most in (150, 900, 4000):
        got = C.build_context(results, spark.createDataFrame(texts, "id string, text string"), "the ledger", 8, most).collect()
        assert {r.query_id for r in got} == {"a", "b"}
        for r in got:
            assert r.characters == len(r.context) <= most and 1 <= r.n_items <= 8 and len(set(r.ids)) == r.n_items
    assert C.build_context(results.limit(0), spark.createDataFrame(texts, "id string, text string"), "x").count() == 0


def test_relevant_texts(spark):
    t = spark.createDataFrame([(1, "short text"), (2, "The ledger is closed by the owner. " * 3 + "Another sentence about freight is here. " * 40), (3, None)], "id long, text string")
    got = {r.id: r.summary for r in C.select_relevant(t, "ledger", 120).collect()}
    assert got[1] == "short text" and "ledger" in got[2] and len(got[2]) <= 120 and set(got) == {1, 2}
    assert C.over_fetch(4) == 16 and C.over_fetch(20) == 60
