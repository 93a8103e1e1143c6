import unicodedata

from pyspark.sql import functions as F

from graphloom.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def test_normalization(spark):
    assert one(spark, "  Café   de\r\nCompras ", T.normalize_space) == "Café de Compras"
    assert one(spark, "Ação ÇÉ ﬃ", lambda c: T.strip_accents(c, exact=True)) == "Acao CE ffi"
    assert one(spark, "Ação Ünter ё が", T.normalize_text) == "acao unter е か".replace("か", unicodedata.normalize("NFKD", "が")[0])
    assert one(spark, None, T.normalize_space) == ""
    text = "  Café de\r\nCompras​   26B  "
    once = one(spark, text, T.normalize_semantic_text)
    assert once == "Café de Compras 26B" and one(spark, once, T.normalize_semantic_text) == once


def test_semantic_text_has_one_unicode_form(spark):
    rows = ["Ｆｕｌｌ\u3000width 26B", "ﬁle cafe\u0301", "ｶﾞ\u200b x", "plain  text", "", None, "½ \ufeffÇ"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    got = {r.i: r.t for r in df.select("i", T.normalize_semantic_text("v").alias("t")).collect()}
    want = {i: " ".join(unicodedata.normalize("NFKC", v or "").translate(dict.fromkeys(map(ord, T.ZERO_WIDTH))).split()) for i, v in enumerate(rows)}
    assert got == want and got[0] == "Full width 26B"
    assert df.agg(F.count_distinct(T.text_hash("v")).alias("n")).first()["n"] == 6


def test_tokens(spark):
    assert one(spark, "PO_HeaderID2", T.tokenize) == ["po_headerid2", "po_header", "id", "po", "headerid2"]
    assert one(spark, "the Café of a camelCase HTTPServer x1", T.tokenize) == ["cafe", "camelcase", "camel", "case", "httpserver", "http", "server", "x1"]
    assert one(spark, None, T.tokenize) == []
    assert one(spark, "bb aa bb cc", lambda c: T.keywords(T.tokenize(c), 2)) == ["bb", "aa"]


def test_node_keywords_are_those_of_the_search_text(spark):
    rows = [("Ledger", "Ledger open periods of the budget, periods"), ("Ledger", ""), ("Ledger", None), (None, None), ("Ledger", "zz " * 5000 + "yy xx yy")]
    df = spark.createDataFrame(rows, "title string, search_text string")
    assert [r.k for r in df.select(T.node_keywords().alias("k")).collect()] == [["periods", "budget", "ledger", "open"], ["ledger"], ["ledger"], [], ["zz", "yy", "xx"]]


def test_identifiers(spark):
    assert one(spark, " Ação & Co. ", T.slugify) == "acao-co"
    assert one(spark, "&&", T.slugify) == "item"
    assert one(spark, "x", lambda c: T.stable_id("n", F.lit("Ab c"), c)).startswith("n:ab-c:")
    assert one(spark, "see AB_X1 and AB_X1, CD_YY2 z", T.mentions) == ["AB_X1", "CD_YY2"]
    r = one(spark, "It references to PO_HEADERS.HEADER_ID here.", T.documented_references)
    assert [(x["table"], x["column"]) for x in r] == [("PO_HEADERS", "HEADER_ID")]
    v = one(spark, "A (Active ), B (Blocked)", T.documented_values)
    assert [(x["value"], x["meaning"]) for x in v] == [("A", "Active"), ("B", "Blocked")]
    assert [x["value"] for x in one(spark, "either y/n", T.documented_values)] == ["Y", "N"]


def test_scores(spark):
    for word, score in (("high", 0.9), ("Very High", 1.0), ("2.5", 1.0), ("-1", 0.0), ("odd", 0.6), (None, 0.6)):
        assert one(spark, word, T.confidence_score) == score
    assert len(one(spark, "x " * 400, T.truncate_summary)) <= 500
    assert one(spark, "h3", T.heading_level) == 3 and one(spark, "p", T.heading_level) == 7


def test_keywords_and_tokens_of_documents(spark, tables):
    from graphloom.queries import QUERIES

    root = tables(documents=spark.createDataFrame([(1, "bb aa bb cc"), (2, None), (3, " ".join(f"w{i % 7000:04d}x" for i in range(15_000)))], "doc_id long, text string"))
    got = {r.doc_id: r.keywords.split() for r in QUERIES["text_keywords_documents"](spark, root).collect()}
    assert got[1] == ["bb", "aa", "cc"] and got[2] == [] and len(got[3]) == 30
    posted = QUERIES["text_tokens_documents"](spark, root)
    assert {(r.term, r.tf, r.dl) for r in posted.where("id = 1").collect()} == {("aa", 1, 4), ("bb", 2, 4), ("cc", 1, 4)}
    assert posted.where("id = 3").count() > 7000
