import base64
import re
import time
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import boilerplate, languages, lookalikes, mojibake, packing, similar, splitting, tokenizer

TEXT = "table_name string, record_id string, text string"


# 1. look-alikes


def _look(s: str) -> str:
    s = "".join(c for c in s if c not in lookalikes.INVISIBLE)
    s = unicodedata.normalize("NFKD", s).translate(str.maketrans(lookalikes.LOOK_ALIKES))
    s = re.sub(r"\r\n?", "\n", unicodedata.normalize("NFC", s))
    return re.sub(r"[^\S\n]", " ", s)


def test_one_form_against_brute_force(spark):
    texts = ["Ｆｕｌｌ width", "Full width", "café", "café", "сору", "copy", "a​b c", "ab c", "x\r\ny", "x\ny", "ﬁle", "Q̣̇", "Q̣̇", "​", "", " ", "ｶﾞ", "ガ", "long " * 5000 + "е"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("copy",)], "text string")
    forms = {bytes(r.key): r.form for r in lookalikes.one_form(df).collect()}
    keyed = {bytes(r.k): r.text for r in df.where("text IS NOT NULL").select("text", lookalikes.text_key(F.col("text")).alias("k")).distinct().collect()}
    assert {keyed[k]: v for k, v in forms.items()} == {t: _look(t) for t in texts}


def test_superscripts_stay(spark):
    df = spark.createDataFrame([("x²½ 1º",)], "text string")
    assert lookalikes.one_form(df).first()["form"] == "x²½ 1º"


def test_pairs(spark):
    rows = [("t", "a", "copy"), ("t", "b", "сору"), ("t", "c", "copy"), ("t", "c", "copy"), ("u", "d", "ｃopy"), ("t", "e", "Copy"), ("t", "f", None), ("t", "g", " "), ("t", "h", " ")]
    got = {tuple(r) for r in lookalikes.look_alike_pairs(spark.createDataFrame(rows, TEXT).withColumn("form", F.lit(1)).withColumn("key", F.lit(2))).collect()}
    assert got == {("t", "a", "b"), ("t", "b", "c")}
    assert lookalikes.look_alike_pairs(spark.createDataFrame([], TEXT)).count() == 0


def test_texts_come_out_in_their_own_letters(spark):
    same = ["Россия и Москва: оса, СССР", "ΑΘΗΝΑ και Νέα Όψη", "copy ATM", "Ёжик — 5 кг", "ACTA", "日本 сорт"]
    texts = {t: t for t in same} | {"Pоccия и Mосквa: oca, CCСP": same[0], "сорy АТМ": "copy ATM", "АСТА": "ACTA", "АΘΗNA και Nέα Όψη": same[1]}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    keys = {bytes(r.key): r.text for r in df.select("text", lookalikes.text_key(F.col("text")).alias("key")).collect()}
    got = {keys[bytes(r.key)]: r.text for r in lookalikes.one_form(df).select("key", lookalikes.in_own_letters(F.col("form")).alias("text")).collect()}
    assert got == texts


def test_classes(spark):
    rows = [("t", "a", "copy"), ("t", "b", "сору"), ("t", "c", "copy"), ("t", "c", "copy"), ("u", "d", "ｃopy"), ("t", "e", "Copy"), ("t", "f", None), ("t", "g", " "), ("u", "h", "alone"), ("u", "i", "alone")]
    got = lookalikes.look_alike_classes(spark.createDataFrame(rows, TEXT).withColumn("n", F.lit(1))).collect()
    assert {(r.table_name, r.record_id, r.n_strings, r.n_records) for r in got} == {("t", x, 2, 3) for x in "abc"} and len({r.class_id for r in got}) == 1
    assert lookalikes.look_alike_classes(spark.createDataFrame([], TEXT)).count() == 0


# 2. splitting


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n!é́😀", max_size=400), st.integers(5, 60), st.data())
def test_split_covers_the_text(text, limit, data):
    overlap = data.draw(st.integers(0, limit // 2 - 1))
    spans = splitting.split_spans(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= limit for a, b in spans)
    assert all(spans[i + 1][0] == spans[i][1] - overlap and spans[i][1] > spans[i][0] + overlap for i in range(len(spans) - 1))


def test_strongest_cut_is_taken_rightmost():
    text = "aaaa. bbbb. cccc dddd eeee ffff"
    assert text[: splitting.split_spans(text, 20, 0)[0][1]] == "aaaa. bbbb. "
    strength = splitting.boundary_strengths(text)
    best = splitting.RightmostMaximum(strength, 64)
    for low in range(len(text)):
        for high in range(low, len(text)):
            window = strength[low : high + 1]
            assert best(low, high) == (high - int(window[::-1].argmax()), window.max())


def test_long_texts_are_indexed_in_blocks(monkeypatch):
    plain = "".join("x" if i % 97 else "é" for i in range(9000)) + " word, word. " * 400 + "y" * 4000
    blocked = splitting.split_spans(plain, 60, 7)
    with monkeypatch.context() as m:
        m.setattr(splitting, "BlockedMaximum", splitting.RightmostMaximum)
        assert splitting.split_spans(plain, 60, 7) == blocked
    text = "".join("ab cd. ef\n"[(i * 7) % 10] for i in range(30_000))
    strength = splitting.boundary_strengths(text)
    whole, blocked = splitting.RightmostMaximum(strength, 50), splitting.BlockedMaximum(strength, 50)
    at = 0
    while at + 50 < len(text):
        window = (at + 1 + at % 13, at + 50)
        assert whole(*window) == blocked(*window)
        at += 37
    assert splitting.split_spans("aaaa. bbbbb cccc dddd", 20, 0, least_share=0.0)[0][1] == 6  # the strongest in the whole window


def test_split_cases(spark):
    t = spark.createDataFrame([("a", "1", "f", "x" * 25, "extra"), ("a", "1", "f", "x" * 25, "extra"), ("a", "2", "f", "", "e"), ("a", "3", "f", None, "e"), ("b", "4", "f", "y" * 99, "e")], "table_name string, record_id string, field_name string, text string, max_size string")
    limits = spark.createDataFrame([("a", "f", 10, 3)], "table_name string, field_name string, max_size int, overlap_size int")
    rows = splitting.split_oversized(t, limits).collect()
    assert sorted((r.record_id, r.piece_no, len(r.piece)) for r in rows) == [("1", 0, 10), ("1", 1, 10), ("1", 2, 10), ("1", 3, 4), ("2", 0, 0)]


# 3. similar vectors


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vector_id long, model_name string, embedding_profile_version string, dimensions int, embedding array<float>")


def test_near_pairs_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 24))
    x = np.concatenate([base, base + 0.15 * rng.normal(size=base.shape), rng.normal(size=(200, 24))]).astype(np.float32)
    rows = [(i, "m", "p", 24, [float(v) for v in r]) for i, r in enumerate(x)]
    for limit in (8192, 8):  # a tiny limit refines buckets and compares blocks in a grid
        vectors = similar.usable_vectors(_vectors(spark, rows))
        near = similar.candidate_neighbours(vectors, 10, 6, 2, 0.9, bucket_rows=limit).select("a", "b").distinct().collect()
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = u @ u.T
        want = {(i, j) for i, j in zip(*np.nonzero(s >= 0.9)) if i != j}
        assert {(r.a, r.b) for r in near} == want


def test_copies_ties_and_unusable(spark):
    rows = [(i, "m", "p", 2, [1.0, 0.0]) for i in range(20)] + [(50, "m", "p", 2, [1.0, 0.1]), (51, "m", "p", 2, None), (52, "m", "p", 2, [0.0, 0.0]), (53, "m", "p", 2, [float("nan"), 1.0]), (54, "m", "p", 2, [1.0]), (55, "m2", "p", 2, [1.0, 0.0]), (0, "m", "p", 2, [1.0, 0.0]), (56, None, None, 2, [1.0, 0.0])]
    near = similar.neighbours(similar.usable_vectors(_vectors(spark, rows)), k=3, tables=2, least=0.9).collect()
    lists: dict = {}
    for r in near:
        lists.setdefault(r.a, []).append(r.b)
    assert {a: sorted(b) for a, b in lists.items()} == {0: [1, 2, 3], 1: [0, 2, 3], 2: [0, 1, 3], **{i: [0, 1, 2] for i in range(3, 20)}, 50: [0, 1, 2]}
    assert similar.neighbours(similar.usable_vectors(_vectors(spark, [])), k=3, tables=2, least=0.9).count() == 0


def test_recall_of_the_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    vectors = similar.usable_vectors(_vectors(spark, [(i, "m", "p", 32, [float(v) for v in r]) for i, r in enumerate(x)]))
    got: dict = {}
    for r in similar.neighbours(vectors, k=10, tables=10, probes=2, query_probes=5, queries=F.col("id") % 50 == 0).collect():
        got.setdefault(r.a, set()).add(r.b)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert np.mean([len(got[q] & set(np.argsort(-s[q])[:10])) / 10 for q in range(0, 1500, 50)]) >= 0.9


def test_hot_buckets_keep_all_candidates(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 32)).astype(np.float32)
    vectors = similar.usable_vectors(_vectors(spark, [(i, "m", "p", 32, [float(v) for v in r]) for i, r in enumerate(x)]))
    lists = []
    for limit in (8192, 16):
        near = similar.candidate_neighbours(vectors, 10, 4, 2, None, F.col("id") % 40 == 0, bucket_rows=limit, query_probes=3)
        best: dict = {}
        for r in near.collect():
            best.setdefault(r.a, {})[r.b] = r.similarity
        lists.append({a: sorted(b, key=lambda i: (-b[i], i))[:10] for a, b in best.items()})
    assert len(lists[0]) == 30 and lists[0] == lists[1]


def test_many_nearly_equal_vectors(spark):
    rng = np.random.default_rng(4)
    x = (np.ones(16) + 1e-4 * rng.normal(size=(3000, 16))).astype(np.float32)
    vectors = similar.usable_vectors(_vectors(spark, [(i, "m", "p", 16, [float(v) for v in r]) for i, r in enumerate(x)]))
    near = similar.candidate_neighbours(vectors, 3, 1, 1, 0.9, bucket_rows=256).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least")).collect()
    assert len(near) == 3000 and all(r.n == similar.SPARE * 3 and r.least > 0.999 for r in near)


# 4. boilerplate


def _samples():
    text = {
        "en": "Each row describes how the record was used and who asked for it. The amounts are rounded and do not include freight. Changes take effect at the next run.",
        "pt": "Cada linha descreve como o registro foi utilizado e quem fez a solicitação. Os montantes são arredondados e não incluem o frete nem a comissão.",
        "ru": "Каждая строка описывает, как используется запись и кто это запросил. Суммы округляются и не включают ни доставку, ни комиссию.",
        "de": "Jede Zeile beschreibt, wofür der Satz verwendet wurde und wer das verlangt hat. Die Beträge werden gerundet und enthalten weder Fracht noch Gebühren.",
    }
    return text


@pytest.fixture(scope="module")
def chains():
    return mojibake.ChainClassifier.train(list(_samples().values()) * 2)


PAGES = "table_name string, record_id string, host string, text string, failed boolean"


def _template(pages, main, chains):
    """{(record_id, line_no)} of the template lines."""
    records, lines = boilerplate.judged(boilerplate.with_page_keys(pages), main, chains)
    return {(r.record_id, r.line_no) for r in records.join(lines, "page").collect()}


def _texts(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_templates_are_found_and_body_is_kept(spark, chains):
    body = [f"The report {i} shows which records were changed. Changes take effect at the next run." for i in range(12)]
    pages = [("t", f"p{i}", "h", f"Home | Products | Guides | Support | Sign in\n\n{b}\nPrerequisites\nBack to top\n## © 2024 Knowledge Library. All rights reserved.", False) for i, b in enumerate(body)]
    pages += [pages[0], ("t", "n", "h", None, False), ("t", "e", "h", "", False), ("t", "b", None, " \n", False), ("t", "long", "h", "word " * 20000, False)]
    df = spark.createDataFrame(pages, PAGES).withColumn("subtree", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("page", F.lit(2))
    main = [_texts(spark, [*body, "Prerequisites", None])]
    assert _template(df, main, chains) == {(f"p{i}", k) for i in range(12) for k in (1, 5, 6)}
    assert _template(df.limit(0), main, chains) == set()


def test_template_in_unknown_words(spark, chains):
    titles = ["ledger", "budget", "invoice", "supplier", "freight", "receipt", "payment", "project"]
    pages = [("t", t, "h", f"Qarel | Vodun | Stef\nQarel > Milotek > {t}\n{t} zeichen\nThe records were changed. Changes take effect at the next run.\nPrerequisites", False) for t in titles]
    main = [_texts(spark, ["Prerequisites"]), _texts(spark, ["Who asked for it? Changes take effect at the next run."])]
    assert _template(spark.createDataFrame(pages, PAGES), main, chains) == {(t, k) for t in titles for k in (1, 2)}


def test_each_host_is_counted_by_itself(spark, chains):
    pages = [("t", f"{h}{i}", h, f"Menu of {h}\nRecord {h * i} was changed.", False) for h in ("a", "b", "c") for i in range(1, 5)]
    pages += [("t", f"d{i}", f"host{i}", f"Menu of d\nRecord {'d' * i} was changed.", False) for i in range(1, 9)]
    assert _template(spark.createDataFrame(pages, PAGES), [_texts(spark, ["x"])], chains) == {(f"{h}{i}", 1) for h in "abc" for i in range(1, 5)}


def test_template_counts_do_not_follow_the_size(spark, chains):
    other = [f"The report {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)} shows which records were changed." for i in range(40_000)]
    few = [("t", str(i), "h", t, False) for i, t in enumerate(["Back to top"] * 3 + other)]
    assert _template(spark.createDataFrame(few, PAGES), [_texts(spark, ["The records"])], chains) == {("0", 1), ("1", 1), ("2", 1)}
    small = [("t", str(i), "h", t, False) for i, t in enumerate(["Back to top"] * 4 + ["The records"])]  # one of 1,000 main texts holds the line, 4 of 5 pages do
    main = [_texts(spark, ["Back to top"] + [f"The record {i}" for i in range(999)])]
    assert _template(spark.createDataFrame(small, PAGES), main, chains) == {(str(i), 1) for i in range(4)}


def test_long_lines_are_judged_alike(spark, chains):
    menu = "Home | Products | Guides | Support | Sign in | Search this site | Skip to main content | Previous | Next | Back to top | " * 5
    prose = "the records were changed and the report shows who asked for it, " * 8
    pages = [("t", str(i), "h", f"{menu}\nOn this page: {prose}{'abcd'[i]}\nOn this page: {'abcd'[i] * 3} · ledger", False) for i in range(4)]
    assert len(menu) > 400 and len(prose) > 400
    assert _template(spark.createDataFrame(pages, PAGES), [_texts(spark, [prose])], chains) == {(str(i), k) for i in range(4) for k in (1, 3)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1٣²_-. É\n", max_size=30))
def test_words_with_digits_are_masked(text):
    counted = re.sub(r"[\w-]*\d[\w-]*", lambda m: "#" * (1 + m[0].count("_")) if re.search(r"[^\W\d_]", m[0]) else re.sub(r"\d+", "0", m[0]), text)
    assert boilerplate.masked(text) == re.sub(r"(?<!\w)[^\W\d]+(?:_[^\W\d]+)+(?!\w)", lambda m: "#" * (1 + m[0].count("_")), counted)


def test_long_words_are_masked_in_linear_time():
    began = time.process_time()
    assert boilerplate.masked("a" * 100_000 + " 1" + "-b" * 50_000 + "é" * 100_000) == "a" * 100_000 + " #"
    assert time.process_time() - began < 5


def test_places_inside_main_text_and_codes_are_kept(spark, chains):
    word = ["one", "two", "six", "ten"]
    pages = [("t", w, "h", f"Skip to content\nRecord {w} was changed.\nLayout\nThe {w} record is drawn.\nTables: AB_{w}_1, CD_{w}_2\nLine {w} remains.\nBack to top", False) for w in word]
    failed = [("t", f"f{i}", "h", "Timed out while reading", True) for i in range(5)]
    df = spark.createDataFrame(pages + failed, PAGES)
    assert _template(df, [_texts(spark, ["x"])], chains) == {(w, k) for w in word for k in (1, 7)}


def test_hot_and_rare_subtrees_are_joined_alike(spark, chains, monkeypatch):
    pages = [("t", str(i), "h", f"Menu\n{chr(97 + i % 26) * (1 + i // 26)} was changed\nFooter", False) for i in range(1200)]
    df = spark.createDataFrame(pages, PAGES)
    assert _template(df, [_texts(spark, ["x"])], chains) == {(str(i), k) for i in range(1200) for k in (1, 3)}


def test_bodies(spark, chains, tables, monkeypatch):
    monkeypatch.setattr(boilerplate, "trained_classifier", lambda *_: chains)
    source = "struct<source_type: string, url: string, release: string>"
    sections = [(f"s{i}", "functional_section", f"Menu\n{w} was changed", (None, "https://h.example/x", None)) for i, w in enumerate(("one", "two", "six"))]
    sections += [("s0", "functional_section", "Menu", (None, "https://h.example/x", None)), ("n", "functional_section", None, None), ("f", "collection_error", "Menu", (None, "https://h.example/x", None))]
    root = tables(
        functional_section=spark.createDataFrame(sections, f"id string, node_type string, text string, source {source}"),
        rest_operation=spark.createDataFrame([], f"id string, node_type string, description string, source {source}"),
        documents=_texts(spark, ["text"]), entity_aliases=spark.createDataFrame([("text",)], "description string"),
    )
    got = {(r.record_id, r.body, r.n_removed) for r in boilerplate.main_body(spark, root).collect()}
    assert got == {("s0", "one was changed", 1), ("s1", "two was changed", 1), ("s2", "six was changed", 1), ("s0", "", 1), ("n", None, 0), ("f", "Menu", 0)}


# 6. encodings


@pytest.mark.parametrize("chain", [("utf-8", "cp1252"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("utf-8", "cp1252", "utf-8", "cp1252"), ("cp1251", "koi8_r"), ("mac_roman", "cp1252"), ("cp850", "cp1252")])
def test_round_trip(chains, chain):
    for lang, text in _samples().items():
        bad = mojibake.garble(text, chain)
        if bad is None or bad == text or (chain[0] != "utf-8" and (lang == "ru") != (chain[0] == "cp1251")) or lang == "de":
            continue
        fixed, found, lost = chains.restore(bad)
        assert fixed == text and found and not lost


def test_training_counts_all_rows_and_whole_texts(spark, tables, monkeypatch):
    monkeypatch.setattr(mojibake.Tally, "AT_ONCE", 700)
    monkeypatch.setattr(mojibake.Tally, "ROWS", 50)
    samples = [*_samples().values()]
    words = ["é" + chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676) for i in range(3200)]  # more rows than were sampled once
    documents = [(i, f"{w} plain", "en") for i, w in enumerate(words)] + [(5000, "plain " * 1000 + "naïveté 金額は", "en"), (5001, "ohne Wert: größer", None), (5002, None, "en"), (5003, "plain", "en")]
    root = tables(lang_samples=_texts(spark, [*samples, samples[0], None]), documents=spark.createDataFrame(documents, "doc_id long, text string, lang string"))
    got = mojibake.trained_classifier(spark, root)
    wanted = mojibake.ChainClassifier.train(samples, [t for _, t, lang in documents if t and lang and not t.isascii()])
    assert np.allclose(got.weights, wanted.weights) and got.model.total == wanted.model.total
    assert all(getattr(got.model, x) == getattr(wanted.model, x) for x in ("single", "left", "right", "before", "after"))
    assert got.model.single["é"] > 3200 and got.model.left["a", "ï"] >= 1


def test_garbled_counts_against_garbling_each_word():
    words = ["voilà", "straße", "Módulos", "área", "данные", "№", "金額は", "café—x", "ÿ", "über", "naïve"]
    wanted = np.zeros((len(mojibake.SCRIPTS), len(mojibake.CHAINS) + 1, mojibake.BUCKETS))
    for word, weight in [*((w, 4) for w in words), *((w.upper(), 1) for w in words if not w.upper().isascii())]:
        for k, chain in enumerate([*mojibake.CHAINS, ()]):
            for part in (mojibake.garble(word, chain) or "").split():
                np.add.at(wanted[mojibake._script(word), k], mojibake._bigrams(part), weight)
    assert (mojibake._garbled_counts(*mojibake.Tally().add([" ".join(words) + " plain", ""]).of(mojibake.GARBLED)) == wanted).all()


def test_clean_text_stays(spark, chains):
    for text in [*_samples().values(), "ATENÇÃO: NÃO SÃO", "├── A-1\n│   └── B-2", "It’s “fine” – really…", "", "plain", "сору text"]:
        assert chains.restore(text) == (text, [], False)
    assert chains.restore("configura��o")[2]
    bad = mojibake.garble(_samples()["pt"], ("utf-8", "cp1252"))
    df = spark.createDataFrame([("t", "1", bad), ("t", "1", bad), ("t", "2", None), ("t", "3", "ok"), ("t", "4", "a�b " * 3000)], TEXT)
    got = {r.record_id: r.text for r in mojibake.restore_column(df.withColumn("lost", F.lit(1)), chains).collect()}
    assert set(got) == {"1", "4"} and got["1"] == _samples()["pt"]


def test_two_chains_in_one_record(chains):
    one, two = ("utf-8", "cp1252"), ("utf-8", "cp850")
    text = _samples()["pt"]
    bad = f"{mojibake.garble(text, one)}\nA plain line.\n{mojibake.garble(text, two)}\n{text}"
    fixed, found, lost = chains.restore(bad)
    assert fixed == f"{text}\nA plain line.\n{text}\n{text}" and not lost
    assert {"utf-8<-cp850"} < set(found) and len(found) == 2


def test_recurring_segments_are_judged_once(monkeypatch):
    judge = mojibake.ChainClassifier.train(list(_samples().values()) * 2)
    texts = [t for x in _samples().values() for c in (("utf-8", "cp1252"), ("cp1251", "koi8_r"), ("cp850", "cp1252")) if (t := mojibake.garble(x, c))]
    wanted = []
    for text in texts:
        judge.segments.clear()
        wanted.append(judge.restore(f"{text}\n{texts[0]}"))
    judged = []
    inverted = judge._inverted
    monkeypatch.setattr(judge, "_inverted", lambda segment, *rest: judged.append((segment, *rest)) or inverted(segment, *rest))
    judge.segments.clear()
    assert [judge.restore(f"{text}\n{texts[0]}") for text in texts for _ in range(2)] == [x for x in wanted for _ in range(2)]
    whole = [x for x in judged if "\n" in x[0] or " " in x[0].strip()]
    assert whole and len(whole) == len(set(whole))


def test_short_japanese():
    text = "この記録は変更されました。金額は四捨五入されます。日本語の設定を確認してください。"
    judge = mojibake.ChainClassifier.train([*_samples().values(), text] * 2)
    for chain in (("utf-8", "cp1252"), ("cp932", "cp1252"), ("euc_jp", "latin-1")):
        for short in ("設定の確認", "日本語を確認"):  # one kana each
            bad = mojibake.garble(short, chain)
            assert bad is None or judge.restore(bad)[0] == short


# 7. tokenizer


def test_encoding_against_the_library(spark):
    import tiktoken

    content, pattern = tokenizer.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello  world\n\n don't", " <|endoftext|>", "ação 購買依頼 📦→", "a" * 3000, "\t\tx=1;\r\n", "x " * 4000, "", None, "Hello  world\n\n don't"]
    df = spark.createDataFrame([(i, t, [0]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in tokenizer.encode_corpus(df).collect()}
    assert got == {i: (encoding.encode_ordinary(t) if t else []) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in tokenizer.token_counts(df).collect()} == {i: len(v) for i, v in got.items()}
    assert tokenizer.encode_corpus(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=12), max_size=8))
def test_trie_equals_plain_merging(words):
    trie = tokenizer._encoder(tokenizer.vocabulary()[0])
    assert trie.encode_all(words) == [trie.merge(w) for w in words]


# 8. packing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_is_valid_and_near_best_fit(histogram):
    slots, total = packing.plan_containers(dict(histogram), 30)
    load, used = [0] * total, {}
    for size, low, high, first, each in slots:
        assert (high - low) % each == 0
        used[size] = used.get(size, 0) + high - low
        for c in range((high - low) // each):
            load[first + c] += size * each
    assert used == histogram and all(0 < x <= 30 for x in load)
    free: list = []
    for size in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [f for f in free if f >= size]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else 30) - size)
    assert total <= len(free) + 1


def test_pack_every_item_once(spark):
    sizes = [(i, n) for i, n in enumerate([None, 0, 5, 5, 5, 10, 25, 3, 7, 10, 1] + [4] * 30)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens int").withColumn("size", F.lit("clash")).withColumn("id", F.lit("clash"))
    for bucket_rows in (1000, 4):
        rows = packing.pack(df, 10, bucket_rows=bucket_rows).collect()
        load: dict = {}
        for r in rows:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        assert max(load.values()) <= 10 and set(load) == set(range(len(load)))
        assert sorted((r.doc_id, r.piece_no, r.n_tokens) for r in rows) == sorted((i, k, min(10, n - 10 * k)) for i, n in sizes if n for k in range(-(-n // 10)))
    assert packing.pack(df.limit(0), 10).count() == 0


def test_pack_with_every_size_in_buckets(spark):
    capacity = 2048
    df = spark.range(3 * capacity).select(F.col("id").alias("doc_id"), (F.col("id") % capacity + 1).cast("int").alias("n_tokens"))
    rows = packing.pack(df, capacity, bucket_rows=2).groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n")).collect()
    bound = 3 * sum(range(1, capacity + 1)) / capacity
    assert sum(r.n for r in rows) == 3 * capacity and max(r.used for r in rows) <= capacity
    assert bound <= len(rows) <= 1.01 * bound


# 9. languages


def test_languages_of_mixed_documents(spark):
    s = _samples()
    trees = languages.ContextTrees(list(s.items()))
    judge = languages.LanguageJudge(trees)
    name = lambda text: [trees.langs[k] for k in judge.languages(judge.segments([text])[0])]
    for lang, text in s.items():
        assert name(text) == [lang] and name(text.upper()) == [lang]
    assert name(f"{s['en']} {s['ru']}") == ["en", "ru"]
    assert name(s["en"] + " " + s["pt"].split(". ")[0] + ". " + s["en"]) == ["en"]  # one sentence does not count
    assert name("Cada linha descreve como o registro foi utilizado e quem fez a solicitacao.") == ["pt"]
    for text in (None, "", "  \n", "AB-1|CD-2|EF-3", "8f071536a9==RV-1", "2024-01-01 10:00; 2024-01-02", "x = foo(bar); if (a) { b(); }"):
        assert name(text) == []
    long = judge.segments([s["en"] * 300])[0]
    assert len(long) > 500


def test_code_lengths_against_the_definition():
    from collections import Counter, defaultdict
    from math import log2

    trees = languages.ContextTrees([("a", "abracadabra abra"), ("b", "banana bandana")])
    for lang, text in (("a", "abracadabra abra"), ("b", "banana bandana")):
        counts = [defaultdict(Counter) for _ in range(languages.ORDER + 1)]
        for word in languages.words_of(text):
            data = b" " + word.encode() + b" "
            for i in range(1, len(data)):
                for k in range(min(languages.ORDER, i) + 1):
                    counts[k][data[i - k : i]][data[i]] += 1
        for word in ("abra", "banana", "zebra", "éa"):
            data, bits = b" " + word.encode() + b" ", 0.0
            for i in range(1, len(data)):
                for k in range(min(languages.ORDER, i), -2, -1):
                    tree = counts[k][data[i - k : i]] if k >= 0 else None
                    if k < 0:
                        bits += 8.0
                    elif tree and data[i] in tree:
                        bits -= log2(tree[data[i]] / (sum(tree.values()) + len(tree)))
                        break
                    elif tree:
                        bits -= log2(len(tree) / (sum(tree.values()) + len(tree)))
            got = trees.code_words([word])[0][0][trees.langs.index(lang)]
            assert got == pytest.approx(bits, rel=1e-4)


def test_labels(spark, tables):
    s = _samples()
    docs = [(1, s["en"], "EN-us"), (2, s["en"], "English"), (3, s["en"], "de"), (4, s["en"], None), (5, s["en"], "n/a"), (6, f"{s['en']} {s['ru']}", "en"), (7, "AB-1|CD-2", None), (8, None, None), (9, s["pt"], "gl"), (10, s["pt"], " por ")]
    root = tables(
        documents=spark.createDataFrame([(i, t, l, "x") for i, t, l in docs], "doc_id long, text string, lang string, label string"),
        lang_samples=spark.createDataFrame([(i, l, t) for i, (l, t) in enumerate(s.items())], "sample_id long, lang string, text string"),
        lang_codes=spark.createDataFrame([("en", "eng", "English"), ("pt", "por", "Portuguese"), ("ru", "rus", "Russian"), ("de", "deu", "German")], "lang_code string, lang_code3 string, lang_name string"),
    )
    got = {(r.doc_id, r.lang) for r in languages.found(spark, root).collect()}
    assert got == {(3, "en"), (4, "en"), (5, "en"), (6, "en"), (6, "ru"), (9, "pt")}
    segments = [(r.doc_id, r.lang) for r in languages.segment_languages(spark, root).orderBy("doc_id", "segment_no").collect()]
    assert segments.count((6, "en")) == 1 and segments.count((6, "ru")) == 1
