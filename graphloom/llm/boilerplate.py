"""Removal of site templates: menus, paths, consent notices, link lists, counters, prompts and footers.

A page text is a tree of lines; a line has elements (parts set off by bars, dots, arrows, wide gaps or the end
of a sentence), an element has a label before a colon, a bullet before words, or, from ``LONG`` words on, opening
words (behind its label). Every subtree of every line is hashed in a form without markup, numbers and codes, after wrong encodings and look-alike characters were
repaired. Spark counts for each host the pages that hold a subtree. Nothing but counts decides:

* a subtree on at least ``LEAST_PAGES`` pages of its host is template, unless it is as usual in known main text
  (a table of main text holds it in more than ``BODY_SHARE`` of its share of the host's pages), for headings,
  notes and list items recur as well;
* a template subtree that stands alone inside main text in more than ``ALONE`` of its places, neither at
  an end of the page nor beside other template, is main text after all (the heading of a drawing, a stock phrase);
* a line comes out if itself or its label is template, or elements of template make up ``COVER`` of its
  letters, and neither it nor that part of it is usual main text, as it stands or by its opening words.

Subtrees that are mostly codes or numbers (table lists, drawings, values) hold no wording that could recur and
are not counted. Lines of any length are treated alike.

Scale: a text that many records share is worked on once; only hashes leave the map. Counts are combined on the
map side, so a line that a third of all pages hold is one counter. When verdicts go back to the places, the
subtrees with more than a share ``HOT`` of all places are broadcast (at most 1 / ``HOT`` rows), the others are
joined by a shuffle in which no key is large.

Defined cases: null, empty and blank texts have no lines; blank lines are counted but never reported;
repeated rows count once, records of one text as often as there are; a host with fewer than ``LEAST_PAGES`` pages with a subtree keeps it; rows
without a host form one group.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.lookalikes import INVISIBLE, LOOK_ALIKES
from graphloom.llm.mojibake import ChainClassifier, trained_classifier
from graphloom.sources.tables import land, read_table, spread

LEAST_PAGES = 3
BODY_SHARE = 0.05
ALONE = 0.5
COVER = 0.5
LONG, OPENING = 6, 3
#: What each part of an identifier and a number count for, when wording is compared with them.
CODE_LENGTH, NUMBER_LENGTH = 6, 2
HOT = 1e-4

_MARKUP = re.compile(r"</?[a-zA-Z][^>]*>|^\s*#+\s+|&copy;|&nbsp;|\]\([^)]*\)|^\s*[*+]\s+(?=\[)|\[")
#: From the first digit of a word to its end, and words joined by underscores.
_COUNTED = re.compile(r"\d[\w-]*+")
_JOINED = re.compile(r"(?<!\w)[^\W\d]+(?:_[^\W\d]+)+(?!\w)")
_LETTER = re.compile(r"[^\W\d_]")
_NUMBER = re.compile(r"\d+")
_DIGIT = re.compile(r"\d")
_LINE_END = re.compile(r"\r\n?|\n")
_QUESTION = re.compile(r"[^:?]{1,40}\?")
_MARK = re.compile(r"[<#&\[\]*+]")
#: Within a sentence; the ends of sentences set off elements, too.
_ELEMENT = re.compile(r"\s+[|·>/←]\s+|\s{2,}|[|·]")
_ENDS = (". ", "! ", "? ", "。", "？")
_LABEL = re.compile(r"([^:?]{1,40}):\s+(.*)")
_BULLET = re.compile(r"\s*([•»›▸►‣*–-]|\d+[.)])\s+([^#0:.!?。,;]*)")
_NO_LETTER = re.compile(r"[\W\d_]+")
_OTHER_SCRIPT = re.compile("[Ͱ-ԯ]")
_HIDDEN = re.compile(f"[{INVISIBLE}]")
_FOLD = str.maketrans(dict.fromkeys(INVISIBLE))
_LATIN = str.maketrans(LOOK_ALIKES)
_MIXED = re.compile(r"(?=.*[A-Za-z])[^\W_]*[Ͱ-ԯ][^\W_]*")
#: Places of subtrees that stand for the whole line.
ROOT, HEAD = -1, -2
#: Kinds of subtrees: whole lines and elements; labels and bullets, only counted as template; opening words, only counted as main text.
TREE, LABEL, OPEN = 0, 1, 2


def plain(line: str) -> str:
    """The text in one letter case, look-alike characters replaced."""
    if line.isascii():
        return line.lower().strip()
    if _HIDDEN.search(line):
        line = line.translate(_FOLD)
    if not unicodedata.is_normalized("NFKC", line):
        line = unicodedata.normalize("NFKC", line)
    if _OTHER_SCRIPT.search(line) and _MIXED.search(line):
        line = " ".join(w.translate(_LATIN) if w.translate(_LATIN).isascii() or re.search("[A-Za-z]", w) else w for w in line.split(" "))
    return line.casefold().strip()


def masked(text: str) -> str:
    """The text with # for each part of an identifier and 0 for numbers."""
    if _DIGIT.search(text):
        out, at = [], 0
        for digits in _COUNTED.finditer(text):
            start, end = digits.span()
            while start > at and (text[start - 1].isalnum() or text[start - 1] in "_-"):
                start -= 1
            word = text[start:end]  # words with a digit are identifiers if they have a letter, too
            out += (text[at:start], "#" * (1 + word.count("_")) if _LETTER.search(word) else _NUMBER.sub("0", word))
            at = end
        text = "".join([*out, text[at:]])
    return _JOINED.sub(lambda m: "#" * (1 + m[0].count("_")), text) if "_" in text else text


def _others(text: str) -> int:
    """About how many letters and digits stand behind the marks of identifiers and numbers."""
    return CODE_LENGTH * text.count("#") + NUMBER_LENGTH * text.count("0")


def _letters(text: str) -> int:
    return len(_NO_LETTER.sub("", text))


def _hash(kind: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}{text}".encode("utf-8", "replace")) - (1 << 63)


class _Element(NamedTuple):
    """An element with what its subtrees need, each hash 0 if there is no such subtree."""

    text: str
    letters: int
    others: int  # what its identifiers and numbers count for
    whole: int
    label: int
    label_letters: int
    labels_words: bool  # whether wording, not codes and numbers, makes up most of what follows the label
    bullet: int
    openings: tuple[int, ...]

    def hashes(self) -> set[int]:
        """All its subtrees that main text may hold."""
        question = _hash("b", self.text[:-1]) if _QUESTION.fullmatch(self.text) else 0
        return {self.whole, self.label, self.bullet, question, *self.openings} - {0} if self.letters else set()


def _element(raw: str) -> _Element:
    part = plain(raw).strip(" |·<>/")
    letters, others = _letters(part), _others(part)
    label, bullet = _LABEL.match(part), _BULLET.fullmatch(part)
    named = _letters(label[1]) if label else 0
    words = part.split()
    openings = [" ".join(words[:OPENING])] if len(words) >= LONG else []
    if label and len(label[2].split()) >= 2 * LONG:
        openings.append(" ".join(label[2].split()[:OPENING]))
    return _Element(
        part, letters, others, _hash("t", part), _hash("b", label[1]) if named else 0, named, bool(label) and letters > named and letters - named >= _others(label[2]),
        _hash("s", bullet[1]) if bullet else 0, tuple(_hash("o", x) for x in openings),
    )


def _chunks(line: str) -> list[str]:
    """The sentences of a line without markup, codes and numbers."""
    if _MARK.search(line):
        line = _MARKUP.sub(" ", line)
    line = masked(line)
    for end in _ENDS:
        if end in line:
            line = line.replace(end, end + "\n")
    return [chunk for chunk in line.split("\n") if chunk]


class _Subtrees(dict):
    """The subtrees of lines. The elements of the chunks (sentences) met last are kept, since chunks without their codes recur
    more than lines, and so are the subtrees of lines met last."""

    def __init__(self):
        super().__init__()
        self.lines: dict[str, list[tuple[int, int, int, float]]] = {}
        self.held: dict[str, set[int]] = {}

    def __missing__(self, chunk: str) -> list[_Element]:
        if len(self) >= 100_000:
            self.clear()
        found = self[chunk] = [e for e in map(_element, _ELEMENT.split(chunk)) if e.text]
        return found

    def of(self, line: str) -> list[tuple[int, int, int, float]]:
        """(place, kind, hash, share of the letters of the line) of each subtree; the place is the element's number,
        ``ROOT`` for the line itself, ``HEAD`` for its label or bullet."""
        found = self.lines.get(line)
        if found is None:
            if len(self.lines) >= 50_000:
                self.lines.clear()
            found = self.lines[line] = self._of(line)
        return found

    def held_by(self, text: str) -> set[int]:
        """The subtrees of all lines of a text."""
        found: set[int] = set()
        for line in _LINE_END.split(text):
            for chunk in _chunks(line):
                hashes = self.held.get(chunk)
                if hashes is None:
                    if len(self.held) >= 100_000:
                        self.held.clear()
                    hashes = self.held[chunk] = {h for e in map(_element, _ELEMENT.split(chunk)) if e.text for h in e.hashes()}
                found |= hashes
        return found

    def _of(self, line: str) -> list[tuple[int, int, int, float]]:
        parts = [e for chunk in _chunks(line) for e in self[chunk]]
        letters = sum(e.letters for e in parts)
        if not letters:
            return []
        first, several = parts[0], len(parts) > 1
        others = sum(e.others for e in parts)
        found = []
        if letters >= others and not several:  # a line of several elements recurs only where they do
            found.append((ROOT, TREE, first.whole, 1.0))
        if first.label and (letters - first.label_letters >= others if several else first.labels_words):
            found.append((HEAD, LABEL, first.label, 1.0))
        elif several and _QUESTION.fullmatch(first.text):
            found.append((HEAD, LABEL, _hash("b", first.text[:-1]), 1.0))
        for place, e in enumerate(parts):
            if not e.letters:
                continue
            share = e.letters / letters
            if several:
                found.append((place, TREE, e.whole, share))
                if e.labels_words:
                    found.append((place, LABEL, e.label, share))
            if e.bullet:
                found.append((place if several else HEAD, LABEL, e.bullet, share))
            for opening in e.openings:
                found.append((place, OPEN, opening, share))
        return found


def subtrees(line: str) -> list[tuple[int, int, int, float]]:
    return _Subtrees().of(line)


def _places(texts: DataFrame, repair: ChainClassifier) -> DataFrame:
    """(page, host, line_no, nth, n_lines, place, kind, subtree, share, records): a row for each subtree of each
    line of ``texts`` (page, host, text, copies). ``nth`` counts the lines that are not blank, ``records`` is the number
    of copies on one row of each subtree of a page, 0 on others."""
    shared = texts.sparkSession.sparkContext.broadcast((repair.weights, repair.model))
    names = ["page", "host", "line_no", "nth", "n_lines", "place", "kind", "subtree", "share", "records"]

    def run(batches):
        fixer, known = ChainClassifier(*shared.value), _Subtrees()
        for batch in batches:
            lines: tuple[list, ...] = tuple([] for _ in range(5))  # text, line_no, nth, n_lines, subtrees
            found: list[tuple[int, int, int, float]] = []
            records: list[int] = []
            for at, (text, copies) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                split = text.split("\n")
                if not text.isascii():
                    fixed = fixer.restore(text)[0].split("\n")
                    split = fixed if len(fixed) == len(split) else split
                kept = [(no, line) for no, line in enumerate(split, 1) if line and not line.isspace()]
                seen: set[int] = set()
                for nth, (no, line) in enumerate(kept):
                    rows = known.of(line)
                    for column, value in zip(lines, (at, no, nth, len(kept), len(rows))):
                        column.append(value)
                    for row in rows:
                        records.append(0 if row[2] in seen else copies)
                        seen.add(row[2])
                    found += rows
            text_at, line_no, nth, n_lines, n = (np.array(c, dtype=np.int32) for c in lines)
            at = pa.array(np.repeat(text_at, n))
            columns = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(np.repeat(x, n)) for x in (line_no, nth, n_lines))]
            columns += [pa.array(c, type=t) for c, t in zip(zip(*found) if found else [[]] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.float32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(records, type=pa.int64())], names=names)

    ddl = "page binary, host string, line_no int, nth int, n_lines int, place int, kind int, subtree bigint, share float, records bigint"
    return texts.select("page", "host", "text", "copies").mapInArrow(run, ddl)


def _usual(main_texts: list[DataFrame]) -> DataFrame:
    """(subtree, usual): the largest share of the texts of one of the tables ``main_texts`` (text) that hold a subtree."""
    def run(batches):
        known = _Subtrees()
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                counts.update(known.held_by(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.int64()), pa.array(list(counts.values()), type=pa.int64())], names=["subtree", "n"])

    usual = None
    for df in main_texts:
        texts = df.select("text").where(F.col("text").isNotNull())
        held = spread(texts).mapInArrow(run, "subtree bigint, n bigint").groupBy("subtree").agg(F.sum("n").alias("n"))
        shares = held.select("subtree", (F.col("n") / max(1, texts.count())).alias("usual"))
        usual = shares if usual is None else usual.unionByName(shares)
    return usual.groupBy("subtree").agg(F.max("usual").alias("usual"))


def _with_verdicts(places: DataFrame, verdicts: DataFrame, total: int) -> DataFrame:
    """``places`` joined with ``verdicts`` (host, subtree, n, is_usual); the few subtrees of very many places are broadcast."""
    limit = max(1000, int(total * HOT))
    hot = F.broadcast(verdicts.where(F.col("n") > limit).drop("n"))  # at most 1 / HOT rows
    cold = verdicts.where(F.col("n") <= limit).drop("n")
    rare = places.join(hot.select("host", "subtree"), ["host", "subtree"], "left_anti")
    joined = places.join(hot, ["host", "subtree"]).unionByName(rare.join(cold, ["host", "subtree"]))
    return joined.where((F.col("kind") == TREE) | ((F.col("kind") == OPEN) == F.col("is_usual")))


def _lines(places: DataFrame) -> DataFrame:
    """One row for each line with its judged subtrees and whether they make it template."""
    lines = places.groupBy("page", "host", "line_no", "nth", "n_lines").agg(F.collect_list(F.struct("place", "kind", "subtree", "share", "is_usual")).alias("held"))
    template, usual = F.filter("held", lambda x: ~x["is_usual"]), F.filter("held", lambda x: x["is_usual"])

    def cover(held: Column) -> Column:
        elements = F.array_distinct(F.transform(F.filter(held, lambda x: x["place"] >= 0), lambda x: F.struct(x["place"].alias("place"), x["share"].cast("double").alias("share"))))
        return F.aggregate(elements, F.lit(0.0), lambda total, x: total + x["share"])

    furniture = F.exists(template, lambda x: x["place"] < 0) | (cover(template) >= COVER)
    main = F.exists(usual, lambda x: x["place"] == ROOT) | (cover(usual) >= COVER)
    return lines.withColumn("template", furniture & ~main)


def template_lines(pages: DataFrame, hosts: DataFrame, main_texts: list[DataFrame], repair: ChainClassifier) -> DataFrame:
    """(page, line_no) of each template line of ``pages`` (page, host, text, copies), one row for each text of a host;
    ``hosts`` is (host, pages), ``main_texts`` are tables (text) of known main text."""
    places = land(_places(pages, repair), "p4-places")
    total = places.count()
    counted = places.groupBy("host", "subtree").agg(F.sum("records").alias("held"), F.count(F.lit(1)).alias("n"))
    verdicts = (
        counted.join(_usual(main_texts), "subtree", "left")
        .where((F.col("held") >= LEAST_PAGES) | F.col("usual").isNotNull())
        .join(hosts, "host")
        .withColumn("is_usual", F.coalesce("usual", F.lit(0.0)) * F.col("pages") > F.col("held") * BODY_SHARE)
        .where(F.col("is_usual") | (F.col("held") >= LEAST_PAGES))
        .select("host", "subtree", "n", "is_usual")
    )
    verdicts = land(verdicts, "p4-verdicts")
    lines = land(_lines(_with_verdicts(places.drop("records"), verdicts, total)).where("template"), "p4-lines")
    around = Window.partitionBy("page").orderBy("nth")
    beside = (F.lag("nth", 1, -9).over(around) == F.col("nth") - 1) | (F.lead("nth", 1, -9).over(around) == F.col("nth") + 1)
    alone = ~beside & (F.col("nth") > 0) & (F.col("nth") < F.col("n_lines") - 1)
    standing = lines.withColumn("alone", alone.cast("long")).select("host", "alone", F.explode(F.array_distinct(F.transform("held", lambda x: x["subtree"]))).alias("subtree"))
    inner = standing.groupBy("host", "subtree").agg(F.avg("alone").alias("alone")).where(F.col("alone") > ALONE)
    verdicts = verdicts.join(inner.select("host", "subtree"), ["host", "subtree"], "left_anti")
    again = lines.select("page", "host", "line_no", "nth", "n_lines", F.explode("held").alias("x")).select("page", "host", "line_no", "nth", "n_lines", "x.place", "x.kind", "x.subtree", "x.share")
    return _lines(_with_verdicts(again, land(verdicts, "p4-verdicts"), total)).where("template").select("page", "line_no")


def catalog_pages(spark, root: str) -> DataFrame:
    sections, operations = read_table(spark, root, "functional_section"), read_table(spark, root, "rest_operation")
    host = F.coalesce(F.parse_url(F.col("source.url"), F.lit("HOST")), F.lit(""))
    failed = F.col("node_type").eqNullSafe("collection_error").alias("failed")
    pages = sections.select(F.lit("functional_section").alias("table_name"), F.col("id").alias("record_id"), host.alias("host"), "text", failed).unionByName(
        operations.select(F.lit("rest_operation").alias("table_name"), F.col("id").alias("record_id"), host.alias("host"), F.col("description").alias("text"), failed)
    )
    return with_page_keys(pages)


def with_page_keys(pages: DataFrame) -> DataFrame:
    """``pages`` (table_name, record_id, host, text, failed) with ``page``, 128 bits that stand for the last three;
    ``failed`` marks records that hold the message of a failed collection, not a page."""
    host = F.coalesce("host", F.lit(""))
    return pages.select("table_name", "record_id", host.alias("host"), "text", "failed", F.substring(F.unhex(F.sha2(F.concat_ws("\n", host, F.col("failed").cast("string"), "text"), 256)), 1, 16).alias("page"))


def judged(pages: DataFrame, main_texts: list[DataFrame], repair: ChainClassifier) -> tuple[DataFrame, DataFrame]:
    """((table_name, record_id, host, page) of the records, (page, line_no) of the template lines of their texts)."""
    worded = pages.where(~F.col("failed") & F.col("text").rlike(r"(?U)\S"))
    records = land(worded.select("table_name", "record_id", "host", "page").distinct(), "p4-records")
    copies = records.groupBy("page").agg(F.count(F.lit(1)).alias("copies"))
    texts = worded.select("page", "host", "text").dropDuplicates(["page"]).join(copies, "page")
    hosts = records.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return records, template_lines(texts, hosts, main_texts, repair)


def main_tables(spark, root: str) -> list[DataFrame]:
    """Texts that were not taken from web pages."""
    return [read_table(spark, root, "documents").select("text"), read_table(spark, root, "entity_aliases").select(F.col("description").alias("text"))]


def found(spark, root: str) -> DataFrame:
    """The lines of each record that do not belong to the main body of its page."""
    records, lines = judged(catalog_pages(spark, root), main_tables(spark, root), trained_classifier(spark, root))
    return records.join(lines, "page").select("table_name", "record_id", F.col("line_no").cast("long").alias("line_no")).distinct()


def main_body(spark, root: str) -> DataFrame:
    """Each stored text of each record with the lines of its main body, which may be empty."""
    pages = catalog_pages(spark, root)
    _, lines = judged(pages, main_tables(spark, root), trained_classifier(spark, root))
    gone = lines.groupBy("page").agg(F.collect_set("line_no").alias("gone"))
    numbered = F.transform(F.split("text", "\n", -1), lambda line, k: F.struct((k + 1).alias("no"), line.alias("line")))
    kept = F.filter(numbered, lambda x: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), x["no"]))
    bodies = (
        pages.select("page", "text").dropDuplicates(["page"]).join(gone, "page", "left")
        .select("page", F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("body"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
    )
    return pages.select("table_name", "record_id", "page").distinct().join(bodies, "page", "left").drop("page")
