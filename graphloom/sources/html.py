"""HTML pages: titles, main text, sections, tables and links, by one pass of the standard parser.

Python UDTFs take (html) or (html, url) and give rows; pages are independent, so they scale with the scan.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructType

_SKIPPED = {"script", "style", "nav", "header", "footer", "noscript", "template", "aside", "form"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLOCKS = {"p", "pre", "blockquote", "dd", "dt", "div"}


class Page(HTMLParser):
    """Collects title, sections and links. Content of page furniture elements is skipped, links in it are kept."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.links = "", []
        self.sections: list[dict] = []
        self.path: list[tuple[int, str]] = []
        self._skip, self._in, self._text, self._items, self._cells, self._rows, self._header = 0, [], [], [], [], [], False
        self._link: list | None = None
        self._list_labels: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self._skip += 1
        if tag in _VOID:
            if tag == "br":
                self._text.append(" ")
            return
        self._in.append(tag)
        if tag == "a":
            href = dict(attrs).get("href")
            self._link = [href, []] if href else None
        if self._skip:
            return
        if tag in _HEADINGS or tag in _BLOCKS or tag in ("li", "table"):
            self._flush(None if tag not in _HEADINGS else tag)
        if tag == "tr":
            self._cells, self._header = [], False
        if tag in ("td", "th"):
            self._text = []
            self._header = self._header or tag == "th"

    def handle_endtag(self, tag):
        if tag in _VOID:
            return
        if tag == "a" and self._link:
            self.links.append((self._link[0], " ".join("".join(self._link[1]).split())))
            self._link = None
        if tag in self._in:
            while self._in and self._in.pop() != tag:
                pass
        if tag in _SKIPPED:
            self._skip = max(0, self._skip - 1)
            return
        if self._skip:
            return
        text = " ".join("".join(self._text).split())
        if tag == "title":
            self.title, self._text = self.title or text, []
        elif tag in _HEADINGS:
            self._text = []
            if text:
                level = int(tag[1])
                self.path = [p for p in self.path if p[0] < level] + [(level, text)]
                self.sections.append({"title": text, "level": level, "path": [p[1] for p in self.path], "texts": [], "items": [], "tables": []})
        elif tag in ("td", "th"):
            self._cells.append(text)
            self._text = []
        elif tag == "tr":
            self._rows.append((self._header, self._cells))
        elif tag == "table":
            if self._rows:
                self._section()["tables"].append(table_records(self._rows))
            self._rows, self._text = [], []
        elif tag == "li":
            if text:
                self._section()["items"].append(text)
            self._text = []
        elif tag in _BLOCKS:
            self._flush(None)

    def handle_data(self, data):
        if self._link:
            self._link[1].append(data)
        if not self._skip:
            self._text.append(data)

    def _section(self) -> dict:
        if not self.sections:
            self.sections.append({"title": self.title, "level": 1, "path": [self.title] if self.title else [], "texts": [], "items": [], "tables": []})
        return self.sections[-1]

    def _flush(self, _tag) -> None:
        text = " ".join("".join(self._text).split())
        self._text = []
        if text and "title" not in self._in[-1:] and not self._rows:
            self._section()["texts"].append(text)


def header_slug(text: str, position: int) -> str:
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_") or f"column_{position}"


def table_records(rows: list[tuple[bool, list[str]]]) -> list[dict[str, str]]:
    """Rows as maps; a first row of header cells names the columns, else they are numbered."""
    header = rows[0][1] if rows and rows[0][0] else None
    names = [header_slug(h, k) for k, h in enumerate(header, 1)] if header else []
    out = []
    for _, cells in rows[1 if header else 0 :]:
        record = {(names[k] if k < len(names) else f"column_{k + 1}"): c for k, c in enumerate(cells)}
        if any(record.values()):
            out.append(record)
    return out


def parse(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    page.close()
    page._flush(None)
    return page


_SECTION = (
    StructType().add("title", StringType()).add("level", IntegerType()).add("section_path", ArrayType(StringType())).add("text", StringType())
    .add("list_items", ArrayType(StringType())).add("tables", ArrayType(ArrayType(MapType(StringType(), StringType()))))
)
_LINK = StructType().add("url", StringType()).add("label", StringType()).add("position", IntegerType())


@F.udtf(returnType=_SECTION)
class HtmlSections:
    """One row for each section: those with content, and the first level."""

    def eval(self, html: str):
        for s in parse(html).sections:
            if s["level"] == 1 or s["texts"] or s["items"] or s["tables"]:
                yield s["title"], s["level"], s["path"], "\n".join(s["texts"]), s["items"], s["tables"]


@F.udtf(returnType=_LINK)
class HtmlLinks:
    """The links of a page, absolute and without fragments, in order."""

    def eval(self, html: str, base: str):
        for k, (href, label) in enumerate(parse(html).links):
            url = urldefrag(urljoin(base or "", href)).url
            if urlparse(url).scheme in ("http", "https"):
                yield url, label, k


def page_sections(pages: DataFrame) -> DataFrame:
    """Sections of pages (url, html)."""
    return pages.lateralJoin(HtmlSections(F.col("html").outer())).drop("html")


def toc_links(pages: DataFrame, extension: str = ".html", excluded: tuple[str, ...] = ()) -> DataFrame:
    """(page, url, label): links below the folder of their page, each URL once, by position."""
    from graphloom.functions.text import same_document_base

    found = pages.withColumnRenamed("url", "page").lateralJoin(HtmlLinks(F.col("html").outer(), F.col("page").outer())).drop("html")
    inside = found.where(same_document_base(F.col("url"), F.col("page")) & F.endswith(F.lower(F.parse_url("url", F.lit("PATH"))), F.lit(extension)))
    if excluded:
        inside = inside.where(~F.element_at(F.split(F.parse_url("url", F.lit("PATH")), "/"), -1).isin(*excluded))
    return inside.groupBy("page", "url").agg(F.min_by("label", "position").alias("label"), F.min("position").alias("position"))
