"""Text functions as Catalyst expressions. No function here leaves the JVM, but for text with characters
whose decomposition has several parts (ligatures, fractions) and NFKC of text beyond ASCII, which go
through Arrow UDFs, and ``run_tokens``, which Arrow workers call."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that carry no meaning for search.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "how", "in", "is", "it", "of", "on", "or", "that", "the", "this",
    "to", "use", "using", "what", "when", "which", "with", "you", "your",
    "de", "da", "das", "do", "dos", "e", "em", "é", "o", "os", "para",
    "por", "que", "qual", "quais", "um", "uma", "no", "na", "nos", "nas",
)
# Identifiers that look like tables and columns.
TABLE_PATTERN = r"\b[A-Z][A-Z0-9$#]{1,15}_[A-Z0-9_$#]{2,}\b"
IDENTIFIER_PATTERN = r"\b[A-Z][A-Z0-9_$#]{2,}\b"
#: Splits inside a word, each applied to the whole word in turn: aB, ABc, a1, 1a.
WORD_SPLITS = ("([a-z0-9])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])")
_INNER_SPLIT = "[a-z0-9][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z][0-9]|[0-9][A-Za-z]"
# Characters that take no space.
ZERO_WIDTH = "\ufeff\u200b\u200c\u200d\u2060"


def text_of(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def normalize_space(column: Column | str) -> Column:
    """Blanks of any kind collapsed to one space, none at the ends; null gives the empty text."""
    return F.trim(F.regexp_replace(text_of(column), r"(?U)\s+", " "))


# Ligatures and signs of several characters that stand in prose.
LIGATURES = "ﬀﬁﬂﬃﬄﬅﬆ™№℠½¼¾…Ĳĳŉ"


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str, str]:
    """(characters with a single plain form, their plain forms, combining marks), by the Unicode rule."""
    source, plain, marks = [], [], []
    for cp in range(0x80, min(0x30000, sys.maxunicode)):
        if 0xD800 <= cp <= 0xF8FF or 0xAC00 <= cp <= 0xD7A3:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        bare = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if bare != ch and len(bare) == 1:
            source.append(ch)
            plain.append(bare)
    return "".join(source), "".join(plain), "".join(marks)


@F.pandas_udf(StringType())
def _strip_accents_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)))


def strip_accents(column: Column | str, exact: bool = False) -> Column:
    """Accents and compatibility forms removed, ``LIGATURES`` taken apart. ``exact`` takes apart every character of
    several, by an Arrow UDF; without it the expression stays in the JVM."""
    text = text_of(column)
    if exact:
        return _strip_accents_udf(text)
    source, plain, marks = _accent_table()
    apart = text
    for ligature in LIGATURES:
        apart = F.replace(apart, F.lit(ligature), F.lit(unicodedata.normalize("NFKD", ligature)))
    apart = F.when(text.rlike(f"[{LIGATURES}]"), apart).otherwise(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(apart, source + marks, plain)).otherwise(text)


def normalize_text(column: Column | str) -> Column:
    """For comparisons: no accents, lower case, single spaces."""
    return normalize_space(F.lower(strip_accents(column)))


def _word_parts(word: Column) -> Column:
    spaced = word
    for pattern in WORD_SPLITS:
        spaced = F.regexp_replace(spaced, pattern, "$1 $2")
    whole, none = F.lower(word), F.array().cast("array<string>")
    parts = F.concat(
        F.array(whole),
        F.when(word.rlike(_INNER_SPLIT), F.split(F.lower(spaced), " ")).otherwise(none),
        F.when(F.contains(word, F.lit("_")), F.filter(F.split(whole, "_"), lambda p: p != "")).otherwise(none),
    )
    # nearly all words are plain: one test instead of the rewrites
    return F.when(word.rlike("^(?:[a-z]+|[A-Z][a-z]*|[0-9]+|[A-Z]+)$"), F.array(whole)).otherwise(parts)


def tokenize(column: Column | str) -> Column:
    """Search tokens in order, with repetitions: whole words and their parts, without short and stop words."""
    words = F.regexp_extract_all(strip_accents(column), F.lit("([A-Za-z0-9_]+)"), F.lit(1))
    return F.filter(F.flatten(F.transform(words, _word_parts)), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


@lru_cache(maxsize=1)
def _plain_table() -> dict[int, str | None]:
    """``_accent_table`` and ``LIGATURES`` for ``str.translate``."""
    source, plain, marks = _accent_table()
    table = dict.fromkeys(map(ord, marks)) | {ord(c): p for c, p in zip(source, plain)}
    return table | {ord(c): unicodedata.normalize("NFKD", c).translate(table) for c in LIGATURES}


_RUNS, _BREAKS = re.compile("[A-Za-z0-9_\x80-\U0010ffff]+"), {i: " " for i in range(128) if not (chr(i).isalnum() or chr(i) == "_")}
_WORD, _INNER, _SPLITS, _STOP = re.compile("[A-Za-z0-9_]+"), re.compile(_INNER_SPLIT), [re.compile(p) for p in WORD_SPLITS], frozenset(STOPWORDS)


def runs_of(text: str) -> list[str]:
    """The parts of a text between ASCII characters that end a word; those beyond ASCII may become letters."""
    return text.translate(_BREAKS).split() if text.isascii() else _RUNS.findall(text)


def run_tokens(run: str) -> list[str]:
    """``tokenize`` of a part of ``runs_of``, in Python: nearly all runs repeat, so that a worker takes each apart once
    where the expressions work on each word of each text."""
    if run.isascii() and (run.isdigit() or run.isalpha() and (run[1:].islower() or run.islower() or run.isupper())):
        words = [(run, False)]
    else:
        words = [(w, True) for w in _WORD.findall(run if run.isascii() else run.translate(_plain_table()))]
    found: list[str] = []
    for word, mixed in words:
        found.append(whole := word.lower())
        if mixed and _INNER.search(word):
            for pattern in _SPLITS:
                word = pattern.sub(r"\1 \2", word)
            found += word.lower().split(" ")
        if "_" in whole:
            found += [p for p in whole.split("_") if p]
    return [t for t in found if len(t) > 1 and t not in _STOP]


def slugify(column: Column | str) -> Column:
    slug = F.regexp_replace(F.regexp_replace(normalize_text(column), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("item"))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix:slug of the first part:hash of all parts."""
    texts = [text_of(p) for p in parts]
    return F.concat_ws(":", F.lit(prefix), F.left(slugify(texts[0]), F.lit(48)), F.left(F.sha1(F.concat_ws("|", *texts)), F.lit(16)))


def distinct_in_order(column: Column | str) -> Column:
    """Normalized values of an array, first occurrence kept, blanks dropped."""
    values = F.coalesce(F.col(column) if isinstance(column, str) else column, F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(values, normalize_space), lambda v: v != ""))


def merge_text(*columns: Column) -> Column:
    """Texts joined by spaces and normalized; nulls are left out."""
    return normalize_space(F.concat_ws(" ", *columns))


def mentions(column: Column | str, pattern: str = TABLE_PATTERN) -> Column:
    """Distinct matches of a pattern in order."""
    return F.array_distinct(F.regexp_extract_all(text_of(column), F.lit(pattern), F.lit(0)))


def documented_references(column: Column | str) -> Column:
    """(table, column) pairs that a text documents as a reference to TABLE.COLUMN, upper case."""
    pattern = r"(?i)\breferences?(?:\s+to)?\s+([A-Z][A-Z0-9_$#]*_[A-Z0-9_$#]+)\.([A-Z][A-Z0-9_$#]*)\b"
    text = text_of(column)
    tables = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.upper)
    columns = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), F.upper)
    return F.zip_with(tables, columns, lambda t, c: F.struct(t.alias("table"), c.alias("column")))


def documented_values(column: Column | str) -> Column:
    """Distinct values that a text documents as ``X (meaning)``; yes and no where it only says Y/N."""
    text = text_of(column)
    pattern = r"\b([A-Z0-9])\s*\(([^)]+)\)"
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    meanings = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    pairs = F.array_distinct(F.zip_with(values, meanings, lambda v, m: F.struct(v.alias("value"), F.trim(m).alias("meaning"))))
    domain = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(m).alias("meaning")) for v, m in (("Y", "Yes"), ("N", "No"))])
    return F.when(F.size(pairs) > 0, pairs).when(text.rlike(r"(?i)\bY\s*(?:/|OR)\s*N\b"), domain).otherwise(pairs)


# The scale of confidence words.
CONFIDENCE = {"very_high": 1.0, "high": 0.9, "medium": 0.7, "low": 0.45, "unknown": 0.3}


def confidence_score(column: Column | str) -> Column:
    """A number clamped to 0..1, a word of the scale, or 0.6."""
    column = F.col(column) if isinstance(column, str) else column
    number = column.cast("string").try_cast("double")
    word = F.replace(normalize_text(column.cast("string")), F.lit(" "), F.lit("_"))
    score = F.when(number.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))
    for name, value in CONFIDENCE.items():
        score = score.when(word == name, value)
    return score.otherwise(0.6)


def heading_level(tag: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(tag), "^h([1-6])$", 1).try_cast("int"), F.lit(7))


def truncate_summary(column: Column | str, limit: int = 500) -> Column:
    text = normalize_space(column)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(limit - 1))), F.lit("…")))


@F.pandas_udf(StringType())
def _nfkc_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def normalize_semantic_text(column: Column | str) -> Column:
    """For embedding: NFKC, zero-width characters out, blanks collapsed; case, accents and punctuation kept."""
    text = text_of(column)
    other = F.when(text.rlike(r"[^\x00-\x7F]"), text)  # plain texts do not reach the UDF
    return F.trim(F.regexp_replace(F.translate(F.coalesce(_nfkc_udf(other), text), ZERO_WIDTH, ""), r"(?U)\s+", " "))


def text_hash(column: Column | str) -> Column:
    return F.sha2(normalize_semantic_text(column), 256)


def safe_log(column: Column) -> Column:
    return F.ln(F.greatest(column, F.lit(1e-12)))


def keywords(tokens: Column, top: int = 30) -> Column:
    """The most frequent tokens, ties by the alphabet. Counted as runs of the sorted tokens."""
    none = F.array().cast("array<int>")
    places = lambda s: F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s))).otherwise(none)
    starts = lambda s: F.filter(places(s), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
    # arrays of one element bind what the inner functions read many times
    bound = F.transform(F.array(F.array_sort(tokens)), lambda s: F.struct(s.alias("s"), starts(s).alias("at")))
    counted = F.transform(bound, lambda b: F.transform(b["at"], lambda i, k: F.struct((i - F.coalesce(F.get(b["at"], k + 1), F.size(b["s"]) + 1)).alias("n"), F.get(b["s"], i - 1).alias("token"))))
    return F.transform(F.slice(F.array_sort(F.flatten(counted)), 1, top), lambda s: s["token"])


def node_keywords() -> Column:
    """Keywords of a node: of its search text, or of its title where that is empty."""
    return keywords(tokenize(F.coalesce(F.nullif(F.col("search_text"), F.lit("")), F.col("title"))))


def same_document_base(url: Column, base: Column) -> Column:
    folder = F.regexp_replace(F.parse_url(base, F.lit("PATH")), "[^/]*$", "")
    return (F.parse_url(url, F.lit("HOST")) == F.parse_url(base, F.lit("HOST"))) & F.startswith(F.parse_url(url, F.lit("PATH")), folder)


def release_of(url: Column) -> Column:
    """The release part of a URL path, such as 24B."""
    return F.nullif(F.upper(F.regexp_extract(url, r"/(\d{2}[A-Za-z])(?:/|$)", 1)), F.lit(""))


def safe_filename(column: Column) -> Column:
    return F.regexp_replace(F.trim(column), "[^A-Za-z0-9._-]+", "_")


def header_name(column: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def utc_now() -> Column:
    """The time of the query in UTC as an ISO string of seconds."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def json_hash(*columns: Column) -> Column:
    """SHA-256 of a row as JSON, its keys in order of name."""
    named = sorted(columns, key=lambda c: c._jc.toString())
    return F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256)


def file_hash(content: Column) -> Column:
    """SHA-256 of the content of a file, as ``binaryFile`` reads it."""
    return F.sha2(content, 256)
