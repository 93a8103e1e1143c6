"""Splitting oversized texts at natural boundaries.

Every position between two characters has a strength: paragraph, line, sentence, clause, blank, inside
a word. A sparse table over the strengths answers "the strongest position in this window, rightmost
among equals" in constant time; each entry holds strength and position in one number, so the maximum
breaks ties to the right by itself. A text is cut from left to right: the window holds the piece
lengths from half the limit to the limit; where it has no natural boundary, the whole permissible
window counts, and only then a word is cut. The next piece starts ``overlap`` characters before the cut.

Only texts above their limit are sent to Python; all others pass as one piece inside the JVM.

Defined cases: null text gives no piece; an empty text gives one empty piece; lengths are code points;
repeated rows count once; ties go right; an overlap that is not below the limit is an error. A cut
never separates a combining mark or joined emoji from its base where another position is in reach.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.tables import read_table

#: Windows that are indexed at a time, and the least size of a piece as a share of the limit where a boundary allows it.
BLOCKS, LEAST_SHARE = 32, 0.5

_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』）]*")
_CLAUSE = re.compile(r"[;:,]\s+|[、，；：]")
_BLANK = re.compile(r"\s+")
_LINE = re.compile(r"\r\n|\n|\r")
_PARAGRAPH = re.compile(r"(?:\r\n|\n|\r)[^\S\n\r]*(?:(?:\r\n|\n|\r)[^\S\n\r]*)+")
_LEVELS = ((_BLANK, 2), (_CLAUSE, 3), (_SENTENCE, 4), (_LINE, 5), (_PARAGRAPH, 6))
_GLUE = re.compile(r"[̀-゙゚ͯ︀-️‍\U0001f3fb-\U0001f3ff]|(?<=‍).", re.S)


def boundary_strengths(text: str) -> np.ndarray:
    """Strength of a cut before each position 0..len: 0 never unless forced, 1 inside a word, up to 6."""
    strength = np.ones(len(text) + 1, dtype=np.int8)
    if not text.isascii():
        strength[[m.start() for m in _GLUE.finditer(text)]] = 0
    for pattern, level in _LEVELS:
        strength[[m.end() for m in pattern.finditer(text)]] = level
    return strength


class RightmostMaximum:
    """Sparse table: the rightmost position of the greatest strength in a window, in constant time."""

    def __init__(self, strength: np.ndarray, widest: int):
        self.width = len(strength) + 1
        level = strength.astype(np.int64) * self.width + np.arange(len(strength))
        self.table = [level]
        step = 1
        while 2 * step <= min(widest, len(strength)):
            level = np.maximum(level[:-step], level[step:])
            self.table.append(level)
            step *= 2

    def __call__(self, low: int, high: int) -> tuple[int, int]:
        """(position, strength) for the window low..high, both included."""
        k = (high - low + 1).bit_length() - 1
        best = max(int(self.table[k][low]), int(self.table[k][high - (1 << k) + 1]))
        return best % self.width, best // self.width


class BlockedMaximum:
    """``RightmostMaximum`` over a few windows at a time, for queries that move to the right: a byte for each character of
    the text, and the index of ``BLOCKS`` windows."""

    def __init__(self, strength: np.ndarray, widest: int):
        self.strength, self.widest = strength, widest
        self.base, self.index = 0, RightmostMaximum(strength[: (BLOCKS + 1) * widest], widest)

    def __call__(self, low: int, high: int) -> tuple[int, int]:
        if high - self.base >= (BLOCKS + 1) * self.widest:
            self.base = max(0, high - self.widest)  # a later window of the same piece may start further left
            self.index = RightmostMaximum(self.strength[self.base : self.base + (BLOCKS + 1) * self.widest], self.widest)
        position, strength = self.index(low - self.base, high - self.base)
        return position + self.base, strength


def split_spans(text: str, limit: int, overlap: int, least_share: float = LEAST_SHARE) -> list[tuple[int, int]]:
    """Start and end of each piece. Cuts are looked for from ``least_share`` of the limit on, so that pieces do not get
    small; only where there is no natural boundary, the whole permissible window counts."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    best = BlockedMaximum(boundary_strengths(text), limit)
    first = max(1, -int(-limit * least_share // 1))
    spans, start = [], 0
    while n - start > limit:
        low, high = start + overlap + 1, start + limit
        cut, strength = best(max(low, start + first), high)
        if strength < 2:
            cut, strength = best(low, high)
        if strength < 2:
            cut = best(max(low, start + first), high)[0]
        spans.append((start, cut))
        start = cut - overlap
    spans.append((start, n))
    return spans


def _cut(batches):
    for batch in batches:
        names, ids, texts, limits, overlaps = (c.to_pylist() for c in batch.columns)
        rows = ([], [], [], [], [], [])
        for name, i, text, limit, overlap in zip(names, ids, texts, limits, overlaps):
            for k, (a, b) in enumerate(split_spans(text, limit, overlap)):
                for column, value in zip(rows, (name, i, k, a, b, text[a:b])):
                    column.append(value)
        types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(rows, types)], names=["table_name", "record_id", "piece_no", "start_at", "end_at", "piece"])


def split_oversized(texts: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of ``texts`` (table_name, record_id, field_name, text) under ``limits`` (table_name,
    field_name, max_size, overlap_size); one row for each piece, ``n_pieces`` on each."""
    texts = texts.select("table_name", "record_id", "field_name", "text").where(F.col("text").isNotNull())
    sized = texts.join(limits.select("table_name", "field_name", "max_size", "overlap_size"), ["table_name", "field_name"]).dropDuplicates(["table_name", "record_id", "text"])
    small = sized.where(F.length("text") <= F.col("max_size")).select(
        "table_name", "record_id", F.lit(0).alias("piece_no"), F.lit(0).alias("start_at"), F.length("text").alias("end_at"), F.col("text").alias("piece"), F.lit(False).alias("oversized")
    )
    large = (
        sized.where(F.length("text") > F.col("max_size"))
        .select("table_name", "record_id", "text", "max_size", "overlap_size")
        .mapInArrow(_cut, "table_name string, record_id string, piece_no int, start_at int, end_at int, piece string")
        .withColumn("oversized", F.lit(True))
    )
    return small.unionByName(large)


def domain_texts(spark, root: str) -> DataFrame:
    sections, operations = read_table(spark, root, "functional_section"), read_table(spark, root, "rest_operation")
    return sections.select(
        F.lit("functional_section").alias("table_name"), F.col("id").alias("record_id"), F.lit("text").alias("field_name"), F.col("text")
    ).unionByName(operations.select(F.lit("rest_operation").alias("table_name"), F.col("id").alias("record_id"), F.lit("description").alias("field_name"), F.col("description").alias("text")))


def catalog_pieces(spark, root: str) -> DataFrame:
    limits = read_table(spark, root, "size_limits").where(F.col("unit") == "character").select("table_name", "field_name", "max_size", "overlap_size")
    return split_oversized(domain_texts(spark, root), limits)


def found(spark, root: str) -> DataFrame:
    """Records whose text came out in more than one piece."""
    return catalog_pieces(spark, root).where(F.col("oversized") & (F.col("piece_no") == 1)).select("table_name", "record_id").distinct()
