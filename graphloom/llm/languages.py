"""Languages of documents and of the segments of mixed ones, by prediction by partial matching.

For each language the labelled ``lang_samples`` give a tree of byte contexts up to ``ORDER`` with counts that
stay frozen. A byte costs its code length in the longest context that has it; every longer known
context without it adds the code length of its escape (method C). All trees are flattened to one sorted
table: context and byte -> the exact code lengths in all languages, and context -> the escape costs in all
languages. Words are coded with the contexts of the word, and since words recur a task codes each
word once, all new words of a batch together with array operations; a sentence costs the sum of its words.

A document is cut into sentences and fragments (headings, list items, code). The language of a sentence
is that with the shortest code; its confidence is the posterior of the code lengths (softened by
``SOFTNESS``, as template text is coded too confidently). A language counts in a document from two
consecutive sentences on; a document without such a run has the language of most of its sentences.

One narrow map, no shuffle; the tables depend on the samples only and are broadcast. Defined cases: null,
empty and blank texts, symbols, codes and program text have no language and no segments; a label is
compared without regard to case, outer blanks and region, by code, three-letter code or name; texts of
any length are handled sentence by sentence; repeated rows are each judged.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.tables import read_table, spread

ORDER = 4
SOFTNESS = 6.0
#: Words of a sentence; a segment with fewer is a fragment.
SENTENCE_WORDS, SENTENCE_KANA = 5, 9
#: Bits a byte beyond which a segment is no natural text of any of the languages.
NATURAL_BITS = 5.2
MEMORY = 300_000

_SEGMENT = re.compile(r"[^\n\r]*?(?:[.!?…]+[\"'”’»)\]]*(?=\s|$)|[。！？]+[」』）]*|[\n\r]+|$)", re.S)
_WORD = re.compile(r"(?<![^\W_])[^\W\d_]+(?:['’][^\W\d_]+)*(?![\w])|[ぁ-ヿ㐀-鿿ｦ-ﾟー]+")
_JAPANESE = re.compile(r"[ぁ-ヿ]")
_CODE = re.compile(r"[{}=;<>$\\`_|]|\(\)|\w\(|->|::|\w\.\w+\(|^\s*(?:#|//|--|/\*)|[+*/]=")


def _variants(text: str) -> list[str]:
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c) or "ぁ" <= c <= "ヿ")
    return [text] if bare == text else [text, unicodedata.normalize("NFC", bare)]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


class ContextTrees:
    """Frozen context trees of several languages, flattened for lookups with arrays."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in samples})
        counts: list[list[dict[bytes, Counter]]] = [[defaultdict(Counter) for _ in range(ORDER + 1)] for _ in self.langs]
        for lang, text in samples:
            trees = counts[self.langs.index(lang)]
            for variant in _variants(text):
                for word in words_of(variant):
                    data = b" " + word.encode() + b" "
                    for i in range(1, len(data)):
                        for k in range(min(ORDER, i) + 1):
                            trees[k][data[i - k : i]][data[i]] += 1
        n = len(self.langs)
        cost: dict[tuple[int, bytes, int], np.ndarray] = {}
        escape: dict[tuple[int, bytes], np.ndarray] = {}
        uniform = np.full(n, 8.0, dtype=np.float32)
        for k in range(ORDER + 1):
            for context in {c for trees in counts for c in trees[k]}:
                out = np.zeros(n, dtype=np.float32)
                seen = set()
                for j, trees in enumerate(counts):
                    tree = trees[k].get(context)
                    if tree:
                        out[j] = -log2(len(tree) / (sum(tree.values()) + len(tree)))
                        seen |= tree.keys()
                escape[k, context] = out
                for byte in seen:
                    row = out + (cost.get((k - 1, context[1:], byte), uniform) if k else uniform)
                    for j, trees in enumerate(counts):
                        tree = trees[k].get(context)
                        if tree and byte in tree:
                            row[j] = -log2(tree[byte] / (sum(tree.values()) + len(tree)))
                    cost[k, context, byte] = row
        self.cost_keys, self.costs = self._flat({(k, c + bytes([b])): v for (k, c, b), v in cost.items()}, n)
        self.escape_keys, self.escapes = self._flat(escape, n)

    @staticmethod
    def _flat(table: dict[tuple[int, bytes], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array([(k << 48) | int.from_bytes(g, "big") for k, g in table], dtype=np.uint64)
        order = np.argsort(keys)
        return keys[order], np.array(list(table.values()), dtype=np.float32).reshape(-1, n)[order]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def code_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(code length of each word in each language, number of coded bytes of each word)."""
        data = [w.encode("utf-8", "replace") + b" " for w in words]
        sizes = np.array([len(d) for d in data], dtype=np.int64)
        flat = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint64)
        starts = np.cumsum(sizes) - sizes
        depth = np.arange(len(flat)) - np.repeat(starts, sizes)  # bytes of the word before this one
        gram = [flat]
        for k in range(1, ORDER + 1):
            before = np.full(len(flat), 32, dtype=np.uint64)
            before[k:] = flat[:-k]
            before[depth < k] = 32  # the blank before the word; beyond it no context is used
            gram.append(gram[-1] | (before << np.uint64(8 * k)))
        total = np.zeros((len(flat), len(self.langs)), dtype=np.float32)
        left = np.arange(len(flat))
        for k in range(ORDER, -1, -1):
            here = left[depth[left] + 1 >= k]
            above = left[depth[left] + 1 < k]
            grams = gram[k][here]
            at, hit = self._find(self.cost_keys, grams | np.uint64(k << 48))
            total[here[hit]] += self.costs[at[hit]]
            miss = here[~hit]
            at, known = self._find(self.escape_keys, (grams[~hit] >> np.uint64(8)) | np.uint64(k << 48))
            total[miss[known]] += self.escapes[at[known]]
            left = np.concatenate([above, miss])
        total[left] += 8.0
        return np.add.reduceat(total, starts, axis=0), sizes


class LanguageJudge:
    """Judges documents batch by batch; keeps the codes of words between batches."""

    def __init__(self, trees: ContextTrees):
        self.trees = trees
        self.number: dict[str, int] = {}
        self.bits = np.zeros((0, len(trees.langs)), dtype=np.float32)
        self.sizes = np.zeros(0, dtype=np.int64)

    def segments(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text its segments (start, end, language index, confidence, whether a sentence)."""
        if len(self.number) > MEMORY:
            self.number = {}
            self.bits, self.sizes = self.bits[:0], self.sizes[:0]
        number, known = self.number, len(self.number)
        spans, index = [], []
        for t, text in enumerate(texts):
            if not text or text.isspace():
                continue
            for m in _SEGMENT.finditer(text):
                piece = m.group()
                if len(piece) < 3:
                    continue
                words = words_of(piece)
                if words:
                    spans.append((t, m.start(), m.end(), len(words), piece))
                    index.append([number.setdefault(w, len(number)) for w in words])
        fresh = list(number)[known:]
        if fresh:
            bits, sizes = self.trees.code_words(fresh)
            self.bits, self.sizes = np.concatenate([self.bits, bits]), np.concatenate([self.sizes, sizes])
        out: list[list[tuple]] = [[] for _ in texts]
        if not spans:
            return out
        flat = np.array([i for x in index for i in x], dtype=np.int64)
        lengths = np.array([len(x) for x in index], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        bits = np.add.reduceat(self.bits[flat], starts, axis=0)
        sizes = np.add.reduceat(self.sizes[flat], starts)
        best = bits.argmin(axis=1)
        share = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) / SOFTNESS)
        confidence = 1.0 / share.sum(axis=1)
        rate = bits.min(axis=1) / sizes
        for (t, a, b, n, piece), l, c, r in zip(spans, best.tolist(), confidence.tolist(), rate.tolist()):
            if r > NATURAL_BITS:
                continue
            japanese = len(_JAPANESE.findall(piece))
            code = len(_CODE.findall(piece))
            sentence = (n >= SENTENCE_WORDS and code * 3 < n) or japanese >= SENTENCE_KANA
            if not sentence and (code or (n < 2 and not japanese)):
                continue
            out[t].append((a, b, l, c, sentence))
        return out

    def languages(self, segments: list[tuple]) -> dict[int, float]:
        """The languages that count in a document with their confidence."""
        sentences = [s for s in segments if s[4]]
        if not sentences:
            sentences = [s for s in segments if s[3] > 0.9 and s[1] - s[0] >= 12]
            if not sentences:
                return {}
        weight, total, runs = Counter(), Counter(), set()
        for k, (a, b, l, c, _) in enumerate(sentences):
            weight[l] += (b - a) * c
            total[l] += b - a
            if k and sentences[k - 1][2] == l:
                runs.add(l)
        counted = runs or {max(sorted(total), key=total.__getitem__)}
        return {l: weight[l] / total[l] for l in sorted(counted)}


def trained_trees(spark, root: str) -> ContextTrees:
    """Trees of ``lang_samples``, a small table that does not grow."""
    rows = read_table(spark, root, "lang_samples").where(F.col("text").isNotNull() & F.col("lang").isNotNull()).orderBy("sample_id").collect()
    return ContextTrees([(r["lang"], r["text"]) for r in rows])


def label_names(spark, root: str) -> dict[str, str]:
    """Spellings of the languages of ``lang_codes`` (a small table) -> code."""
    rows = read_table(spark, root, "lang_codes").collect()
    return {str(v).strip().lower(): r["lang_code"] for r in rows for v in (r["lang_code"], r["lang_code3"], r["lang_name"]) if v}


# Labels that name no language.
UNUSABLE = ("", "xx", "xxx", "und", "unk", "unknown", "n/a", "na", "none", "null", "mul", "mis", "zxx", "?", "-")


def _judged(documents: DataFrame, trees: ContextTrees, spans: bool) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(trees)
    if spans:
        names = ["doc_id", "segment_no", "start_at", "end_at", "lang", "confidence"]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
    else:
        names, types = ["doc_id", "label", "lang", "confidence"], (pa.int64(), pa.string(), pa.string(), pa.float64())

    def run(batches):
        judge = LanguageJudge(shared.value)
        langs = judge.trees.langs
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                ids, labels, texts = (c.to_pylist() for c in batch.columns)
                rows: tuple[list, ...] = tuple([] for _ in names)
                for i, label, found in zip(ids, labels, judge.segments(texts)):
                    if spans:
                        values = ((i, k, *joined) for k, joined in enumerate(_joined(found, langs)))
                    else:
                        values = ((i, label, langs[l], c) for l, c in judge.languages(found).items())
                    for row in values:
                        for column, value in zip(rows, row):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(rows, types)], names=names)

    ddl = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.float64(): "double"}
    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")).mapInArrow(run, ", ".join(f"{n} {ddl[t]}" for n, t in zip(names, types)))


def _joined(found: list[tuple], langs: list[str]):
    """Neighbouring segments of one language as one: (start, end, language, confidence)."""
    run: list[tuple] = []
    for s in [*found, None]:
        if run and (s is None or s[2] != run[-1][2]):
            size = sum(b - a for a, b, *_ in run)
            yield run[0][0], run[-1][1], langs[run[0][2]], sum((b - a) * c for a, b, _, c, _ in run) / size
            run = []
        if s is not None:
            run.append(s)


def document_languages(spark, root: str) -> DataFrame:
    """(doc_id, label, lang, confidence): one row for each language of each document."""
    return _judged(read_table(spark, root, "documents"), trained_trees(spark, root), spans=False)


def segment_languages(spark, root: str) -> DataFrame:
    """(doc_id, segment_no, start_at, end_at, lang, confidence): the runs of one language in each document."""
    return _judged(read_table(spark, root, "documents"), trained_trees(spark, root), spans=True)


def found(spark, root: str) -> DataFrame:
    """Languages of the documents whose label is unusable, names another language, or that mix languages."""
    names = label_names(spark, root)
    label = F.lower(F.regexp_replace("label", r"(?U)^\s+|\s+$", ""))
    base = F.element_at(F.split(label, "[-_]"), 1)
    codes = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    judged = document_languages(spark, root).withColumn("code", F.coalesce(codes[label], codes[base], F.when(label.isin(*UNUSABLE), None).otherwise(label)))
    per_document = judged.groupBy("doc_id").agg(F.first("code").alias("code"), F.collect_set("lang").alias("langs"))
    wrong = F.col("code").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("code"))
    return per_document.where(wrong).select("doc_id", F.explode("langs").alias("lang"))
