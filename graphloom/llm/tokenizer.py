"""Encoding of a whole corpus by a public byte-level BPE tokenizer.

Method: the distinct words of a batch form a trie. It is walked depth first; every node keeps only the
last token of the encoding of its prefix. The encoding of a prefix follows from those of its ancestors:
of all tokens that end the prefix, exactly one forms a valid neighbour pair with the last token of the
prefix before it. So a prefix shared by many words is encoded once. Words of earlier batches of the
task are kept (up to ``MEMORY`` words, then the trie starts anew), and the documents are assembled from
word numbers with array operations.

The operator is one narrow map: no shuffle, no row leaves its task. The vocabulary has a fixed size
(about 50,000 tokens, below 1 MB), is read by the driver and broadcast.

Defined cases: null and empty text give an empty list; text is taken as stored; special tokens are
never produced; the text of a special token is ordinary text. Repeated rows are each encoded.
"""

from __future__ import annotations

import base64
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.arrow import gather_ranges, list_array
from graphloom.sources.tables import spread

MEMORY = 400_000
#: Environment variable with the folder of the tokenizer files, for clusters where the driver lacks the package.
DIR_VARIABLE = "GRAPHLOOM_TOKENIZER_DIR"


def vocabulary(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> tuple[bytes, str]:
    """The content of a rank file and the pattern that cuts text into words."""
    import public_tokenizers

    folder = folder or os.environ.get(DIR_VARIABLE)
    path = os.path.join(folder, name) if folder else public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read(), public_tokenizers.PATTERN


class TrieEncoder:
    """Encodes sets of words; ``ranks`` maps the bytes of a token to its id, in order of the merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}

    def merge(self, word: bytes) -> list[int]:
        """Plain byte pair encoding: joins the neighbours of the lowest rank, leftmost first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def reachable(self, token: int) -> bool:
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merge(self.tokens[token]) == [token]
        return known

    def valid(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand side by side in an encoding."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def encode_all(self, words: list[bytes]) -> list[list[int]]:
        """The encodings of ``words``. Sorted order is the depth-first order of their trie: what a word
        shares with the one before it is still on the path, with the last token of each prefix."""
        out: list[list[int]] = [[]] * len(words)
        ranks, longest = self.ranks, self.longest
        path: list[int] = [-1]  # last token of each prefix, by its length
        before = b""
        for k in sorted(range(len(words)), key=words.__getitem__):
            word = words[k]
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                last = -1
                for start in range(max(0, end - longest), end):
                    token = ranks.get(word[start:end])
                    if token is not None and self.reachable(token) and (start == 0 or self.valid(path[start], token)):
                        last = token
                        break
                path.append(last)
            before = word
            ids, end = [], len(word)
            while end:
                ids.append(path[end])
                end -= len(self.tokens[path[end]])
            ids.reverse()
            out[k] = ids
        return out


@lru_cache(maxsize=2)
def _encoder(content: bytes) -> TrieEncoder:
    return TrieEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if b})


class CorpusEncoder:
    """Encodes documents batch by batch, sharing words between batches."""

    def __init__(self, content: bytes, pattern: str):
        import regex

        self.trie = _encoder(content)
        self.words = regex.compile(pattern).findall
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.starts, self.sizes = array("i"), array("q"), array("q")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat token ids, number of tokens of each text)."""
        if len(self.number) > MEMORY:
            self._reset()
        number, known = self.number, len(self.number)
        seen, counts = array("q"), np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                words = self.words(text)
                counts[i] = len(words)
                seen.extend([number.setdefault(w, len(number)) for w in words])
        fresh = list(number)[known:]
        for ids in self.trie.encode_all([w.encode("utf-8", "replace") for w in fresh]):
            self.starts.append(len(self.flat))
            self.sizes.append(len(ids))
            self.flat.extend(ids)
        at = np.frombuffer(seen, dtype=np.int64) if seen else np.zeros(0, np.int64)
        starts = np.array(self.starts, dtype=np.int64)[at]
        sizes = np.array(self.sizes, dtype=np.int64)[at]
        flat = np.array(self.flat, dtype=np.int32)[gather_ranges(starts, sizes)]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        return flat, edges[ends] - edges[ends - counts]


def _blocks(batch: pa.RecordBatch, characters: int = 8_000_000):
    """Slices of a batch with a bounded amount of text each (one text at least)."""
    sizes = np.fromiter((len(t) if t else 0 for t in batch.column(1).to_pylist()), dtype=np.int64, count=batch.num_rows)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total + n > characters and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(id, ids ARRAY<INT>) of each row."""
    content, pattern = vocabulary(name, folder)
    shared = df.sparkSession.sparkContext.broadcast((content, pattern))

    def run(batches):
        encoder = CorpusEncoder(*shared.value)
        for batch in batches:
            for block in _blocks(batch):
                flat, sizes = encoder.encode(block.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([block.column(0), list_array(flat, sizes, pa.int32())], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(id, n_tokens INT) of each row, by the same encoder."""
    content, pattern = vocabulary(name, folder)
    shared = df.sparkSession.sparkContext.broadcast((content, pattern))

    def run(batches):
        encoder = CorpusEncoder(*shared.value)
        for batch in batches:
            for block in _blocks(batch):
                _, sizes = encoder.encode(block.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(sizes, type=pa.int32())], names=[id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens int")
