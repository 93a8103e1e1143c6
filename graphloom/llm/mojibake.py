"""Finding and restoring text that was decoded with the wrong character encoding.

A chain is "written in A, read as B" (once or twice). The words with non-ASCII characters of clean texts (the labelled
``lang_samples``, all labelled documents and a few fixed phrases with typographic characters, also in upper case) are
garbled by every chain, and a multinomial classifier over hashed byte bigrams is trained on the result, with "clean" as one
more class. Its model is a matrix of fixed size (classes x ``BUCKETS``), which is broadcast.

Every chain garbles character by character, so it is enough to know how often two characters stand side by side in words of
a script that the same encodings can write. Spark counts these pairs, and what the model of clean text counts, over all rows
and whole texts; the driver gets one row for each pair of characters that occurs, and garbles characters instead of words.

Each text is judged in segments (sentences of a line), since often only a part is garbled, and by different chains.
The log-likelihoods of a segment are the sums over its words with non-ASCII characters, kept for each word, so a word
is classified once for each task. A segment whose likeliest class is "clean" stays. For others every chain likelier than
"clean" is inverted, the likeliest first, the evidence of the other segments of the record added, until one passes the
verification: the inverse must be strictly decodable, be read back as the same garbled text, and be more plausible
by a bigram model of clean characters. So a wrong prediction changes nothing. Text with replacement characters is
affected although its characters are lost; the rest of such a segment is kept.

One narrow map, no shuffle but the removal of repeated rows. Defined cases: null, empty and ASCII texts are
never affected; repeated rows count once; texts of any length are worked on segment by segment.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.lookalikes import INVISIBLE, LOOK_ALIKES
from graphloom.sources.tables import read_table, spread

BUCKETS = 1 << 13
#: How often a trusted text (samples and phrases) counts beside one of the labelled documents, and how many characters all of
#: these count for together where they have more, so that trusted texts weigh the same at every size.
TRUST, CHARACTERS = 25, 3_000_000
#: Mean log-probability of its non-ASCII characters below which a word is looked at.
SUSPECT = -7.0
#: What an inverted segment must reach, and gain for each character, when its original has one byte a character.
LIKELY, MARGIN = -6.0, 2.0
#: Gain that a one-byte chain must have over a whole record.
EVIDENCE = 9.0
#: Log-odds of a chain over "clean" from which it is tried, and from which one or two kana are enough for a Japanese original.
ODDS, SURE = 2.0, 6.0
#: Log-odds within which chains count as equally likely.
TIE = 4.0
#: Smoothing of the bigram counts, as a part of all counts of a class, so that an unseen bigram costs the same in every class.
SMOOTHING = 0.05

# Fixed values: (written in, read as), applied once.
_ONCE = [
    *(("utf-8", wrong) for wrong in ("cp1252", "latin-1", "cp850", "cp437", "mac_roman", "cp1251", "cp866", "koi8_r", "cp1250", "iso8859_15", "cp1253", "mac_cyrillic")),
    *(("cp1252", wrong) for wrong in ("mac_roman", "cp850", "cp437", "cp1250", "cp1251", "koi8_r", "cp1253", "iso8859_2", "cp866")),
    *(("mac_roman", wrong) for wrong in ("cp1252", "latin-1", "cp850")),
    *(("cp850", wrong) for wrong in ("cp1252", "latin-1", "mac_roman")),
    *(("cp437", wrong) for wrong in ("cp1252", "latin-1")),
    *(("cp1251", wrong) for wrong in ("cp1252", "latin-1", "koi8_r", "cp866", "mac_roman", "mac_cyrillic", "cp850", "cp437")),
    *(("koi8_r", wrong) for wrong in ("cp1251", "cp1252", "latin-1", "cp866")),
    *(("cp866", wrong) for wrong in ("cp1251", "cp1252", "latin-1", "koi8_r")),
    *(("cp932", wrong) for wrong in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251")),
    *(("euc_jp", wrong) for wrong in ("cp1252", "latin-1", "mac_roman")),
]
# Chains of two misreadings.
_TWICE = [(a, b, a, c) for a in ("utf-8",) for b in ("cp1252", "latin-1", "cp850", "mac_roman") for c in ("cp1252", "latin-1", "cp850", "mac_roman")]
CHAINS = [*_ONCE, *_TWICE]

_PHRASES = (
    "You’ll see the “open” items – they’re listed once… The user’s note — it’s ‘final’ — isn’t kept. “No”, he said (“yes”)… “Why?” “So!” [“a”] “b”] “c”< ‘d’, ’e. f’; “G: h”/ 5’ x’. y’? …and",
    "A café résumé costs €20 or £15 (naïve façade), 5 °C, § 4, ½ price, 3 × 4 µm, ±2 %, ¥100.",
    "« Bonjour », l’été d’où s’ouvre c’est n’est qu’il ; „Grüße“ ‚so‘ ¿Qué? ¡Así! nº 3 ª coração São João",
    "├── A-1\n│   └── B-2\n└── C-3\n• item · more » next ← back → on © 2024 ® ™ ✓ №",
    "例：（注）「完了」・保留？！ Примечание: «так» — № 5; Ё ё Ъ ъ É Ê ¿ ¡ Ñ ñ ê â ô û î ï ü ö ä ß ù ò ì",
    "Área Áreas Módulos Início Página Código Situação ATENÇÃO NÃO SÃO CONCILIAÇÃO É À Õ Ê Ç Í Ú Ó Â Ô",
)
_SEGMENT = re.compile(r"[^\n]*?(?:[.!?…]+[\"'”’»)]*(?=\s)|[。！？]|\n|$)\s*", re.S)
_SPLIT = re.compile(r"((?<=\s)(?=\S))")
_WIDE = ("utf-8", "cp932", "euc_jp")
_FOREIGN = re.compile(r"[^\x00-\x7f]")
_LOST = "�"


@lru_cache(maxsize=None)
def _table(encoding: str) -> tuple[str, object]:
    """The 256 characters of a one-byte encoding and its encoding map; bytes it leaves open read as the
    control of their number."""
    chars = [bytes([b]).decode(encoding, "replace") for b in range(256)]
    chars = "".join(chr(b) if c == _LOST else c for b, c in enumerate(chars))
    return chars, codecs.charmap_build(chars)


def _read(data: bytes, encoding: str) -> str:
    if encoding == "utf-8":
        return data.decode("utf-8")
    return codecs.charmap_decode(data, "strict", _table(encoding)[0])[0]


def _write(text: str, encoding: str) -> bytes | None:
    try:
        if encoding in _WIDE:
            return text.encode(encoding)
        return codecs.charmap_encode(text, "strict", _table(encoding)[1])[0]
    except UnicodeEncodeError:
        return None


def foreign_words(text: str) -> list[str]:
    """The words with non-ASCII characters."""
    return [] if text.isascii() else [w for w in text.split() if not w.isascii()]


def garble(text: str, chain: tuple[str, ...]) -> str | None:
    """``text`` as misread by the chain, None where a character can't be written."""
    for written, read in zip(chain[::2], chain[1::2]):
        data = _write(text, written)
        if data is None:
            return None
        text = _read(data, read)
    return text


def invert(text: str, chain: tuple[str, ...]) -> str | None:
    """The original behind a garbled text: strict at every step, None where the chain can't have made it."""
    garbled = text
    for read, written in zip(chain[::-1][::2], chain[::-1][1::2]):
        data = _write(text, read)
        if data is None:
            return None
        try:
            text = data.decode(written, "strict") if written in ("utf-8", "cp932", "euc_jp") else _read(data, written)
        except UnicodeDecodeError:
            return None
    return text if garble(text, chain) == garbled else None


def _bucket(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ((first * 256 + second) * 0x9E3779B1 >> 7) % BUCKETS


def _bigrams(word: str) -> np.ndarray:
    data = np.frombuffer((" " + word + " ").encode("utf-8", "replace"), dtype=np.uint8).astype(np.int64)
    return _bucket(data[:-1], data[1:])


_WIDE_FORMS = str.maketrans({chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | dict.fromkeys(INVISIBLE) | {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "\u212a": "K"})
_LATIN = str.maketrans(LOOK_ALIKES)
_MIXED = re.compile(r"(?=.*[A-Za-z])(?=.*[\u0370-\u052f])", re.S)


def _as_seen(word: str) -> str:
    """Look-alike, full-width, combining and invisible characters are another fault: a word is judged as it looks."""
    word = unicodedata.normalize("NFC", word.translate(_WIDE_FORMS))
    latin = word.translate(_LATIN)
    return (latin if latin.isascii() or _MIXED.search(word) else word).casefold()


def _kind(c: str) -> str:
    return "a" if c.isalpha() else "0" if c.isdigit() else c


#: Scripts of the original words; each class has a distribution for each.
SCRIPTS = (re.compile("[\u3041-\u9fff\uff65-\uff9f]"), re.compile("[\u0370-\u052f]"), re.compile(r"[^\W\d_\x00-\x7f]"), re.compile(""))


def _script(word: str) -> int:
    return next(k for k, script in enumerate(SCRIPTS) if script.search(word))


#: What is counted in training texts: pairs of characters within words that are to be garbled (four for a word, one for it
#: in upper case), characters, pairs with a non-ASCII character.
GARBLED, SINGLE, BESIDE = range(3)
_WRITTEN = sorted({chain[0] for chain in CHAINS} - {"utf-8"})
_CODE = 21
_KNOWN = 1 << 15
_FACTS = np.zeros(0x110000, dtype=np.uint16)


def _facts(codes: np.ndarray) -> np.ndarray:
    """For each character ``_KNOWN``, its script and a bit for each of ``_WRITTEN`` that can write it."""
    facts = _FACTS[codes]
    if not facts.all():
        for code in np.unique(codes[facts == 0]).tolist():
            _FACTS[code] = _KNOWN | _script(chr(code)) << len(_WRITTEN) | sum((_write(chr(code), e) is not None) << k for k, e in enumerate(_WRITTEN))
        facts = _FACTS[codes]
    return facts


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)


def _word_pairs(words: list[str]) -> np.ndarray:
    """A key for each two characters side by side in the words, blanks around them: script of the word, encodings that write it, the two."""
    codes = _codes(f" {' '.join(words)} ")
    blank = codes == 32
    starts = np.flatnonzero(blank)[:-1]
    facts = _facts(codes)
    every = (1 << len(_WRITTEN)) - 1
    written = np.bitwise_and.reduceat(np.where(blank, every, facts & every), starts)
    script = np.minimum.reduceat((facts & ~np.uint16(_KNOWN)) >> len(_WRITTEN), starts)  # a blank has the last
    word = np.repeat((script.astype(np.int64) << len(_WRITTEN) | written) << 2 * _CODE, np.diff(np.append(starts, len(codes) - 1)))
    return word | codes[:-1] << _CODE | codes[1:]


class Tally:
    """Counts of ``GARBLED``, ``SINGLE`` and ``BESIDE`` over texts of any number and length."""

    AT_ONCE, ROWS = 1 << 20, 1 << 21

    def __init__(self):
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], [], []]

    def _add(self, kind: int, keys: np.ndarray, n: np.ndarray) -> None:
        held = self.held[kind]
        held.append((keys, n))
        if sum(len(k) for k, _ in held[1:]) > max(self.ROWS, len(held[0][0])):
            held[:] = [self.of(kind)]

    def of(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, counts) of a kind, in the order of the keys."""
        keys, n = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (zip(*self.held[kind]) if self.held[kind] else ((), ())))
        keys, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(keys), dtype=np.int64)
        np.add.at(total, at, n)
        return keys, total

    def add(self, texts: Iterable[str]) -> Tally:
        words: list[str] = []
        folded: list[str] = []
        n_words = n_folded = 0
        for text in texts:
            split = text.split()
            for word in split if not text.isascii() else ():
                if not word.isascii():
                    words.append(word)
                    n_words += len(word)
                    if n_words >= self.AT_ONCE:
                        self._add_words(words)
                        words, n_words = [], 0
            folded.append(" ".join(["", *split, ""]).casefold() if split else "  ")
            n_folded += len(folded[-1])
            if n_folded >= self.AT_ONCE:
                self._add_folded("".join(folded))
                folded, n_folded = [], 0
        self._add_words(words)
        self._add_folded("".join(folded))
        return self

    def _add_words(self, words: list[str]) -> None:
        for found, n in ((words, 4), ([w for w in map(str.upper, words) if not w.isascii()], 1)):
            if found:
                keys, counts = np.unique(_word_pairs(found), return_counts=True)
                self._add(GARBLED, keys, n * counts)

    def _add_folded(self, text: str) -> None:
        for start in range(0, len(text), self.AT_ONCE):
            codes = _codes(text[start : start + self.AT_ONCE + 1])
            single = np.bincount(codes[: self.AT_ONCE])
            self._add(SINGLE, np.flatnonzero(single), single[single > 0])
            foreign = codes > 0x7F
            at = np.flatnonzero(foreign[:-1] | foreign[1:])
            keys, counts = np.unique(codes[at] << _CODE | codes[at + 1], return_counts=True)
            self._add(BESIDE, keys, counts)


class Weighed:
    """Tallies with the weights of their texts: keys and weights of each kind."""

    def __init__(self, *tallies: tuple[Tally, float]):
        self.kinds = []
        for kind in (GARBLED, SINGLE, BESIDE):
            found = [tally.of(kind) for tally, _ in tallies]
            keys = np.concatenate([keys for keys, _ in found])
            self.kinds.append((keys, np.concatenate([n * weight for (_, n), (_, weight) in zip(found, tallies)])))

    def of(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        return self.kinds[kind]


def _garbled_counts(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(scripts, chains + 1, BUCKETS) counts of the byte bigrams of the garbled words, blanks around each part of a word."""
    script, written = keys >> 2 * _CODE + len(_WRITTEN), keys >> 2 * _CODE
    characters, at = np.unique(np.concatenate([keys >> _CODE, keys]) & (1 << _CODE) - 1, return_inverse=True)
    left, right = at[: len(keys)], at[len(keys) :]
    texts = [chr(c) for c in characters.tolist()]
    counts = np.zeros((len(SCRIPTS), len(CHAINS) + 1, BUCKETS))
    for k, chain in enumerate([*CHAINS, ()]):
        can = chain[:1] in ((), ("utf-8",))
        weight = weights if can else weights * (written >> _WRITTEN.index(chain[0]) & 1)
        bad = ["?" if x is None else x if x.isprintable() else "".join(" " if c.isspace() else c for c in x) for x in (garble(c, chain) for c in texts)]
        data = [x.encode("utf-8", "replace") for x in bad]
        flat = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum([len(x) for x in data])
        owner = np.repeat(np.arange(len(data)), [len(x) for x in data])
        first, last = flat[ends - [len(x) for x in data]], flat[ends - 1]
        inner = np.flatnonzero((owner[:-1] == owner[1:]) & ((flat[:-1] != 32) | (flat[1:] != 32)))
        within = _bucket(flat[inner], flat[inner + 1])
        often = np.bincount(script * len(texts) + left, weight, len(SCRIPTS) * len(texts)).reshape(len(SCRIPTS), -1)
        between = np.where((last[left] != 32) | (first[right] != 32), weight, 0.0)
        counts[:, k] = np.bincount(script * BUCKETS + _bucket(last[left], first[right]), between, len(SCRIPTS) * BUCKETS).reshape(len(SCRIPTS), -1)
        for row, n in zip(counts[:, k], often):
            row += np.bincount(within, n[owner[inner]], BUCKETS)
    return counts


class CleanModel:
    """How plausible the non-ASCII characters of clean text are, each between its neighbours."""

    LETTERS = tuple((*range(0xDF, 0xF7), *range(0xF8, 0x100), 0x153, *range(0x430, 0x450), 0x451, *range(0x3041, 0x3097), *range(0x30A1, 0x30FB), 0x30FC, 0x3001, 0x3002))

    def __init__(self, texts: Weighed):
        single: Counter = Counter({chr(c): 0.3 for c in self.LETTERS})
        left, right, before = Counter(), Counter(), Counter()
        for code, n in zip(*(x.tolist() for x in texts.of(SINGLE))):
            c = chr(code)
            before[c] += n
            before[_kind(c), ] += n
            if c > "\x7f":
                single[c] += n
        for key, n in zip(*(x.tolist() for x in texts.of(BESIDE))):
            l, r = chr(key >> _CODE), chr(key & (1 << _CODE) - 1)
            if r > "\x7f":
                left[l if r.isalpha() else _kind(l), r] += n
            if l > "\x7f":
                right[l, r if l.isalpha() else _kind(r)] += n
        after = before
        self.total = sum(n for c, n in before.items() if isinstance(c, str))
        self.single, self.left, self.right, self.before, self.after = (dict(x) for x in (single, left, right, before, after))
        self.known: dict[tuple[str, bool], tuple[float, int]] = {}

    def _character(self, l: str, c: str, r: str) -> float:
        if "\u3041" <= c <= "\u9fff" or "\uff65" <= c <= "\uff9f":
            return max(log(self.single.get(c, 0.1) / self.total), -6.5)  # thousands of letters: too many for the training texts
        p = self.single.get(c, 0.002) / self.total
        if c.isalpha():
            one, two = self.before.get(l, 0), self.after.get(r, 0)
        else:  # a sign stands by kinds of neighbours, not by single letters
            l, r = _kind(l), _kind(r)
            one, two = self.before.get((l,), 0), self.after.get((r,), 0)
            if (l, c) in self.left and (c, r) in self.right:
                return max(log(p), -6.5)
        one = (self.left.get((l, c), 0) + 2 * p) / (one + 2)
        two = (self.right.get((c, r), 0) + 2 * p) / (two + 2)
        return max(log(one), log(two), log(p) - 2.0)

    def word(self, word: str, stored: bool = True) -> tuple[float, int]:
        """(sum of log-probabilities, number) of its non-ASCII characters; a stored word is judged as it looks."""
        found = self.known.get((word, stored))
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            text = " " + (_as_seen(word) if stored else word.casefold()) + " "
            values = [self._character(l, c, r) for l, c, r in zip(text, text[1:], text[2:]) if c > "\x7f"]
            if len(word) < 4 and not any(map(str.isalnum, word)):
                values = []  # bullets, arrows and drawings stand alone in clean text, too
            found = (sum(values), len(values))
            if len(word) < 64:
                self.known[word, stored] = found
        return found

    def mean(self, words: list[str], stored: bool = True) -> float:
        total, n = 0.0, 0
        for w in words:
            a, b = self.word(w, stored)
            total += a
            n += b
        return total / n if n else 0.0


class _Segment:
    """What is known of a segment: its words with non-ASCII characters, those without lost ones and what they can gain at most;
    on demand their scores, the suspicious ones and what came of inverting chains."""

    __slots__ = ("foreign", "words", "bound", "scores", "bad", "tried")

    def __init__(self, text: str, judge: ChainClassifier):
        self.foreign = foreign_words(text)
        self.words = [w for w in self.foreign if _LOST not in w]
        self.bound = judge.bound(self.words)
        self.scores: np.ndarray | None = None
        self.bad: set[str] | None = None
        self.tried: dict[tuple[int, bool], tuple[str, float]] = {}


class ChainClassifier:
    """Multinomial naive Bayes over ``CHAINS`` and "clean" (the last class), with the model of clean text that verifies its predictions."""

    def __init__(self, weights: np.ndarray, model: CleanModel):
        self.weights = weights  # (scripts, chains + 1, BUCKETS) log-probabilities
        self.model = model
        self.rows = np.ascontiguousarray(weights.reshape(-1, BUCKETS).T)  # what a bigram adds stands together
        self.known: dict[str, np.ndarray] = {}
        self.most: dict[str, float] = {}
        self.clean: set[str] = set()
        self.segments: dict[str, _Segment] = {}

    @classmethod
    def train(cls, samples: list[str], more_clean: list[str] = ()) -> ChainClassifier:
        """Trained on ``samples``, each counting ``TRUST`` times, and ``more_clean``."""
        return cls.of(Tally().add(dict.fromkeys([*samples, *_PHRASES])), Tally().add(more_clean))

    @classmethod
    def of(cls, trusted: Tally, more_clean: Tally) -> ChainClassifier:
        texts = Weighed((trusted, TRUST), (more_clean, min(1.0, CHARACTERS / max(1, more_clean.of(SINGLE)[1].sum()))))
        keys, weights = texts.of(GARBLED)
        counts = _garbled_counts(keys, weights / 4)
        counts += SMOOTHING * np.maximum(1.0, counts.sum(axis=2, keepdims=True)) / BUCKETS
        return cls(np.log(counts / counts.sum(axis=2, keepdims=True)).astype(np.float32), CleanModel(texts))

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-odds of every chain over "clean"; a word counts as of the script that suits it best."""
        total = np.zeros(len(CHAINS), dtype=np.float32)
        for word in words:
            found = self.known.get(word)
            if found is None:
                if len(self.known) > 100_000:
                    self.known.clear()
                likely = self.rows[_bigrams(word)].sum(axis=0).reshape(len(SCRIPTS), -1).max(axis=0)
                found = self.known[word] = likely[:-1] - likely[-1]
            total = total + found
        return total

    def bound(self, words: Iterable[str]) -> float:
        """At least the greatest log-odds any chain can have for the words together or any part of them."""
        total = 0.0
        for word in words:
            most = self.most.get(word)
            if most is None:
                if len(self.most) > 200_000:
                    self.most.clear()
                most = self.most[word] = max(0.0, float(self.scores([word]).max()))
            total += most
        return total

    def _clean(self, text: str) -> bool:
        """Whether no word of the text speaks for any chain."""
        for word in set(text.split()).difference(self.clean):
            if not word.isascii() and _LOST not in word:
                if self.bound((word,)) > 0:
                    return False
                if len(self.clean) > 200_000:
                    self.clean.clear()
                self.clean.add(word)
        return True

    def suspicious(self, words: list[str]) -> list[str]:
        return [w for w, (total, n) in zip(words, map(self.model.word, words)) if total < SUSPECT * n]

    def _segment(self, text: str) -> _Segment:
        """What is known of a segment; segments of usual length met last are kept, for menus and sentences recur."""
        found = self.segments.get(text)
        if found is None:
            found = _Segment(text, self)
            if len(text) < 512:
                if len(self.segments) >= 20_000:
                    self.segments.clear()
                self.segments[text] = found
        return found

    def attempt(self, segment: str, chain: tuple[str, ...], sure: bool = False) -> tuple[str, float]:
        """(the segment with ``chain`` inverted where that is plausible, gain of plausibility): as a whole
        or, where it was garbled in part only, by its blank-separated parts."""
        whole = self._inverted(segment, chain, sure)
        if whole is not None:
            return whole
        known = self._segment(segment)
        if known.bad is None:
            known.bad = set(self.suspicious(known.foreign))
        bad = known.bad
        if not bad:
            return segment, 0.0
        out, total = [], 0.0
        for part in _SPLIT.split(segment):
            fixed, gain = (self._inverted(part, chain, sure) if part.rstrip() in bad else None) or (part, 0.0)
            out.append(fixed)
            total += gain
        return "".join(out), total

    def _inverted(self, segment: str, chain: tuple[str, ...], sure: bool) -> tuple[str, float] | None:
        text = invert(segment, chain)
        if text is None or text == segment or _IMPLAUSIBLE.search(text) or (_BETWEEN.search(text) and not _BETWEEN.search(segment)):
            return None
        if chain[0] in ("cp932", "euc_jp") and len(_KANA.findall(text)) < (1 if sure else 3):
            return None
        words = foreign_words(segment)
        before, after = self.model.mean(words), self.model.mean(foreign_words(text), stored=False)
        wide = chain[0] in _WIDE
        if not wide and not sure:  # one character for each: those that stand alone as signs now are not plausible by that
            n, m = (sum(self.model.word(w, stored)[1] for w in ws) for ws, stored in ((words, True), (foreign_words(text), False)))
            after = (after * m + SUSPECT * (n - m)) / n if n > m else after
        # a multi-byte original that decodes strictly is evidence by itself
        need, floor = (0.3, LIKELY - 2.5) if wide else (MARGIN, LIKELY - 2.5 if sure else LIKELY)
        if after - before < need or after < floor:
            return None
        return text, (after - before) * sum(self.model.word(w)[1] for w in words)

    def restore(self, text: str) -> tuple[str, list[str], bool]:
        """(restored text, the inverted chains, whether characters are lost for good)."""
        lost = _LOST in text
        if self._clean(text) or self.bound(w for w in foreign_words(text) if _LOST not in w) <= ODDS:
            return text, [], lost
        segments = _SEGMENT.findall(text)
        known = {k: self._segment(x) for k, x in enumerate(segments) if not x.isascii()}
        if all(x.bound <= ODDS for x in known.values()):
            return text, [], lost
        for x in known.values():
            if x.scores is None:
                x.scores = self.scores(x.words)
        scores = {k: x.scores for k, x in known.items() if x.words}
        odds = {k: score for k, score in scores.items() if score.max() > ODDS}
        if not odds:
            return text, [], lost
        support = sum(np.maximum(score, 0.0) for score in odds.values())

        def attempt(k: int, c: int) -> tuple[str, float]:
            tried, sure = known[k].tried, bool(scores[k][c] >= SURE)
            if (c, sure) not in tried:
                tried[c, sure] = self.attempt(segments[k], CHAINS[c], sure)
            return tried[c, sure]

        heads = set()
        for k, score in odds.items():
            rank = score + support
            order = np.argsort(-rank, kind="stable")
            order = order[score[order] > ODDS].tolist()
            first = next((c for c in order if attempt(k, c)[1] > 0), None)
            if first is not None and not any(rank[c] >= rank[first] - TIE and attempt(k, c)[1] > 0.9 * attempt(k, first)[1] for c in heads):
                # among chains that are as likely, the more plausible text
                heads.add(max((c for c in order if abs(rank[c] - rank[first]) <= TIE), key=lambda c: attempt(k, c)[1]))
        # a one-byte chain always decodes: it needs more evidence from the whole record
        gains = {c: sum(attempt(k, c)[1] for k in odds if odds[k][c] > 0) for c in heads}
        good = [c for c in sorted(heads) if gains[c] >= (EVIDENCE / 4 if CHAINS[c][0] in _WIDE else EVIDENCE)]
        chains, out = [], []
        for k, segment in enumerate(segments):
            if good and k in scores and (scores[k].max() > 0 or self.suspicious(known[k].words)):
                for c in sorted(good, key=lambda c: -(scores[k][c] + support[c])):
                    if attempt(k, c)[1] > 0:
                        segment = attempt(k, c)[0]
                        chains.append("<-".join(CHAINS[c]))
                        break
            out.append(segment)
        return "".join(out), list(dict.fromkeys(chains)), lost


_KANA = re.compile(r"[\u3041-\u30ff]")
#: Letters of two scripts side by side.
_BETWEEN = re.compile("[A-Za-zÀ-ɏ][Ͱ-ԯ]|[Ͱ-ԯ][A-Za-zÀ-ɏ]")
_IMPLAUSIBLE = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f-�]")


def _tallied(texts: DataFrame) -> DataFrame:
    """(trusted, kind, key, n): the tally of ``texts`` (trusted, text), one row for each key."""
    def run(batches):
        tallies = {True: Tally(), False: Tally()}
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for trusted, tally in tallies.items():
                tally.add(text for own, text in rows if own is trusted)
        for trusted, tally in tallies.items():
            for kind in range(len(tally.held)):
                keys, n = tally.of(kind)
                for start in range(0, len(keys), 100_000):
                    part = slice(start, start + 100_000)
                    columns = [np.full(len(keys[part]), trusted), np.full(len(keys[part]), kind, dtype=np.int32), keys[part], n[part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["trusted", "kind", "key", "n"])

    tallied = texts.select("trusted", "text").mapInArrow(run, "trusted boolean, kind int, key bigint, n bigint")
    return tallied.groupBy("trusted", "kind", "key").agg(F.sum("n").alias("n"))


def trained_classifier(spark, root: str) -> ChainClassifier:
    """Trained on all ``lang_samples`` and all labelled documents with non-ASCII characters."""
    samples = read_table(spark, root, "lang_samples").select("text").where(F.col("text").isNotNull()).distinct()
    documents = read_table(spark, root, "documents").where(F.col("lang").isNotNull() & F.col("text").rlike(r"[^\x00-\x7F]"))
    texts = samples.select(F.lit(True).alias("trusted"), "text").unionByName(spread(documents.select(F.lit(False).alias("trusted"), "text")))
    counted = _tallied(texts).toArrow()
    trusted, kind, key, n = (c.to_numpy() for c in counted.columns)
    tallies = Tally().add(_PHRASES), Tally()
    for k in range(len(tallies[0].held)):
        for tally, own in zip(tallies, (trusted, ~trusted)):
            tally.held[k].append((key[own & (kind == k)], n[own & (kind == k)]))
    return ChainClassifier.of(*tallies)


def restore_column(df: DataFrame, classifier: ChainClassifier) -> DataFrame:
    """``df`` (table_name, record_id, text) with restored text, the chains and whether characters are lost;
    only affected rows come out."""
    shared = df.sparkSession.sparkContext.broadcast((classifier.weights, classifier.model))

    def run(batches):
        judge = ChainClassifier(*shared.value)
        for batch in batches:
            rows = ([], [], [], [], [])
            for name, record, text in zip(*(c.to_pylist() for c in batch.columns)):
                fixed, chains, lost = judge.restore(text)
                if chains or lost:
                    for column, value in zip(rows, (name, record, fixed, list(dict.fromkeys(chains)), lost)):
                        column.append(value)
            types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(rows, types)], names=["table_name", "record_id", "text", "chains", "lost"])

    candidates = df.select("table_name", "record_id", "text").where(F.col("text").rlike(r"[^\x00-\x7F]")).dropDuplicates(["table_name", "record_id", "text"])
    return candidates.mapInArrow(run, "table_name string, record_id string, text string, chains array<string>, lost boolean")


def catalog_texts(spark, root: str) -> DataFrame:
    sections, entities = read_table(spark, root, "functional_section"), read_table(spark, root, "entity_aliases")
    return sections.select(F.lit("functional_section").alias("table_name"), F.col("id").alias("record_id"), "text").unionByName(
        entities.select(F.lit("entity_aliases").alias("table_name"), F.col("entity_id").alias("record_id"), F.col("description").alias("text"))
    )


def restored(spark, root: str) -> DataFrame:
    """The affected records with the original text as far as it can be restored."""
    return restore_column(catalog_texts(spark, root), trained_classifier(spark, root))


def found(spark, root: str) -> DataFrame:
    return restored(spark, root).select("table_name", "record_id").distinct()
