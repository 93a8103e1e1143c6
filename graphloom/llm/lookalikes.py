"""One consistent form for texts that look the same.

Texts are exploded to positioned code points (a run of plain ASCII is one piece but for its last character); two small fixed tables, built by rule from the Unicode
character database, are broadcast-joined: the decomposition of each character (full-width, half-width,
ligature, no-break and font variants, and accents) with its look-alike letter, and the composed
character of each base with its marks. In between, combining marks are ordered by their class. Then the
strings are rebuilt. Characters that differ visibly (superscripts, fractions, circled digits) stay.

The form is a key for comparison: look-alike letters are Latin in it. ``in_own_letters`` writes it back in the script of
each word, so Russian and Greek texts come out whole. A starter takes its first three marks along into composition, further marks
stay behind it in their order, which is the same for every spelling of a cluster.

Only texts that can change at all are exploded: a text made of self-stable characters (each maps to
itself and none combines) is its own form, which the JVM decides by one lookup for each character. Distinct
texts are hashed once; the explosion, the joins, the ordering and the rebuilding all keep that
partitioning, so no code point is ever shuffled.

Defined cases: null stays null; blank texts are never a case; kinds of blanks become a space and kinds
of line ends a line feed; invisible characters (zero width, soft hyphen, byte order mark) vanish;
letter case, accents, digits and blank lines are kept; repeated rows count once.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.tables import cut_lineage, read_table

# Letters of other scripts with the Latin letter that looks the same: Cyrillic, Greek, Armenian, phonetic, Cherokee, Lisu.
LOOK_ALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮԌԚԜѴаеорсухѕіјһӏԁԛԝѵ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ" "ՏոսօցՕ" "ᴄᴏɡᴠᴡᴢᴜ" "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏙᏚᏞᏟᏢᏦᏴ" "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ",
        "ABESIJKMHOPCTYXYGQWVaeopcyxsijhldqwv" "ABEZHIKMNOPTYXovcj" "SnuogO" "cogvwzu" "DRTAJEWMHYGZVSLCPKB" "BPDTGKJCZFMNLSRVHWXYAEIOU",
    )
)
# Of the scripts that texts are written in, the letters behind those Latin letters.
_OWN = {"Cyrillic": ("АВЕЅІЈКМНОРСТУХаеорсухѕіј", "ABESIJKMHOPCTYXaeopcyxsij"), "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον", "ABEZHIKMNOPTYXov")}
_RANGES = {"Cyrillic": "\u0400-\u052f", "Greek": "\u0370-\u03ff\u1f00-\u1fff", "Latin": "A-Za-z\u00c0-\u024f\u1e00-\u1eff"}
_KEPT_TAGS = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>", "<compat> 0020", "<compat> 0028")
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
_BLANKS = r"[\t\x0B\f\x1C-\x1F   -   　]"
_LINE_ENDS = r"\r\n|[\r\u0085  ]"
_JOINERS = ("‍", "️")


def _decomposed(ch: str) -> str:
    """Full decomposition by the tags that do not show, base letters replaced by their look-alike."""
    d = unicodedata.decomposition(ch)
    if not d or d.startswith(_KEPT_TAGS):
        return LOOK_ALIKES.get(ch, ch)
    parts = d.split(" ")
    return "".join(_decomposed(chr(int(p, 16))) for p in parts if not p.startswith("<"))


@lru_cache(maxsize=1)
def character_tables() -> tuple[list[tuple[str, int, str, int]], list[tuple[str, str]], str]:
    """(rows of character, part number, part, combining class), (decomposed cluster, composed), changing characters."""
    parts, composed, changing = [], {}, []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if 0xD800 <= cp <= 0xDFFF or 0xE000 <= cp <= 0xF8FF or cp >= 0xF0000:
            continue
        if 0xAC00 <= cp <= 0xD7A3:
            continue  # Hangul syllables are composed and stable
        flat, ccc = _decomposed(ch), unicodedata.combining(ch)
        if ch in INVISIBLE:
            flat = ""
        elif flat.isspace() and not ch.isspace():
            flat = ch
        changed = unicodedata.normalize("NFC", flat) != ch
        if flat != ch or ccc:
            if not flat:
                parts.append((ch, 0, "", 0))
            for k, p in enumerate(flat):
                parts.append((ch, k, p, unicodedata.combining(p)))
        if changed or ccc:
            changing.append(cp)
        whole = unicodedata.normalize("NFC", flat)
        if len(whole) == 1 and len(flat) > 1:
            composed.setdefault(flat, whole)
    return parts, sorted(composed.items()), "".join(map(chr, changing))


def _plain_spaces(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _LINE_ENDS, "\n"), _BLANKS, " ")


def text_key(text: Column) -> Column:
    """What stands for a text in shuffles and joins (256 bits: no two texts share it)."""
    return F.unhex(F.sha2(text, 256))


def one_form(texts: DataFrame) -> DataFrame:
    """(key, form) of each distinct non-null ``text``."""
    spark = texts.sparkSession
    parts, composed, changing = character_tables()
    mapping = F.broadcast(spark.createDataFrame(parts, "ch string, part int, piece string, ccc int"))
    composition = F.broadcast(spark.createDataFrame(composed, "cluster string, whole string"))
    distinct = texts.where(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    foreign = F.regexp_replace("text", r"[\x00-\x7F]+", "")
    changes = F.col("text").rlike(r"[^\x00-\x7F]") & (F.length(F.translate(foreign, changing, "")) < F.length(foreign))
    # a text that cannot change is one piece; the empty piece before others stands for texts of invisible characters only
    # and so are plain characters up to the last one before another, which may have marks
    points = F.regexp_extract_all("text", F.lit(r"(?s)[\x00-\x7F]+(?=[\x00-\x7F])|."), F.lit(0))
    pieces = F.when(changes, F.concat(F.array(F.lit("")), points)).otherwise(F.array("text"))
    points = (
        distinct.select("key", F.posexplode(pieces).alias("pos", "ch"))
        .join(mapping, "ch", "left")
        .select("key", "pos", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("piece", "ch").alias("piece"), F.coalesce("ccc", F.lit(0)).alias("ccc"))
        .where((F.col("piece") != "") | (F.col("pos") == 0))
    )
    along = Window.partitionBy("key").orderBy("pos", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starter = F.max(F.when(F.col("ccc") == 0, F.struct("pos", "part"))).over(along)
    # marks behind their starter in order of their class: a starter takes its first three marks along, further
    # marks stay pieces of their own; leads and lags over the sorted rows, no group for each character
    ordered = Window.partitionBy("key").orderBy("starter", "ccc", "pos", "part")
    lead = lambda c, n: F.lead(c, n).over(ordered)
    lag = lambda n: F.coalesce(F.lag("ccc", n).over(ordered), F.lit(1))
    marks = [F.coalesce(lead("ccc", n), F.lit(0)) > 0 for n in (1, 2, 3)]
    cluster = F.concat("piece", F.when(marks[0], F.concat(lead("piece", 1), F.when(marks[1], F.concat(lead("piece", 2), F.when(marks[2], lead("piece", 3)).otherwise(""))).otherwise(""))).otherwise(""))
    taken = (F.col("ccc") > 0) & ((lag(1) == 0) | (lag(2) == 0) | (lag(3) == 0))
    clusters = (
        points.withColumn("starter", F.coalesce(starter, F.struct(F.lit(-1).alias("pos"), F.lit(-1).alias("part"))))
        .select("key", "starter", "ccc", "pos", "part", F.when(F.col("ccc") == 0, cluster).otherwise(F.col("piece")).alias("cluster"), taken.alias("taken"))
        .where(~F.col("taken"))
        .join(composition, "cluster", "left")
    )
    pieces = F.array_sort(F.collect_list(F.struct("starter", "ccc", "pos", "part", F.coalesce("whole", "cluster").alias("piece"))))
    return clusters.groupBy("key").agg(pieces.alias("pieces")).select("key", _plain_spaces(F.array_join(F.col("pieces")["piece"], "")).alias("form"))


@lru_cache(maxsize=None)
def _own_letters(script: str) -> tuple[str, str]:
    """(letters of the script, their Latin look-alikes), plain and with marks."""
    letters, latin = map(list, _OWN[script])
    for cp in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(cp))
        alike = unicodedata.normalize("NFC", "".join([LOOK_ALIKES.get(base, base), *marks]))
        if marks and base in _OWN[script][0] and len(alike) == 1 and alike not in latin:
            letters.append(chr(cp))
            latin.append(alike)
    return "".join(letters), "".join(latin)


def in_own_letters(form: Column) -> Column:
    """The form with its letters in the script of each word: a word with letters that only Cyrillic or Greek has is
    written in that script; a word of letters that look the same in all follows the script of most other letters of its text.
    It depends on the form alone, so equal forms stay equal."""
    shared = "".join(sorted({*_own_letters("Cyrillic")[1], *_own_letters("Greek")[1]}))
    count = {name: F.length(F.regexp_replace(form, f"[^{span}]|[{shared}]", "")) for name, span in _RANGES.items()}
    words = F.split(form, r"(?<=[^\p{L}\p{M}])(?=[\p{L}\p{M}])|(?<=[\p{L}\p{M}])(?=[^\p{L}\p{M}])")

    def own(word: Column) -> Column:
        out = F.lit(None).cast("string")
        latin_only = word.rlike(f"(?![{shared}])[{_RANGES['Latin']}]")
        for name, other in (("Greek", "Cyrillic"), ("Cyrillic", "Greek")):
            letters, latin = _own_letters(name)
            suits = ~word.rlike(f"[{_RANGES[other]}]") & ~latin_only & (word.rlike(f"[{_RANGES[name]}]") | (word.rlike(f"^[{latin}]+$") & (count[name] > count["Latin"]) & (count[name] >= count[other])))
            out = F.when(suits, F.translate(word, latin, letters)).otherwise(out)
        return F.coalesce(out, word)

    return F.when(form.rlike(f"[{_RANGES['Cyrillic']}{_RANGES['Greek']}]"), F.array_join(F.transform(words, own), "")).otherwise(form)


def catalog_texts(spark, root: str) -> DataFrame:
    sections, columns = read_table(spark, root, "functional_section"), read_table(spark, root, "physical_column")
    return sections.select(F.lit("functional_section").alias("table_name"), F.col("id").alias("record_id"), "text").unionByName(
        columns.select(F.lit("physical_column").alias("table_name"), F.col("id").alias("record_id"), F.col("description").alias("text"))
    )


def normalized(spark, root: str) -> DataFrame:
    """Each record with its text in the one form, in the letters of its own script, and the hash of the form for comparisons."""
    records = catalog_texts(spark, root)
    keys = records.select("table_name", "record_id", text_key(F.col("text")).alias("key")).distinct()
    forms = one_form(records).select("key", in_own_letters(F.col("form")).alias("text"), F.sha2("form", 256).alias("form_hash"))
    return keys.join(forms, "key", "left").select("table_name", "record_id", "text", "form_hash")


def look_alike_pairs(records: DataFrame) -> DataFrame:
    """Pairs of different ids of one table whose non-blank texts look the same and differ as strings.

    Strings are compared among themselves first: only forms that more than one string of a table has
    are joined, so a text shared by very many records meets its few variants, never itself.
    """
    texts = records.where(F.col("text").rlike(r"(?U)\S"))
    forms = one_form(texts).where(F.col("form").rlike(r"(?U)\S")).select("key", text_key(F.col("form")).alias("form"))
    members = texts.select("table_name", "record_id", text_key(F.col("text")).alias("key")).distinct()
    strings = cut_lineage(members.select("table_name", "key").distinct().join(forms, "key"))  # hashes only; read three times below
    shared = strings.groupBy("table_name", "form").agg(F.min("key").alias("low"), F.max("key").alias("high")).where(F.col("low") != F.col("high"))
    variants = strings.join(shared.select("table_name", "form"), ["table_name", "form"])
    other = variants.select("table_name", "form", F.col("key").alias("other"))
    pairs = variants.join(other, ["table_name", "form"]).where(F.col("key") < F.col("other")).select("table_name", "key", "other")
    left = pairs.join(members, ["table_name", "key"]).select("table_name", F.col("other").alias("key"), F.col("record_id").alias("one"))
    both = left.join(members, ["table_name", "key"]).where(F.col("one") != F.col("record_id"))
    return both.select("table_name", F.least("one", "record_id").alias("id_a"), F.greatest("one", "record_id").alias("id_b")).distinct()


def look_alike_classes(records: DataFrame) -> DataFrame:
    """(table_name, record_id, class_id, n_strings, n_records): the records whose non-blank text looks like that of another
    record and differs as a string, one row for each; members of a class of any size, without pairs."""
    texts = records.where(F.col("text").rlike(r"(?U)\S"))
    forms = one_form(texts).where(F.col("form").rlike(r"(?U)\S")).select("key", text_key(F.col("form")).alias("form"))
    members = texts.select("table_name", "record_id", text_key(F.col("text")).alias("key")).distinct()
    sized = members.groupBy("table_name", "key").agg(F.count(F.lit(1)).alias("n"))
    strings = cut_lineage(sized.join(forms, "key"))
    classes = strings.groupBy("table_name", "form").agg(F.count(F.lit(1)).alias("n_strings"), F.sum("n").alias("n_records")).where(F.col("n_strings") > 1)
    shared = strings.select("table_name", "key", "form").join(classes, ["table_name", "form"])
    return members.join(shared, ["table_name", "key"]).select("table_name", "record_id", F.lower(F.hex("form")).alias("class_id"), "n_strings", "n_records").distinct()


def classes(spark, root: str) -> DataFrame:
    return look_alike_classes(catalog_texts(spark, root))


def found(spark, root: str) -> DataFrame:
    return look_alike_pairs(catalog_texts(spark, root))
