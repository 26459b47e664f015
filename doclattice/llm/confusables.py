"""Visually identical text with different characters: confusables skeletons.

Skeleton: decompose canonically, replace every character by its prototype from the look-alike
table, decompose again; here the skeleton is then composed once more, so that the consistent form
is readable and plain Hangul stays short. Two texts look the same exactly if their forms are equal.

The table holds only differences that a reader cannot see: width, invisible characters, spaces,
hyphens of one shape, letters of other scripts drawn alike, ligatures, compatibility ideographs.
Superscripts, circled numbers, letter case, 1/l/I and 0/O stay apart.

Defined results: null and empty texts have no form and are in no class; equal copies share a class
and make no pair; extra columns of the input are not carried.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.session import cut

# Letters of other scripts that are drawn as the Latin letter beside them.
ALIKE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ԍ": "G", "Ѵ": "V",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "օ": "o", "µ": "μ", "‐": "-", "‑": "-",
    " ": "\n", " ": "\n",
}
#: Ranges whose compatibility decomposition looks as the character itself: Latin ligatures, Roman numerals, Kangxi radicals.
SAME_SHAPE = ((0xFB00, 0xFB06), (0x2160, 0x217F), (0x2F00, 0x2FD5))
#: Format characters that are drawn (Arabic number signs and the like) or that turn the direction of text.
DRAWN = frozenset({*range(0x600, 0x606), 0x6DD, 0x70F, 0x8E2, 0x202D, 0x202E, 0x110BD, 0x110CD})
#: Characters without a shape beside those of category Cf.
SHAPELESS = frozenset({0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180F), *range(0xFE00, 0xFE10)})

#: Texts made of these alone are their own form.
_PLAIN = re.compile("[^\t\n\x20-\x7e가-힣一-鿿]")


@cache
def table() -> dict[str, str]:
    """Prototype of each character that has another one, by rule and by ``ALIKE``; decomposing is folded in."""
    out: dict[int, str] = {ord(a): b for a, b in ALIKE.items()}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cp in out or cat in ("Cn", "Cs", "Co"):
            continue
        if cp in SHAPELESS or cat == "Cf" and cp not in DRAWN:
            out[cp] = ""
        elif cat == "Zs":
            out[cp] = " "
        else:
            kind, *parts = unicodedata.decomposition(ch).split() or [""]
            if kind in ("<wide>", "<narrow>"):
                one = chr(int(parts[0], 16))
                out[cp] = out.get(ord(one), one)
            elif kind == "<compat>" and any(a <= cp <= b for a, b in SAME_SHAPE):
                out[cp] = "".join(chr(int(x, 16)) for x in parts)
    for cp in range(0x80, sys.maxunicode + 1):  # composed characters whose parts have prototypes
        if cp not in out and not 0xAC00 <= cp <= 0xD7A3:
            parts = unicodedata.normalize("NFD", chr(cp))
            if len(parts) > 1 and (to := parts.translate(out)) != parts:
                out[cp] = to
    return {chr(cp): to for cp, to in out.items()}  # type: ignore[misc]


def form(text: str) -> str:
    """The one consistent form of a text."""
    if _PLAIN.search(text):
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        for ch in table().keys() & set(text):
            text = text.replace(ch, table()[ch])
        text = unicodedata.normalize("NFC", text)
    if " \n" in text:
        text = re.sub(" +\n", "\n", text)
    return text.rstrip(" \n")


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([_digest(form(t)) for t in texts], pa.binary()), pa.array([_digest(t) for t in texts], pa.binary())],
            names=["res_id", "look", "raw"],
        )


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        forms = [form(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms, pa.string()), pa.array([_digest(t) for t in forms], pa.binary())], names=["res_id", "form", "look"])


def _texts(results: DataFrame) -> DataFrame:
    return results.where("markdown is not null and markdown <> ''").select("res_id", "markdown")


def consistent(results: DataFrame) -> DataFrame:
    """(res_id, form, look): each result's markdown in its consistent form, and the form's digest. No shuffle."""
    return _texts(results).mapInArrow(_forms, "res_id bigint, form string, look binary")


def keys(results: DataFrame) -> DataFrame:
    """(res_id, look, raw): digests of the form and of the text itself; 40 bytes a row leave the scan."""
    return _texts(results).mapInArrow(_keys, "res_id bigint, look binary, raw binary")


def spellings(keyed: DataFrame) -> DataFrame:
    """(look, raw, lo, n): one row for each spelling of each class, with its smallest id and its copies; partial aggregation collapses equal copies before the shuffle."""
    return keyed.groupBy("look", "raw").agg(F.min("res_id").alias("lo"), F.count("*").alias("n"))


def classes(results: DataFrame) -> DataFrame:
    """One row per result: its class (the smallest id that looks the same), the class's size and number of spellings.

    Partial aggregation bounds what a hot class sends; the classes join back by digest.
    """
    k = cut(keys(results))
    of = spellings(k).groupBy("look").agg(F.min("lo").alias("class_id"), F.sum("n").alias("n_members"), F.count("*").alias("n_spellings"))
    return k.join(of, "look").select("res_id", "class_id", "n_members", "n_spellings")


def pairs(results: DataFrame) -> DataFrame:
    """(res_lo, res_hi): results that look the same and are not equal, all of them, as the query's definition asks.

    Pairs of spellings are found among collapsed copies; only members of classes with two spellings
    or more meet them, by spelling, so that no pair of equal copies is ever formed. Where a spelling
    is hot, AQE splits the join. ``classes`` tells the same in one row per result.
    """
    k = cut(keys(results).dropDuplicates(["res_id", "raw"]))
    groups = spellings(k)
    many = groups.groupBy("look").agg(F.count("*").alias("n")).where("n > 1").select("look")
    own = groups.join(many, "look", "left_semi").select("look", "raw")
    both = own.withColumnRenamed("raw", "raw_a").join(own.withColumnRenamed("raw", "raw_b"), "look").where("raw_a < raw_b").select("raw_a", "raw_b")
    left, right = (k.select(F.col("raw").alias(f"raw_{x}"), F.col("res_id").alias(f"res_{x}")) for x in "ab")
    met = both.join(left, "raw_a").join(right, "raw_b")
    return met.select(F.least("res_a", "res_b").alias("res_lo"), F.greatest("res_a", "res_b").alias("res_hi")).where("res_lo < res_hi")


