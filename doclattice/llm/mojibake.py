"""Garbled text from wrong character encoding: find it, name the encoding chain, restore it.

A multinomial classifier on hashed byte bigrams learns from all clean lines of the table itself, the
words of which are counted, and each distinct one is garbled on purpose by every chain of ``CHAINS``,
in partitions; its class of genuine text is made of names in many languages from the JVM's locale
data and of words with look-alike letters. The counts are scaled to those of ``WEIGHT_LINES`` lines,
so that names and smoothing weigh the same at every size of the table. Per line, the words
that hold unusual characters are classified; the predicted chain is inverted and counts as verified
if every byte is strictly decodable and the outcome is likely text of the corpus. Text with lost
bytes can't be inverted: it counts where the classifier is sure and replacement or control
characters bear it out, and it stays as it is.

Defined results: null and empty fields make no case; null entries of ``warnings`` are skipped; a
table without clean lines trains on the locale names alone; whole texts are read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that all clean lines of a larger table weigh as much as, against the names and the smoothing.
WEIGHT_LINES = 600
#: Characters that one text of ``clean_sample`` gives.
MOST_CHARS = 20_000
BUCKETS = 1 << 14
#: Mean log probability of a restored character from which it is likely text of the corpus.
LIKELY = -9.0
#: Log odds by which a garbled class must exceed genuine text where bytes are lost.
SURE = 2.0

_SINGLE = ("cp1252", "latin-1", "mac_roman", "cp1251", "iso8859-15", "cp437", "koi8-r")
_DOUBLE = ("cp949", "cp932", "gbk", "big5", "euc_jp")
#: (true encoding, wrongly used encoding), once or twice in a row.
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    *((("utf-8", d),) for d in (*_SINGLE, *_DOUBLE)),
    *((("cp949", d),) for d in (*_SINGLE, *_DOUBLE[1:], "utf-8")),
    *((("utf-8", d),) * 2 for d in ("cp1252", "latin-1")),
    (("utf-16-le", "utf-16-be"),),
)

# Characters of ordinary text here: ASCII, Hangul, width forms, punctuation, spaces, list signs, boxes.
_USUAL = "\t\n\r\x20-\x7e\xa0\xad\xb2\xb3\xb7\xb9가-힣ᄀ-ᇿㄱ-ㆎ！-～ ᠎ -‧ -※ -⁰⁴-⁹←-↙①-⓿─-◿　-〟㈀-㋿￠-￦﻿"
_TO_BLANK = {ord("\t"): " ", ord("\r"): " "}
# Only plain blanks part words: a no-break space can be a byte of a garbled character.
_ODD_WORD = re.compile(f"[^ \t\n\r]*(?:[^{_USUAL}]|[a-z][가-힣]+[a-z])[^ \t\n\r]*")
_ODD = re.compile(f"[^{_USUAL}]|[a-z][가-힣]+[a-z]")
_UNUSUAL = re.compile(f"[^{_USUAL}]")
_LOST = re.compile("[�\x80-\x9f-]")


def _sloppy(codec: str) -> tuple[str, dict[str, int]]:
    """256 characters of a single-byte encoding, undefined bytes as control characters, and back."""
    chars = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256))
    return chars, {c: b for b, c in enumerate(chars)}


_TABLES = {c: _sloppy(c) for c in _SINGLE}


def _hangul_pairs(codec: str) -> dict[str, bytes]:
    """What the two bytes of each Hangul syllable are read as in another double-byte encoding, and back.

    The encoder of some encodings picks other bytes for a character that has two codes.
    """
    out: dict[str, bytes] = {}
    for lead in range(0xB0, 0xC9):
        for trail in range(0xA1, 0xFF):
            ch = bytes([lead, trail]).decode(codec, "ignore")
            if len(ch) == 1:
                out.setdefault(ch, bytes([lead, trail]))
    return out


_PAIRS = {c: _hangul_pairs(c) for c in _DOUBLE[1:]}


def garble(text: str, chain: tuple[tuple[str, str], ...], sloppy: bool = True) -> str:
    """The text as it is read when each step's encoding is taken for the wrong one."""
    for right, wrong in chain:
        data = text.encode(right, "replace")
        if wrong in _TABLES and sloppy:
            text = data.decode("latin-1").translate(_TABLES[wrong][0])
        else:
            text = data.decode(wrong, "replace")
    return text


def restore(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The original of a garbled text; None unless every byte is strictly decodable."""
    for right, wrong in reversed(chain):
        try:
            if wrong in _TABLES:
                back = _TABLES[wrong][1]
                data = bytes([back[c] for c in text])
            elif right == "cp949" and wrong in _PAIRS:
                pairs = _PAIRS[wrong]
                data = b"".join(pairs.get(c) or c.encode(wrong) for c in text)
            else:
                data = text.encode(wrong)
            text = data.decode(right)
        except (KeyError, UnicodeError):
            return None
    return text


def odd_words(line: str) -> str:
    """The words of a line that hold unusual characters."""
    return " ".join(_ODD_WORD.findall(line))


def bigrams(text: str) -> np.ndarray:
    """Hashed byte bigrams of a text."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    return ((b[:-1] * np.uint32(256) + b[1:]) * np.uint32(2654435761)) >> np.uint32(32 - 14)


class Model:
    """The multinomial classifier, and the characters of the corpus for what is likely."""

    def __init__(self, weights: np.ndarray, chars: dict[str, float], floor: float) -> None:
        self.weights, self.chars, self.floor = weights, chars, floor
        self.seen: dict[str, tuple[int | None, str | None]] = {}

    def likely(self, text: str) -> bool:
        odd = [c for c in text if c > "\x7f"]
        return bool(odd) and sum(self.chars.get(c, self.floor) for c in odd) / len(odd) > LIKELY and not _LOST.search(text)

    def judge(self, sample: str) -> tuple[int | None, str | None]:
        """(chain's number or None, restored sample or None) of a line's unusual words."""
        if sample in self.seen:
            return self.seen[sample]
        got = self._judge(sample)
        if len(self.seen) < 50_000:
            self.seen[sample] = got
        return got

    def _judge(self, sample: str) -> tuple[int | None, str | None]:
        ids = bigrams(sample)
        if not len(ids):
            return None, None
        scores = self.weights[ids].sum(axis=0)
        order = np.argsort(-scores)
        for k in order[:6]:
            if k < len(CHAINS) and "�" not in sample:
                back = restore(sample, CHAINS[k])
                if back is not None and len(back) < len(sample) + 1 and back != sample and self.likely(back) and not (back.isascii()):
                    if CHAINS[k][0][0] == "utf-8" or scores[k] > scores[-1]:
                        return int(k), back
        for word in sample.split(" ") if " " in sample or "�" in sample else ():
            for piece in word.split("�"):
                for k in order[:3]:
                    if len(piece) > 2 and k < len(CHAINS) and CHAINS[k][0][0] == "utf-8" and (back := restore(piece, CHAINS[k])) and len(back) < len(piece) and self.likely(back):
                        return int(k), None
        k = int(order[0])
        if k < len(CHAINS) and scores[k] > scores[-1] + SURE and _LOST.search(sample):
            return k, None
        if "�" in sample and k == len(CHAINS):
            k = int(order[1])
            return k, None
        return None, None

    def _word(self, word: str, chain: int) -> str:
        back = restore(word, CHAINS[chain])
        return back if back is not None and self.likely(back) else word

    def line(self, line: str) -> tuple[int | None, str | None]:
        """(chain, restored line) of one line."""
        sample = odd_words(line)
        if not sample:
            return None, None
        chain, back = self.judge(sample)
        if chain is None:
            return None, None
        if back is None:
            part = _ODD_WORD.sub(lambda m: self._word(m[0], chain), line)
            return chain, part if part != line else None
        whole = restore(line, CHAINS[chain])
        if whole is not None and self.likely(whole):
            return chain, whole
        return chain, _ODD_WORD.sub(lambda m: restore(m[0], CHAINS[chain]) or m[0], line)

    def garbled(self, text: str) -> bool:
        if not _ODD.search(text):
            return False
        return any(self.line(x)[0] is not None for x in text.split("\n") if _ODD.search(x))

    def repair(self, text: str) -> tuple[list[int], str]:
        """(chains found, text with what could be restored)."""
        if not _ODD.search(text):
            return [], text
        out, chains = [], set()
        for x in text.split("\n"):
            chain, back = self.line(x) if _ODD.search(x) else (None, None)
            if chain is not None:
                chains.add(chain)
            out.append(x if back is None else back)
        return sorted(chains), "\n".join(out)


def _genuine(spark: SparkSession) -> list[str]:
    """Names of countries and languages in many languages, from the JVM's locale data."""
    locale = spark._jvm.java.util.Locale
    to = ("fr", "pt", "es", "de", "ru", "el", "vi", "ja", "zh", "tr", "pl", "cs", "sv", "uk", "hu", "ro", "he", "ar", "th", "hi")
    codes = ("FR", "DE", "KR", "JP", "CN", "BR", "RU", "GR", "VN", "US", "GB", "IN", "TR", "MX", "EG", "CI", "SE", "CH", "UA", "SA", "CZ", "AT", "NO", "KP", "ZA")
    out = []
    for lang in to:
        target = locale.forLanguageTag(lang)
        for code in codes:
            name = locale.forLanguageTag(f"und-{code}").getDisplayCountry(target)
            out += [name, name.upper()]
    return [unicodedata.normalize("NFC", x) for x in out]


# Look-alike letters with which clean words are disguised for the class of genuine text.
_DISGUISE = str.maketrans("aeopcxyisjABEKMHOPCTX", "аеорсхуіѕјАВЕКМНОРСТХ")


def _weighed(texts: list[str], n: np.ndarray, out: np.ndarray) -> None:
    """Adds the bigrams of texts, each ``n`` times, to the counts; a blank stands around each, as between the words of a line."""
    sizes = np.array([len(t.encode("utf-8", "replace")) + 1 for t in texts], np.int64)
    if len(texts):
        # the bigram that ends a text's blank belongs to the next text, whose first byte it holds
        out += np.bincount(bigrams(" " + " ".join(texts) + " ")[: sizes.sum()], np.repeat(n, sizes), BUCKETS)


def garbled_words(words: list[str], chain: tuple[tuple[str, str], ...] | None) -> list[str]:
    """Each word garbled, or disguised without a chain; all at once where the ends of lines between them outlast the chain."""
    if not words:
        return []
    bad = (lambda x: garble(x, chain)) if chain else (lambda x: x.translate(_DISGUISE))
    out = bad("\n".join(words)).split(bad("\n"))
    if len(out) != len(words):
        return [*map(bad, words)]
    return out


_ASCII = "".join(map(chr, range(0x80)))
#: Whether a chain leaves plain characters as they are.
_KEEPS_ASCII = {chain: garble(_ASCII, chain) == _ASCII for chain in CHAINS}


def counted(words: list[str], n: Iterable[int]) -> np.ndarray:
    """Bigram counts of words that each occur ``n`` times: as garbled by each chain, and at last disguised.

    As in a line, a garbled word counts only if unusual characters are in it.
    """
    out = np.zeros((len(CHAINS) + 1, BUCKETS))
    every = np.asarray(n, np.float64)
    # plain words, which most chains leave as they are, have no unusual characters then either
    some = [j for j, w in enumerate(words) if not w.isascii() or _ODD.search(w)]
    fewer, of_fewer = [words[j] for j in some], every[some]
    for k, chain in enumerate((*CHAINS, None)):
        own, times = (fewer, of_fewer) if _KEEPS_ASCII.get(chain) else (words, every)
        texts = garbled_words(own, chain)
        odd = [j for j, t in enumerate(texts) if _ODD.search(t)]
        _weighed([texts[j] for j in odd], times[odd], out[k])
    return out


def model(counts: np.ndarray, chars: dict[str, float], n_lines: int, n_ascii: int, names: list[str]) -> Model:
    """The classifier from the bigram counts and characters of all clean lines, and genuine foreign names."""
    foreign = [n for n in names if _ODD.search(n)]
    scale = min(1.0, WEIGHT_LINES / max(n_lines, 1))
    out = counts.T * scale
    out[:, -1] /= 3  # disguised words are a third as many as lines
    for x in [*foreign, *(" ".join(foreign[k : k + 4]) for k in range(0, len(foreign), 3))]:
        out[:, -1] += np.bincount(bigrams(x), minlength=BUCKETS)
    # lines of plain characters look the same garbled; they count with a name and signs after them
    signs = [f"{x}’s “{foreign[-k % len(foreign)]}” — €4" for k, x in enumerate(foreign)]
    for k, chain in enumerate(CHAINS):
        for x in signs if n_ascii else ():
            bad = garble(x, chain)
            out[:, k] += np.bincount(bigrams(odd_words(bad) or bad), minlength=BUCKETS) * (n_ascii * scale / len(signs))
    weights = np.log(out + 0.05) - np.log((out + 0.05).sum(axis=0))
    own = Counter({c: n * scale for c, n in chars.items()}) + Counter(c for x in foreign for c in x if "\xa0" < c < "ɐ") + Counter("’“”—–…€·" * 3)
    total = sum(own.values()) or 1
    rare = 0.02  # a character never seen
    return Model(weights.astype(np.float32), {c: math.log(max(n, rare) / total) for c, n in own.items()}, math.log(rare / total))


def train(lines: list[str], names: list[str]) -> Model:
    """The classifier from clean lines and genuine foreign names."""
    words = Counter(w for x in lines for w in re.split("[ \t\r]+", x) if w)
    chars = Counter(c for x in lines for c in x if c > "\x7f")
    return model(counted(list(words), [*words.values()]), chars, len(lines), sum(x.isascii() for x in lines), names)


def clean_sample(results: DataFrame, n: int) -> list[str]:
    """Texts without unusual characters of about ``n`` results, by the hash of their ids.

    A long text gives a stretch of ``MOST_CHARS`` from a place that its hash tells. The hash is filtered before the order, so that each task sends few rows however many tasks there are.
    """
    cut_at = min(1_000_000, int(4_000_000 * n / max(results.count(), 1)) + 1)
    some = results.where(F.pmod(F.xxhash64("res_id"), F.lit(1_000_000)) < cut_at)
    h, size = F.xxhash64("res_id"), F.length("markdown")
    part = F.when(size > MOST_CHARS, F.substring("markdown", (F.pmod(h, size - MOST_CHARS) + 1).cast("int"), F.lit(MOST_CHARS))).otherwise(F.col("markdown"))
    clean = some.select(part.alias("markdown"), h.alias("h")).where(F.col("markdown").rlike(f"^[{_USUAL}]+$"))
    return [r.markdown for r in clean.orderBy("h").limit(n).collect()]


def clean(texts: pa.Array) -> list[str]:
    """The texts without unusual characters."""
    return [t for t in texts.to_pylist() if t and not _UNUSUAL.search(t)]


def words_of(results: DataFrame) -> DataFrame:
    """(w, n, lines, plain): how often each word stands in the lines of all clean texts, and in the rows of the empty word how many lines there are, and plain ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        n_lines = n_plain = 0

        def summed() -> pa.RecordBatch:
            words[""] = 0
            own = [*words]
            ends = [np.zeros(len(own), np.int64) for _ in range(2)]
            ends[0][own.index("")], ends[1][own.index("")] = n_lines, n_plain
            return pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([*words.values()], pa.int64()), *map(pa.array, ends)], names=["w", "n", "lines", "plain"])

        for b in batches:
            for t in clean(b.column(0)):
                lines = [x for x in t.translate(_TO_BLANK).split("\n") if len(x) > 3] if "\t" in t or "\r" in t else [x for x in t.split("\n") if len(x) > 3]
                n_lines += len(lines)
                n_plain += sum(map(str.isascii, lines))
                words.update(" ".join(lines).split(" "))
            if len(words) > 400_000:
                yield summed()
                words.clear()
                n_lines = n_plain = 0
        yield summed()

    each = results.where("markdown is not null").select("markdown").mapInArrow(run, "w string, n bigint, lines bigint, plain bigint")
    return each.groupBy("w").agg(*(F.sum(c).alias(c) for c in ("n", "lines", "plain")))


def learn(results: DataFrame) -> Model:
    """Trains on all clean texts: words are counted in partitions, each distinct one is garbled once; sums of a fixed number of counts reach the driver."""
    each = words_of(results)
    # places of the sums: bigram counts, then all lines, plain lines, and characters by their codes
    size = (len(CHAINS) + 1) * BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size + 2 + 0x110000)
        for b in batches:
            own, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            out[:size] += counted(own, n).ravel()
            out[size] += b.column(2).to_numpy().sum()
            out[size + 1] += b.column(3).to_numpy().sum()
            codes = np.frombuffer("".join(own).encode("utf-32-le", "replace"), np.uint32)
            out[size + 2 :] += np.bincount(codes, np.repeat(n, [len(w) for w in own]), 0x110000)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out[at].astype(np.int64))], names=["at", "n"])

    sums = each.mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 2 + 0x110000)
    out[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    chars = {chr(c): out[size + 2 + c] for c in np.flatnonzero(out[size + 2 :]) if c > 0x7F}
    return model(out[:size].reshape(-1, BUCKETS), chars, int(out[size]), int(out[size + 1]), _genuine(results.sparkSession))


def _apply(results: DataFrame, run, schema: str) -> DataFrame:
    model = results.sparkSession.sparkContext.broadcast(learn(results))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from run(model.value, zip(*(c.to_pylist() for c in b.columns), strict=True))

    return results.select("res_id", "markdown", "warnings").mapInArrow(go, schema)


def _batch(rows: list[tuple], types: Iterable[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def found(results: DataFrame) -> DataFrame:
    """(res_id, field_name) of every field with a garbled stretch. One narrow stage."""

    def run(model: Model, rows):
        out = []
        for rid, text, warnings in rows:
            if text and model.garbled(text):
                out.append((rid, "markdown"))
            if any(w and model.garbled(w) for w in warnings or ()):
                out.append((rid, "warnings"))
        yield from _batch(out, (pa.int64(), pa.string()), ["res_id", "field_name"])

    return _apply(results, run, "res_id bigint, field_name string")


def repaired(results: DataFrame) -> DataFrame:
    """(res_id, field_name, chains, restored): the affected fields, the chains found, and the text as far as it can be had."""

    def run(model: Model, rows):
        out = []
        for rid, text, warnings in rows:
            for name, value in (("markdown", text), ("warnings", "\n".join(w.replace("\n", " ") for w in warnings or () if w))):
                if value:
                    chains, back = model.repair(value)
                    if chains:
                        out.append((rid, name, ["+".join(f"{a}>{b}" for a, b in CHAINS[k]) for k in chains], back))
        yield from _batch(out, (pa.int64(), pa.string(), pa.list_(pa.string()), pa.string()), ["res_id", "field_name", "chains", "restored"])

    return _apply(results, run, "res_id bigint, field_name string, chains array<string>, restored string")
