"""Noise in text from scanned pages: cut words, misread characters, running lines; and its repair.

Word counts come from the insides of all lines of all results; every word is counted, at every size.
A rare word is linked to frequent ones that plausible glyph edits lead to: words are brought together
by a key that no edit changes, and each distinct word is linked once. Skip-gram vectors with negative
sampling are learned in partitions for a fixed number of context words; against these, every word
that something is linked to, and every other word that stands beside a linked one, gets its vector
from its co-occurrences in all results. A second scan takes out the places where a linked word or a
broken line may be a flaw; they meet the counts, links and vectors in joins, and the link that fits
the vectors of all words around best is the correction.
At last page furniture is removed, cut words are joined and broken lines are reflowed into paragraphs.

To the driver, and to the tasks by broadcast, come the context words, their vectors and filters of a
fixed number of bits; whatever grows with the table stays in tables. A filter lets some words pass
in vain, the joins behind it are exact.

Defined results: null and empty texts have no flaw and stay as they are; codes and names that no
frequent word resembles stay; lists and tables keep their lines; whole texts are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.llm.confusables import form
from doclattice.session import cut

#: Number of the most frequent words whose vectors are trained; all others get theirs from these.
CONTEXTS = 2_048
DIMENSIONS, WINDOW, NEGATIVE = 32, 3, 4
#: Rounds in which the context vectors are trained, passes over the pairs in each, and partitions whose vectors are averaged after it.
ROUNDS, EPOCHS, SHARDS = 4, 12, 8
#: How many times as frequent a word is as the rare word linked to it; a word never seen inside a line counts as half a one.
RATIO = 15
#: How many times as frequent a whole word is as the rarer of two that a line's end without hyphen may have made of it.
SOFT_RATIO = 50
#: Characters and sets of them that are taken for another: most edits that a word may need.
MOST_EDITS = 3
#: Mean log odds of a context below which a correction is refused.
CONTEXT = -3.5
#: Contexts of words that are solved side by side: places for them, those that are left empty too.
MOST_SOLVED = 8_192
#: Bits of a filter of words.
FILTER_BITS = 1 << 24

# What a character recogniser writes, and what stood on the page.
LATIN_GLYPHS = {
    "rn": "m", "ri": "n", "r!": "n", "vv": "w", "cl": "d", "ii": "u", "1": "l", "!": "i", "|": "l", "0": "o", "O": "o", "I": "l", "9": "g", "5": "s",
    "6": "b", "8": "B", "f": "t", "c": "e", "b": "h", "h": "b", "m": "rn", "e": "c", "t": "f",
}
HANGUL_GLYPHS = {
    "0l": "이", "Ol": "이", "01": "이", "0|": "이", "7l": "기", "71": "기", "7|": "기", "7ㅏ": "가", "A;": "소", "A|": "시", "Al": "시", "ㅅ|": "시", "ㄱㅏ": "가", "ㄷㅏ": "다", "ㅇㅣ": "이", "^": "ㅅ",
}
# Parts of a syllable that look alike, as sets.
ALIKE_FIRST = ("ㄱㅋ", "ㄱㅍ", "ㄷㅌ", "ㄹㅌ", "ㅈㅊ", "ㅇㅎ")
ALIKE_VOWEL = ("ㅏㅣ", "ㅏㅑ", "ㅓㅣ", "ㅓㅕ", "ㅐㅔ", "ㅔㅖ", "ㅐㅒ", "ㅗㅛ", "ㅡㅗ", "ㅜㅠ", "ㅢㅚ", "ㅝㅟ")
ALIKE_LAST = ("ㅇㅁ", "ㄱㅋ")
# Syllables that look alike as wholes, whatever consonant closes them.
ALIKE_WHOLE = ("파과", "퍄과", "머대")

_FIRSTS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
_VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
_LASTS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"

_EDGE = "\"'`“”‘’()[]{}<>.,:*_~#…·"
_CUT = re.compile(r"(?<![^\s|│])([^\s|│]*[A-Za-zÀ-ɏ가-힣])[-¬] ?\n([A-Za-zÀ-ɏ가-힣][^\s|│]*)")
_ANY_CUT = re.compile(r"[A-Za-zÀ-ɏ가-힣][-¬] ?\n[A-Za-zÀ-ɏ가-힣]")
_SOFT_CUT = re.compile(r"(?<=[ \n])([^\W\d_]+)\n([^\W\d_]+)(?=[ .,\n])")
_NUMBER = r"[0-9OolI]{1,4}"
_PAGE = re.compile(rf"^\s*(?:[-—–~]\s*{_NUMBER}\s*[-—–~]|(?:[Pp]age|PAGE|p\.|쪽|페이지)\s*{_NUMBER}(?:\s*(?:of|/)\s*{_NUMBER})?|\[\s*{_NUMBER}\s*\]|제\s*{_NUMBER}\s*(?:쪽|페이지|면)|{_NUMBER}\s*(?:쪽|페이지)?|{_NUMBER}\s*/\s*{_NUMBER}(?:\s*(?:쪽|페이지))?)\s*$")
_PAGE_TAIL = re.compile(rf"(?:^\s*{_NUMBER}\s+|\s*[-—–|·/\[(]*\s*{_NUMBER}\s*[\])]?\s*$)")
_LISTED = re.compile(r"^\s*(?:[|│┌├└+#>]|[-*•○●·□■]\s|[(]?(?:[0-9]{1,3}|[가-하]|[a-z])[.)]\s|[①-⓿]|```)")
_ENDS = re.compile(r"[.!?。][\"'”’)\]]*$")
_HEADING = re.compile(r"^(?:# .*|[-] (?:원본 형식|변환기): .*|## 페이지 [0-9]+|### [0-9]+쪽 OCR 결과.*|```.*)$")
#: What every heading begins with.
_HEADS = "#-`"
_WORDS = re.compile(r"\S+")
#: Blanks that part words for Python's ``split``, beside space and line end; words are parted at those of ``_BLANKS`` alone.
_OTHER_BLANK = re.compile(r"[^\S \n]")
_BLANKS = re.compile("[ \t\v\f\r]+")
#: Texts with words that only joining or the consistent form brings about hold one of these.
_FORMED = re.compile("[-¬] ?\n|[^\t\n\x20-\x7e가-힣]")
_GAPS = re.compile(r"\S {2,}\S.* {2,}\S|\.{5,}")
_SENTENCE_END = re.compile(r"[.!?](?: |$)")


def _similar(ch: str) -> list[str]:
    """Syllables that differ in one part that looks alike, or look alike as wholes."""
    code = ord(ch) - 0xAC00
    if not 0 <= code < 11172:
        return []
    a, b, c = code // 588, code // 28 % 21, code % 28
    out = []
    for groups, parts, at, unit in ((ALIKE_FIRST, _FIRSTS, a, 588), (ALIKE_VOWEL, _VOWELS, b, 28), (ALIKE_LAST, _LASTS, c, 1)):
        for g in groups:
            if parts[at] in g:
                out += [chr(ord(ch) + (parts.index(x) - at) * unit) for x in g if x != parts[at]]
    for g in ALIKE_WHOLE:
        if chr(ord(ch) - c) in g:
            out += [chr(ord(x) + c) for x in g if ord(x) != ord(ch) - c]
    return out


_SIMILAR: dict[str, list[str]] = {}


def _edits(word: str) -> list[tuple[int, int, str]]:
    """(from, to, what stood there) of each plausible glyph edit of a word."""
    hangul = any("가" <= c <= "힣" for c in word)
    out = []
    for glyphs in (HANGUL_GLYPHS,) if hangul else (LATIN_GLYPHS, HANGUL_GLYPHS):
        for seen, true in glyphs.items():
            at = word.find(seen)
            while at >= 0:
                out.append((at, at + len(seen), true))
                at = word.find(seen, at + 1)
    if hangul:
        for k, ch in enumerate(word):
            if "가" <= ch <= "힣":
                alike = _SIMILAR.get(ch)
                if alike is None:
                    alike = _SIMILAR[ch] = _similar(ch)
                out += [(k, k + 1, x) for x in alike]
    return sorted(out)


_PARTS = {"first": {"ㄱㅋㅍ": "7", "ㄷㅌㄹㅁ": "T", "ㅈㅊ": "J", "ㅇㅎ": "o", "ㅅ": "A"}, "vowel": {"ㅏㅑㅓㅕㅣㅐㅒㅔㅖㅘ": "l", "ㅡㅗㅛ": ";", "ㅜㅠ": "U", "ㅢㅚ": "Y", "ㅝㅟ": "W"}, "last": {"ㅇㅁ": "ㅇ", "ㄱㅋ": "ㄱ", " ": ""}}
_FIRST_KEY, _VOWEL_KEY, _LAST_KEY = ({c: k for group, k in _PARTS[part].items() for c in group} for part in ("first", "vowel", "last"))
_KEYS = str.maketrans({
    "m": "rri", "n": "ri", "w": "vv", "d": "cl", "e": "c", "u": "ii", "h": "b", "f": "t", "!": "i", "1": "l", "|": "l", "I": "l", "0": "o", "O": "o", "9": "g", "5": "s", "6": "b", "8": "B",
    "^": "A", "ㅅ": "A", "ㄱ": "7", "ㄷ": "T", "ㅇ": "o", "ㅏ": "l", "ㅣ": "l",
} | {
    chr(0xAC00 + (a * 21 + b) * 28 + c): _FIRST_KEY.get(x, x) + _VOWEL_KEY.get(y, y) + _LAST_KEY.get(z, z)
    for a, x in enumerate(_FIRSTS) for b, y in enumerate(_VOWELS) for c, z in enumerate(_LASTS)
})


def key(word: str) -> str:
    """A spelling that no glyph edit changes, character by character: linked words have the same."""
    return word.translate(_KEYS)


def candidates(word: str, known: dict[str, int], floor: float) -> list[str]:
    """Known words of at least the floor's count that plausible edits lead to, by the least number of edits.

    The search goes from the known words, which share the word's key, so that its length doesn't matter.
    """
    edits, out = _edits(word), []
    if not edits:
        return []
    most = min(MOST_EDITS, max(1, len(word) // 2))
    reached: dict[str, int] = {}
    for true, n in known.items():
        if n >= floor and true != word and (steps := _steps(word, true, edits, most)):
            reached[true] = steps
    least = min(reached.values(), default=0)
    out = [w for w, k in reached.items() if k == least]
    return out


def _steps(word: str, true: str, edits: list[tuple[int, int, str]], most: int) -> int:
    """The least number of edits, side by side, that make the one word of the other; 0 if more than ``most`` or none do."""
    by_start: dict[int, list[tuple[int, str]]] = {}
    for a, b, x in edits:
        by_start.setdefault(a, []).append((b, x))
    level = {(0, 0): 0}  # (place in the word, place in the true word): edits so far
    best = most + 1
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        k = level[i, j]
        if i == len(word) and j == len(true):
            best = min(best, k)
            continue
        after = [(i + 1, j + 1, k)] if i < len(word) and j < len(true) and word[i] == true[j] else []
        after += [(b, j + len(x), k + 1) for b, x in by_start.get(i, ()) if k < most and true.startswith(x, j)]
        for i2, j2, k2 in after:
            if k2 < level.get((i2, j2), most + 1):
                level[i2, j2] = k2
                todo.append((i2, j2))
    return best if 0 < best <= most else 0


class Kept(dict):
    """What a function gives for each argument, kept for so many at a time; what is kept is looked up without a call."""

    def __init__(self, of: Callable, most: int = 200_000) -> None:
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, x):
        if len(self) >= self.most:
            self.clear()
        got = self[x] = self.of(x)
        return got


def _bare(word: str) -> str:
    """A word without the signs around it; signs of a table's frame are none."""
    return "" if word in ("|", "│") else word.strip(_EDGE)


_BARE = Kept(_bare)


class Words:
    """A filter of words: of those that were put in none is missed, of others a few pass."""

    def __init__(self, bits: bytes | bytearray) -> None:
        self.bits, self.seen = bits, {}

    def __contains__(self, word: str) -> bool:
        got = self.seen.get(word)
        if got is None:
            at = zlib.crc32(word.encode("utf-8", "replace")) % FILTER_BITS
            if len(self.seen) >= 200_000:
                self.seen.clear()
            got = self.seen[word] = bool(self.bits[at >> 3] >> (at & 7) & 1)
        return got

    def __getstate__(self):
        return self.bits

    def __setstate__(self, bits) -> None:
        self.bits, self.seen = bits, {}


def words_of(df: DataFrame, word: str = "word") -> Words:
    """The filter of a column's words; bitmaps are built in the JVM, ``FILTER_BITS`` reach the driver whatever the table's size."""
    at = F.pmod(F.crc32(F.col(word).cast("binary")), F.lit(FILTER_BITS)) + 1
    rows = df.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    bits = bytearray(FILTER_BITS // 8)
    for r in rows:
        bits[(r.k - 1) * 4096 : r.k * 4096] = r.bits
    return Words(bits)


def worth(word: str) -> bool:
    """Whether a word may be misread: not a number, a code, a name with a number or a lone sign."""
    if len(word) < 3 and (word.isascii() and word not in HANGUL_GLYPHS or len(word) < 2):
        return False
    digits = sum(c.isdigit() for c in word)
    if word.isascii():
        return digits <= 3 and 2 * digits < len(word)
    return not word[-1].isdigit() and digits <= 3


class Places:
    """Takes out of a text the places where a flaw may be."""

    def __init__(self, linked: Words, common: Words, index: dict[str, int]) -> None:
        self.linked, self.common, self.index = linked, common, index
        self.asked = Kept(lambda w: w in linked and worth(w))

    def __reduce__(self):
        return Places, (self.linked, self.common, self.index)

    def of(self, text: str) -> Iterator[tuple[str, int, str, str, str, list[int], list[str]]]:
        """(kind, number, whole word, left, right, contexts, other words around): a running line; two ends of lines; the number-th occurrence of a linked word."""
        text = form(text)
        lines = text.split("\n")
        gone = furniture(lines)
        if gone:
            yield "running_line", 0, "", "", "", [], []
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone and not _heading(x)) if gone else text
        if _ANY_CUT.search(kept):
            for k, m in enumerate(_CUT.finditer(kept)):
                a, b = m[1].strip(_EDGE), m[2].strip(_EDGE)
                yield "cut", k, a + b, a, b, [], []
        for k, (a, b) in enumerate(self._soft(kept.split("\n"))):
            yield "soft", k, a + b, a, b, [], []
        times: dict[str, int] = {}
        asked = self.asked
        for words in rows_of(kept):
            for k in [k for k, w in enumerate(words) if asked[w]]:
                word = words[k]
                times[word] = times.get(word, -1) + 1
                around = (*words[max(0, k - WINDOW) : k], *words[k + 1 : k + 1 + WINDOW])
                near = [at for w in around if (at := self.index.get(w)) is not None]
                yield "word", times[word], word, "", "", near, [w for w in around if w not in self.index]

    def _soft(self, lines: list[str]) -> Iterator[tuple[str, str]]:
        """Ends of lines without hyphen that together may be one word."""
        for a, b in zip(lines, lines[1:], strict=False):
            if a and b and a[-1].isalpha() and b[0].isalpha():
                left, right = a.rpartition(" ")[2], b.partition(" ")[0].rstrip(".,")
                if left.isalpha() and right.isalpha() and len(left + right) > 2 and left + right in self.common:
                    yield left, right


def _heading(line: str) -> bool:
    return line[:1] in _HEADS and _HEADING.match(line) is not None


def joined(text: str, apart: frozenset[tuple[str, str]] = frozenset()) -> str:
    """The text with its hyphenated ends of lines joined, but for those that stay apart."""
    if not _ANY_CUT.search(text):
        return text
    return _CUT.sub(lambda m: m[0] if (m[1].strip(_EDGE), m[2].strip(_EDGE)) in apart else m[1] + m[2], text)


def rows_of(text: str) -> Iterator[list[str]]:
    """Words of each paragraph, cut words joined."""
    for block in joined(text).split("\n\n"):
        words = [w for line in block.split("\n") if not _heading(line) for w in map(_BARE.__getitem__, line.split()) if w]
        if words:
            yield words


def furniture(lines: list[str]) -> set[int]:
    """Positions of page numbers and of page headers that come back, in running text."""
    body = [k for k, x in enumerate(lines) if x.strip() and not _heading(x)]
    if not any(_SENTENCE_END.search(lines[k]) for k in body):
        return set()
    listed = sum(1 for k in body if "\t" in (x := lines[k]) or _LISTED.match(x) or ("  " in x or "....." in x) and _GAPS.search(x))
    if listed > 0.5 * len(body):
        return set()
    out = {k for k in body if _PAGE.match(lines[k])}
    title = next((x for x in lines if x.startswith("# ")), "# ")[2:]
    parts = [re.sub(r"[\W_]+", "", p).casefold() for p in re.split(r"[_ ]", re.sub(r"(_[0-9]+)?\.\w+$", "", title))]
    name, genre = "".join(parts), parts[-1]
    groups: dict[str, list[int]] = {}
    for k in body:
        x = lines[k].strip()
        if k in out or len(x) > 90 or _ENDS.search(x) or _LISTED.match(x):
            continue
        bare = _PAGE_TAIL.sub("", x).strip(" ·-—|") if re.search(r"(?:^[0-9OlI]+ | [0-9OlI]+$|[\])]$|[-—] ?[0-9]+)", x) else x
        key = re.sub(r"[\W_]+", "", bare).casefold()
        if len(key) >= 3:
            groups.setdefault(key, []).append(k)
    for key, at in groups.items():
        if len(at) < 2:
            continue
        words = _PAGE_TAIL.sub("", lines[at[0]]).split()
        titled = name and (key == name or len(genre) > 1 and key.endswith(genre) and key[:3] == name[:3])
        letters = [w for w in words if any(c.isalpha() for c in w)]
        latin = [w for w in letters if w.isascii()]
        noun = len(letters) >= 2 and (all(w[0].isupper() for w in latin) if len(latin) == len(letters) else not any(re.search(r"(?:을|를|은|는|의|에|에서|으로|와|과|고|다|며|여|한|된|할|까지|게|이)$", w) for w in letters))
        if titled or noun and len(at) >= 2:
            out.update(at)
    return out


def repair(text: str, apart: frozenset[tuple[str, str]], soft: frozenset[tuple[str, str]], fixes: dict[tuple[str, int], str]) -> str:
    """Continuous paragraphs: furniture gone, cut words joined, misread words corrected, lines reflowed.

    ``fixes`` has the correction of the number-th occurrence of a word, counted as ``Places`` does.
    """
    lines = form(text).split("\n")
    gone = furniture(lines)
    text = joined("\n".join(x for k, x in enumerate(lines) if k not in gone), apart)
    times: dict[str, int] = {}
    watched = {w for w, _ in fixes}

    def corrected(line: str) -> str:
        if _HEADING.match(line):
            return line
        out, at = [], 0
        for m in _WORDS.finditer(line):
            bare = m[0].strip(_EDGE)
            if bare in watched:
                times[bare] = times.get(bare, -1) + 1
                if (new := fixes.get((bare, times[bare]))) is not None:
                    out += [line[at : m.start()], m[0].replace(bare, new, 1)]
                    at = m.end()
        return "".join([*out, line[at:]])

    if watched:
        text = "\n".join(map(corrected, text.split("\n")))
    if soft:
        text = _SOFT_CUT.sub(lambda m: m[1] + m[2] if (m[1], m[2]) in soft else m[0], text)
    blocks = []
    for block in re.split(r"\n\s*\n", text):
        if not any(_LISTED.match(x) or _HEADING.match(x) or "\t" in x for x in block.split("\n")):
            block = re.sub(r" *\n *", " ", block)
        blocks.append(block)
    return "\n\n".join(blocks)


def vocabulary(results: DataFrame) -> DataFrame:
    """(word, n) of all words: n over the insides of all lines, as first and last words of lines may be halves of cut words.

    Words that only joining or the consistent form brings about count 0. One scan; words are counted as they stand, so that only distinct ones are stripped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter[str] = Counter()
        ends: set[str] = set()
        more: set[str] = set()

        def summed() -> pa.RecordBatch:
            own: Counter[str] = Counter(dict.fromkeys(more, 0) | dict.fromkeys((w.strip(_EDGE) for w in ends), 0))
            for w, n in raw.items():
                own[w.strip(_EDGE)] += n
            return pa.RecordBatch.from_arrays([pa.array([*own], pa.string()), pa.array([*own.values()], pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                other = _OTHER_BLANK.search(t)
                parted = map(str.split, t.split("\n")) if not other else (_BLANKS.split(x.strip(" ")) for x in t.split("\n"))
                inside: list[str] = []
                for words in parted:
                    inside += words[1:-1]
                    ends.update(words[:1], words[-1:])
                raw.update(inside)
                if _FORMED.search(t):
                    if (f := form(t)) != t:
                        # where only blanks at the end are gone, all words but joined ones are counted already
                        if other or f != t.rstrip(" \n") or _ANY_CUT.search(f):
                            more.update(*rows_of(f))
                    else:
                        more.update(m[1].strip(_EDGE) + m[2].strip(_EDGE) for m in _CUT.finditer(t))
            if len(raw) + len(ends) + len(more) > 400_000:
                yield summed()
                for kept in raw, ends, more:
                    kept.clear()
        yield summed()

    each = results.where("markdown is not null").select("markdown").mapInArrow(run, "word string, n bigint")
    return each.where(F.col("word").rlike(r"[\p{L}]")).groupBy("word").agg(F.sum("n").alias("n"))


def links(counted: DataFrame) -> DataFrame:
    """(word, links: array of (w, n)) of every word that plausible edits lead from to words frequent enough; words meet by their keys, so at every size."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([key(w) for w in b.column(0).to_pylist()], pa.string()), b.column(0), b.column(1)], names=["key", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("w", pa.string()), ("n", pa.int64())]))
        for b in batches:
            rows = []
            for words in b.column(0).to_pylist():
                known = {r["word"]: r["n"] for r in words}
                most = max(known.values())
                for w, n in known.items():
                    floor = RATIO * max(n, 0.5)
                    if most >= floor and worth(w) and (got := candidates(w, known, floor)):
                        rows.append((w, [{"w": x, "n": known[x]} for x in got]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([x for _, x in rows], kind)], names=["word", "links"])

    each = counted.select("word", "n").mapInArrow(keyed, "key string, word string, n bigint")
    together = each.groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("words"), F.max("n").alias("most")).where((F.size("words") > 1) & (F.col("most") >= RATIO / 2))
    return together.select("words").mapInArrow(run, "word string, links array<struct<w:string,n:bigint>>")


def co_occurrences(results: DataFrame, index: dict[str, int], targets: Words) -> DataFrame:
    """(word, context, n): how often each context word and each target stands within the window of a context, over all results."""
    shared = results.sparkSession.sparkContext.broadcast((index, targets))
    k = len(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, wanted = shared.value
        names = list(contexts)
        at: dict[str, int] = dict(contexts)

        def number(word: str) -> int:
            w = word.strip(_EDGE)
            got = at.get(w)
            if got is None:
                got = at[w] = len(names) if w in wanted else -1
                if got >= 0:
                    names.append(w)
            return got

        numbers = Kept(number, 1 << 62)
        fresh: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate([np.zeros(0, np.int64), *fresh]), return_counts=True)
            own = pa.array(names, pa.string()).take(pa.array(pair // k))
            return pa.RecordBatch.from_arrays([own, pa.array(pair % k, pa.int32()), pa.array(n, pa.int64())], names=["word", "context", "n"])

        for b in batches:
            ids: list[int] = []
            for t in b.column(0).to_pylist():
                ids += map(numbers.__getitem__, t.split())
                ids += [-1] * WINDOW
            x = np.array(ids, np.int64)
            for d in range(1, WINDOW + 1):
                a, c = x[:-d], x[d:]
                for centre, around in ((a, c), (c, a)):
                    ok = (centre >= 0) & (around >= 0) & (around < k)
                    fresh.append(centre[ok] * k + around[ok])
            if sum(map(len, fresh)) > 2_000_000 or len(numbers) > 300_000:
                yield summed()
                fresh.clear()
                numbers.clear()
                names, at = list(contexts), dict(contexts)
        yield summed()

    rows = results.where("markdown is not null").select("markdown").mapInArrow(run, "word string, context int, n bigint")
    return rows.groupBy("word", "context").agg(F.sum("n").alias("n"))


def _descend(x: np.ndarray, y: np.ndarray, n: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Skip-gram with negative sampling on the pairs of some centres; moves the vectors in place.

    The negative samples are taken in expectation: every context weighs as often as it would be drawn.
    """
    own, row = np.unique(x, return_inverse=True)
    good = np.zeros((len(own), len(v)), np.float32)
    good[row, y] = n**0.75
    noise = good.sum(axis=0) ** 0.75
    bad = NEGATIVE * good.sum(axis=1, keepdims=True) * (noise / noise.sum())
    gain_u, gain_v = np.full((len(own), 1), 1e-3, np.float32), np.full((len(v), 1), 1e-3, np.float32)
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-np.clip(u[own] @ v.T, -30, 30)))
        g = good * (1 - p) - bad * p
        to_u, to_v = g @ v, g.T @ u[own]
        # steps are scaled by what each word has moved so far, so that frequent words don't run away
        gain_u += (to_u**2).mean(axis=1, keepdims=True)
        gain_v += (to_v**2).mean(axis=1, keepdims=True)
        u[own] += 0.3 * to_u / np.sqrt(gain_u)
        v += 0.3 * to_v / np.sqrt(gain_v)


def skip_gram(pairs: DataFrame, index: dict[str, int], seed: int = 11) -> np.ndarray:
    """Vectors of the context words, trained in ``SHARDS`` partitions that are averaged after each round.

    Pairs of contexts alone take part: at most their number squared, whatever the table's size.
    """
    spark, k = pairs.sparkSession, len(index)
    rng = np.random.default_rng(seed)
    u, v = ((rng.random((k, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32), np.zeros((k, DIMENSIONS), np.float32)
    names = spark.createDataFrame(pa.table({"word": pa.array(list(index), pa.string()), "centre": pa.array(range(k), pa.int32())}))
    own = cut(pairs.join(F.broadcast(names), "word").select("centre", "context", "n").repartition(SHARDS, "centre").sortWithinPartitions("centre", "context"))
    for _ in range(ROUNDS):
        here = spark.sparkContext.broadcast((u, v))

        def run(batches: Iterator[pa.RecordBatch], here=here) -> Iterator[pa.RecordBatch]:
            got = [tuple(c.to_numpy() for c in b.columns) for b in batches]
            if got and len(got[0][0]):
                x, y, n = (np.concatenate(c) for c in zip(*got, strict=True))
                u, v = (w.copy() for w in here.value)
                _descend(x, y, n.astype(np.float32), u, v)
                mine = np.zeros_like(u)
                mine[np.unique(x)] = u[np.unique(x)]  # each centre is in one partition
                yield pa.RecordBatch.from_arrays([pa.array([mine.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()), pa.array([float(n.sum())])], names=["u", "v", "n"])

        rows = sorted(own.mapInArrow(run, "u binary, v binary, n double").collect(), key=lambda r: (r.n, r.v))
        if not rows:
            break
        total = sum(r.n for r in rows)
        u = sum(np.frombuffer(r.u, np.float32).reshape(k, DIMENSIONS) for r in rows)
        v = sum(np.frombuffer(r.v, np.float32).reshape(k, DIMENSIONS) * (r.n / total) for r in rows).astype(np.float32)
    return v


def solved(context: np.ndarray, n: np.ndarray, starts: np.ndarray, v: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The skip-gram vector of each word against the contexts' vectors: the best one, by Newton's method.

    The k-th word has the contexts and counts from ``starts[k]`` to ``starts[k + 1]``. Against the vectors as contexts
    it is that of a centre, against those as centres that of a context. ``noise`` are drawn contexts that stand for the
    negative samples. Words of about as many contexts are solved side by side.
    """
    once, times = np.unique(noise, return_counts=True)
    bad, d, size = v[once].astype(np.float64), v.shape[1], np.diff(starts)
    a, b = np.triu_indices(d)
    products = bad[:, a] * bad[:, b]
    mirror = np.zeros((d, d), np.int64)
    mirror[a, b] = mirror[b, a] = np.arange(len(a))
    out = np.zeros((len(size), d))
    order = np.argsort(size, kind="stable") if len(n) else ()
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and to - at < 64 and (to - at + 1) * size[order[to]] <= MOST_SOLVED:
            to += 1
        own, at = order[at:to], to
        place = np.arange(max(int(size[own].max()), 1))
        there = place < size[own][:, None]
        flat = np.where(there, starts[own][:, None] + place, 0)
        count = np.where(there, n[flat], 0.0)
        good = v[np.where(there, context[flat], 0)].astype(np.float64)
        each = NEGATIVE * count.sum(axis=1, keepdims=True) / len(noise) * times
        u = np.zeros((len(own), d))
        for _ in range(8):
            p = 1 / (1 + np.exp(-np.clip((good @ u[:, :, None])[:, :, 0], -30, 30)))
            q = 1 / (1 + np.exp(-np.clip(u @ bad.T, -30, 30)))
            slope = ((count * (1 - p))[:, None, :] @ good)[:, 0] - (each * q) @ bad - u
            curve = (good * (count * p * (1 - p))[:, :, None]).transpose(0, 2, 1) @ good + ((each * q * (1 - q)) @ products)[:, mirror] + np.eye(d)
            step = np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
            step *= np.minimum(1.0, 4.0 / np.maximum(np.abs(step).max(axis=1, keepdims=True), 1e-9))
            u += step
            out[own] = u
            if not (far := np.abs(step).max(axis=1) >= 1e-3).any():
                break
            if not far.all():
                own, u, good, count, each = own[far], u[far], good[far], count[far], each[far]
    return out


def drawn(pairs: DataFrame, k: int) -> np.ndarray:
    """Contexts that stand for the negative samples."""
    often = {r.context: r.n for r in pairs.groupBy("context").agg(F.sum("n").alias("n")).collect()}  # one row a context
    weight = np.cumsum(np.array([often.get(c, 0) for c in range(k)], np.float64) ** 0.75)
    return np.minimum(np.searchsorted(weight, (np.arange(256) + 0.5) / 256 * weight[-1]), k - 1)


def vectors(pairs: DataFrame, v: np.ndarray, noise: np.ndarray, targets: DataFrame) -> DataFrame:
    """(w, vector) of every target that has contexts; a task holds the contexts of some words at a time."""
    shared = pairs.sparkSession.sparkContext.broadcast((v, noise))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each, starts = b.column(1).flatten(), b.column(1).offsets.to_numpy().astype(np.int64)
            own = solved(each.field("context").to_numpy(), each.field("n").to_numpy().astype(np.float64), starts - starts[0], *shared.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in own], pa.binary())], names=["w", "vector"])

    each = pairs.join(targets, F.col("word") == F.col("w"), "left_semi").groupBy(F.col("word").alias("w")).agg(F.collect_list(F.struct("context", "n")).alias("cs"))
    return each.mapInArrow(run, "w string, vector binary")


def centres(pairs: DataFrame, index: dict[str, int], v: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The vectors of the context words as centres, each the best one against the contexts' vectors."""
    names = pairs.sparkSession.createDataFrame(pa.table({"w": pa.array(list(index), pa.string())}))
    u = np.zeros_like(v)
    for r in vectors(pairs, v, noise, names).collect():
        u[index[r.w]] = np.frombuffer(r.vector, np.float32)
    return u


def _least(counted: DataFrame) -> int:
    """A count that at least ``CONTEXTS`` words reach, if there are so many, in steps of a quarter power of two."""
    step = F.floor(F.log2("n") * 4).cast("int")
    total, low = 0, 1 << 62
    for r in sorted(counted.groupBy(step.alias("k")).agg(F.count("*").alias("n"), F.min("n").alias("low")).collect(), key=lambda r: -r.k):
        total, low = total + r.n, r.low
        if total >= CONTEXTS:
            break
    return low


def best(near: list[int] | None, far: list[bytes] | None, known: list[dict], v: np.ndarray) -> str | None:
    """The link that fits the words around: contexts, and vectors of others; without any the most frequent one. None where no link fits."""
    if not near and not far:
        return max(known, key=lambda r: (r["n"], r["w"]))["w"]
    # in the order of their bytes, as a sum's last bit depends on it
    around = np.concatenate([v[near or []], np.frombuffer(b"".join(sorted(far or ())), np.float32).reshape(-1, v.shape[1])])

    def fit(r: dict) -> float:
        if r["vector"] is None:  # it stands beside no context
            return -1.6
        return float(np.mean(-np.logaddexp(0, -(around @ np.frombuffer(r["vector"], np.float32)))))

    score, _, word = max((fit(r), r["n"], r["w"]) for r in known)
    return word if score >= CONTEXT else None


def places(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flaws, fixes) of all results.

    flaws: (res_id, kind, number, whole, left, right) of running lines and of ends of lines with what
    the counts say of them, in ``kind``: running_line, cut, apart, soft. fixes: (res_id, number, word,
    new) of each misread word.
    """
    spark = results.sparkSession
    texts = results.where("markdown is not null and markdown <> ''").select("res_id", "markdown")
    counted = cut(vocabulary(texts))
    inside = counted.where("n > 0")
    top = sorted(inside.where(F.col("n") >= _least(inside)).collect(), key=lambda r: (-r.n, r.word))[:CONTEXTS]
    index = {r.word: k for k, r in enumerate(top)}
    linked = cut(links(counted))
    targets = linked.select(F.explode("links").alias("x")).select("x.w").distinct()
    shared = spark.sparkContext.broadcast(Places(words_of(linked), words_of(counted.where(F.col("n") >= SOFT_RATIO / 2)), index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()))
        for b in batches:
            rows = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in shared.value.of(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["res_id", "kind", "number", "whole", "left", "right", "near", "far"])

    each = cut(texts.mapInArrow(run, "res_id bigint, kind string, number int, whole string, left string, right string, near array<int>, far array<string>"))
    # what the counts say of two ends of lines: both keys of a place meet them in one join
    ends = each.where("kind in ('cut', 'soft')")
    keys = F.when(F.col("kind") == "cut", F.array("whole", F.concat("left", F.lit("-"), "right"))).otherwise(F.array("whole", "left", "right"))
    asked = ends.select("res_id", "kind", "number", "whole", "left", "right", F.posexplode(keys).alias("k", "word"))
    n = asked.join(inside, "word", "left").groupBy("res_id", "kind", "number", "whole", "left", "right").agg(*(F.coalesce(F.max(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(3)))
    kind = F.when(F.col("kind") == "cut", F.when((F.col("n0") > 0) | (F.col("n1") == 0), "cut").otherwise("apart")).when(F.col("n0") >= SOFT_RATIO * F.greatest(F.least("n1", "n2").cast("double"), F.lit(0.5)), "soft")
    told = n.select("res_id", kind.alias("kind"), "number", "whole", "left", "right").where("kind is not null")
    flaws = told.unionByName(each.where("kind = 'running_line'").drop("near", "far"))
    if not index:
        return flaws, spark.createDataFrame([], "res_id bigint, number int, word string, new string")
    # every place has a number of its own, as one id may stand for several texts
    met = cut(each.where("kind = 'word'").select("res_id", "number", F.col("whole").alias("word"), "near", "far").join(linked.select("word"), "word", "left_semi").withColumn("place", F.monotonically_increasing_id()))
    beside = met.select("place", F.explode("far").alias("w"))
    others = beside.select("w").distinct()
    pairs = cut(co_occurrences(texts, index, words_of(targets.unionByName(others), "w")))
    v, noise = skip_gram(pairs, index), drawn(pairs, len(index))
    known = linked.select("word", F.explode("links").alias("x")).select("word", "x.w", "x.n").join(vectors(pairs, v, noise, targets), "w", "left")
    known = known.groupBy("word").agg(F.collect_list(F.struct("w", "n", "vector")).alias("known"))
    around = spark.sparkContext.broadcast(v)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [best(*x, around.value) for x in zip(*(c.to_pylist() for c in b.columns[3:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(new, pa.string())], names=["res_id", "number", "word", "new"])

    far = beside.join(vectors(pairs, centres(pairs, index, v, noise), noise, others), "w").groupBy("place").agg(F.collect_list("vector").alias("far"))
    full = met.drop("far").join(far, "place", "left").join(known, "word")
    fixes = full.select("res_id", "number", "word", "near", "far", "known").mapInArrow(choose, "res_id bigint, number int, word string, new string").where("new is not null")
    return flaws, fixes


def found(results: DataFrame) -> DataFrame:
    """(res_id, flaw) of every flaw of scanned text."""
    flaws, fixes = places(results)
    name = F.when(F.col("kind").isin("cut", "soft"), "cut_word").when(F.col("kind") == "running_line", "running_line")
    broken = flaws.select("res_id", name.alias("flaw")).where("flaw is not null")
    return broken.unionByName(fixes.select("res_id", F.lit("misread").alias("flaw"))).distinct()


def repaired(results: DataFrame) -> DataFrame:
    """(res_id, paragraphs): each result's text as continuous paragraphs; its flaws join by id, all of one text together."""
    flaws, fixes = places(results)
    every = flaws.where("kind <> 'running_line'").select("res_id", "kind", "number", "left", "right")
    every = every.unionByName(fixes.select("res_id", F.lit("fix").alias("kind"), "number", F.col("word").alias("left"), F.col("new").alias("right")))
    told = every.groupBy("res_id").agg(F.collect_list(F.struct("kind", "number", "left", "right")).alias("told"))
    texts = results.where("markdown is not null and markdown <> ''").select("res_id", "markdown")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, rows in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                of = {k: [r for r in rows or () if r["kind"] == k] for k in ("apart", "soft", "fix")}
                apart, soft = (frozenset((r["left"], r["right"]) for r in of[k]) for k in ("apart", "soft"))
                out.append(repair(text, apart, soft, {(r["left"], r["number"]): r["right"] for r in of["fix"]}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["res_id", "paragraphs"])

    return texts.join(told, "res_id", "left").select("res_id", "markdown", "told").mapInArrow(run, "res_id bigint, paragraphs string")
