"""Evaluation texts leaking into training text: latent semantic retrieval, then alignment.

Passages (sentences, and windows where a sentence does not end) become TF-IDF vectors over hashed
character trigrams of their letters and digits alone, so that case, spacing, line breaks,
punctuation, Markdown signs and look-alike characters do not count. A randomised SVD, its sketches
summed over the partitions, gives the latent space; each passage's cosine with every sentence of
the stated evaluation items names candidates. In every document and item that share enough of them,
every candidate is aligned: the sentence stands in the document wholly, or a longest common
subsequence within the candidate's neighbourhood covers ``COVER`` of it and keeps its answers: most
of its figures and of what is rare in it. A case has at least half of the item's sentences in the document.

Inverse document frequencies come from all documents; the SVD is fitted on a bounded sample of
them; every document is searched with its whole text.

Defined results: null and empty texts, and items without letters, make no case; items of equal text
are each named; repeated documents are each named; empty tables give an empty table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.llm.confusables import form

FEATURES = 4096
RANK = 96
#: Documents on which the SVD is fitted, about; the sample is taken by the hash of the id.
FIT_DOCUMENTS = 4_000
#: Items whose sentences a scan of the documents looks for; a larger set takes as many scans as it has blocks.
BLOCK_ITEMS = 20_000
#: Cosine from which a passage, or a window of a long one, may hold a sentence, and the share of an item's sentences that makes a candidate.
NEAR, NEAR_WINDOW, SHARE = 0.93, 0.8, 0.34
#: Share of a sentence that a common subsequence must cover; half the sentences make a case.
COVER, HALF = 0.85, 0.5
#: Answers: share of the figures that the subsequence keeps, and of the trigrams, weighted by rarity, that stand in the stretch.
FIGURES, RARE = 0.5, 0.7
#: Letters of a sentence for each place where it may be changed, beside two; a candidate's neighbourhood holds all trigrams but those that ``COVER`` and so many places can cost.
PLACES = 16
#: Letters of a passage beyond which it is searched in overlapping windows as well.
LONG, WINDOW = 170, 60
#: Characters of documents taken together, and letters laid side by side in one step of the alignment.
TOGETHER, STEP = 2_000_000, 1_000_000
#: Buckets of letters by which a candidate's longest subsequence is bounded from above.
BAG = 251

# Syllables that close a Korean verb before 다: with a final ㅆ or ㄴ.
_PAST, _PRESENT = ("".join(chr(c) for c in range(0xAC00, 0xD7A4) if (c - 0xAC00) % 28 == k) for k in (20, 4))
# A passage ends after a full stop, at a blank line, before a list sign or table bar, and after a Korean verb's final ending.
_END = r"[\s\"'”’)\]*_]"
_SPLIT = re.compile(
    rf"{_END}(?:(?<=[.!?。．！？][\s\S]){_END}*|(?<=\n)(?:\s*\n|(?=[ \t]*(?:[#|>○•·]|[*-][ \t]|[0-9]+[.)][ \t])))"
    rf"|(?<=[{_PAST}{_PRESENT}니이하]다[ \n])[ \n]*|(?<=[세어아에예해네지]요[ \n])[ \n]*)"
)
_BREAK = re.compile(r"<br ?/?>", re.I)


@cache
def _roles() -> np.ndarray:
    """What each code point is: 1 a letter or digit, 2 the end of a passage, 3 the end of a document, 0 nothing that counts."""
    out = np.array([chr(k).isalnum() for k in range(0x110000)], np.uint8)
    out[0], out[1] = 2, 3
    return out


@cache
def _plain() -> frozenset[str]:
    """Characters that have no other compatibility form, of ASCII and Hangul."""
    return frozenset(map(chr, [*range(0x80), *range(0xAC00, 0xD7A4)]))


@cache
def _plainer(ch: str) -> str:
    return unicodedata.normalize("NFKC", ch)


def _marked(text: str) -> str:
    """A text in one consistent form, with a mark at the end of each passage."""
    if not text.isascii():
        text = form(text)
        for ch in set(text) - _plain():
            if (to := _plainer(ch)) != ch:
                text = text.replace(ch, to)
    if "<" in text:
        text = _BREAK.sub("\n\n", text)
    return _SPLIT.sub("\0", text.replace("\0", "").replace("\1", "").casefold())


class Passages:
    """The letters and digits of all passages of some texts, end to end: codes, and each passage's text, start and size."""

    def __init__(self, texts: list[str]) -> None:
        codes = np.frombuffer("\1".join(map(_marked, texts)).encode("utf-32-le", "replace"), np.uint32)
        role = _roles()[codes]
        codes, role = codes[role > 0], role[role > 0]
        letter = role == 1
        passage = np.cumsum(~letter, dtype=np.int64)[letter]
        text = np.cumsum(role == 3, dtype=np.int64)[letter]
        self.codes = codes[letter]
        self.start = np.flatnonzero(np.diff(passage, prepend=-1))
        self.size = np.diff(self.start, append=len(self.codes))
        self.text = text[self.start]
        h = np.zeros(0, np.uint32)
        if len(self.codes) >= 3:
            c = self.codes
            h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
        self.features = (h >> np.uint32(20)).astype(np.int64)

    def string(self, a: int, z: int) -> str:
        return self.codes[a:z].tobytes().decode("utf-32-le")

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """(passage, feature) of every trigram."""
        own = np.repeat(np.arange(len(self.size)), self.size)
        keep = own[2:] == own[:-2]
        return own[:-2][keep], self.features[keep]

    def weighted(self, idf: np.ndarray) -> np.ndarray:
        """Passages by features, TF-IDF of length 1."""
        own, feature = self.cells()
        a = np.bincount(own * FEATURES + feature, minlength=len(self.size) * FEATURES).reshape(-1, FEATURES) * idf
        return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-6)


def passages(text: str) -> list[str]:
    """The letters and digits of each passage of a text, in one consistent form and in order."""
    p = Passages([text])
    return [p.string(a, a + n) for a, n in zip(p.start, p.size, strict=True)]


def latent(p: Passages, start: np.ndarray, size: np.ndarray, scaled: np.ndarray) -> np.ndarray:
    """Unit vectors of stretches of passages in the latent space; scaled is the basis times the document frequencies' weights.

    The sum of the trigrams' rows of the basis; stretches of about one length are summed together.
    """
    table = np.r_[scaled, np.zeros((1, scaled.shape[1]), np.float32)]
    grams = np.maximum(size - 2, 0)
    order = np.argsort(grams, kind="stable")
    v = np.zeros((len(start), scaled.shape[1]), np.float32)
    at = int(np.searchsorted(grams[order], 1))
    while at < len(order):
        own = order[at : at + max(1, 6_000 // int(grams[order[at]]))]
        own = own[grams[own] <= grams[own[0]] + 4]
        at += len(own)
        place = np.arange(int(grams[own[-1]]))
        feature = p.features[np.minimum(start[own, None] + place, len(p.features) - 1)]
        feature[place >= grams[own, None]] = len(scaled)
        v[own] = table[feature].sum(axis=1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about ``TOGETHER`` characters; a longer text is a run of its own."""
    lo = size = 0
    for k, t in enumerate(texts):
        if k > lo and size + len(t) > TOGETHER:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, number of its stretch) of all positions of some stretches."""
    own = np.repeat(np.arange(len(size)), size)
    return np.arange(len(own)) + np.repeat(start - np.cumsum(np.r_[0, size])[:-1], size), own


class Alignment:
    """Longest common subsequences of known sentences with stretches of text, bit-parallel and many side by side."""

    def __init__(self, sentences: list[str], idf: np.ndarray) -> None:
        self.idf = idf
        p = Passages(sentences)  # letters alone already, so that each is one passage
        self.passages, self.sizes = p, np.array([len(s) for s in sentences])
        self.grams = self.sizes - 2 - (1 - COVER) * self.sizes - 2 * (2 + self.sizes / PLACES)
        self.words = 1 << np.ceil(np.log2(np.maximum(1, -(-self.sizes // 64)))).astype(np.int64)  # in steps, so that many go side by side
        self.figures = [np.fromiter((k for k, c in enumerate(s) if c.isdigit()), np.int64) for s in sentences]
        codes = np.frombuffer("".join(sentences).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        own = np.repeat(np.arange(len(sentences)), self.sizes)
        self.bags = np.bincount(own * BAG + codes % BAG, minlength=len(sentences) * BAG).reshape(-1, BAG).astype(np.uint16)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(np.r_[0, self.sizes])[:-1], self.sizes)
        key = own << 21 | codes
        self.keys, at = np.unique(key, return_inverse=True)
        self.masks = np.zeros((len(self.keys) + 1, int(self.words.max(initial=1))), np.uint64)
        np.bitwise_or.at(self.masks, (at, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))

    def left(self, codes: np.ndarray, which: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Bits of the letters of each sentence that the longest common subsequence with its stretch leaves out."""
        out = np.zeros((len(which), self.masks.shape[1]), np.uint64)
        size = end - start
        order = np.lexsort((size, self.words[which]))
        at = 0
        while at < len(order):
            words, width = int(self.words[which[order[at]]]), int(size[order[at]])
            own = order[at : at + max(1, STEP // max(width, 64))]
            own = own[(self.words[which[own]] == words) & (size[own] <= 4 * width + 64)]
            at += len(own)
            own = own[np.argsort(which[own], kind="stable")]  # neighbours share their keys
            place = np.arange(int(size[own].max()))[:, None]
            ch = codes[np.minimum(start[own] + place, len(codes) - 1)].astype(np.int64)
            key = which[own] << 21 | ch
            hit = np.searchsorted(self.keys, key)
            hit[(place >= size[own]) | (self.keys[np.minimum(hit, len(self.keys) - 1)] != key)] = len(self.keys)
            v = [np.full(len(own), ~np.uint64(0)) for _ in range(words)]
            columns = [np.ascontiguousarray(self.masks[:, w]) for w in range(words)]
            for row in hit:
                over = None
                for w in range(words):
                    u = columns[w][row]
                    u &= v[w]
                    total = v[w] + u
                    carry = total < u
                    if over is not None:
                        total += over
                        carry |= total < over
                    over = carry
                    v[w] ^= u
                    v[w] |= total
            for w in range(words):
                out[own, w] = v[w]
        bits = np.arange(64, dtype=np.uint64)
        for w in range(out.shape[1]):  # bits beyond a sentence's end say nothing
            room = np.clip(self.sizes[which] - 64 * w, 0, 64).astype(np.uint64)
            out[:, w] &= np.where(room == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(room, bits[-1])) - np.uint64(1))
        return out

    def possible(self, p: Passages, which: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the letters of each stretch, in whatever order, can cover the sentence, and enough of its trigrams stand there."""
        stretch, of = np.unique(start << 32 | end, return_inverse=True)
        a, size = stretch >> 32, (stretch & 0xFFFFFFFF) - (stretch >> 32)
        ok = np.zeros(len(which), bool)
        order = np.argsort(of, kind="stable")
        bound = np.searchsorted(of[order], np.arange(len(stretch) + 1))
        ends = np.cumsum(size)
        lo = 0
        while lo < len(stretch):
            hi = max(lo + 1, min(lo + 1_024, int(np.searchsorted(ends, ends[lo] + STEP))))
            at, own = _spread(a[lo:hi], size[lo:hi])
            bags = np.bincount(own * BAG + p.codes[at].astype(np.int64) % BAG, minlength=(hi - lo) * BAG).reshape(-1, BAG)
            bags = np.minimum(bags, 0xFFFF).astype(np.uint16)
            there = np.zeros((hi - lo, FEATURES), bool)
            at, own = _spread(a[lo:hi], np.maximum(size[lo:hi] - 2, 0))
            there[own, p.features[at]] = True
            for k in range(bound[lo], bound[hi], 2_048):
                pair = order[k : min(k + 2_048, bound[hi])]
                s, r = which[pair], of[pair] - lo
                may = np.minimum(self.bags[s], bags[r]).sum(axis=1, dtype=np.int32) >= COVER * self.sizes[s] - 1e-9
                pair, s, r = pair[may], s[may], r[may]
                at, own = _spread(self.passages.start[s], np.maximum(self.sizes[s] - 2, 0))
                shared = np.bincount(own, there[r[own], self.passages.features[at]], len(pair))
                ok[pair] = shared >= self.grams[s]
            lo = hi
        return ok

    def stands(self, p: Passages, which: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each stretch holds the sentence: ``COVER`` of its letters in order, and its answers."""
        left = self.left(p.codes, which, start, end)
        ok = np.bitwise_count(left).sum(axis=1) <= self.sizes[which] * (1 - COVER) + 1e-9
        for k in np.flatnonzero(ok):
            at = self.figures[which[k]]
            gone = left[k, at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
            first = self.passages.start[which[k]]
            grams = self.passages.features[first : first + max(0, self.sizes[which[k]] - 2)]
            weight = self.idf[grams]
            there = np.isin(grams, p.features[start[k] : max(start[k], end[k] - 2)])
            ok[k] = gone.sum() <= (1 - FIGURES) * len(at) and weight[there].sum() >= RARE * weight.sum() - 1e-6
        return ok


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    codes = np.frombuffer(b.encode("utf-32-le", "replace"), np.uint32)
    if not a or not b:
        return 0
    left = Alignment([a], np.ones(FEATURES, np.float32)).left(codes, np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(codes)]))
    return len(a) - int(np.bitwise_count(left).sum())


class Search:
    """A block of evaluation items, ready to be looked for."""

    def __init__(self, items: list[tuple[int, list[str]]], idf: np.ndarray, basis: np.ndarray) -> None:
        self.scaled = (idf[:, None] * basis).astype(np.float32)
        self.ids = np.array([i for i, _ in items], np.int64)
        self.sentences = [s for _, ss in items for s in ss]
        self.sizes = np.array([len(ss) for _, ss in items])
        self.item_of = np.repeat(np.arange(len(items)), self.sizes)
        self.alignment = Alignment(self.sentences, idf)
        self.least = 0.7 * self.alignment.sizes.min()
        own = self.alignment.passages
        self.groups = self._grouped(latent(own, own.start, own.size, self.scaled))
        self.centres = np.array([c for c, _, _, _ in self.groups], np.float32).T.copy()
        self.radii = np.array([r for _, r, _, _ in self.groups], np.float32)

    @staticmethod
    def _grouped(vectors: np.ndarray, rounds: int = 8) -> list[tuple[np.ndarray, float, np.ndarray, np.ndarray]]:
        """Sentences grouped by direction, about twice as many groups as the root of their number: (centre, widest angle to it, members, their vectors).

        A passage within an angle of a member is within that angle and the group's of its centre, so
        that groups farther off are left out without losing a candidate.
        """
        rng = np.random.default_rng(5)
        centres = vectors[rng.permutation(len(vectors))[: max(1, int(2 * len(vectors) ** 0.5))]]
        for _ in range(rounds):
            own = (vectors @ centres.T).argmax(axis=1)
            centres = np.array([vectors[own == k].sum(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))], np.float32)
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        own = (vectors @ centres.T).argmax(axis=1)
        out = []
        for k in np.unique(own):
            members = np.flatnonzero(own == k)
            angle = float(np.arccos(np.clip(vectors[members] @ centres[k], -1, 1)).max())
            out.append((centres[k], angle, members, vectors[members].T.copy()))
        return out

    def _candidates(self, v: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(stretch, sentence) of every pair whose cosine reaches the stretch's floor."""
        to = np.arccos(np.clip(v @ self.centres, -1, 1))
        near = to <= np.arccos(floor)[:, None] + self.radii + 1e-3
        rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (_, _, members, vectors) in enumerate(self.groups):
            own = np.flatnonzero(near[:, k])
            if len(own):
                r, c = np.nonzero(v[own] @ vectors >= floor[own, None])
                rows.append(own[r])
                cols.append(members[c])
        return np.concatenate(rows), np.concatenate(cols)

    def match(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(text's position, item id) of every case."""
        for lo, hi in _portions(texts):
            yield from ((lo + d, item) for d, item in self.cases(Passages(texts[lo:hi])))

    def cases(self, p: Passages) -> list[tuple[int, int]]:
        """(text, item id) of every case; each text is judged by all of its passages together."""
        windows = [(k, o) for k in np.flatnonzero(p.size > LONG) for o in range(0, int(p.size[k]) - WINDOW // 2, WINDOW // 2)]
        fit = np.flatnonzero(p.size >= self.least)
        of = np.r_[fit, np.array([k for k, _ in windows], np.int64)]  # the passage of each stretch
        start = np.r_[p.start[fit], np.array([p.start[k] + o for k, o in windows], np.int64)]
        end = np.minimum(np.r_[p.start[fit] + p.size[fit], np.array([p.start[k] + o + WINDOW for k, o in windows], np.int64)], (p.start + p.size)[of])
        window = np.arange(len(of)) >= len(fit)
        floor = np.where(window, np.float32(NEAR_WINDOW), np.float32(NEAR))
        got = [(a + r, c) for a in range(0, len(of), 4_096) for r, c in [self._candidates(latent(p, start[a : a + 4_096], (end - start)[a : a + 4_096], self.scaled), floor[a : a + 4_096])]]
        rows, cols = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*got, strict=True) if got else ((), ())))
        keep = self._enough(p.text[of[rows]], cols, np.ones(len(rows), bool))
        rows, cols = rows[keep], cols[keep]
        if not len(rows):
            return []
        sizes = self.alignment.sizes[cols]
        near = window[rows] | (p.size[of[rows]] <= np.maximum(LONG, 3 * sizes))  # the windows serve for the rest
        rows, cols = rows[near], cols[near]
        a, z = self._around(p, of[rows], start[rows], end[rows], window[rows], self.alignment.sizes[cols])
        order = np.lexsort((z, a, cols))
        each = order[np.any(np.diff(np.c_[cols, a, z][order], axis=0, prepend=-1) != 0, axis=1)]
        doc, cols, a, z = p.text[of[rows[each]]], cols[each], a[each], z[each]
        may = self.alignment.possible(p, cols, a, z)
        may &= self._enough(doc, cols, may)
        doc, cols, a, z = doc[may], cols[may], a[may], z[may]
        ok = self.alignment.stands(p, cols, a, z)
        n = len(self.sentences)
        held = np.unique(doc[ok] * n + cols[ok])
        holds = set(held.tolist())
        each, votes = np.unique(held // n * len(self.ids) + self.item_of[held % n], return_counts=True)
        whole: dict[int, str] = {}
        bounds = np.searchsorted(p.text, np.arange(p.text[-1] + 2))
        out = []
        for case in each[votes >= SHARE * self.sizes[each % len(self.ids)]].tolist():
            d, item = divmod(case, len(self.ids))
            first, last = np.searchsorted(self.item_of, (item, item + 1))
            if d not in whole:
                lo, hi = bounds[d], bounds[d + 1]
                whole[d] = p.string(p.start[lo], p.start[hi - 1] + p.size[hi - 1])
            if sum(d * n + c in holds or self.sentences[c] in whole[d] for c in range(first, last)) >= HALF * (last - first):
                out.append((d, int(self.ids[item])))
        return out

    def _enough(self, doc: np.ndarray, cols: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """Whether each pair's text and item share enough candidate sentences among the pairs that are counted."""
        n = len(self.sentences)
        pair = np.unique(doc[counted] * n + cols[counted])
        case, votes = np.unique(pair // n * len(self.ids) + self.item_of[pair % n], return_counts=True)
        return np.isin(doc * len(self.ids) + self.item_of[cols], case[votes >= SHARE * self.sizes[case % len(self.ids)]])

    @staticmethod
    def _around(p: Passages, of: np.ndarray, start: np.ndarray, end: np.ndarray, window: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch in which a sentence may stand: the passage, with its neighbours where it is short; or the part of a long passage about a window.

        The parts lie on a grid of the sentence's size, so that windows side by side have one part together.
        """
        lo, hi = p.start[of], p.start[of] + p.size[of]
        short = ~window & (p.size[of] < COVER * size)
        before, after = np.maximum(of - 1, 0), np.minimum(of + 1, len(p.size) - 1)
        before, after = np.where(p.text[before] == p.text[of], before, of), np.where(p.text[after] == p.text[of], after, of)
        step = np.maximum(size, WINDOW // 2)
        part = lo + (start - lo) // step * step
        a = np.where(window, np.maximum(lo, part - size), np.where(short, p.start[before], lo))
        z = np.where(window, np.minimum(hi, part + step + WINDOW + size), np.where(short, p.start[after] + p.size[after], hi))
        return a, z


def frequencies(documents: DataFrame) -> tuple[np.ndarray, int, int]:
    """(passages with each feature, passages, documents) over all documents: one pass, map-side sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, docs = np.zeros(FEATURES, np.int64), 0, 0
        for b in batches:
            texts = b.column(0).to_pylist()
            docs += len(texts)
            for lo, hi in _portions(texts):
                p = Passages(texts[lo:hi])
                n += len(p.size)
                own, feature = p.cells()
                cells = np.sort(own * FEATURES + feature)
                total += np.bincount(cells[np.diff(cells, prepend=-1) > 0] % FEATURES, minlength=FEATURES)
        hit = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array([*hit, -1, -2], pa.int32()), pa.array([*total[hit], n, docs], pa.int64())], names=["feature", "n"])

    rows = _texts(documents).select("text").mapInArrow(run, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    got = {r.feature: r.n for r in rows}
    return np.array([got.get(k, 0) for k in range(FEATURES)]), got.get(-1, 0), got.get(-2, 0)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.where("text is not null and text <> ''").select("doc_id", "text")


def fit(documents: DataFrame, idf: np.ndarray, n_docs: int, passes: int = 2) -> np.ndarray:
    """Basis of the latent space by a randomised SVD with power iterations.

    Each pass multiplies by the TF-IDF matrix and its transpose inside the partitions; what comes to
    the driver is one FEATURES x rank sketch a task of a bounded sample, in eight tasks.
    """
    cut_at = min(1_000_000, int(1_000_000 * FIT_DOCUMENTS / max(n_docs, 1)) + 1)
    sample = _texts(documents).where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < cut_at).select("text").repartition(8)
    q = np.random.default_rng(7).standard_normal((FEATURES, RANK + 16)).astype(np.float32)
    for _ in range(passes):
        here = documents.sparkSession.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch], here=here) -> Iterator[pa.RecordBatch]:
            y = np.zeros((FEATURES, RANK + 16), np.float32)
            for b in batches:
                texts = b.column(0).to_pylist()
                for lo in range(0, len(texts), 64):
                    p = Passages(texts[lo : lo + 64])
                    if len(p.size):
                        a = p.weighted(idf).astype(np.float32)
                        y += a.T @ (a @ here.value)
            yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary())], names=["y"])

        sketches = sample.mapInArrow(run, "y binary").collect()
        y = sum((np.frombuffer(r.y, np.float32).reshape(FEATURES, RANK + 16) for r in sketches), np.zeros((FEATURES, RANK + 16), np.float32))
        q = np.linalg.qr(y.astype(np.float64))[0].astype(np.float32) if np.abs(y).max() > 0 else q
    return q[:, :RANK].copy()


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every leak; one narrow stage over the documents a block of items. Only items and the basis are broadcast, a block at a time."""
    freq, n, n_docs = frequencies(documents)
    idf = np.log((1 + n) / (1 + freq)).astype(np.float32)
    basis = fit(documents, idf, n_docs)
    ids = items.where("text is not null").select("item_id").distinct()
    blocks = max(1, -(-ids.count() // BLOCK_ITEMS))
    out = None
    for block in range(blocks):
        rows = items.where("text is not null").where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).select("item_id", "text").distinct().collect()
        own = [(r.item_id, ss) for r in rows if (ss := passages(r.text))]
        if not own:
            continue
        search = documents.sparkSession.sparkContext.broadcast((own, idf, basis))

        def run(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            ready = Search(*search.value)
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                got = [(ids[k], item) for k, item in ready.match(texts)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["doc_id", "item_id"])

        part = _texts(documents).mapInArrow(run, "doc_id bigint, item_id bigint")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    return out.distinct()
