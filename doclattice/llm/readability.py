"""Reading level of each document: interpolated n-gram models, surprisal, isotonic regression.

One interpolated character n-gram model per level of the scale is trained on the running text of
all judged documents (level: median of the raters), counted in partitions. The surprisal of every sentence under every model
gives the sentence's expected level; the distribution over the whole document, weighted by length,
gives its difficulty, which an isotonic regression maps monotonically to the scale.

Headings, lists, tables and noise are left aside. Defined results: documents that are null, empty
or hold no running text have no level; null judgements and repeated rows don't count; without
judgements the result is empty; whole texts are read.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.session import cut

#: Partitions in which the judged documents are counted; each sends arrays of a fixed size.
SHARDS = 8
ORDER, BITS, BLEND = 4, 16, 4.0
ROUNDS = 2
#: Parts of the judged documents whose difficulty is measured by models of the other parts.
FOLDS = 3
#: Letters that running text has at least.
LEAST_LETTERS = 12

_COLUMNS, _BLANKS = re.compile(r"\S {2,}\S.* {2,}\S"), re.compile(" {2,}")
_FENCE = re.compile(r"^\s*(```|~~~)")
_ITEM = re.compile(r"^\s*(?:[-*+•○●▪◦·□■◆▶]|\(?(?:[0-9]{1,3}|[a-zA-Z가-하]|[ivxIVX]{1,4})[.)]|[①-⓿㈀-㈞])\s+")
_END = re.compile(r"[.!?。．！？][\"'”’)\]*_]*$")
_SENTENCE = re.compile(r"(?<=[.!?。．！？])[\"'”’)\]*_]*\s+")
_WORD = re.compile(r"[^\W\d_]{2,}")


def prose_lines(text: str) -> Iterator[str]:
    """Paragraphs of running text: broken lines are joined; headings, items, rows and noise are left out."""
    block: list[str] = []
    for line in [*re.sub(r"<br ?/?>", "\n", text).split("\n"), ""]:
        bare = line.strip()
        if not bare or bare[0] in "#|+│┌├└=>" or "\t" in bare or bare.count("|") > 1 or bare.count("│") > 1 or _FENCE.match(bare) or "  " in bare and _COLUMNS.search(bare):
            if block:
                yield " ".join(block)
                block = []
            if bare and bare[0] in "|>│" and _END.search(bare.rstrip("| │")):
                cell = max(bare.strip("|>│ ").split("|"), key=len).strip()
                if len(cell) > 40 and _END.search(cell):
                    yield cell
        else:
            block.append(_BLANKS.sub(" ", bare) if "  " in bare else bare)


def sentences(text: str) -> list[str]:
    """Sentences of the running text of a document."""
    out = []
    for block in prose_lines(text):
        for s in _SENTENCE.split(block):
            s = _ITEM.sub("", s).strip("*_ ")
            words = _WORD.findall(s)
            if len(words) < 2 or not _END.search(s) or '","' in s:
                continue
            n = sum(map(len, words))
            if n >= LEAST_LETTERS * 0.6 and n >= 0.55 * len(s.replace(" ", "")) and n / len(words) > 1.4:
                out.append(s)
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(text of each character, hashed n-gram ending at it for each order)."""
    size = np.array([len(t) + 1 for t in texts])
    codes = np.frombuffer("".join("\n" + t for t in texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(texts)), size)
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(ORDER):
        back = np.zeros_like(codes)
        back[n:] = codes[: len(codes) - n] if n else codes
        if n:
            back[n:][own[n:] != own[:-n]] = 0
        h = (h ^ (back + np.uint64(n + 1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out.append((h >> np.uint64(64 - BITS)).astype(np.int64))
    return own, out


def _before(own: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The gram one place back; 0 where a text starts, so that no text depends on the one before it."""
    before = np.r_[0, grams[:-1]]
    before[np.flatnonzero(np.diff(own, prepend=-1))] = 0
    return before


def counted(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """n-gram counts of sentences, of each order, then contexts of each order; weights: a row over the levels for each sentence."""
    out = np.zeros((weights.shape[1], 2 * ORDER, 1 << BITS))
    if texts:
        own, grams = _grams(texts)
        # contexts: the n characters before, which is the gram of order n one place back
        rows = [*grams, *(_before(own, grams[max(n - 1, 0)]) for n in range(ORDER))]
        for k in range(weights.shape[1]):
            w = weights[own, k]
            if w.any():
                for n, at in enumerate(rows):
                    if n != ORDER:
                        out[k, n] = np.bincount(at, w, 1 << BITS)
    return out


class Models:
    """n-gram models of all levels, side by side, and the map from difficulty to level."""

    def __init__(self, levels: list[int]) -> None:
        self.levels = np.array(levels)
        self.n = [np.zeros((1 << BITS, len(levels)), np.float32) for _ in range(ORDER)]
        self.below = [np.zeros((1 << BITS, len(levels)), np.float32) for _ in range(ORDER)]
        self.total = np.zeros(len(levels), np.float32)
        self.steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))

    def __getstate__(self) -> bytes:
        return zlib.compress(pickle.dumps(self.__dict__), 1)

    def __setstate__(self, state: bytes) -> None:
        self.__dict__.update(pickle.loads(zlib.decompress(state)))

    def put(self, counts: np.ndarray) -> None:
        """Takes the sums of ``counted``."""
        counts = counts.astype(np.float32)
        for n in range(ORDER):
            self.n[n] = np.ascontiguousarray(counts[:, n].T)
            if n:
                self.below[n] = np.ascontiguousarray(counts[:, ORDER + n].T)
        self.total = counts[:, 0].sum(axis=1, dtype=np.float64).astype(np.float32)

    def surprisal(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits of each sentence under each level's model, characters of each)."""
        own, grams = _grams(texts)
        p = (self.n[0][grams[0]] + 0.5) / (self.total + 0.5 * 3000)
        for n in range(1, ORDER):
            before = _before(own, grams[n - 1])
            # Dirichlet interpolation with the lower order
            p = (self.n[n][grams[n]] + BLEND * p) / (self.below[n][before] + BLEND)
        start = np.flatnonzero(np.diff(own, prepend=-1))
        bits = np.add.reduceat(-np.log2(np.maximum(p, 1e-9)), start, axis=0)
        return bits, np.diff(np.r_[start, len(own)])

    def mix(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(weight of each level for each sentence, characters)."""
        bits, size = self.surprisal(texts)
        z = -(bits - bits.min(axis=1, keepdims=True)) / np.maximum(4.0, np.sqrt(size))[:, None] * 2
        e = np.exp2(z)
        return e / e.sum(axis=1, keepdims=True), size

    def difficulty(self, docs: list[list[str]]) -> np.ndarray:
        """Expected level of each document, from the distribution over all its sentences."""
        flat = [s for d in docs for s in d]
        w, size = self.mix(flat)
        expected = (w @ self.levels) * size
        first = np.cumsum([0, *map(len, docs)])[:-1]
        return np.add.reduceat(expected, first) / np.add.reduceat(size, first)

    def level(self, difficulty: np.ndarray) -> np.ndarray:
        x, y = self.steps
        fitted = np.interp(difficulty, x, y)
        return np.clip(np.floor(fitted + 0.5), self.levels.min(), self.levels.max()).astype(int)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least squares non-decreasing fit by pooling adjacent violators: (positions, values) to interpolate."""
    order = np.lexsort((y, x))
    pools: list[list[float]] = []  # value, weight, first x, last x
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        pools.append([b, c, a, a])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b2, c2, _, last = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][1] + b2 * c2) / (pools[-1][1] + c2), pools[-1][1] + c2, pools[-1][2], last]
    return np.array([v for p in pools for v in (p[2], p[3] + 1e-9)]), np.array([v for p in pools for v in (p[0], p[0])])


def _given(level: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Weights over the levels by the judgement alone: shared by the levels it lies between."""
    far = np.abs(level[:, None] - levels[None, :])
    start = np.maximum(0, 1 - far)
    return np.where(start.sum(axis=1, keepdims=True) > 0, start, far == far.min(axis=1, keepdims=True)).astype(np.float32)


def _purified(m: Models, texts: list[str], level: np.ndarray) -> np.ndarray:
    """Documents mix levels: a sentence goes where its model is, held back by its document's judgement."""
    w, _ = m.mix(texts)
    weights = w * np.exp2(-1.2 * np.abs(level[:, None] - m.levels[None, :]))
    return (weights / weights.sum(axis=1, keepdims=True)).astype(np.float32)


def train(judged: list[tuple[str, float, int]]) -> Models | None:
    """Models from (text, level, number of raters) of a few documents, with the isotonic map of these."""
    rows = [(ss, lev, n) for text, lev, n in judged if (ss := sentences(text))]
    own = sorted({int(np.floor(lev + 0.5)) for _, lev, _ in rows})
    if not own:
        return None
    m, flat = Models(own), [s for ss, _, _ in rows for s in ss]
    level = np.array([float(lev) for ss, lev, _ in rows for _ in ss])
    for k in range(ROUNDS + 1):
        m.put(counted(flat, _purified(m, flat, level) if k else _given(level, m.levels)))
    m.steps = isotonic(m.difficulty([ss for ss, _, _ in rows]), np.array([lev for _, lev, _ in rows]), np.array([float(n) for *_, n in rows]))
    return m


def judgements(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(sentences, level, n, fold) of all judged documents with running text, with the median of their raters."""
    each = labels.where("reading_level is not null").select("doc_id", "rater", "reading_level").distinct()
    per = each.groupBy("doc_id").agg(F.median("reading_level").alias("level"), F.count("*").alias("n"))
    own = documents.where("text is not null and text <> ''").select("doc_id", "text").join(per, "doc_id")
    own = own.select("text", "level", "n", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([sentences(t) for t in b.column(0).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([got, *b.columns[1:]], names=["sentences", "level", "n", "fold"])

    return own.mapInArrow(run, "sentences array<string>, level double, n bigint, fold int").where(F.size("sentences") > 0)


def _sums(rows: DataFrame, levels: np.ndarray, models: dict[int, Models] | None) -> np.ndarray:
    """Counts of the sentences of each fold, for each model that may see it: [model, level, order, bucket]; model 0 sees all, model k + 1 all but fold k.

    The counts are whole numbers of 2^-10, so that their sum doesn't depend on the order of rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        out = np.zeros((FOLDS + 1, len(levels), 2 * ORDER, 1 << BITS))
        for b in batches:
            for fold in range(FOLDS):
                own = b.filter(pc.equal(b.column(3), fold))
                docs = own.column(0).to_pylist()
                for lo in range(0, len(docs), 512):
                    part = docs[lo : lo + 512]
                    flat = [s for d in part for s in d]
                    level = np.repeat(own.column(1).to_numpy()[lo : lo + 512], [len(d) for d in part])
                    whole = lambda w: np.rint(w * 1024)
                    if models is None:  # the same for every model
                        got = counted(flat, whole(_given(level, levels)))
                        for k in range(FOLDS + 1):
                            if k != fold + 1:
                                out[k] += got
                    else:
                        seen = [k for k in models if k != fold + 1]
                        got = counted(flat, np.concatenate([whole(_purified(models[k], flat, level)) for k in seen], axis=1))
                        for j, k in enumerate(seen):
                            out[k] += got[j * len(levels) : (j + 1) * len(levels)]
        kind = np.int32 if out.max() < 1 << 31 else np.int64
        for k in range(FOLDS + 1):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([kind().itemsize], pa.int32()), pa.array([zlib.compress(out[k].astype(kind).tobytes(), 1)], pa.binary())], names=["model", "bytes", "counts"])

    sums = np.zeros((FOLDS + 1, len(levels), 2 * ORDER, 1 << BITS), np.int64)
    for r in rows.mapInArrow(run, "model int, bytes int, counts binary").collect():
        sums[r.model] += np.frombuffer(zlib.decompress(r.counts), f"i{r.bytes}").reshape(sums.shape[1:])
    shared.destroy()
    return sums / 1024


def learn(documents: DataFrame, labels: DataFrame) -> Models | None:
    """The models from all judged documents; the isotonic map comes from documents that the models it was fitted with had not seen."""
    rows = cut(judgements(documents, labels).repartition(SHARDS))
    count = rows.groupBy(F.floor(F.col("level") + 0.5).cast("int").alias("level")).count().collect()
    own = sorted(r.level for r in count)
    if not own:
        return None
    held = sum(r["count"] for r in count) >= 10 * FOLDS
    levels, models = np.array(own), None
    for _ in range(ROUNDS + 1):
        sums = _sums(rows, levels, models)
        models = {}
        for k in range(FOLDS + 1 if held else 1):
            models[k] = Models(own)
            models[k].put(sums[k])
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fold in range(FOLDS):
                own = b.filter(pc.equal(b.column(3), fold))
                if len(own):
                    d = shared.value[fold + 1 if held else 0].difficulty(own.column(0).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.float64()), own.column(1), own.column(2)], names=["d", "level", "n"])

    # documents of one difficulty to four digits count together: a bounded number of points
    points = rows.mapInArrow(run, "d double, level double, n bigint").groupBy(F.round("d", 4).alias("d"), "level").agg(F.sum("n").alias("n")).toPandas()
    shared.destroy()
    models[0].steps = isotonic(points["d"].to_numpy(float), points["level"].to_numpy(float), points["n"].to_numpy(float))
    return models[0]


def levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, reading_level, difficulty) of every document with running text; one narrow stage over whole texts."""
    model = learn(documents, labels)
    schema = "doc_id bigint, reading_level int, difficulty double"
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(ids), 64):
                own = [(i, ss) for i, t in zip(ids[lo : lo + 64], texts[lo : lo + 64], strict=True) if (ss := sentences(t))]
                if own:
                    d = shared.value.difficulty([ss for _, ss in own])
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array(shared.value.level(d), pa.int32()), pa.array(d, pa.float64())], names=["doc_id", "reading_level", "difficulty"])

    return documents.where("text is not null and text <> ''").select("doc_id", "text").mapInArrow(run, schema)


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return levels(documents, labels).select("doc_id", "reading_level").distinct()


def profile(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents and mean difficulty per source and level."""
    lev = levels(documents, labels)
    return documents.select("doc_id", "source").join(lev, "doc_id").groupBy("source", "reading_level").agg(F.count("*").alias("n_docs"), F.avg("difficulty").alias("difficulty"))
