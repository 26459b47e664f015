"""Filling fixed-capacity containers with texts: bounded-space best fit.

A text's size is that of the public byte tokenizer: its UTF-8 bytes and one end token. Each
partition keeps a fixed number of open windows; an item goes where it fits best, and where none
fits the fullest window is closed. Windows still open at the end of a partition are leftovers;
they are packed again, as wholes, in ever fewer partitions until one is left.

Defined results: null texts are in no container, empty texts have one token; a text larger than the
capacity, and only such a text, is divided at character bounds, each piece with its end token; the
same rows under other ids are other items; without kinds or texts the result is empty.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclattice.session import cut, parallelism

#: Windows that a partition keeps open for each kind of container.
OPEN_WINDOWS = 256
#: Kinds of container are a small dimension: beyond this number the query refuses.
MOST_KINDS = 1_000
#: Partitions of leftovers that are merged into one.
FAN_IN = 32

_PIECES = T.ArrayType(T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("tokens", T.IntegerType())]))


def divide(text: str, capacity: int) -> list[tuple[int, int, int]]:
    """(piece, first byte, tokens) of a text larger than the capacity; no character is divided.

    A capacity under 5 tokens can't hold every character with its end token; a piece then still
    takes one whole character.
    """
    data, out, start = text.encode("utf-8", "replace"), [], 0
    room = max(1, capacity - 1)
    while start < len(data):
        end = min(len(data), start + room)
        while end < len(data) and end > start and data[end] & 0xC0 == 0x80:
            end -= 1
        if end == start:
            end = start + 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        out.append((len(out), start, end - start + 1))
        start = end
    return out


class Windows:
    """Open containers of one kind: best fit by a sorted list of (room left, container)."""

    def __init__(self, capacity: int, most: int = OPEN_WINDOWS) -> None:
        self.capacity, self.most = capacity, most
        self.rooms: list[tuple[int, int]] = []
        self.opened = 0

    def place(self, size: int) -> int:
        """The container of an item of this size; at most ``most`` stay open."""
        at = bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, which = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.most:
                self.rooms.pop(0)  # the fullest
            room, which = max(self.capacity, size), self.opened
            self.opened += 1
        if room > size:
            insort(self.rooms, (room - size, which))
        return which


def sized(documents: DataFrame, bins: DataFrame) -> DataFrame:
    """(bin_name, capacity, doc_id, piece, start_byte, tokens): the items of each kind of container.

    Sizes are counted in the JVM; only the texts that must be divided go through Python.
    """
    kinds = bins.where("bin_name is not null and capacity > 0").select("bin_name", "capacity").distinct().limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of container")
    spark = documents.sparkSession
    if not kinds:
        return spark.createDataFrame([], "bin_name string, capacity int, doc_id bigint, piece int, start_byte int, tokens int")
    each = F.array(*(F.struct(F.lit(k.bin_name).alias("bin_name"), F.lit(int(k.capacity)).alias("capacity")) for k in kinds))
    docs = documents.where("text is not null").select("doc_id", "text", (F.octet_length("text") + 1).alias("tokens"))
    whole = docs.select("doc_id", "tokens", F.explode(F.filter(each, lambda k: F.col("tokens") <= k["capacity"])).alias("k"))
    whole = whole.select("k.bin_name", "k.capacity", "doc_id", F.lit(0).alias("piece"), F.lit(0).alias("start_byte"), "tokens")
    least = min(int(k.capacity) for k in kinds)

    @F.udf(_PIECES, useArrow=True)
    def pieces(text: str, capacity: int):
        return divide(text, capacity)

    large = docs.where(F.col("tokens") > least).select("doc_id", "text", F.explode(F.filter(each, lambda k: F.col("tokens") > k["capacity"])).alias("k"))
    large = large.select("k.bin_name", "k.capacity", "doc_id", F.explode(pieces("text", "k.capacity")).alias("p"))
    return whole.unionByName(large.select("bin_name", "capacity", "doc_id", "p.piece", F.col("p.start").alias("start_byte"), "p.tokens"))


_ITEM = "bin_name string, capacity int, doc_id bigint, piece int, start_byte int, tokens int, window bigint"
_MERGED = "bin_name string, capacity int, window bigint, used int, into bigint, open boolean"


def _first(most: int):
    """Packs a partition's items; at its end a row without document for each window still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kinds: dict[tuple, Windows] = {}
        schema = None
        for b in batches:
            if not b.num_rows:
                continue
            own = []
            for name, capacity, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(5).to_pylist(), strict=True):
                w = kinds.get((name, capacity)) or kinds.setdefault((name, capacity), Windows(capacity, most))
                own.append(part << 32 | w.place(tokens))
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], names=[*b.schema.names, "window"])
            schema = out.schema
            yield out
        left = [(name, capacity, None, None, None, capacity - room, part << 32 | which) for (name, capacity), w in kinds.items() for room, which in w.rooms]
        if left:
            cols = [pa.array(c, t.type) for c, t in zip(zip(*left, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return run


def _again(most: int):
    """Packs leftover windows as wholes; names the container by the first window in it and says if it is still open.

    A task holds at most ``FAN_IN`` times ``most`` windows of a kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[tuple, tuple[Windows, dict[int, int]]] = {}
        rows: list[tuple] = []
        for b in batches:
            for name, capacity, window, used in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w, first = kinds.get((name, capacity)) or kinds.setdefault((name, capacity), (Windows(capacity, most), {}))
                at = w.place(used)
                rows.append((name, capacity, window, used, first.setdefault(at, window), at))
        still = {k: {which for _, which in w.rooms} for k, (w, _) in kinds.items()}
        done = [(*r[:5], r[5] in still[r[:2]]) for r in rows]
        if done:
            types = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=["bin_name", "capacity", "window", "used", "into", "open"])

    return run


def fill(documents: DataFrame, bins: DataFrame, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """(bin_name, doc_id, piece, start_byte, tokens, container): a container for every document or piece.

    The first round's result is checkpointed, so that the containers named by a later round are
    those of the same run even where an executor was lost. Only leftovers travel further: at most
    ``open_windows`` a partition and kind.
    """
    parts = parallelism(documents)
    spread = sized(documents, bins).repartition(parts, "doc_id", "piece").sortWithinPartitions(F.xxhash64("doc_id", "piece"), "bin_name", "doc_id", "piece")
    placed = cut(spread.mapInArrow(_first(open_windows), _ITEM))
    moved = placed.where("doc_id is null").select("bin_name", "capacity", "window", F.col("tokens").alias("used"))
    renamed = None
    while True:
        parts = max(1, parts // FAN_IN)
        spot = F.pmod(F.shiftright("window", 32), F.lit(parts))
        again = moved.repartition(parts, spot).sortWithinPartitions(F.desc("used"), "bin_name", "window")
        step = cut(again.mapInArrow(_again(open_windows), _MERGED))
        later = step.select("bin_name", F.col("window").alias("into"), F.col("into").alias("later"))
        renamed = step.select("bin_name", "window", "into") if renamed is None else renamed.join(later, ["bin_name", "into"], "left").select("bin_name", "window", F.coalesce("later", "into").alias("into"))
        if parts == 1:
            break
        moved = step.where("open").groupBy("bin_name", "capacity", F.col("into").alias("window")).agg(F.sum("used").cast("int").alias("used"))
    out = placed.where("doc_id is not null").join(renamed, ["bin_name", "window"], "left")
    return out.select("bin_name", "doc_id", "piece", "start_byte", "tokens", F.coalesce("into", "window").alias("container"))


def divided(documents: DataFrame, bins: DataFrame) -> DataFrame:
    """(bin_name, doc_id) of every document that the filling had to divide: those with a second piece in a container."""
    return fill(documents, bins).where("piece = 1").select("bin_name", "doc_id")


def filling(documents: DataFrame, bins: DataFrame) -> DataFrame:
    """Per kind: containers, tokens in them and the share of unused space."""
    each = fill(documents, bins).join(F.broadcast(bins.select("bin_name", "capacity").distinct().limit(MOST_KINDS)), "bin_name")
    per = each.groupBy("bin_name", "capacity", "container").agg(F.sum("tokens").alias("used"))
    return per.groupBy("bin_name", "capacity").agg(
        F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("most_used"),
        (1 - F.sum("used") / (F.count("*") * F.col("capacity"))).alias("unused"),
    )
