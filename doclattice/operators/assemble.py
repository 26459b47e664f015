"""Ordered assembly: Markdown tables from cells, ordered concatenation, splitting, packaging by reference."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclattice.functions import markdown as md


def joined(block: str, order: str, by: str = "\n\n") -> Column:
    """Blocks of a group in their order, joined; null blocks are left out."""
    pairs = F.array_sort(F.collect_list(F.when(F.col(block).isNotNull(), F.struct(F.col(order).alias("o"), F.col(block).alias("b")))))
    return F.array_join(F.transform(pairs, lambda p: p["b"]), by)


def numbered_table(rows: Column) -> Column:
    """Markdown of a ragged array of rows of cells: the header is column numbers, rows keep their number, a notice tells unequal widths."""
    widths = F.transform(rows, F.size)
    width = F.coalesce(F.array_max(widths), F.lit(0))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = F.concat(F.array(F.lit("행")), F.transform(F.sequence(F.lit(1), width), lambda k: F.concat(F.lit("열"), k.cast("string"))))
    rule = F.array_repeat(F.lit("---"), width + 1)
    body = F.transform(rows, lambda r, k: line(F.concat(F.array((k + 1).cast("string")), F.transform(r, md.esc_cell), F.array_repeat(F.lit(""), width - F.size(r)))))
    kinds = F.array_sort(F.array_distinct(widths))
    notice = F.when(F.size(kinds) > 1, F.array(F.lit(""), F.concat(F.lit("> 행마다 열 수가 다르다("), F.array_join(kinds.cast("array<string>"), ", "), F.lit(")"))))
    out = F.concat(F.array(line(head), line(rule)), body, F.coalesce(notice, F.array().cast("array<string>")))
    return F.when(width > 0, F.array_join(out, "\n")).otherwise("")


def split_text(body: str, limit: int) -> list[str]:
    """Parts of at most ``limit`` characters (one more where a line ends just there) that join to the body again.

    A part is filled paragraph by paragraph; a paragraph that does not fit is cut after its last line
    that fits, or else where the part is full.
    """
    if limit <= 0:
        return [body] if body else []
    parts: list[str] = []
    held, at = "", 0
    while at < len(body):
        stop = body.find("\n\n", at)
        end = len(body) if stop < 0 else stop + 2
        while at < end:
            if len(held) == limit:
                parts.append(held)
                held = ""
            free = limit - len(held)
            if end - at <= free:
                held, at = held + body[at:end], end
                continue
            line = body.rfind("\n", at, min(end, at + free + 1))
            to = line + 1 if line >= 0 else at + free
            parts.append(held + body[at:to])
            held, at = "", to
    return [*parts, held] if held else parts


def chunks(df: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, seq, n_chunks, chunk): one narrow Arrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, n, len(ps), p) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for ps in [split_text(t, limit)] for n, p in enumerate(ps, 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=[key, "seq", "n_chunks", "chunk"])

    return df.select(F.col(key).cast("bigint"), text).mapInArrow(run, f"{key} bigint, seq int, n_chunks int, chunk string")


def leftovers(cells: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with a value inside a merged range that are not its anchor.

    A range is spread over its rows first, so that the range join becomes an equi-join on the row.
    """
    rows = merged.withColumn("row", F.explode(F.sequence("row_lo", "row_hi")))
    hit = cells.join(rows, [*keys, "row"]).where("col between col_lo and col_hi and not (row = row_lo and col = col_lo)")
    return hit.where("value is not null").select(*keys, "row", "col", "value")


def latest_before(rows: DataFrame, part: str, order: str, flag: Column, value: str, name: str) -> DataFrame:
    """As-of grouping: the value of the last flagged row at or before each row."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(F.when(flag, F.col(value)), ignorenulls=True).over(w))


def within_cap(rows: DataFrame, part: str, order: list[str], size: str, cap: int) -> DataFrame:
    """Rows of each part until the running sum of sizes passes the cap."""
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= cap)


def top_n(rows: DataFrame, part: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
