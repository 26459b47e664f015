"""Round trips: rows of the tables → file bytes in each format → readers → rows, against SQL over the source rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.functions import markdown as md
from doclattice.operators import assemble
from doclattice.session import table
from doclattice.sources import convert, fixtures

_MAKE = {
    "docx": fixtures.docx, "hwp": fixtures.hwp, "pptx": lambda ls: fixtures.pptx([ls]), "hwpx": lambda ls: fixtures.hwpx([ls]), "pdf": lambda ls: fixtures.pdf([ls]),
    "xlsx": lambda ls: fixtures.xlsx({"글": [[x] for x in ls]}), "xls": lambda ls: fixtures.xls(ls, ["글"]), "txt": lambda ls: "\n".join(ls).encode("cp949", "xmlcharrefreplace"),
}


def files(documents: DataFrame, fmt: str) -> DataFrame:
    """(path, content): each document's lines as a file of the format."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = _MAKE[fmt]([x for x in t.split("\n") if x.strip()])
                yield pa.RecordBatch.from_arrays([pa.array([f"/{i}.{fmt}"]), pa.array([data], pa.binary())], names=["path", "content"])

    lines = documents.where(F.col("text").isNotNull() & (md.strip(F.col("text")) != ""))
    return lines.select("doc_id", "text").mapInArrow(run, "path string, content binary")


def _doc_id() -> F.Column:
    return F.regexp_extract("path", r"(\d+)\.", 1).cast("bigint")


def _back(fmt: str):
    def query(spark, d):
        e = convert.extract(files(table(spark, d, "documents"), fmt))
        own = e.where("kind = 'para' and attrs['raw'] is null" if fmt not in ("xlsx",) else "kind = 'table'")
        text = F.replace(F.replace("text", F.lit("\\|"), F.lit("|")), F.lit("\\\\"), F.lit("\\"))
        each = own.select(_doc_id().alias("doc_id"), "ord", text.alias("text"))
        whole = each.groupBy("doc_id").agg(assemble.joined("text", "ord", "\n").alias("text"))
        return whole.select("doc_id", F.md5(F.regexp_replace("text", r"[ \t\n\f\r]+", "")).alias("digest"))

    return query


_BACK = r"""SELECT doc_id, md5(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10)), '[ \t\n\f\r]+', '', 'g')) AS digest
FROM documents WHERE regexp_replace(text, '[\s\x{a0}\x{3000}\x{2000}-\x{200a}\x{202f}]+', '', 'g') <> ''"""


def _verified(fmt: str):
    """Files converted and reconciled by both routes: what is lost, and the status."""

    def query(spark, d):
        r = convert.convert(files(table(spark, d, "documents"), fmt))
        return r.select(F.regexp_extract("path", r"(\d+)\.", 1).cast("bigint").alias("doc_id"), "status", "lost")

    return query


def _verified_sql(status: str) -> str:
    return rf"SELECT doc_id, '{status}' AS status, CAST(0 AS BIGINT) AS lost FROM documents WHERE regexp_replace(text, '[\s\x{{a0}}\x{{3000}}\x{{2000}}-\x{{200a}}\x{{202f}}]+', '', 'g') <> ''"


def cells_back(spark, d):
    """Suppliers as one sheet a nation, read again: cells and names of each."""
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name", "s_acctbal"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from doclattice.model import Limits
        from doclattice.sources.xlsx import Xlsx

        for b in batches:
            for nation, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                book = fixtures.xlsx({"s": [[r["s_name"], r["s_suppkey"], r["s_suppkey"] % 2 == 0] for r in rows]})
                x = Xlsx(book, Limits())
                got = [(row, col, text) for _, _, part in x.sheets() for row, col, _, text, _ in x.cells(part)]
                yield pa.RecordBatch.from_arrays([pa.array([nation] * len(got), pa.int32()), *(pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int32(), pa.int32(), pa.string()), strict=True))], names=["sheet", "row", "col", "shown"])

    return s.mapInArrow(run, "sheet int, row int, col int, shown string")


_CELLS = """WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)
SELECT s_nationkey AS sheet, CAST(k AS INTEGER) AS "row", 1 AS col, s_name AS shown FROM s UNION ALL SELECT s_nationkey, CAST(k AS INTEGER), 2, CAST(s_suppkey AS VARCHAR) FROM s
UNION ALL SELECT s_nationkey, CAST(k AS INTEGER), 3, CASE WHEN s_suppkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END FROM s"""


def strings_back(spark, d):
    """Texts of legacy spreadsheets found again by the flat record scan."""
    e = convert.evidence(files(table(spark, d, "documents"), "xls"))
    return e.where("text <> '글'").groupBy(_doc_id().alias("doc_id")).agg(F.sum("n").alias("n_texts"), F.count("*").alias("n_kinds"))


_STRINGS = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), k AS (SELECT * FROM l WHERE regexp_replace(x, '[\\s\\x{a0}\\x{3000}\\x{2000}-\\x{200a}\\x{202f}]+', '', 'g') <> '')
SELECT doc_id, count(*) AS n_texts, count(DISTINCT x) AS n_kinds FROM k GROUP BY 1""".replace("\\\\", "\\")


def queries() -> dict:
    out = {f"rt_{fmt}": _back(fmt) for fmt in ("docx", "pptx", "hwpx", "hwp", "pdf")}
    out |= {f"verified_{fmt}": _verified(fmt) for fmt in ("docx", "pptx", "hwpx", "hwp", "pdf", "xlsx")}
    return out | {"rt_xlsx": cells_back, "rt_xls": strings_back}


def oracle_sql() -> dict[str, str]:
    out = {f"rt_{fmt}": _BACK for fmt in ("docx", "pptx", "hwpx", "hwp", "pdf")}
    out |= {f"verified_{fmt}": _verified_sql("unverified" if fmt == "pdf" else "success") for fmt in ("docx", "pptx", "hwpx", "hwp", "pdf", "xlsx")}
    return out | {"rt_xlsx": _CELLS, "rt_xls": _STRINGS}
