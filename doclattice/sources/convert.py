"""Files → elements → Markdown → verified results, as DataFrames.

Path A decodes a file in a Python worker and emits elements in document order. Path B reads the
original bytes by another route: text nodes by regular expressions in the JVM for XML packages, a
flat record or operand scan for binary formats. The two meet in a join on the file; the worst event
is the status, and only what is wholly reconciled is ``success``. A file that can't be read gives a
row, never an exception.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.functions import markdown as md
from doclattice.model import ELEMENTS, Element, Limits, Unreadable, event
from doclattice.operators import assemble, verify
from doclattice.session import ship
from doclattice.sources import biff, hwp, pdf, plain
from doclattice.sources.docx import Docx
from doclattice.sources.hwpx import Hwpx
from doclattice.sources.packages import detect
from doclattice.sources.pptx import Pptx
from doclattice.sources.xlsx import Xlsx

CONVERTER = "doclattice/1.0"
TEXT = frozenset({"txt", "md", "markdown", "log"})
DELIMITED = frozenset({"csv", "tsv"})
IMAGES = frozenset({"png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif", "webp"})
#: Converted by an external office program to the format beside it; without the program they are unsupported.
LEGACY = {"doc": "docx", "dot": "docx", "rtf": "docx", "odt": "docx", "wps": "docx", "xls": "xlsx", "ods": "xlsx", "ppt": "pptx", "odp": "pptx"}
PACKAGES = {"docx": Docx, "xlsx": Xlsx, "pptx": Pptx, "hwpx": Hwpx}
SUPPORTED = TEXT | DELIMITED | IMAGES | frozenset(LEGACY) | frozenset(PACKAGES) | {"hwp", "pdf"}


def read(spark: SparkSession, path: str, recursive: bool = True, limits: Limits = Limits()) -> DataFrame:
    """(path, length, content) of the supported files below a folder; sizes are filtered before contents are read.

    ``refused`` has the rows of all other files.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.where(extension(F.col("path")).isin(*SUPPORTED) & (F.col("length") <= limits.file_bytes)).select("path", "length", "content")


def refused(spark: SparkSession, path: str, recursive: bool = True, limits: Limits = Limits()) -> DataFrame:
    """Rows as those of ``convert`` for the files that ``read`` leaves out: unsupported ones and oversized ones, contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length")
    fmt, size = extension(F.col("path")), F.col("length")
    known, fits = fmt.isin(*SUPPORTED), size <= limits.file_bytes
    reason = F.when(~known, F.concat(F.lit("지원하지 않는 형식: "), fmt)).otherwise(F.concat(size.cast("string"), F.lit(f" bytes; {limits.file_bytes} are allowed")))
    head = md.header_block(F.element_at(F.split("path", "/"), -1), fmt, CONVERTER)
    none = F.lit(0).cast("bigint")
    return files.where(~(known & fits)).select(
        "path", fmt.alias("fmt"), F.when(known, "failed").otherwise("unsupported").alias("status"), head.alias("markdown"), F.array(reason).alias("warnings"), none.alias("lost"), none.alias("kinds"), none.alias("n_assets"),
    )


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def elements_of(name: str, content: bytes, limits: Limits = Limits(), encoding: str | None = None) -> Iterator[Element]:
    """Elements of one file; what goes wrong becomes an event."""
    ext = os.path.splitext(name)[1].lower().lstrip(".")
    try:
        if len(content) > limits.file_bytes:
            raise Unreadable(f"{len(content)} bytes; {limits.file_bytes} are allowed")
        if ext in PACKAGES and content[:4] != b"PK\x03\x04":
            real = detect(content)
            if real is None:
                raise Unreadable("파일 시그니처 불일치")
            yield Element("warning", f"확장자는 {ext}이지만 내용은 {real}이다")
            ext = real
        if ext in TEXT:
            yield from plain.text_elements(content, ext, encoding)
        elif ext in DELIMITED:
            yield from plain.csv_elements(content, ext, encoding)
        elif ext in PACKAGES:
            yield from PACKAGES[ext](content, limits).elements()
            yield from (event("unverified", f"둘째 경로가 읽지 않는 크기: {x}", x) for x in oversized(content, limits))
        elif ext == "hwp":
            yield from hwp.Hwp(content, limits).elements()
        elif ext == "pdf":
            yield from pdf.elements(content, limits)
        elif ext in IMAGES:
            yield Element("para", f"![그림: 내용 해석 안 됨](media/{os.path.basename(name)})", attrs={"raw": "1"})
            yield event("unverified", "그림은 글자로 읽지 않았다")
        elif ext in LEGACY:
            yield event("unsupported", "변환 프로그램이 없다")
        else:
            yield event("unsupported", f"지원하지 않는 형식: {ext}")
    except Unreadable as e:
        yield event(e.status, str(e))
    except Exception as e:  # one broken file must not end the batch
        yield event("failed", f"{type(e).__name__}: {e}")


def oversized(content: bytes, limits: Limits) -> list[str]:
    """Parts with text that the second route leaves out for their size."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [i.filename for i in z.infolist() if i.file_size > limits.xml_bytes and (re.search(EVIDENCE_PARTS, i.filename) or i.filename.startswith("xl/") and i.filename.endswith(".xml"))]


def extract(files: DataFrame, limits: Limits = Limits(), encoding: str | None = None) -> DataFrame:
    """Rows of ``ELEMENTS`` for (path, content); one narrow stage, one file in memory at a time."""
    limits = replace(limits)
    schema = pa.schema([("path", pa.string()), ("ord", pa.int32()), ("part", pa.string()), ("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                path, content = b.column(0)[k].as_py(), b.column(1)[k].as_py() or b""
                rows = [(path, n, e.part, e.kind, e.level, e.text, list(e.attrs.items()), e.data) for n, e in enumerate(elements_of(path, content, limits, encoding))]
                for lo in range(0, len(rows), 10_000):
                    cols = zip(*rows[lo : lo + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, ELEMENTS)


def block() -> Column:
    """Markdown of one element; null for what is no block."""
    text, level = F.col("text"), F.col("level")
    raw = F.col("attrs")["raw"].isNotNull()
    return (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(level, F.lit(1))), F.lit(" "), text))
        .when(F.col("kind") == "item", F.concat(F.repeat(F.lit("  "), level), F.col("attrs")["mark"], F.lit(" "), text))
        .when(F.col("kind").isin("table", "note"), text)
        .when(F.col("kind") == "para", F.when(raw, text).otherwise(md.esc_block(text)))
    )


def _texts_of(name: str, content: bytes) -> list[str]:
    """Path B of binary formats and plain text."""
    ext = os.path.splitext(name)[1].lower().lstrip(".")
    try:
        if ext == "hwp":
            return list(hwp.paragraph_texts(content))
        if ext == "xls":
            return [*biff.strings(content), *biff.sheet_names(content)]
        if ext in TEXT:
            return [x for x in plain.decode(content)[0].splitlines() if x.strip()]
    except Exception:  # an unreadable file has its event already
        return []
    return []


def parts(files: DataFrame, pattern: str, limits: Limits = Limits()) -> DataFrame:
    """(path, part, xml): text of the package parts whose names match; read again from the original bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = re.compile(pattern)
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                path, content = b.column(0)[k].as_py(), b.column(1)[k].as_py() or b""
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(path, i.filename, z.read(i).decode("utf-8", "replace")) for i in z.infolist() if want.search(i.filename) and i.file_size <= limits.xml_bytes]
                except (zipfile.BadZipFile, OSError, RuntimeError, zlib_error):
                    continue
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["path", "part", "xml"])

    zlib_error = __import__("zlib").error
    return files.where(F.substring("content", 1, 4) == F.unhex(F.lit("504B0304"))).select("path", "content").mapInArrow(run, "path string, part string, xml string")


#: Parts with text, and the elements that hold it, per package.
EVIDENCE_PARTS = r"^word/(?!settings|styles|numbering|fontTable|webSettings|theme)[^/]+\.xml$|^ppt/(?:slides|notesSlides)/[^/]+\.xml$|section\d+\.xml$"
_NODE = r"(?s)<(?:[A-Za-z0-9]+:)?(t|delText|instrText|script)(?:\s[^>]*[^/>])?>(.*?)</(?:[A-Za-z0-9]+:)?\1>"


def cells(files: DataFrame) -> DataFrame:
    """(path, part, ref, kind, text, formula): stored cells of spreadsheets by patterns over the raw sheet XML, in the JVM.

    Shared strings join by position; so this route shares no parsing with the reader.
    """
    xml = parts(files, r"^xl/(?:worksheets/[^/]+|sharedStrings)\.xml$")
    one = r"(?s)<c\s[^>]*?(?:/>|>.*?</c>)"
    each = xml.where(F.col("part") != "xl/sharedStrings.xml").select("path", "part", F.explode(F.regexp_extract_all("xml", F.lit(one), F.lit(0))).alias("c"))
    got = lambda p: F.regexp_extract("c", p, 1)
    value = F.when(F.col("c").rlike(r"<v[ >]"), md.xml_unescape(got(r"(?s)<v(?:\s[^>]*)?>(.*?)</v>")))
    formula = F.when(F.col("c").rlike("<f[ >]"), md.xml_unescape(got(r"(?s)<f(?:\s[^>]*)?>(.*?)</f>")))
    raw = each.select("path", "part", got(r'\sr="([A-Z]+[0-9]+)"').alias("ref"), got(r'\st="(\w+)"').alias("kind"), value.alias("v"), formula.alias("formula"), md.xml_unescape(F.array_join(F.regexp_extract_all("c", F.lit(r"(?s)<t(?:\s[^>]*)?>(.*?)</t>"), F.lit(1)), "")).alias("own"))
    item = xml.where(F.col("part") == "xl/sharedStrings.xml").select("path", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<si(?:\s[^>]*)?>(.*?)</si>"), F.lit(1))).alias("k", "si"))
    plain = F.regexp_replace("si", r"(?s)<rPh\b.*?</rPh>", "")
    item = item.select("path", F.col("k").alias("at"), md.xml_unescape(F.array_join(F.regexp_extract_all(plain, F.lit(r"(?s)<t(?:\s[^>]*)?>(.*?)</t>"), F.lit(1)), "")).alias("shared"))
    raw = raw.withColumn("at", F.when(F.col("kind") == "s", F.expr("try_cast(v AS int)")))
    number = F.expr("try_cast(v AS double)")
    whole = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < 1e15)
    text = (
        F.when(F.col("kind") == "s", F.col("shared")).when(F.col("kind") == "inlineStr", F.col("own")).when(F.col("kind") == "b", F.when(F.col("v") == "1", "TRUE").otherwise("FALSE"))
        .when(F.col("kind").isin("e", "str", "d"), F.col("v")).when(whole, md.number_text(number)).otherwise(F.col("v"))
    )
    return raw.join(item, ["path", "at"], "left").select("path", "part", "ref", "kind", text.alias("text"), "formula")


def delimited(files: DataFrame, encoding: str | None = None) -> DataFrame:
    """(path, text) of every filled cell and row number of delimited files, as a table shows them.

    A second tokeniser: patterns in the JVM over the decoded text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    text = plain.decode(content or b"", encoding)[0]
                except Unreadable:  # has its event already
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.string())], names=["path", "text"])

    some = files.where(extension(F.col("path")).isin(*DELIMITED)).select("path", "content").mapInArrow(run, "path string, text string").where("text <> ''")
    whole = F.concat(F.lit("\n"), F.regexp_replace("text", r"(?:\r\n|\r|\n)\z", ""))
    tokens = lambda sep: F.regexp_extract_all(whole, F.lit(rf'(?s)(?:\r\n|[\r\n{sep}])(?:"[^"]*+(?:""[^"]*+)*+(?:"|\z))?+[^\r\n{sep}]*+'), F.lit(0))
    token = some.select("path", F.when(extension(F.col("path")) == "tsv", tokens(r"\t")).otherwise(tokens(",")).alias("tokens"))
    rows = F.size(F.filter("tokens", lambda t: t.rlike(r"^[\r\n]")))
    bare = F.regexp_replace("t", r"^(?:\r\n|.|[\r\n])", "")
    quoted = F.replace(F.regexp_replace(bare, r'(?s)^"([^"]*+(?:""[^"]*+)*+)(?:"|\z)', "$1"), F.lit('""'), F.lit('"'))
    cell = F.when(bare.startswith('"'), quoted).otherwise(bare)
    for seen, shown in (("\\", "\\\\"), ("|", "\\|"), ("\r\n", "\n"), ("\n", "<br>")):
        cell = F.replace(cell, F.lit(seen), F.lit(shown))
    filled = token.select("path", F.explode("tokens").alias("t")).select("path", cell.alias("text")).where(md.strip(F.col("text")) != "")
    numbers = token.select("path", F.explode(F.sequence(F.lit(1), rows).cast("array<string>")).alias("text"))
    return filled.unionByName(numbers).select("path", F.concat(F.lit(" "), F.col("text"), F.lit(" |")).alias("text"))


def evidence(files: DataFrame, encoding: str | None = None) -> DataFrame:
    """(path, text, n): the counted inventory of texts by path B."""
    xml = parts(files, EVIDENCE_PARTS).where(~F.col("part").startswith("Preview/"))
    node = xml.select("path", F.explode(F.regexp_extract_all("xml", F.lit(_NODE), F.lit(2))).alias("raw"))
    piece = node.select("path", F.explode(F.split("raw", "<[^>]*>")).alias("raw")).select("path", md.xml_unescape(F.col("raw")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, t) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in _texts_of(p, c or b"")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["path", "text"])

    flat = files.where(extension(F.col("path")).isin("hwp", "xls", *TEXT)).select("path", "content").mapInArrow(run, "path string, text string")
    stored = cells(files).select("path", F.explode(F.array("text", "formula")).alias("text"))
    every = piece.unionByName(flat).unionByName(stored).unionByName(delimited(files, encoding)).where(F.col("text").isNotNull()).where(md.strip(F.col("text")) != "")
    return every.groupBy("path", "text").agg(F.count("*").alias("n"))


def assets(elements: DataFrame) -> DataFrame:
    """(path, name, sha256, data): the pictures and other parts that a document's text points to."""
    a = elements.where("kind = 'asset'")
    return a.select("path", F.col("text").alias("name"), F.col("attrs")["sha256"].alias("sha256"), "data")


def convert(files: DataFrame, limits: Limits = Limits(), encoding: str | None = None) -> DataFrame:
    """One row per file: path, fmt, status, markdown, warnings, lost, kinds, n_assets."""
    from doclattice.session import cut

    return judged(files, cut(extract(files, limits, encoding)), limits, encoding)  # read once, used for text and for events


def judged(files: DataFrame, e: DataFrame, limits: Limits = Limits(), encoding: str | None = None) -> DataFrame:
    """The results of files whose elements are at hand: rendered, reconciled with the second route, and given their status."""
    from doclattice.session import cut

    e = e.withColumn("block", block())
    body = e.groupBy("path").agg(
        assemble.joined("block", "ord").alias("body"), F.count_if(F.col("kind") == "asset").alias("n_assets"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isin("event", "warning"), F.col("text")))).alias("warnings"),
    )
    empty = F.array().cast("array<string>")  # a file without elements has its row as well
    body = files.select("path").distinct().join(body, "path", "left").select("path", F.coalesce("body", F.lit("")).alias("body"), F.coalesce("n_assets", F.lit(0)).cast("bigint").alias("n_assets"), F.coalesce("warnings", empty).alias("warnings"))
    head = md.header_block(F.element_at(F.split("path", "/"), -1), extension(F.col("path")), CONVERTER)
    out = body.withColumn("markdown", F.concat(head, F.lit("\n\n"), F.col("body")))
    out = out.withColumn("markdown", F.when(extension(F.col("path")) == "md", F.col("body")).otherwise(F.col("markdown")))
    wanted = cut(evidence(files, encoding))
    lost = verify.report(verify.shortfall(wanted, out.select("path", "markdown"), "path", "text"), "path", "text").drop("samples")
    events = e.where("kind = 'event'").select("path", F.col("attrs")["status"].alias("status"))
    events = events.unionByName(lost.select("path", F.lit("partial").alias("status")))
    proven = wanted.select("path").distinct()
    events = events.unionByName(out.select("path").join(proven, "path", "left_anti").select("path", F.lit("unverified").alias("status")))
    status = verify.worst(events, "path").select("path", "status")
    return out.join(status, "path", "left").join(lost, "path", "left").select(
        "path", extension(F.col("path")).alias("fmt"), F.coalesce("status", F.lit("success")).alias("status"), "markdown", "warnings",
        F.coalesce("lost", F.lit(0)).cast("bigint").alias("lost"), F.coalesce("kinds", F.lit(0)).cast("bigint").alias("kinds"), "n_assets",
    )


def write(results: DataFrame, out: str) -> None:
    """The result table, complete and incomplete documents in folders of their own."""
    results.withColumn("complete", F.col("status") == "success").write.mode("overwrite").partitionBy("complete").parquet(out)
