"""Queries of the conversion run: text functions, reconciliation, status, tables, windows; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from doclattice.functions import markdown as md
from doclattice.operators import assemble, verify
from doclattice.session import table
from doclattice.streaming import ingest

CONVERTER = "doclattice/1.0"


def _docs(spark, d):
    """Documents with marks mixed in by id, so that the escapes have something to do."""
    t = F.col("text")
    k = F.col("doc_id") % 6
    mixed = (
        F.when(k == 0, F.replace(t, F.lit("\n"), F.lit("\r\n"))).when(k == 1, F.replace(t, F.lit("\n"), F.lit("\r")))
        .when(k == 2, F.concat(F.lit("# a|b\\c\n  - "), t)).when(k == 3, F.concat(F.lit("```x``` **b** ~~c~~ <br>\n1) "), t))
        .when(k == 4, F.concat(F.lit("<span style=\"color:#F00\">"), t, F.lit("</span>\t`````"))).otherwise(t)
    )
    return table(spark, d, "documents").select("doc_id", mixed.alias("t"))


_MIXED = r"""(SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 1 THEN replace(text, chr(10), chr(13))
    WHEN 2 THEN '# a|b\c' || chr(10) || '  - ' || text WHEN 3 THEN '```x``` **b** ~~c~~ <br>' || chr(10) || '1) ' || text
    WHEN 4 THEN '<span style="color:#F00">' || text || '</span>' || chr(9) || '`````' ELSE text END AS t FROM documents)"""

_NORM = r"regexp_replace(replace(replace(replace(regexp_replace(regexp_replace({0}, '</?span[^>]*>', '', 'g'), '<br\s*/?>', chr(10), 'g'), '~~', ''), '**', ''), '`', ''), '\\(.)', '\1', 'g')"
_STRIP = r"regexp_replace({0}, '^[\s\x0b\x1c-\x1f\x85\xa0\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x0b\x1c-\x1f\x85\xa0\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"


def _scalar(column):
    return lambda spark, d: _docs(spark, d).select("doc_id", column(F.col("t")).alias("out"))


def _scalar_sql(expr: str) -> str:
    return f"SELECT doc_id, {expr} AS out FROM {_MIXED}"


# ------------------------------------------------------------------------------- documents
def verify_documents(spark, d):
    """Each document rendered as a fenced block; the rendering of every seventh has its repeated lines removed. What is lost, and the status."""
    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", md.to_lf(F.col("text")).alias("text"))
    shown = F.when(F.col("doc_id") % 7 == 0, F.array_join(F.array_distinct(F.split("text", "\n")), "\n")).otherwise(F.col("text"))
    fence = md.fence_for(F.col("text"))
    out = docs.select("doc_id", F.concat(fence, F.lit("text\n"), shown, F.lit("\n"), fence).alias("markdown"))
    lost = verify.report(verify.shortfall(verify.evidence_of(docs), out, "doc_id"), "doc_id")
    return docs.select("doc_id").join(lost.select("doc_id", "lost", "kinds"), "doc_id", "left").select(
        "doc_id", F.coalesce("lost", F.lit(0)).cast("bigint").alias("lost"), F.coalesce("kinds", F.lit(0)).cast("bigint").alias("kinds"),
        F.when(F.col("lost") > 0, "partial").otherwise("success").alias("status"),
    )


_VERIFY_DOCUMENTS = f"""
WITH docs AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents WHERE text <> ''),
lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM docs),
numbered AS (SELECT doc_id, line, pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs)),
firsts AS (SELECT doc_id, line, min(pos) AS pos FROM numbered GROUP BY 1, 2),
shown AS (SELECT d.doc_id, CASE WHEN d.doc_id % 7 = 0 THEN (SELECT string_agg(f.line, chr(10) ORDER BY f.pos) FROM firsts f WHERE f.doc_id = d.doc_id) ELSE d.text END AS body, d.text FROM docs d),
fenced AS (SELECT doc_id, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) + 1)) AS f, body FROM shown),
out AS (SELECT doc_id, f || 'text' || chr(10) || body || chr(10) || f AS m FROM fenced),
normed AS (SELECT doc_id, m, {_NORM.format('m')} AS norm FROM out),
wanted AS (SELECT doc_id, line, count(*) AS n FROM lines WHERE {_STRIP.format('line')} <> '' GROUP BY 1, 2),
counted AS (SELECT w.doc_id, w.n, w.line, greatest((length(m) - length(replace(m, line, ''))) // length(line), (length(norm) - length(replace(norm, line, ''))) // length(line)) AS direct,
    norm, {_NORM.format('line')} AS same FROM wanted w JOIN normed USING (doc_id)),
got AS (SELECT doc_id, n, CASE WHEN direct > 0 THEN direct WHEN {_STRIP.format('same')} <> '' THEN (length(norm) - length(replace(norm, same, ''))) // length(same) ELSE 0 END AS got FROM counted),
lost AS (SELECT doc_id, sum(n - got) AS lost, count(*) AS kinds FROM got WHERE got < n GROUP BY 1)
SELECT doc_id, CAST(coalesce(lost, 0) AS BIGINT) AS lost, CAST(coalesce(kinds, 0) AS BIGINT) AS kinds, CASE WHEN lost > 0 THEN 'partial' ELSE 'success' END AS status
FROM docs LEFT JOIN lost USING (doc_id)"""


def reconcile_evidence(spark, d):
    """Evidence of the source bytes against each document's latest result: what is short, per document."""
    r = table(spark, d, "results").where("markdown is not null")
    last = r.groupBy("doc_id").agg(F.max_by("markdown", F.struct("finished_at", "res_id")).alias("markdown"))
    e = table(spark, d, "evidence").where("text is not null and n > 0").select("doc_id", "text", "n").distinct()
    e = e.groupBy("doc_id", "text").agg(F.max("n").alias("n")).where(md.strip(F.col("text")) != "")
    return verify.report(verify.shortfall(e, last, "doc_id", "text"), "doc_id", "text").drop("samples")


_RECONCILE = f"""
WITH r AS (SELECT doc_id, markdown AS m FROM results WHERE markdown IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY finished_at DESC NULLS LAST, res_id DESC) = 1),
w AS (SELECT doc_id, text AS line, max(n) AS n FROM evidence WHERE text IS NOT NULL AND n > 0 AND {_STRIP.format('text')} <> '' GROUP BY 1, 2),
c AS (SELECT doc_id, n, line, m, {_NORM.format('m')} AS norm, {_NORM.format('line')} AS same FROM w JOIN r USING (doc_id)),
g AS (SELECT doc_id, n, greatest((length(m) - length(replace(m, line, ''))) // length(line), (length(norm) - length(replace(norm, line, ''))) // length(line)) AS direct, norm, same FROM c),
h AS (SELECT doc_id, n, CASE WHEN direct > 0 THEN direct WHEN {_STRIP.format('same')} <> '' THEN (length(norm) - length(replace(norm, same, ''))) // length(same) ELSE 0 END AS got FROM g)
SELECT doc_id, CAST(sum(n - got) AS BIGINT) AS lost, count(*) AS kinds FROM h WHERE got < n GROUP BY 1"""


# ------------------------------------------------------------------------------- status
def status_lattice(spark, d):
    return verify.worst(table(spark, d, "status_events").distinct(), "doc_id")


_RANK = "CASE status WHEN 'success' THEN 0 WHEN 'unverified' THEN 1 WHEN 'partial' THEN 2 WHEN 'unsupported' THEN 3 WHEN 'skipped' THEN 3 WHEN 'failed' THEN 4 ELSE 0 END"
_WORST = f"""SELECT doc_id, status, CAST(r AS INTEGER) AS severity, n_events FROM
    (SELECT doc_id, status, {_RANK} AS r, count(*) OVER (PARTITION BY doc_id) AS n_events, row_number() OVER (PARTITION BY doc_id ORDER BY {_RANK} DESC, status) AS k
     FROM (SELECT DISTINCT * FROM status_events) WHERE status IS NOT NULL) WHERE k = 1"""


def batch_summary(spark, d):
    files = verify.distinct_files(table(spark, d, "source_files")).select("doc_id", "root_id")
    return verify.summary(files.join(status_lattice(spark, d), "doc_id"), "root_id")


_SUMMARY = f"""
WITH f AS (SELECT doc_id, root_id FROM source_files QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at NULLS LAST, rel_path NULLS FIRST, sha256 NULLS FIRST) = 1), s AS ({_WORST})
SELECT root_id, count(*) AS n, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in verify.RANK)},
    bool_and(status IN ('success', 'skipped')) AS complete, CAST(max(CASE WHEN status IN ('success', 'skipped') THEN 0 ELSE 1 END) AS INTEGER) AS exit_code
FROM f JOIN s USING (doc_id) GROUP BY root_id"""


def reuse_cache(spark, d):
    """Files whose bytes an earlier finished run has converted under the same path."""
    files = table(spark, d, "source_files").where("sha256 is not null").select("doc_id", "rel_path", "sha256", "modified_at").distinct()
    done = table(spark, d, "results").where("status = 'success'").select("doc_id").distinct()
    manifest = files.join(done, "doc_id", "left_semi").select("rel_path", "sha256").distinct()
    return verify.reusable(files, manifest).select("doc_id", "rel_path").distinct()


_REUSE = """SELECT DISTINCT f.doc_id, f.rel_path FROM source_files f WHERE sha256 IS NOT NULL AND EXISTS (SELECT 1 FROM source_files g WHERE g.sha256 IS NOT NULL AND g.rel_path = f.rel_path
    AND g.sha256 = f.sha256 AND g.doc_id IN (SELECT doc_id FROM results WHERE status = 'success'))"""


def output_conflict(spark, d):
    """Outputs of finished results that stand in another root under the same path already."""
    files = verify.distinct_files(table(spark, d, "source_files")).where("rel_path is not null")
    first = files.groupBy("rel_path").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    return files.join(first.where("n > 1").select("rel_path", F.col("doc_id").alias("holder")), "rel_path").where("doc_id <> holder").select("doc_id", "rel_path", "holder")


_CONFLICT = """WITH f AS (SELECT doc_id, rel_path FROM source_files QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at NULLS LAST, rel_path NULLS FIRST, sha256 NULLS FIRST) = 1),
h AS (SELECT rel_path, min(doc_id) AS holder FROM f WHERE rel_path IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, rel_path, holder FROM f JOIN h USING (rel_path) WHERE doc_id <> holder"""


def stale_artifacts(spark, d):
    """Results that a later result of the same document has replaced."""
    r = table(spark, d, "results").select("res_id", "doc_id", "finished_at")
    kept = r.groupBy("doc_id").agg(F.max_by("res_id", F.struct("finished_at", "res_id")).alias("res_id"))
    return r.join(kept.select("res_id"), "res_id", "left_anti").select("res_id", "doc_id")


_STALE = "SELECT res_id, doc_id FROM results QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY finished_at DESC NULLS LAST, res_id DESC) > 1"


# ------------------------------------------------------------------------------- formats
def format_of(spark, d):
    """Files per route of conversion; the extension in any case, with or without its dot."""
    ext = F.lower(F.ltrim(F.trim("ext"), F.lit(".")))
    route = (
        F.when(ext.isin("txt", "md", "markdown", "log"), "text").when(ext.isin("csv", "tsv"), "csv").when(ext.isin("png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif", "webp"), "image")
        .when(ext.isin("doc", "dot", "rtf", "odt", "wps", "xls", "ods", "ppt", "odp"), "legacy").when(ext.isin("docx", "xlsx", "hwpx", "hwp", "pptx", "pdf"), ext).otherwise("unsupported")
    )
    return table(spark, d, "source_files").groupBy(route.alias("route")).agg(F.count("*").alias("n_files"), F.countDistinct("doc_id").alias("n_docs"), F.sum("byte_length").alias("bytes"))


_FORMAT = """WITH f AS (SELECT *, lower(ltrim(trim(ext), '.')) AS e FROM source_files)
SELECT CASE WHEN e IN ('txt','md','markdown','log') THEN 'text' WHEN e IN ('csv','tsv') THEN 'csv' WHEN e IN ('png','jpg','jpeg','tif','tiff','bmp','gif','webp') THEN 'image'
    WHEN e IN ('doc','dot','rtf','odt','wps','xls','ods','ppt','odp') THEN 'legacy' WHEN e IN ('docx','xlsx','hwpx','hwp','pptx','pdf') THEN e ELSE 'unsupported' END AS route,
    count(*) AS n_files, count(DISTINCT doc_id) AS n_docs, CAST(sum(byte_length) AS BIGINT) AS bytes FROM f GROUP BY 1"""

_MAGIC = ["504B0304", "D0CF11E0A1B11AE1", "25504446", "89504E47", "FFD8FF", "7B5C7274"]


def detect_format(spark, d):
    """What the first bytes say, against what the name says."""
    head = F.element_at(F.array(*(F.lit(m) for m in _MAGIC)), (F.col("doc_id") % 6 + 1).cast("int"))
    b = F.unhex(head)
    real = F.when(F.hex(F.substring(b, 1, 4)) == "504B0304", "zip").when(F.hex(F.substring(b, 1, 8)) == "D0CF11E0A1B11AE1", "hwp").when(F.hex(F.substring(b, 1, 4)) == "25504446", "pdf").otherwise("other")
    ext = F.lower(F.ltrim(F.trim("ext"), F.lit(".")))
    files = table(spark, d, "source_files").select("doc_id", ext.alias("e"), real.alias("real")).distinct()
    return files.select("doc_id", "real", (F.col("e").isin("docx", "xlsx", "hwpx", "pptx") & (F.col("real") != "zip")).alias("mismatch"))


_DETECT = f"""SELECT DISTINCT doc_id, CASE doc_id % 6 WHEN 0 THEN 'zip' WHEN 1 THEN 'hwp' WHEN 2 THEN 'pdf' ELSE 'other' END AS real,
    (lower(ltrim(trim(ext), '.')) IN ('docx','xlsx','hwpx','pptx') AND doc_id % 6 <> 0) AS mismatch FROM source_files"""


def size_guard(spark, d):
    return table(spark, d, "source_files").where(F.col("byte_length") > 5_000_000).groupBy("root_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("byte_length").alias("largest"))


def zip_limits(spark, d):
    """Files of each root, in order of path, while their bytes together stay under a cap."""
    files = verify.distinct_files(table(spark, d, "source_files")).where("root_id is not null").select("doc_id", "root_id", "byte_length")
    kept = assemble.within_cap(files, "root_id", ["doc_id"], "byte_length", 50_000_000)
    return kept.select("doc_id", "root_id", "running")


_ZIP = """WITH f AS (SELECT doc_id, root_id, byte_length FROM source_files QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at NULLS LAST, rel_path NULLS FIRST, sha256 NULLS FIRST) = 1)
SELECT doc_id, root_id, running FROM (SELECT doc_id, root_id, CAST(sum(byte_length) OVER (PARTITION BY root_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM f WHERE root_id IS NOT NULL) WHERE running <= 50000000"""


# ------------------------------------------------------------------------------- pages
def pdf_stats(spark, d):
    p = table(spark, d, "pdf_pages")
    return p.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.sum("codes").alias("codes"), F.sum("unmapped").alias("unmapped"), F.sum(F.length("text")).cast("bigint").alias("chars"),
        F.count_if(F.coalesce(md.strip(F.col("text")), F.lit("")) == "").alias("empty_pages"), F.max(F.when(F.coalesce("unmapped", F.lit(0)) > 0, "partial").otherwise("unverified")).alias("_x"),
    ).select("doc_id", "pages", "codes", "unmapped", "chars", "empty_pages", F.when(F.coalesce("unmapped", F.lit(0)) > 0, "partial").otherwise("unverified").alias("status"))


_PDF = f"""SELECT doc_id, count(*) AS pages, CAST(sum(codes) AS BIGINT) AS codes, CAST(sum(unmapped) AS BIGINT) AS unmapped, CAST(sum(length(text)) AS BIGINT) AS chars,
    count(*) FILTER (WHERE coalesce({_STRIP.format('text')}, '') = '') AS empty_pages, CASE WHEN coalesce(sum(unmapped), 0) > 0 THEN 'partial' ELSE 'unverified' END AS status FROM pdf_pages GROUP BY 1"""


def unmapped_codes(spark, d):
    """The fifty most frequent codes without a character of each document."""
    p = table(spark, d, "pdf_pages").select("doc_id", F.explode("unmapped_codes").alias("code", "n"))
    return assemble.top_n(p.groupBy("doc_id", "code").agg(F.sum("n").alias("n")), ["doc_id"], [F.desc("n"), F.asc("code")], 50)


_CODES = """WITH u AS (SELECT doc_id, unnest(map_entries(unmapped_codes)) AS e FROM pdf_pages), g AS (SELECT doc_id, e.key AS code, CAST(sum(e.value) AS BIGINT) AS n FROM u GROUP BY 1, 2)
SELECT doc_id, code, n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) AS place FROM g) WHERE place <= 50"""


def page_markdown(spark, d):
    """Pages of each document in order, as one text."""
    block = F.concat(F.lit("## 페이지 "), F.col("page_no").cast("string"), F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit("\n\n"), F.col("text"))).otherwise(""))
    p = table(spark, d, "pdf_pages").withColumn("block", block)
    return p.groupBy("doc_id").agg(F.md5(assemble.joined("block", "page_no")).alias("digest"), F.count("*").alias("n_pages"))


_PAGES = """SELECT doc_id, md5(string_agg('## 페이지 ' || page_no || CASE WHEN coalesce(text, '') <> '' THEN chr(10) || chr(10) || text ELSE '' END, chr(10) || chr(10) ORDER BY page_no)) AS digest, count(*) AS n_pages FROM pdf_pages GROUP BY 1"""


# ------------------------------------------------------------------------------- tables
def csv_table(spark, d):
    """Ragged rows of each nation's customers as one Markdown table with row and column numbers."""
    c = table(spark, d, "customer")
    row = F.when(F.col("c_custkey") % 5 == 0, F.array("c_name")).otherwise(F.array("c_name", F.concat("c_mktsegment", F.lit("|\n")), F.col("c_custkey").cast("string")))
    g = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("o"), row.alias("r")))).alias("rows"))
    return g.select("c_nationkey", assemble.numbered_table(F.transform("rows", lambda x: x["r"])).alias("out"))


_CSV = r"""
WITH r AS (SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 5 = 0 THEN [c_name] ELSE [c_name, c_mktsegment || '\|<br>', CAST(c_custkey AS VARCHAR)] END AS cells FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, max(len(cells)) OVER (PARTITION BY c_nationkey) AS w FROM r),
t AS (SELECT c_nationkey, any_value(w) AS w, list(DISTINCT len(cells)) AS ws, string_agg('| ' || k || ' | ' || array_to_string(list_concat(cells, list_transform(range(w - len(cells)), lambda i: '')), ' | ') || ' |', chr(10) ORDER BY k) AS body FROM n GROUP BY 1)
SELECT c_nationkey, '| 행 | ' || array_to_string(list_transform(range(1, w + 1), lambda i: '열' || i), ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(range(w + 1), lambda i: '---'), ' | ') || ' |' || chr(10) || body
    || CASE WHEN len(ws) > 1 THEN chr(10) || chr(10) || '> 행마다 열 수가 다르다(' || array_to_string(list_sort(ws), ', ') || ')' ELSE '' END AS out FROM t"""


def xl_values(spark, d):
    li = table(spark, d, "lineitem")
    k = F.col("l_orderkey") % 5
    kind = F.when(k == 0, "n").when(k == 1, "s").when(k == 2, "b").when(k == 3, "e")
    out = md.value_text(kind, F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("l_shipmode") if "l_shipmode" in li.columns else F.col("l_returnflag")), F.col("l_quantity"), F.col("l_linenumber") % 2 == 0)
    return li.groupBy(kind.alias("kind"), out.alias("shown")).agg(F.count("*").alias("n"))


_VALUES = """WITH v AS (SELECT CASE l_orderkey % 5 WHEN 0 THEN 'n' WHEN 1 THEN 's' WHEN 2 THEN 'b' WHEN 3 THEN 'e' END AS kind, * FROM lineitem)
SELECT kind, CASE kind WHEN 'n' THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 's' THEN CASE WHEN l_linenumber = 1 THEN '[빈 문자열]' ELSE l_returnflag END
    WHEN 'b' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END WHEN 'e' THEN CASE WHEN l_linenumber = 1 THEN '' ELSE l_returnflag END ELSE '' END AS shown, count(*) AS n FROM v GROUP BY 1, 2"""


def xl_serial(spark, d):
    return table(spark, d, "orders").select("o_orderkey", md.serial_date(F.col("o_orderdate")).alias("serial"))


def xl_columns(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 18_278 + 1).cast("int").alias("n"))
    return p.select("p_partkey", "n", md.column_letters(F.col("n")).alias("letters")).withColumn("back", md.column_number(F.col("letters")))


_COLUMNS = """SELECT p_partkey, CAST(n AS INTEGER) AS n, CASE WHEN n > 702 THEN chr(CAST(65 + ((n - 703) // 676) % 26 AS INTEGER)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(65 + ((n - 27) // 26) % 26 AS INTEGER)) ELSE '' END
    || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) AS letters, CAST(n AS INTEGER) AS back FROM (SELECT p_partkey, p_partkey % 18278 + 1 AS n FROM part)"""


def formula_shapes(spark, d):
    li = table(spark, d, "lineitem")
    f = F.concat(F.lit("= sum($a"), F.col("l_linenumber").cast("string"), F.lit(":B"), (F.col("l_orderkey") % 97).cast("string"), F.lit(") * "), F.when(F.col("l_linenumber") == 2, "C$7").otherwise("max(1, d2)"))
    return li.groupBy(md.formula_shape(f).alias("shape")).agg(F.count("*").alias("n"))


_SHAPES = r"""SELECT CASE WHEN l_linenumber = 2 THEN 'SUM(@:@)*@' ELSE 'SUM(@:@)*MAX(1,@)' END AS shape, count(*) AS n FROM lineitem GROUP BY 1"""


def table_mode(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n_rows"), F.countDistinct("c_mktsegment").alias("width"))
    return c.withColumn("mode", F.when((F.col("width") > 12) | (F.col("n_rows") > 200), "tsv").otherwise("md"))


def merged_leftovers(spark, d):
    """Cells hidden below merged ranges: suppliers as cells of a grid per nation, ranges by nation."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("sheet"), (F.col("s_suppkey") % 20).cast("int").alias("row"), (F.col("s_suppkey") % 7).cast("int").alias("col"), F.col("s_name").alias("value"))
    m = table(spark, d, "nation").select(F.col("n_nationkey").alias("sheet"), (F.col("n_nationkey") % 5).cast("int").alias("row_lo"), (F.col("n_nationkey") % 5 + 8).cast("int").alias("row_hi"), F.lit(1).alias("col_lo"), F.lit(4).alias("col_hi"))
    return assemble.leftovers(s, m, ["sheet"])


_MERGED = """SELECT s_nationkey AS sheet, CAST(s_suppkey % 20 AS INTEGER) AS "row", CAST(s_suppkey % 7 AS INTEGER) AS col, s_name AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE s_suppkey % 20 BETWEEN n_nationkey % 5 AND n_nationkey % 5 + 8 AND s_suppkey % 7 BETWEEN 1 AND 4 AND NOT (s_suppkey % 20 = n_nationkey % 5 AND s_suppkey % 7 = 1) AND s_name IS NOT NULL"""


def cell_reconcile(spark, d):
    """Cells read by one route against cells read by another: same, mismatched (beyond 1e-9) or missing."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("l_extendedprice"))
    other = li.where("l_orderkey % 11 <> 0").withColumn("seen", F.when(F.col("l_orderkey") % 13 == 0, F.col("l_extendedprice") + 0.01).otherwise(F.col("l_extendedprice") + 1e-12)).drop("l_extendedprice")
    j = li.join(other, ["l_orderkey", "l_linenumber"], "left")
    what = F.when(F.col("seen").isNull(), "missing").when(F.abs(F.col("seen") - F.col("l_extendedprice")) > 1e-9 * F.greatest(F.lit(1.0), F.abs("l_extendedprice")), "mismatch").otherwise("same")
    return j.groupBy("l_linenumber", what.alias("outcome")).agg(F.count("*").alias("n"))


_CELLS = """SELECT l_linenumber, CASE WHEN l_orderkey % 11 = 0 THEN 'missing' WHEN l_orderkey % 13 = 0 THEN 'mismatch' ELSE 'same' END AS outcome, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1, 2"""


def chart_pivot(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).select("l_returnflag", F.coalesce("F", F.lit(0)).alias("s_f"), F.coalesce("O", F.lit(0)).alias("s_o"))


def header_groups(spark, d):
    """As-of grouping: each state change under the last one of severity 2 or more at or before it."""
    e = table(spark, d, "status_events").where("logged_at is not null").groupBy("doc_id", "logged_at").agg(F.max("severity").alias("severity"))
    return assemble.latest_before(e, "doc_id", "logged_at", F.col("severity") >= 2, "logged_at", "under")


_HEADERS = """SELECT doc_id, logged_at, severity, last_value(CASE WHEN severity >= 2 THEN logged_at END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY logged_at ROWS UNBOUNDED PRECEDING) AS under
FROM (SELECT doc_id, logged_at, max(severity) AS severity FROM status_events WHERE logged_at IS NOT NULL GROUP BY 1, 2)"""


def ocr_largest(spark, d):
    """The three largest pictures of each nation, by area."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 25).cast("int").alias("page"), (F.col("p_size") * (F.col("p_partkey") % 40 + 1)).alias("area"))
    return assemble.top_n(p, ["page"], [F.desc("area"), F.asc("p_partkey")], 3).withColumn("area", F.col("area").cast("bigint"))


_OCR = """SELECT p_partkey, page, area, CAST(place AS INTEGER) AS place FROM (SELECT p_partkey, CAST(p_partkey % 25 AS INTEGER) AS page, CAST(p_size * (p_partkey % 40 + 1) AS BIGINT) AS area,
    row_number() OVER (PARTITION BY p_partkey % 25 ORDER BY p_size * (p_partkey % 40 + 1) DESC, p_partkey) AS place FROM part) WHERE place <= 3"""


def media_triage(spark, d):
    """Files of a root that no result shows: referenced by evidence, or orphans."""
    files = verify.distinct_files(table(spark, d, "source_files")).select("doc_id", "root_id")
    shown = table(spark, d, "results").where("markdown is not null").select("doc_id").distinct()
    named = table(spark, d, "evidence").select("doc_id").distinct().withColumn("named", F.lit(True))
    rest = files.join(shown, "doc_id", "left_anti").join(named, "doc_id", "left")
    return rest.select("doc_id", F.when(F.col("named"), "referenced").otherwise("orphan").alias("kind"))


_TRIAGE = """SELECT DISTINCT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM evidence WHERE doc_id IS NOT NULL) THEN 'referenced' ELSE 'orphan' END AS kind FROM source_files
WHERE doc_id NOT IN (SELECT doc_id FROM results WHERE markdown IS NOT NULL AND doc_id IS NOT NULL)"""


def split_rejoin(spark, d):
    parts = assemble.chunks(table(spark, d, "documents").select("doc_id", "text"), 1_200)
    back = parts.groupBy("doc_id").agg(F.md5(assemble.joined("chunk", "seq", "")).alias("digest"), (F.max(F.length("chunk")) <= 1_201).alias("fits"))
    return back


def asset_sha256(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


def evidence_profile(spark, d):
    """The bag of evidence per place found, with its most repeated text's count."""
    e = table(spark, d, "evidence").distinct()
    return e.groupBy("root_id", "found_in").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n"), F.max("n").alias("most"), F.countDistinct("doc_id").alias("n_docs"))


def status_windows(spark, d):
    return ingest.status_windows(table(spark, d, "status_events"))


def queries() -> dict:
    return {
        "status_windows": status_windows,
        "verify_documents": verify_documents, "reconcile_evidence": reconcile_evidence, "status_lattice": status_lattice, "batch_summary": batch_summary,
        "reuse_cache": reuse_cache, "output_conflict": output_conflict, "stale_artifacts": stale_artifacts, "format_of": format_of, "detect_format": detect_format,
        "size_guard": size_guard, "zip_limits": zip_limits, "pdf_stats": pdf_stats, "unmapped_codes": unmapped_codes, "page_markdown": page_markdown,
        "csv_table": csv_table, "xl_values": xl_values, "xl_serial": xl_serial, "xl_columns": xl_columns, "formula_shapes": formula_shapes, "table_mode": table_mode,
        "merged_leftovers": merged_leftovers, "cell_reconcile": cell_reconcile, "chart_pivot": chart_pivot, "header_groups": header_groups, "ocr_largest": ocr_largest,
        "media_triage": media_triage, "split_rejoin": split_rejoin, "asset_sha256": asset_sha256, "evidence_profile": evidence_profile,
        "text_line_style": _scalar(md.line_style), "text_to_lf": _scalar(md.to_lf), "esc_inline": _scalar(md.esc_inline), "esc_block": _scalar(lambda c: md.esc_block(md.to_lf(c))),
        "esc_cell": _scalar(md.esc_cell), "cell_block": _scalar(lambda c: md.cell_block(md.to_lf(c))), "esc_tsv": _scalar(md.esc_tsv), "normalize_md": _scalar(md.normalize_md),
        "fence_for": _scalar(md.fence_for), "xml_round_trip": _scalar(lambda c: md.xml_unescape(md.xml_escape(c))),
        "text_fenced_markdown": _scalar(lambda c: F.concat(md.header_block(F.lit("a.txt"), F.lit("txt"), CONVERTER), F.lit("\n\n"), md.fence_for(c), F.lit("text\n"), md.to_lf(c), F.lit("\n"), md.fence_for(c))),
    }


_LF = "replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_FENCE = "repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 0) + 1))"


def oracle_sql() -> dict[str, str]:
    lf = _LF.format("t")
    inline = r"replace(replace(t, '\', '\\'), '|', '\|')"
    return {
        "status_windows": "SELECT time_bucket(INTERVAL 1 DAY, logged_at) AS day, status, count(*) AS n, max(severity) AS severity FROM (SELECT DISTINCT doc_id, status, logged_at, reason, place, any_value(severity) OVER (PARTITION BY doc_id, status, logged_at, reason, place) AS severity FROM status_events WHERE logged_at IS NOT NULL) GROUP BY 1, 2",
        "verify_documents": _VERIFY_DOCUMENTS, "reconcile_evidence": _RECONCILE, "status_lattice": _WORST, "batch_summary": _SUMMARY, "reuse_cache": _REUSE, "output_conflict": _CONFLICT,
        "stale_artifacts": _STALE, "format_of": _FORMAT, "detect_format": _DETECT,
        "size_guard": "SELECT root_id, count(DISTINCT doc_id) AS n_docs, max(byte_length) AS largest FROM source_files WHERE byte_length > 5000000 GROUP BY 1",
        "zip_limits": _ZIP, "pdf_stats": _PDF, "unmapped_codes": _CODES, "page_markdown": _PAGES, "csv_table": _CSV, "xl_values": _VALUES,
        "xl_serial": "SELECT o_orderkey, epoch_us(o_orderdate) / 86400e6 + 25569 AS serial FROM orders",
        "xl_columns": _COLUMNS, "formula_shapes": _SHAPES,
        "table_mode": "SELECT c_nationkey, count(*) AS n_rows, count(DISTINCT c_mktsegment) AS width, CASE WHEN count(DISTINCT c_mktsegment) > 12 OR count(*) > 200 THEN 'tsv' ELSE 'md' END AS mode FROM customer GROUP BY 1",
        "merged_leftovers": _MERGED, "cell_reconcile": _CELLS,
        "chart_pivot": "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS s_f, count(*) FILTER (WHERE l_linestatus = 'O') AS s_o FROM lineitem GROUP BY 1",
        "header_groups": _HEADERS, "ocr_largest": _OCR, "media_triage": _TRIAGE,
        "split_rejoin": "SELECT doc_id, md5(text) AS digest, true AS fits FROM documents WHERE text <> ''",
        "asset_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL",
        "evidence_profile": "SELECT root_id, found_in, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n, max(n) AS most, count(DISTINCT doc_id) AS n_docs FROM (SELECT DISTINCT * FROM evidence) GROUP BY 1, 2",
        "text_line_style": _scalar_sql("CASE WHEN contains(t, chr(13) || chr(10)) THEN 'CRLF' WHEN contains(t, chr(13)) THEN 'CR' WHEN t IS NOT NULL THEN 'LF' END"),
        "text_to_lf": _scalar_sql(lf), "esc_inline": _scalar_sql(inline), "esc_cell": _scalar_sql(f"replace({inline}, chr(10), '<br>')"),
        "esc_block": _scalar_sql(rf"regexp_replace({lf}, '(?m)^([ \t\f\v\r]*)([#>\-+*=]|\d+[.)]|\|)', '\1\\\2', 'g')"),
        "cell_block": _scalar_sql(rf"CASE WHEN regexp_matches({lf}, '(?m)^[ \t\f\v]*[|>]') THEN replace({lf}, chr(10), chr(10) || '    ') ELSE replace({lf}, chr(10), '<br>') END"),
        "esc_tsv": _scalar_sql(r"replace(replace(replace(replace(t, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r')"),
        "normalize_md": _scalar_sql(_NORM.format("t")), "fence_for": _scalar_sql(_FENCE), "xml_round_trip": _scalar_sql(lf),
        "text_fenced_markdown": _scalar_sql(f"'# a.txt' || chr(10) || chr(10) || '- 원본 형식: `txt`' || chr(10) || '- 변환기: `{CONVERTER}`' || chr(10) || chr(10) || {_FENCE} || 'text' || chr(10) || {lf} || chr(10) || {_FENCE}"),
    }
