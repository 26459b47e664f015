import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doclattice.functions import markdown as md
from doclattice.operators import assemble, verify


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("x")).head().x


def test_escapes(spark):
    assert one(spark, md.esc_inline, "a|b\\c") == "a\\|b\\\\c"
    assert one(spark, md.esc_block, "# a\n  - b\n1) c\nd # e\n|x") == "\\# a\n  \\- b\n\\1) c\nd # e\n\\|x"
    assert one(spark, md.esc_cell, "a\n|") == "a<br>\\|"
    assert one(spark, md.cell_block, "a\n| b") == "a\n    | b" and one(spark, md.cell_block, "a\nb") == "a<br>b"
    assert one(spark, md.normalize_md, '<span style="x">**a**</span>~~b~~<br>`c` \\|') == "ab\nc |"
    assert one(spark, md.fence_for, "```` `") == "`````" and one(spark, md.fence_for, "") == "```"
    assert one(spark, md.esc_tsv, "a\\\t\n\r") == "a\\\\\\t\\n\\r"
    assert one(spark, md.xml_unescape, "&lt;&#44032;&#xAC01;&amp;lt;&#38;amp;\r\n") == "<가각&lt;&amp;\n"
    assert one(spark, md.line_style, "a\rb") == "CR" and one(spark, md.to_lf, "a\r\nb\rc") == "a\nb\nc"


def test_nulls(spark):
    for f in (md.esc_inline, md.esc_block, md.esc_cell, md.normalize_md, md.esc_tsv, md.xml_unescape, md.line_style, md.to_lf, md.formula_shape):
        assert one(spark, f, None) is None


def test_numbers(spark):
    assert [one(spark, md.number_text, x, "double") for x in (1.0, 0.125, -3.0)] == ["1", "0.125", "-3"]
    assert one(spark, md.serial_date, datetime.datetime(2026, 9, 20), "timestamp") == 46285.0
    assert [one(spark, md.column_letters, n, "int") for n in (1, 26, 27, 702, 703, 18278)] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ"]
    assert one(spark, md.formula_shape, "=sum($A1:B$22) * c3") == "SUM(@:@)*@"
    assert [one(spark, md.heading_level, x) for x in ("개요 3", "제목 12", "본문", None)] == [3, 6, 0, 0]


def test_occurrences(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("가나가", "가"), ("x", ""), ("", "a")], "a string, b string")
    assert [r.n for r in df.select(md.occurrences(F.col("a"), F.col("b")).alias("n")).collect()] == [2, 2, 0, 0]


@settings(max_examples=200, deadline=None)
@given(st.text("ab\n", max_size=80), st.integers(1, 12))
def test_parts_join_to_the_body(body, limit):
    parts = assemble.split_text(body, limit)
    assert "".join(parts) == body and all(0 < len(p) <= limit + 1 for p in parts)


def test_unbroken_line_is_cut_by_size():
    assert [len(p) for p in assemble.split_text("x" * 2_501, 1_000)] == [1_000, 1_000, 501]


def test_status(spark):
    rows = [(1, "success"), (1, "partial"), (2, "unsupported"), (2, "skipped"), (3, "success"), (3, None), (4, None)]
    got = verify.worst(spark.createDataFrame(rows, "doc_id int, status string"), "doc_id")
    assert sorted((r.doc_id, r.status, r.severity) for r in got.collect()) == [(1, "partial", 2), (2, "skipped", 3), (3, "success", 0)]
    s = verify.summary(got.withColumn("b", F.lit(1)), "b").head()
    assert (s.n, s.n_partial, s.complete, s.exit_code) == (3, 1, False, 1)


def test_repeats_are_counted(spark):
    docs = spark.createDataFrame([(1, "가\n가\n가\n나"), (2, None), (3, "")], "doc_id int, text string")
    out = spark.createDataFrame([(1, "가 나")], "doc_id int, markdown string")
    got = verify.report(verify.shortfall(verify.evidence_of(docs), out, "doc_id"), "doc_id").collect()
    assert [(r.doc_id, r.lost, r.kinds, r.samples) for r in got] == [(1, 2, 1, ["가"])]


def test_table_of_ragged_rows(spark):
    df = spark.createDataFrame([([["a", "b|"], ["c"]],), ([],)], "r array<array<string>>")
    assert [x.t for x in df.select(assemble.numbered_table(F.col("r")).alias("t")).collect()] == ["| 행 | 열1 | 열2 |\n| --- | --- | --- |\n| 1 | a | b\\| |\n| 2 | c |  |\n\n> 행마다 열 수가 다르다(1, 2)", ""]
