import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from doclattice.model import Limits, Unreadable
from doclattice.sources import biff, convert, fixtures, hwp, pdf
from doclattice.sources.packages import Package, detect, resolve
from doclattice.sources.xlsx import Xlsx

LINES = ["첫 문단 | a\\b", "# 둘째", "가나다 <&> 한글"]


def texts(name, data, kind="para"):
    return [e.text for e in convert.elements_of(name, data) if e.kind == kind and "raw" not in e.attrs]


def events(name, data):
    return [e.attrs["status"] for e in convert.elements_of(name, data) if e.kind == "event"]


@pytest.mark.parametrize("fmt", ["docx", "pptx", "hwpx", "hwp"])
def test_text_formats(fmt):
    make = {"docx": fixtures.docx, "pptx": lambda x: fixtures.pptx([x]), "hwpx": lambda x: fixtures.hwpx([x]), "hwp": fixtures.hwp}[fmt]
    assert texts(f"a.{fmt}", make(LINES)) == ["첫 문단 \\| a\\\\b", *LINES[1:]]
    assert events(f"a.{fmt}", make(LINES)) == []


def test_order_is_that_of_the_package():
    assert texts("a.pptx", fixtures.pptx([["eins"], ["zwei"]], [2, 1])) == ["zwei", "eins"]
    assert texts("a.hwpx", fixtures.hwpx([["eins"], ["zwei"]], [1, 0])) == ["zwei", "eins"]


def test_docx_structure():
    w = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    body = (
        f'<w:p><w:pPr><w:pStyle w:val="H2"/></w:pPr>{w("제목")}</w:p>'
        f'<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr></w:pPr>{w("항목")}</w:p>'
        f'<w:p><w:ins><w:r><w:rPr><w:b/></w:rPr><w:t>새</w:t></w:r></w:ins><w:del><w:r><w:delText>옛</w:delText></w:r></w:del><w:r><w:footnoteReference w:id="2"/></w:r></w:p>'
        f'<w:tbl><w:tr><w:tc><w:p>{w("a")}</w:p></w:tc><w:tc><w:p>{w("b|c")}</w:p></w:tc></w:tr></w:tbl>'
        f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p>{w("넓다")}</w:p></w:tc></w:tr></w:tbl>'
        '<w:p><w:r><w:drawing><a:blip r:embed="i1"/></w:drawing></w:r></w:p>'
    )
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    extra = {
        "word/styles.xml": f'<w:styles {ns}><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {ns}><w:abstractNum w:abstractNumId="9"><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="9"/></w:num></w:numbering>',
        "word/footnotes.xml": f'<w:footnotes {ns}><w:footnote w:id="0" w:type="separator"><w:p>{w("x")}</w:p></w:footnote><w:footnote w:id="2"><w:p>{w("주석")}</w:p></w:footnote></w:footnotes>',
        "word/_rels/document.xml.rels": fixtures.rels(("i1", "image", "media/image1.png"), ("h", "header", "header1.xml")),
        "word/header1.xml": f'<w:hdr {ns}><w:p>{w("머리")}</w:p></w:hdr>',
        "word/media/image1.png": b"png",
    }
    got = list(convert.elements_of("a.docx", fixtures.docx([], extra, body)))
    by = lambda k: [e for e in got if e.kind == k]
    assert [(e.text, e.level) for e in by("heading")] == [("제목", 2), ("머리글: header1.xml", 2)]
    assert [(e.text, e.level, e.attrs["mark"]) for e in by("item")] == [("항목", 1, "1.")]
    assert by("para")[0].text == "{+삽입:**새**+}{-삭제:옛-}[^fn2]"
    assert "| a | b\\|c |" in by("table")[0].text and "열1" in by("table")[0].text
    assert by("table")[1].text == "- **R1C1** (가로병합 2칸): 넓다"
    assert [e.text for e in by("note")] == ["[^fn2]: 주석"]
    assert [e.text for e in by("asset")] == ["media/image1.png"]


def test_xlsx_values():
    book = fixtures.xlsx({"매출": [["이름", 1.0, True, 0], ["", 0.125, None, "a|b\n"]]})
    table = next(e.text for e in convert.elements_of("a.xlsx", book) if e.kind == "table")
    assert table.split("\n")[2:] == ["| 1 | 이름 | 1 | TRUE | 0 |", "| 2 | [빈 문자열] | 0.125 |  | a\\|b<br> |"]
    x = Xlsx(book, Limits(cells=2))
    assert [e.attrs["status"] for e in x.elements() if e.kind == "event"] == ["partial"]


def test_protected_and_broken():
    assert events("a.hwp", fixtures.hwp(LINES, flags=2)) == ["unsupported"]
    assert events("a.hwp", fixtures.hwp(LINES, version=0x03000000)) == ["unsupported"]
    assert events("a.docx", b"zzzz") == ["failed"]
    assert events("a.docx", fixtures.package({"word/document.xml": "<!DOCTYPE x><a/>"})) == ["failed"]
    assert events("a.pdf", fixtures.pdf([["x"]]) + b"/Encrypt 9 0 R") == ["unsupported"]
    assert events("a.xyz", b"") == ["unsupported"] and events("a.xls", b"") == ["unsupported"]
    assert events("a.txt", bytes.fromhex("FFFE00616263814 0FF".replace(" ", ""))) == ["failed"]
    with pytest.raises(Unreadable):
        Package(fixtures.package({"../../evil.xml": "x"}), Limits())
    with pytest.raises(Unreadable):
        Package(fixtures.package({"a": "x", "b": "y"}), Limits(zip_entries=1))


def test_wrong_suffix_goes_by_content():
    kinds = [e.kind for e in convert.elements_of("a.docx", fixtures.hwp(LINES))]
    assert kinds[0] == "warning" and "para" in kinds


def test_pdf():
    got = list(convert.elements_of("a.pdf", fixtures.pdf([["첫 줄", "둘째 줄"], []])))
    assert [e.text for e in got if e.kind == "para"] == ["첫 줄\n둘째 줄"]
    assert [e.attrs["status"] for e in got if e.kind == "event"] == ["unverified", "unverified"]
    assert pdf._ascii85(b"<~87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert pdf._runs(bytes([2, 65, 66, 67, 254, 68, 128])) == b"ABCDDD"
    assert pdf._unpredict(bytes([2, 1, 2, 2, 1, 1]), {"Predictor": 12, "Columns": 2}) == bytes([1, 2, 2, 3])


def test_detect_and_resolve():
    assert [detect(x) for x in (fixtures.docx(LINES), fixtures.pptx([LINES]), fixtures.hwpx([LINES]), fixtures.hwp(LINES), fixtures.pdf([LINES]), b"x")] == ["docx", "pptx", "hwpx", "hwp", "pdf", None]
    assert resolve("ppt/slides/slide1.xml", "../media/a.png") == "ppt/media/a.png" and resolve("a/b", "/ppt/c.xml") == "ppt/c.xml"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=32, max_codepoint=0xD7A3), min_size=1, max_size=3000).filter(str.strip), min_size=1, max_size=30))
def test_biff_strings_come_back(strings):
    data = fixtures.xls(strings, ["시트"])
    assert biff.strings(data) == strings and biff.sheet_names(data) == ["시트"]


def test_hwp_second_route():
    assert list(hwp.paragraph_texts(fixtures.hwp(LINES, packed=False))) == LINES


def test_convert_and_mutants(spark):
    from doclattice.operators import verify

    files = [(f"/{k}.{fmt}", make) for k, (fmt, make) in enumerate({"docx": fixtures.docx(LINES * 3), "hwpx": fixtures.hwpx([LINES]), "hwp": fixtures.hwp(LINES), "txt": "가\n나".encode("cp949"), "csv": b"a,b\n1", "pdf": fixtures.pdf([LINES]), "docx ": b"x", "png": b"x"}.items())]
    df = spark.createDataFrame([(p.strip(), c) for p, c in files], "path string, content binary")
    got = {r.path.rpartition(".")[2] + str(n): r for n, r in enumerate(sorted(convert.convert(df).collect(), key=lambda r: r.path))}
    assert [r.status for r in got.values()] == ["success", "success", "success", "success", "success", "unverified", "failed", "unverified"]
    assert got["docx0"].markdown.startswith("# 0.docx\n\n- 원본 형식: `docx`")
    ev = convert.evidence(df.where("path = '/0.docx'"))
    cut_out = spark.createDataFrame([("/0.docx", got["docx0"].markdown.replace("가나다", "", 1))], "path string, markdown string")
    lost = verify.report(verify.shortfall(ev, cut_out, "path", "text"), "path", "text").collect()
    assert [(r.lost, r.kinds) for r in lost] == [(1, 1)]


def test_stream_equals_batch(spark, tmp_path):
    from doclattice.streaming import ingest

    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.txt").write_bytes("가나다".encode())
    (folder / "b.docx").write_bytes(fixtures.docx(LINES))
    (folder / "c.unknown").write_bytes(b"")
    ingest.ingest(spark, str(folder), out).awaitTermination()
    one = {r.path.rpartition("/")[2]: (r.status, r.markdown) for r in spark.read.parquet(out + "/results").collect()}
    batch = {r.path.rpartition("/")[2]: (r.status, r.markdown) for r in convert.convert(convert.read(spark, str(folder))).collect()}
    assert one == batch and set(one) == {"a.txt", "b.docx"}
    (folder / "d.txt").write_bytes("새 글".encode())
    ingest.ingest(spark, str(folder), out).awaitTermination()
    assert spark.read.parquet(out + "/results").count() == 3


def test_refused_files_have_rows(spark, tmp_path):
    from doclattice.__main__ import main
    from doclattice.streaming import ingest

    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.txt").write_bytes("가나다".encode())
    (folder / "b.txt").write_bytes("가나다".encode() * 100)
    (folder / "c.unknown").write_bytes(b"x")
    limits = Limits(file_bytes=100)
    told = lambda df: {r.path.rpartition("/")[2]: r.status for r in df.collect()}
    assert told(convert.refused(spark, str(folder), True, limits)) == {"b.txt": "failed", "c.unknown": "unsupported"}
    ingest.ingest(spark, str(folder), out, limits).awaitTermination()
    assert told(ingest.outcome(spark, out)) == {"a.txt": "success", "b.txt": "failed", "c.unknown": "unsupported"}
    for k, more in enumerate(([], ["--reuse"])):
        assert main([str(folder), "--out", str(tmp_path / f"cli{k}"), *more]) == 1
    assert {x.name for x in (tmp_path / "cli0" / "_incomplete").iterdir() if x.suffix == ".md"} == {"c.unknown.md"}
    only = tmp_path / "only"
    only.mkdir()
    (only / "c.unknown").write_bytes(b"x")
    assert main([str(only), "--out", str(tmp_path / "cli2"), "--reuse"]) == 1


def test_cells_of_delimited_files_are_counted(spark):
    data = {"/a.csv": b'a,"b, ""c""\r\nd",1\r\n\r\n1,x|y\\z\r\n', "/b.tsv": "가\t나\n나\t1".encode("cp949"), "/c.csv": b"1,1\n1,1", "/d.csv": b'a,"open', "/e.docx": fixtures.docx([])}
    df = spark.createDataFrame(list(data.items()), "path string, content binary")
    told = lambda: {r.path: (r.status, r.lost) for r in convert.convert(df).collect()}
    assert told() == {"/a.csv": ("success", 0), "/b.tsv": ("success", 0), "/c.csv": ("success", 0), "/d.csv": ("success", 0), "/e.docx": ("unverified", 0)}
    want = {r.text: r.n for r in convert.evidence(df.where("path = '/c.csv'")).collect()}
    assert want == {" 1 |": 5, " 2 |": 1}
    out = spark.createDataFrame([("/c.csv", "| 행 | 열1 | 열2 |\n| --- | --- | --- |\n| 1 | 1 | 1 |\n| 2 | 1 |  |")], "path string, markdown string")
    from doclattice.operators import verify

    assert [(r.text, r.lost) for r in verify.shortfall(convert.evidence(df.where("path = '/c.csv'")), out, "path", "text").collect()] == [(" 1 |", 1)]


def test_a_batch_that_runs_again_keeps_its_rows(spark, tmp_path):
    from doclattice.streaming import ingest

    df = spark.createDataFrame([("/in/a.txt", "가나다".encode()), ("/in/b.txt", "라".encode())], "path string, content binary")
    for _ in range(2):
        ingest.write_batch(df, 0, str(tmp_path))
        assert spark.read.parquet(f"{tmp_path}/results").count() == 2
    ingest.write_batch(df, 1, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/results").count() == 2
    ingest.write_batch(df, 2, str(tmp_path), encoding="utf-8")  # other options, other results
    assert spark.read.parquet(f"{tmp_path}/results").count() == 4


def test_shared_formulas_move():
    from doclattice.sources.xlsx import shifted

    assert shifted('SUM(A1:B$2)*$C3&"A1"+\'A1 b\'!D4+LOG10(5)', 2, 1) == 'SUM(B3:C$2)*$C5&"A1"+\'A1 b\'!E6+LOG10(5)'
    assert shifted("A1", -1, 0) == "#REF!"


def _program(pairs, names=()):
    """A font program with a character map of segments, one a glyph, and glyph names."""
    import struct

    pairs = sorted(pairs)
    n = len(pairs) + 1
    cols = [*(c for c, _ in pairs), 0xFFFF], [*(c for c, _ in pairs), 0xFFFF], [*((g - c) & 0xFFFF for c, g in pairs), 1], [0] * n
    sub = struct.pack(">HHHHHHH", 4, 16 + 8 * n, 0, 2 * n, 0, 0, 0) + struct.pack(f">{n}H", *cols[0]) + b"\0\0" + b"".join(struct.pack(f">{n}H", *c) for c in cols[1:])
    post = struct.pack(">L28x", 0x20000) + struct.pack(f">H{len(names)}H", len(names), *(258 + k for k in range(len(names)))) + b"".join(bytes([len(x)]) + x.encode() for x in names)
    parts = {b"cmap": struct.pack(">HHHHL", 0, 1, 3, 1, 12) + sub, b"maxp": struct.pack(">LH", 0x10000, 40), b"post": post}
    out, at = struct.pack(">LHHHH", 0x10000, len(parts), 0, 0, 0), 12 + 16 * len(parts)
    for tag, data in parts.items():
        out += struct.pack(">4sLLL", tag, 0, at, len(data))
        at += len(data)
    return out + b"".join(parts.values())


def test_embedded_programs_tell_characters():
    from doclattice.sources import pdf, truetype

    got = truetype.characters(_program([(0xAC00, 5), (0x41, 6)], [".notdef", "B", "endash", "uni4E00", "strange"]), pdf._glyph)
    assert got == {5: "가", 6: "A", 1: "B", 2: "–", 3: "一"}
    for broken in (b"", b"\0" * 40, _program([(0x41, 1)])[:70]):
        assert truetype.characters(broken, pdf._glyph) == {}


def test_streams_beyond_their_bound_are_refused():
    import zlib

    import pytest

    from doclattice.sources import hwp

    c = zlib.compressobj(wbits=-15)
    packed = c.compress(b"x" * 10_000) + c.flush()
    assert hwp.inflated(packed, 10_000) == b"x" * 10_000
    with pytest.raises(ValueError):
        hwp.inflated(packed, 9_999)


def test_oversized_parts_are_told():
    content = fixtures.docx(["가나다"] * 50)
    told = [e for e in convert.elements_of("/a.docx", content, Limits(xml_bytes=100)) if e.kind == "event"]
    assert any(e.attrs["status"] in ("unverified", "failed") for e in told)
    assert convert.oversized(content, Limits(xml_bytes=100)) == ["word/document.xml"] and not convert.oversized(content, Limits())
