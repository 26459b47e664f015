import json

from doclattice.__main__ import main
from doclattice.sources import fixtures, sinks


def test_export_and_conflict(spark, tmp_path):
    rows = [("/a/x.txt", "success", "글"), ("/a/b/x.txt", "success", "또"), ("/a/y.pdf", "unverified", "쪽"), ("/a/z.txt", "failed", None)]
    df = spark.createDataFrame(rows, "path string, status string, markdown string")
    out = lambda d, **k: {(r.path, r.target.rpartition(".")[2]): r.outcome for r in sinks.export(d, str(tmp_path), root="/a", **k).collect()}
    first = out(df)
    assert len(first) == 8 and set(first.values()) == {"written"} and out(df) == first
    assert (tmp_path / "x.txt.md").read_text().startswith("글\n---") and (tmp_path / "b" / "x.txt.md").read_text().startswith("또") and (tmp_path / "_incomplete" / "y.pdf.md").exists()
    assert "success (전체 보존 검증 통과)" in (tmp_path / "x.txt.md").read_text() and json.loads((tmp_path / "x.txt.json").read_text())["status"] == "success"
    other = df.replace({"글": "다른 글"}, subset=["markdown"]).replace({"unverified": "success"}, subset=["status"])
    assert out(other)["/a/x.txt", "md"] == "conflict" and (tmp_path / "x.txt.md").read_text().startswith("글")
    assert set(out(other, overwrite=True).values()) == {"written"} and (tmp_path / "x.txt.md").read_text().startswith("다른 글")
    assert (tmp_path / "y.pdf.md").exists() and not (tmp_path / "_incomplete" / "y.pdf.md").exists()


def test_assets_are_kept(spark, tmp_path):
    import hashlib

    df = spark.createDataFrame([("/a/x.docx", "success", "![그림](media/image1.png)")], "path string, status string, markdown string")
    data = b"\x89PNG"
    assets = spark.createDataFrame([("/a/x.docx", "media/image1.png", hashlib.sha256(data).hexdigest(), data), ("/a/x.docx", "media/../i.png", "0", data)], "path string, name string, sha256 string, data binary")
    got = {r.target.removeprefix(str(tmp_path)): r.outcome for r in sinks.export(df, str(tmp_path), root="/a", assets=assets).collect()}
    assert got == {"/x.docx.md": "written", "/x.docx.json": "written", "/x.docx.media/image1.png": "written", "/x.docx.media/_/i.png": "damaged"}
    assert (tmp_path / "x.docx.media" / "image1.png").read_bytes() == data and "](x.docx.media/image1.png)" in (tmp_path / "x.docx.md").read_text()


def test_summary(spark):
    df = spark.createDataFrame([("/a/x.txt", "success", "글"), ("/a/y.pdf", "unverified", "쪽"), ("/a/z.txt", "failed", None)], "path string, status string, markdown string")
    told = json.loads(sinks.summary(df))
    assert (told["n"], told["n_success"], told["complete"], told["exit_code"]) == (3, 1, False, 1)
    assert json.loads(sinks.summary(df.limit(0)))["complete"] is True


def test_command_line(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.docx").write_bytes(fixtures.docx(["가나"]))
    assert main(["https://example.org/x", "--out", "o"]) == 2
    assert main([str(folder), "--out", str(tmp_path / "out")]) == 0
    (folder / "b.pdf").write_bytes(fixtures.pdf([["x"]]))
    assert main([str(folder), "--out", str(tmp_path / "out2")]) == 1
    assert (tmp_path / "out2" / "_incomplete" / "b.pdf.md").exists()
