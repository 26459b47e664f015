import random

import numpy as np
import pytest

from doclattice.llm import mojibake as m

LINES = [f"{a} {b}에서 {c} 자료를 검토하고 {k}건의 결과를 보고하였다." for k, (a, b, c) in enumerate((x, y, z) for x in ("기획과", "재무과", "교육팀") for y in ("회의실", "도서관", "현관", "창고") for z in ("계약", "예산", "점검", "문서"))]
LINES += ["The office will review the report — it’s due soon.", "Please bring the “final” copy to the café."] * 4
GENUINE = ["Всем привет", "Ελλάδα", "NÃO HÁ INFORMAÇÃO", "école française", "決裁 年月日", "Việt Nam", "日本語の文書", "naïve Übung"]


@pytest.fixture(scope="module")
def model(spark):
    return m.train(LINES, m._genuine(spark) + GENUINE[:4])


def test_round_trip(model):
    """Chains that lose no byte are inverted exactly."""
    random.seed(1)
    text = "재무과 회의실에서 예산 자료를 검토하고 결과를 보고하였다."
    for right, wrong in (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("cp949", "latin-1"), ("cp949", "mac_roman"), ("cp949", "gbk")):
        bad = m.garble(text, ((right, wrong),))
        assert model.garbled(bad), (right, wrong)
        assert model.repair(bad + "\n" + text)[1] == text + "\n" + text, (right, wrong)
    twice = m.garble(text, (("utf-8", "cp1252"),) * 2)
    assert model.repair(twice)[1] == text


def test_lost_bytes(model):
    for right, wrong in (("cp949", "utf-8"), ("utf-8", "cp949"), ("utf-8", "cp932")):
        assert model.garbled(text := m.garble("재무과 회의실에서 예산 자료를 검토하고", ((right, wrong),))) and "�" in text


def test_genuine(model):
    for x in [*GENUINE, *LINES, "", "ㅋㅋㅋ ｆｕｌｌ ①②", "оffісе"]:
        assert not model.garbled(x), x


def test_held_out_accuracy(model):
    rng = random.Random(2)
    words = "검토 결과 예산 자료 회의 문서 점검 보고 계약 기획 재무 교육 창고 현관".split()
    hits = n = 0
    for k, chain in enumerate(m.CHAINS):
        for _ in range(5):
            text = " ".join(rng.choice(words) + rng.choice(["를", "에서", "의"]) for _ in range(6))
            bad = m.garble(text, chain)
            n += 1
            hits += model.garbled(bad)
    assert hits >= 0.9 * n


def test_frames(spark):
    bad = m.garble(LINES[0], (("utf-8", "cp1252"),))
    rows = [(k, x, None) for k, x in enumerate(LINES)] + [(100, bad, ["정상", None, bad]), (101, None, []), (102, "", [None]), (100, bad, ["정상", None, bad])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "res_id bigint, markdown string, warnings array<string>, field_name int")
    got = sorted((r.res_id, r.field_name) for r in m.found(df).collect())
    assert got == [(100, "markdown")] * 2 + [(100, "warnings")] * 2
    assert {r.restored for r in m.repaired(df).where("field_name = 'markdown'").collect()} == {LINES[0]}
    assert m.found(df.limit(0)).count() == 0


def test_all_clean_texts_count(spark):
    """The model in partitions is the model of all lines at once, whatever their number and length."""
    long = "\n".join(f"{k}번 서류는 창고{k}에 두었다\t끝" for k in range(3_000))
    texts = [*LINES * 15, long, "한다" * 15_000 + " 뷁쒧", "짧\nab", "Тест " + LINES[0]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate([*texts, None, ""])], "res_id bigint, markdown string").repartition(5)
    got = m.learn(df)
    lines = [x for t in texts if m.re.fullmatch(f"[{m._USUAL}]+", t) for x in t.split("\n") if len(x) > 3]
    want = m.train(lines, m._genuine(spark))
    assert len(lines) > 3_000 and "뷁" in got.chars and "쒧" in got.chars
    assert got.chars.keys() == want.chars.keys() and all(abs(x - want.chars[c]) < 1e-9 for c, x in got.chars.items())
    assert abs(got.weights - want.weights).max() < 1e-5 and got.floor == pytest.approx(want.floor)


def test_words_are_garbled_as_alone():
    words = ["예산", "담당자는", "a가b", "cafe", "“끝”", "㈜한국", "x" * 300, "éa"]
    for chain in m.CHAINS:
        assert m.garbled_words(words, chain) == [m.garble(w, chain) for w in words], chain


def test_words_of_clean_lines(spark):
    """Words stand at blanks, tabs and returns of lines of more than three characters; texts with unusual characters, null and empty ones don't count."""
    rows = [(1, "\tab cd　ef\n  x\ty  ab\n\nabc\n가나 다|\r\n"), (2, "é ab cd\n"), (3, None), (4, ""), (5, "\n\n"), (6, "plain ab")]
    got = m.words_of(spark.createDataFrame(rows, "res_id bigint, markdown string"))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # lines are no rows
    rows = got.collect()
    assert {r.w: r.n for r in rows if r.w} == {"ab": 3, "cd　ef": 1, "x": 1, "y": 1, "가나": 1, "다|": 1, "plain": 1}
    assert (sum(r.lines for r in rows), sum(r.plain for r in rows)) == (4, 2)


def test_plain_words_are_garbled_where_a_chain_changes_them():
    """Counts of plain and other words together are those of each word garbled alone by each chain."""
    words, n = ["plain", "a", "", "1,2\\~", "가나다", "a가b", "x\x7fy", "“가”"], [3, 1, 2, 5, 4, 6, 7, 2]
    got = m.counted(words, n)
    for k, chain in enumerate((*m.CHAINS, None)):
        want = np.zeros(m.BUCKETS)
        for w, times in zip(words, n, strict=True):
            bad = m.garble(w, chain) if chain else w.translate(m._DISGUISE)
            if m._ODD.search(bad):
                want += times * np.bincount(m.bigrams(f" {bad} ")[: len(bad.encode("utf-8", "replace")) + 1], minlength=m.BUCKETS)
        assert np.array_equal(got[k], want), chain
    assert any(not kept for kept in m._KEEPS_ASCII.values()) and sum(m._KEEPS_ASCII.values()) > 20
