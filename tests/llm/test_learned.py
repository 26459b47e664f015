"""Operators with trained models: small fixtures, brute force, held-out accuracy, edge rows."""

import random

import numpy as np
import pytest

from doclattice.llm import leakage, quality, readability, scan_noise

RNG = random.Random(3)
NOUN = "예산 계약 문서 회의 점검 보고 교육 창고 서류 일정 시설 기록 민원 장비 자료".split()
PLACE = "강당 현관 옥상 로비 교실 식당 사무실 회의실".split()
EASY = lambda: f"{RNG.choice(PLACE)}에 {RNG.choice(NOUN)} 책이 있어요."
PLAIN = lambda: f"{RNG.choice(NOUN)} 담당자는 {RNG.choice(PLACE)}에서 {RNG.choice(NOUN)} 신청서를 받아 주시기 바랍니다."
HARD = lambda: f"수급인이 {RNG.choice(NOUN)}에 관한 소명자료를 첨부하지 아니한 경우 {RNG.choice(NOUN)}의 효력은 {RNG.choice(NOUN)}에 미치지 아니한다."


# ------------------------------------------------------------------ reading level
def test_levels(spark):
    make = {1: EASY, 2: PLAIN, 4: HARD}
    docs, truth = [], {}
    for k in range(240):
        level = (1, 2, 4)[k % 3]
        truth[k] = level
        docs.append((k, "# 제목\n\n" + " ".join(make[level]() for _ in range(8)) + "\n\n- 항목\n- 항목", "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, "- 가\n- 나\n| a | b |", "x"), (903, " ".join(HARD() for _ in range(3_000)), "x"), (904, "1. 예산\n2. 계약", "x")]
    labels = [(k, truth[k], f"r{j}") for k in range(0, 240, 2) for j in range(2)] + [(0, None, "r9"), (0, 1, "r0"), (999, 3, "r1")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, reading_level string")
    lab = spark.createDataFrame(labels, "doc_id bigint, reading_level int, rater string")
    got = {r.doc_id: r.reading_level for r in readability.found(d, lab).collect()}
    held = [k for k in range(1, 240, 2)]
    assert np.mean([got[k] == truth[k] for k in held]) > 0.95
    assert got[903] == 4 and not {900, 901, 902, 904} & set(got)
    assert readability.found(d, lab.limit(0)).count() == 0 and readability.found(d.limit(0), lab).count() == 0


def test_models_count_whole_documents():
    texts = [" ".join(HARD() for _ in range(200)), " ".join(EASY() for _ in range(300))]
    m = readability.train([(texts[0], 4.0, 1), (texts[1], 1.0, 1)])
    assert m.total.sum() == pytest.approx(sum(len(s) + 1 for t in texts for s in readability.sentences(t)), rel=1e-4)


def test_isotonic():
    x, y = readability.isotonic(np.array([1, 2, 3, 4.0]), np.array([1, 3, 2, 4.0]), np.ones(4))
    assert list(np.interp([1, 2, 3, 4], x, y)) == [1, 2.5, 2.5, 4]


# ------------------------------------------------------------------ leakage
def test_leaks(spark):
    items = [(k, " ".join(f"{PLACE[(k * 3 + j) % 8]}의 {NOUN[(k * 5 + j * 7) % 15]} 목록 {k * 17 + j}번은 {NOUN[(k + j * 2) % 15]} 담당자가 {PLACE[(k + j) % 8]}으로 옮겼다." for j in range(6))) for k in range(12)]
    sentences = {k: t.replace(".", ".\n").strip().split("\n") for k, t in items}
    noise = lambda: " ".join(PLAIN() for _ in range(6))
    docs = [(k, noise(), k) for k in range(60)]
    s = [x.strip() for x in sentences[3]]
    docs += [(100, noise() + "\n\n" + items[3][1], 0), (101, noise() + " " + " ".join(s[2:5]), 0), (102, " ".join(s[:2]) + " " + noise(), 0)]
    docs += [(103, items[4][1].replace(".", "").replace(" ", "  "), 0), (104, items[5][1].replace("담당자가", "**담당자가**").replace(" ", "\n"), 0), (105, None, 0), (106, "", 0), (107, noise() * 400 + items[6][1], 0), (100, noise() + "\n\n" + items[3][1], 0)]
    docs += [(108, items[7][1].replace("목록", "복사기", 3), 0)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([*items, (50, None), (51, ""), (52, "!!!")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()}
    assert got == {(100, 3), (101, 3), (103, 4), (104, 5), (107, 6), (108, 7)}
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_long_documents_are_judged_as_a_whole(spark):
    """Half of an item, two sentences near each end of a document of over 1,024 passages."""
    s = [f"{PLACE[j]}의 {NOUN[j * 2 % 15]} 목록 {j * 17}번은 {NOUN[j + 3]} 담당자가 {PLACE[7 - j]}으로 옮겼다." for j in range(8)]
    noise = " ".join(PLAIN() for _ in range(1_500))
    d = spark.createDataFrame([(1, f"{s[0]} {s[1]} {noise} {s[2]} {s[3]}"), (2, f"{s[0]} {s[1]} {noise}")], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, " ".join(s))], "item_id bigint, text string")
    assert [tuple(r) for r in leakage.leaks(d, i).collect()] == [(1, 7)]


def _search(items):
    idf = np.ones(leakage.FEATURES, np.float32)
    own = leakage.Passages([x for _, ss in items for x in ss])
    return leakage.Search(items, idf, np.linalg.svd(own.weighted(idf), full_matrices=False)[2].T.astype(np.float32))


def test_all_near_passages_are_aligned():
    """A sentence that stands behind four others of the same turn of phrase is found, and they are no case."""
    true = "창고담당자가예산서류를현관으로옮기고기록을남겼다고보고했다"
    others = " ".join(["창고 담당자가 예산 회의를 강당에서 열고 점검을 마쳤다고 말씀했다."] * 4)
    search = _search([(1, [true])])
    assert list(search.match([f"{others} {true.replace('현관', '옥상')}.", others])) == [(0, 1)]


def test_figures_are_answers():
    """The same turn of phrase with other figures is no case, though the subsequence covers enough letters; order of rows makes no difference."""
    said = [f"{PLACE[j]}의 {NOUN[j]} 목록은 2025년 {j + 3}월 1일부터 {j * 137 + 112}건이 접수되어 {NOUN[j + 3]} 담당자가 모두 확인하고 빠짐없이 정리하여 보고서와 함께 처리했다." for j in range(4)]
    other = [s.replace("2025년", "1987년").replace("1일", "29일").replace(f"{j * 137 + 112}건", f"{900 - j * 77}건") for j, s in enumerate(said)]
    search = _search([(5, leakage.passages(" ".join(said)))])
    a, b = (leakage.passages(x)[0] for x in (said[1], other[1]))
    assert leakage.lcs(a, b) >= 0.85 * len(a)
    texts = [" ".join(said), " ".join(other), " ".join(said[:2]), said[0]]
    assert list(search.match(texts)) == [(0, 5), (2, 5)] and sorted(search.match(texts[::-1])) == [(1, 5), (3, 5)]


def test_lcs_against_brute_force():
    def slow(a, b):
        t = [0] * (len(b) + 1)
        for x in a:
            p = 0
            for k, y in enumerate(b, 1):
                p, t[k] = t[k], p + 1 if x == y else max(t[k], t[k - 1])
        return t[-1]

    for _ in range(200):
        a, b = ("".join(RNG.choice("가나다라") for _ in range(RNG.randint(0, 30))) for _ in range(2))
        assert leakage.lcs(a, b) == slow(a, b)


def test_all_judged_documents_count(spark):
    """Counts in partitions are those of all judged sentences, of as many documents as there are; a text's surprisal doesn't depend on the one before."""
    docs = [(k, f"{(EASY, HARD)[k % 2]()} {(EASY, HARD)[k % 2]()}") for k in range(2_500)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)
    lab = spark.createDataFrame([(k, (1, 4)[k % 2], "r") for k, _ in docs], "doc_id bigint, reading_level int, rater string")
    rows = readability.judgements(d, lab)
    assert rows.count() == 2_500
    got = readability._sums(rows, np.array([1, 4]), None)
    flat, level = zip(*[(s, float((1, 4)[k % 2])) for k, t in docs for s in readability.sentences(t)], strict=True)
    want = readability.counted(list(flat), readability._given(np.array(level), np.array([1, 4])))
    assert np.array_equal(got[0], want) and np.array_equal(got[1:].sum(axis=0), want * (readability.FOLDS - 1))
    m = readability.learn(d, lab)
    bits, _ = m.surprisal(list(flat[:50]))
    assert all(np.allclose(bits[k], m.surprisal([flat[k]])[0][0], rtol=1e-4) for k in range(50))


# ------------------------------------------------------------------ scan noise
def test_scan_noise(spark):
    pages = [(k, "# 문서.pdf\n\n" + " ".join(PLAIN() for _ in range(10)), 0) for k in range(120)]
    good = "예산 담당자는 현관에서 계약 신청서를 받아 주시기 바랍니다. 문서 담당자는 옥상에서 점검 신청서를 받아 주시기 바랍니다."
    rows = [
        (500, "# 문서.png\n\n" + good.replace("신청서를 받아", "신청-\n서를 받아"), 0),
        (501, "# 문서.png\n\n" + good.replace("담당자는", "담당지는"), 0),
        (502, "# 문서.png\n\n" + good + "\n\n- 12 -\n\n" + good, 0),
        (503, "# 문서.png\n\n" + good.replace(" 신청서를 ", "\n신청서를 "), 0),
        (504, None, 0), (505, "", 0), (506, "# a.txt\n\n- 12\n- 가나\n- 13", 0), (507, good * 2_000, 0), (508, "# 가.pdf\n\n" + good + "\n가 보고서 3\n" + good + "\n가 보고서 4\n" + good, 0),
    ]
    df = spark.createDataFrame(pages + rows, "res_id bigint, markdown string, flaw int")
    got = {(r.res_id, r.flaw) for r in scan_noise.found(df).collect()}
    assert got == {(500, "cut_word"), (501, "misread"), (502, "running_line"), (508, "running_line")}
    back = {r.res_id: r.paragraphs for r in scan_noise.repaired(df).collect()}
    assert good in back[500] and good in back[501] and "12" not in back[502] and good in back[503] and "보고서" not in back[508]
    assert scan_noise.found(df.limit(0)).count() == 0


def test_frequent_misreadings_are_looked_at(spark):
    """A misreading grows with the table as its link does; only their ratio counts."""
    for scale in (1, 100, 10_000):
        known = {"것으로": 4_090, "것으료": 37, "한다": 9_000, "할다": 8_000, "로비의": 150, "로비외": 11}
        df = spark.createDataFrame([(w, n * scale) for w, n in known.items()], "word string, n bigint")
        assert [(r.word, [x.w for x in r.links]) for r in scan_noise.links(df).collect()] == [("것으료", ["것으로"])], scale


def test_every_word_counts(spark):
    """Rare words count as often as they occur, words that only joining brings about are known, and all ends of lines meet their counts."""
    line = "우리 모두 함께 여기 저기 그렇게 다시 말한다 오늘"
    rows = [(k, "\n".join([line] * 10 + ["우리 모두 담당자는 함께 여기"] * 2), 0) for k in range(10)]
    rows += [(51, "우리 모두 담당지는 함께 여기", 0), (52, "the well-known case\nit is well-\nknown here.", 0), (53, "the note is unwell-\nknowing here.", 0), (54, "가" * 60 + " 나", 0)]
    df = spark.createDataFrame(rows, "res_id bigint, markdown string, flaw int")
    counted = {r.word: r.n for r in scan_noise.vocabulary(df).collect()}
    assert counted["담당자는"] == 20 and counted["우리"] == 0 and counted["unwellknowing"] == 0 and "없다" not in counted and "가" * 60 in counted
    flaws, fixes = scan_noise.places(df)
    assert {(r.res_id, r.kind) for r in flaws.collect()} == {(52, "apart"), (53, "cut")}
    assert [(r.res_id, r.word, r.new) for r in fixes.collect()] == [(51, "담당지는", "담당자는")]


def test_context_alone_decides(spark):
    """Two frequent words are one edit away, one of them twice as frequent; the words around tell which was meant."""
    a, b = "회의실에서 주민 대표가 누가리 안내판을 고쳤다 그리고", "약국에서 환자 가족이 누거리 처방전을 받았다 그리고"
    rows = [(k, "\n".join([a] * 20 + [b] * 10), 0) for k in range(10)] + [(50, a.replace("누가리", "누기리"), 0), (51, b.replace("누거리", "누기리"), 0)]
    assert sorted(scan_noise.candidates("누기리", {"누가리": 200, "누거리": 100}, 8)) == ["누가리", "누거리"]
    df = spark.createDataFrame(rows, "res_id bigint, markdown string, flaw int")
    assert {r.res_id: r.new for r in scan_noise.places(df)[1].collect()} == {50: "누가리", 51: "누거리"}


def test_words_that_are_no_contexts_count(spark, monkeypatch):
    """A misread word all of whose neighbours are rarer than the context words is corrected all the same, by their own contexts."""
    monkeypatch.setattr(scan_noise, "CONTEXTS", 4)
    a, b = "끝 주민대표 누가리 안내판을 끝", "끝 환자가족 누거리 처방전을 끝"
    lines = [f"끝 {x} {w} {y} 끝" for x, y, ws in (("회의실에서", "고쳤다", a), ("약국에서", "받았다", b)) for w in ws.split()[1:4] for _ in range(20)]
    rows = [(k, "\n\n".join([*lines, a, b]), 0) for k in range(10)] + [(50, a.replace("누가리", "누기리"), 0), (51, b.replace("누거리", "누기리"), 0), (52, "끝나는줄 누기리 없던말", 0)]
    df = spark.createDataFrame(rows, "res_id bigint, markdown string, flaw int")
    got = {r.res_id: r.new for r in scan_noise.places(df)[1].collect()}
    assert got.keys() == {50, 51, 52} and (got[50], got[51]) == ("누가리", "누거리")


def test_words_are_counted_in_one_scan(spark):
    """One scan gives all counts, whatever blanks part the words; only space, tab, line feeds and form feeds do."""
    rows = [(1, "\ta b c d\n  x\u00a0y z  (q) w\ne\x0bf\x0cg \r h\n\n\n"), (2, "| k | l-\nm |\nk|n-\no “p”"), (3, "a b c\x1fd e\nf"), (4, None), (5, "")]
    got = scan_noise.vocabulary(spark.createDataFrame(rows, "res_id bigint, markdown string"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    inside = {"a": 1, "b": 2, "c": 1, "z": 1, "q": 1, "f": 1, "g": 1, "k": 1, "c\x1fd": 1}
    edges = ["d", "x\u00a0y", "w", "e", "h", "l-", "m", "k|n-", "o", "p", "x", "y", "lm", "no"]
    assert {r.word: r.n for r in got.collect()} == dict.fromkeys(edges, 0) | inside


def test_vectors_are_solved_side_by_side():
    """Words of one and of many contexts together get the vectors that they get alone: the best ones."""
    rng = np.random.default_rng(4)
    v, noise = rng.normal(size=(300, 8)).astype(np.float32), rng.integers(0, 40, 256)
    size = [1, 280, 3, 0, 17, *rng.integers(1, 30, 100)]
    starts = np.concatenate([[0], np.cumsum(size)])
    context, n = np.concatenate([rng.choice(300, k, replace=False) for k in size]), rng.integers(1, 9, starts[-1]).astype(float)
    got = scan_noise.solved(context, n, starts, v, noise)
    for k, u in enumerate(got):
        c, m = context[starts[k] : starts[k + 1]], n[starts[k] : starts[k + 1]]
        assert np.allclose(u, scan_noise.solved(c, m, np.array([0, len(c)]), v, noise)[0])
        slope = (m / (1 + np.exp(v[c] @ u))) @ v[c] - scan_noise.NEGATIVE * m.sum() / 256 * (1 / (1 + np.exp(-(v[noise] @ u)))) @ v[noise] - u
        assert np.abs(slope).max() < 0.01 * max(1, m.sum())


def test_filter_misses_no_word(spark):
    words = ["가나다", "abc", "", "a" * 300, "“”", "𝒳"]
    got = scan_noise.words_of(spark.createDataFrame([(w,) for w in words], "word string"))
    assert all(w in got for w in words) and sum(f"w{k}" in got for k in range(1_000)) < 5


def test_keys_are_kept_by_edits():
    chars = [*"".join(scan_noise.LATIN_GLYPHS), *"".join(scan_noise.HANGUL_GLYPHS), *"abcdefghijklmnopqrstuvwxyz", *"파머퍈대"]
    for _ in range(5_000):
        word = "".join(RNG.choice(chars) if RNG.random() < 0.6 else chr(RNG.randrange(0xAC00, 0xD7A4)) for _ in range(RNG.randint(2, 6)))
        assert all(scan_noise.key(word[:a] + true + word[b:]) == scan_noise.key(word) for a, b, true in scan_noise._edits(word)), word


def test_glyph_edits():
    known = {"inspection": 100, "기반을": 50, "moved": 40, "로비의": 30}
    for bad, true in (("inspecfion", "inspection"), ("1nspecti0n", None), ("7l반을", "기반을"), ("rnoved", "moved"), ("로비외", "로비의"), ("R2-O2", None)):
        assert (scan_noise.candidates(bad, known, 8) or [None])[0] == true, bad


# ------------------------------------------------------------------ quality
@pytest.fixture(scope="module")
def rules():
    return None


def test_kinds(spark):
    prose = [(k, f"# {k}.txt\n\n" + " ".join(RNG.choice((PLAIN, HARD))() for _ in range(8)), 0) for k in range(80)]
    rows = [
        (500, "# a\n\n" + "\n".join(f"- {RNG.choice(NOUN)}" for _ in range(20)), 0), (501, "# a\n\n" + "\n".join(f"{k}. {RNG.choice(NOUN)} {RNG.choice(NOUN)}" for k in range(1, 20)), 0),
        (502, "# a\n\n| 행 | 열1 |\n| --- | --- |\n" + "\n".join(f"| {k} | {RNG.choice(NOUN)} | {k * 3.5} |" for k in range(20)), 0), (503, "\n".join(f"{RNG.choice(NOUN)},{k},A-{k},O" for k in range(30)), 0),
        (504, "\n".join("ㅋ" * 40 for _ in range(8)), 0), (505, "\n".join(" ".join(f"(cid:{k * j % 700})" for j in range(9)) for k in range(9)), 0), (506, "\n".join(f"{k * 16:08x}  " + " ".join(f"{(k * 7 + j * 13) % 256:02x}" for j in range(16)) for k in range(12)), 0),
        (507, None, 0), (508, "", 0), (509, "# a\n\n" + " ".join(PLAIN() for _ in range(2_000)), 0), (510, "# a\n\n" + " ".join(PLAIN() for _ in range(9)) + "\n\n- 예산\n- 계약", 0),
    ]
    df = spark.createDataFrame(prose + rows, "res_id bigint, markdown string, text_kind int")
    got = {r.res_id: r.text_kind for r in quality.found(df).collect()}
    assert got == {500: "list", 501: "list", 502: "table", 503: "table", 504: "junk", 505: "junk", 506: "junk"}
    stats = {r.res_id: r for r in quality.kinds(df).collect()}
    assert len(stats) == 80 + 9 and stats[509].n_words > 10_000 and stats[510].text_kind == "prose"
    assert quality.found(df.limit(0)).count() == 0


def test_words_of_all_clean_texts_count(spark):
    """Words and syllables that most of many texts hold rarely, and a few hold often, are as common as they are in all."""
    rows = [(k, " ".join(PLAIN() for _ in range(3))) for k in range(1_500)] + [(2_000, " ".join("뷁뷁 담당자는 옥상에서 뷁뷁 신청서를 받아 주시기 바랍니다." for _ in range(2_000))), (2_001, None), (2_002, "")]
    words, common = quality.common_words(spark.createDataFrame(rows, "res_id bigint, markdown string").repartition(5))
    assert "뷁뷁" in words and "뷁" in common and "담당자" in words and "신청서" in words


def test_rules_on_held_out():
    rng = np.random.default_rng(1)
    x = rng.random((900, len(quality.TESTED)))
    row, item = quality.TESTED.index("row_share"), quality.TESTED.index("item_share")
    y = np.where(x[:, row] > 0.5, "table", np.where(x[:, item] > 0.6, "list", "prose"))
    found = quality.induce(x[:600], y[:600])
    import duckdb
    import pandas as pd

    test = pd.DataFrame(x[600:], columns=quality.TESTED).assign(n_chars=1)
    got = duckdb.query_df(test, "t", f"SELECT {quality.case(found)} AS k FROM t").df()["k"]
    assert (got.to_numpy() == y[600:]).mean() > 0.97
