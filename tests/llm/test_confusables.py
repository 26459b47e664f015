import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from doclattice.llm import confusables as c

SCHEMA = "res_id bigint, markdown string, look string, raw string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "clash") for r in rows], SCHEMA)


def test_looks():
    base = "office 가나 A-7 naïve"
    for same in ("ｏｆｆｉｃｅ　가나 Ａ‐７ naïve", "оffісе 가나 А‑7 naïve", unicodedata.normalize("NFD", base), "o​ffice\xa0가\xad나 A-7 naïve﻿", "oﬀice 가나 A-7 naïve", base + "  \n"):
        assert c.form(same) == c.form(base), same
    for other in ("Office 가나 A-7 naïve", "office 가나 A-⑦ naïve", "office 가나 A-⁷ naïve", "office 가나 A–7 naïve", "office 가나 A-7 naive", "office  가나 A-7 naïve", "0ffice 가나 A-7 naïve", "office ㄱㅏ나 A-7 naïve"):
        assert c.form(other) != c.form(base), other
    assert c.form("金") == c.form("金")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_form_is_stable(text):
    assert c.form(c.form(text)) == c.form(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_form_is_decompose_map_decompose(text):
    """The folded table gives what decomposing, replacing and decomposing again gives."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    table = str.maketrans({k: v for k, v in c.table().items() if len(unicodedata.normalize("NFD", k)) == 1})
    slow = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))
    import re

    assert re.sub(" +\n", "\n", unicodedata.normalize("NFC", slow)).rstrip(" \n") == c.form(text)


def test_pairs_against_brute_force(spark):
    rows = [(1, "abc"), (2, "аbc"), (3, "abc"), (4, "ａｂｃ"), (5, None), (6, ""), (7, "xyz"), (8, "x" * 100_000), (9, "х" * 100_000), (10, "abd")]
    got = {(r.res_lo, r.res_hi) for r in c.pairs(frame(spark, rows)).collect()}
    want = {(a, b) for a, s in rows for b, t in rows if a < b and s and t and s != t and c.form(s) == c.form(t)}
    assert got == want
    cls = {r.res_id: (r.class_id, r.n_members, r.n_spellings) for r in c.classes(frame(spark, rows)).collect()}
    assert cls[4] == (1, 4, 3) and cls[7] == (7, 1, 1) and 5 not in cls


def test_empty(spark):
    assert c.pairs(frame(spark, [])).count() == 0 and c.classes(frame(spark, [])).count() == 0
