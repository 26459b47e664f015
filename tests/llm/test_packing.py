from hypothesis import given, settings
from hypothesis import strategies as st

from doclattice.llm import packing as p

DOCS = "doc_id bigint, text string, capacity int, piece string"


def frames(spark, docs, bins):
    return spark.createDataFrame([(*d, 3, "clash") for d in docs], DOCS), spark.createDataFrame(bins, "bin_name string, capacity int")


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), min_size=1, max_size=200), st.integers(5, 60))
def test_pieces_join(text, capacity):
    data = text.encode()
    cuts = p.divide(text, capacity)
    ends = [s for _, s, _ in cuts[1:]] + [len(data)]
    assert all(data[s:e].decode() and e - s + 1 == t <= capacity for (_, s, t), e in zip(cuts, ends, strict=True))
    assert "".join(data[s:e].decode() for (_, s, _), e in zip(cuts, ends, strict=True)) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=300), st.integers(1, 8))
def test_windows_hold_their_capacity(sizes, most):
    w, used = p.Windows(100, most), {}
    for s in sizes:
        k = w.place(s)
        used[k] = used.get(k, 0) + s
    assert all(u <= 100 for u in used.values()) and len(w.rooms) <= most


def test_fill(spark):
    docs = [(k, "가" * (k % 90)) for k in range(1_500)] + [(5_000, None), (5_001, ""), (5_002, "나" * 100_000), (5_003, "가" * 20)]
    d, b = frames(spark, docs, [("small", 100), ("large", 400), (None, 5)])
    got = p.fill(d, b).collect()
    for name, capacity in (("small", 100), ("large", 400)):
        own = [r for r in got if r.bin_name == name]
        used = {}
        for r in own:
            used[r.container] = used.get(r.container, 0) + r.tokens
        assert max(used.values()) <= capacity
        assert sum(used.values()) / (len(used) * capacity) > 0.95
        assert {r.doc_id for r in own} == {k for k, t in docs if t is not None}
        assert len({(r.doc_id, r.piece) for r in own}) == len(own)
        for k, t in docs:
            if t is not None and len(t.encode()) + 1 <= capacity:
                assert [r.tokens for r in own if r.doc_id == k] == [len(t.encode()) + 1]
    cut = {(r.bin_name, r.doc_id) for r in p.divided(d, b).collect()}
    assert cut == {(n, k) for n, c in (("small", 100), ("large", 400)) for k, t in docs if t is not None and len(t.encode()) + 1 > c}


def test_empty(spark):
    d, b = frames(spark, [], [("a", 10)])
    assert p.fill(d, b).count() == 0 and p.divided(d, b).count() == 0
    assert p.fill(*frames(spark, [(1, "x")], [])).count() == 0
