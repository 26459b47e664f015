import json

from hypothesis import given, settings
from hypothesis import strategies as st

from doclattice.operators import nested

SCHEMA = "res_id bigint, meta string, info string, checks array<struct<item string, ok boolean, metrics map<string,bigint>, note string>>, pre int, node_path string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)


def test_found(spark):
    meta = json.dumps({"pages": [None, {"images": {"a": 1}, "q": json.dumps({"z": [[{}]]})}], "k": {"b": "[1]"}, "n": None})
    rows = [
        (1, meta, None, [None, ("x", True, {"n": 1}, None), None, (None, None, None, None)]),
        (2, json.dumps(meta), '{"broken": ', None),
        (3, "", "NaN", []),
        (4, '"just text"', '{"series": {"points": [{"i": 0}, null, {"i": 1}]}, "metrics": 5}', None),
        (4, '"just text"', '{"series": {"points": [{"i": 0}, null, {"i": 1}]}, "metrics": 5}', None),
    ]
    got = sorted(tuple(r) for r in nested.found(frame(spark, rows)).collect())
    own = [("meta/k", "meta"), ("meta/pages/1", "meta"), ("meta/pages/1/images/0", "meta/pages/1"), ("meta/pages/1/q", "meta/pages/1"), ("meta/pages/1/q/z/0/0", "meta/pages/1/q")]
    series = [(4, "info/series/0", "info"), (4, "info/series/0/points/0", "info/series/0"), (4, "info/series/0/points/2", "info/series/0")]
    assert got == sorted([(1, *x) for x in own] + [(2, *x) for x in own] + [(1, "checks/1", "checks"), (1, "checks/3", "checks")] + series * 2)
    assert nested.orphans(frame(spark, rows[:4])).count() == 0


def test_empty(spark):
    assert nested.found(frame(spark, [])).count() == 0


TREE = st.recursive(st.none() | st.integers() | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abimages", min_size=1, max_size=3), x, max_size=3), max_leaves=12)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "b", "images"]), TREE, max_size=3))
def test_intervals_contain(value):
    """A node's parent is its nearest encloser by interval; labels are distinct."""
    nodes = nested.label("meta", value)
    for kind, path, parent, pre, post, parent_pre, depth, *_ in nodes:
        around = [n for n in nodes if n[3] < pre and n[4] > post]
        if around:
            near = max(around, key=lambda n: n[3])
            assert (near[1], near[3], near[6] + 1) == (parent, parent_pre, depth)
        else:
            assert (kind, path, parent, pre, parent_pre) == (nested.ROOT, "meta", None, 0, None)
    assert len({n[3] for n in nodes}) == len(nodes) and sorted(n[4] for n in nodes) == list(range(len(nodes)))


def test_list_at_the_top():
    """Elements of a list at the top hang on the root, which is none of them."""
    nodes = nested.label("meta", [{"a": 1}, None, {"b": {"c": 2}}, 5, [7]])
    assert [(n[1], n[2], n[3], n[5]) for n in nodes] == [("meta", None, 0, None), ("meta/0", "meta", 1, 0), ("meta/2", "meta", 2, 0), ("meta/2/b", "meta/2", 3, 2)]
    assert nodes[0][8] == [{"path": "meta/3", "value": "5"}, {"path": "meta/4/0", "value": "7"}]


def test_values(spark):
    """Scalars of the top, of lists and of objects are all rows that name their encloser."""
    meta = json.dumps({"title": "t", "n": 2, "tags": ["x", None, "y"], "p": {"q": True, "r": [[1.5]], "z": None}})
    df = frame(spark, [(1, meta, None, [None, ("i", True, {"n": 1}, None)]), (2, "[3]", None, None)])
    got = {(r.res_id, r.value_path): (r.value, r.parent_path, r.parent_pre) for r in nested.values(df).collect()}
    assert got == {
        (1, "meta/title"): ("t", "meta", 0), (1, "meta/n"): ("2", "meta", 0), (1, "meta/tags/0"): ("x", "meta", 0), (1, "meta/tags/2"): ("y", "meta", 0), (1, "meta/p/q"): ("true", "meta/p", 1),
        (1, "meta/p/r/0/0"): ("1.5", "meta/p", 1), (1, "checks/1/item"): ("i", "checks/1", 1), (1, "checks/1/ok"): ("true", "checks/1", 1), (1, "checks/1/metrics"): ('{"n":1}', "checks/1", 1), (2, "meta/0"): ("3", "meta", 0),
    }


def test_deep_tree():
    value = {"a": 1}
    for _ in range(400):
        value = {"c": value}
    assert len(nested.label("meta", value)) == 401
