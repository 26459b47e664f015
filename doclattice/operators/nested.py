"""Deeply nested semi-structured records as flat node tables (interval labelling).

Every tree's root and every object below it gets the numbers of a depth-first walk: ``pre`` (order
of entering; the root has 0) and ``post`` (order of leaving). Node *a* encloses node *b* exactly if
``a.pre < b.pre`` and ``a.post > b.post``; a child's nearest encloser is also written as
``parent_pre``, so that child tables join their parent on ``(res_id, tree, parent_pre = pre)`` without
a range join. Scalars, those of the root and those in lists among them, are rows of the value table,
which names the enclosing node's number as well.

Defined results: a null or unreadable tree has no nodes, not even a root (unreadable is also what is nested
beyond the JSON reader's recursion, thousands of levels); a null in a list keeps its position and
has no node; text that holds the JSON of an object or list counts as that value; an object alone
in one of ``LONE_LISTS`` counts as position 0 of a list; empty tables give empty tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields whose value is a list of objects even where one object stands alone.
LONE_LISTS = frozenset({"images", "sheets", "charts", "series"})

NODE_SCHEMA = (
    "res_id bigint, tree string, node_type string, node_path string, parent_path string, "
    "pre int, post int, parent_pre int, depth int, fields map<string,string>, items array<struct<path:string,value:string>>"
)
_ARROW = pa.schema(
    [
        ("res_id", pa.int64()), ("tree", pa.string()), ("node_type", pa.string()), ("node_path", pa.string()),
        ("parent_path", pa.string()), ("pre", pa.int32()), ("post", pa.int32()), ("parent_pre", pa.int32()),
        ("depth", pa.int32()), ("fields", pa.map_(pa.string(), pa.string())),
        ("items", pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))),
    ]
)


def _refuse(token: str) -> None:
    raise ValueError(token)


def read_json(text: str | None):
    """The value of a JSON text; None where it can't be read (NaN and Infinity aren't JSON)."""
    if not text:
        return None
    try:
        return json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None


def _unwrapped(value):
    """Text that is itself the JSON of an object or list, as that value."""
    while isinstance(value, str):
        head = value.lstrip()[:1]
        if head not in ("{", "[", '"'):
            return value
        inner = read_json(value)
        if not isinstance(inner, (dict, list, str)) or inner == value:
            return value
        if isinstance(inner, str) and inner.lstrip()[:1] not in ("{", "[", '"'):
            return value
        value = inner
    return value


ROOT = "root"


def label(column: str, value) -> list[tuple]:
    """Nodes of one tree, its root first: (type, path, parent path, pre, post, parent pre, depth, scalar fields, scalars in lists).

    The walk keeps its own stack: depth is bounded by the JSON reader, not by Python's recursion. A
    scalar in a list belongs to the nearest enclosing object, or to the root.
    """
    value = _unwrapped(value)
    if not isinstance(value, (dict, list)):
        return []
    nodes: list[list] = [[ROOT, column, None, 0, 0, None, 0, {}, []]]
    pre, post = 1, 0
    # (value, path, field, number of the enclosing node); a value of None leaves that node
    stack: list[tuple] = [(None, "", "", 0)]
    top = value if isinstance(value, dict) else None

    def below(obj: dict, path: str, at: int) -> list[tuple]:
        later = []
        for key, item in obj.items():
            item = _unwrapped(item)
            if isinstance(item, dict) and key in LONE_LISTS:
                later.append((item, f"{path}/{key}/0", key, at))
            elif isinstance(item, (dict, list)):
                later.append((item, f"{path}/{key}", key, at))
            elif item is not None:
                nodes[at][7][key] = item if isinstance(item, str) else json.dumps(item)
        return later

    stack.extend(reversed(below(top, column, 0)) if top is not None else [(value, column, column, 0)])
    while stack:
        val, path, field, up = stack.pop()
        if val is None:
            nodes[up][4] = post
            post += 1
        elif isinstance(val, dict):
            at = len(nodes)
            nodes.append([field, path, nodes[up][1], pre, 0, nodes[up][3], nodes[up][6] + 1, {}, []])
            pre += 1
            stack.append((None, "", "", at))
            stack.extend(reversed(below(val, path, at)))
        else:
            later = []
            for k, item in enumerate(val):
                item = _unwrapped(item)
                if isinstance(item, (dict, list)):
                    later.append((item, f"{path}/{k}", field, up))
                elif item is not None:
                    nodes[up][8].append({"path": f"{path}/{k}", "value": item if isinstance(item, str) else json.dumps(item)})
            stack.extend(reversed(later))
    return [tuple(n) for n in nodes]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in _ARROW]
        for rid, meta, info in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            for name, text in (("meta", meta), ("info", info)):
                for node in label(name, read_json(text)):
                    for col, x in zip(cols, (rid, name, *node[:7], list(node[7].items()), node[8]), strict=True):
                        col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def json_nodes(results: DataFrame) -> DataFrame:
    """Nodes of the JSON columns ``meta`` and ``info``; one narrow Arrow stage, no shuffle."""
    return results.select("res_id", "meta", "info").mapInArrow(_walk, NODE_SCHEMA)


def check_nodes(results: DataFrame) -> DataFrame:
    """Nodes of the array column ``checks`` and its root, wholly in the JVM."""
    filled = lambda a: F.size(F.filter(a, lambda x: x.isNotNull()))
    # position 0 stands for the root
    at = results.where("checks is not null").select("res_id", "checks", F.posexplode(F.concat(F.array(F.lit(None)), "checks")).alias("place", "c"))
    rank = filled(F.slice("checks", 1, F.col("place")))
    top = F.col("place") == 0
    text = F.map_filter(
        F.create_map(F.lit("item"), F.col("c.item"), F.lit("ok"), F.col("c.ok").cast("string"), F.lit("note"), F.col("c.note"), F.lit("metrics"), F.to_json("c.metrics")),
        lambda _, v: v.isNotNull(),
    )
    return at.where(top | F.col("c").isNotNull()).select(
        "res_id", F.lit("checks").alias("tree"), F.when(top, ROOT).otherwise("checks").alias("node_type"), F.when(top, "checks").otherwise(F.concat(F.lit("checks/"), (F.col("place") - 1).cast("string"))).alias("node_path"),
        F.when(~top, "checks").alias("parent_path"), rank.cast("int").alias("pre"), F.when(top, filled(F.col("checks"))).otherwise(rank - 1).cast("int").alias("post"), F.when(~top, 0).alias("parent_pre"),
        F.when(top, 0).otherwise(1).alias("depth"), text.alias("fields"), F.array().cast("array<struct<path:string,value:string>>").alias("items"),
    )


def nodes(results: DataFrame) -> DataFrame:
    """All nodes of a result's three trees, the roots among them."""
    return check_nodes(results).unionByName(json_nodes(results))


def values(results: DataFrame) -> DataFrame:
    """The table of scalars: (res_id, tree, parent_pre, parent_path, value_path, value); with the node tables it holds every tree whole."""
    n = nodes(results)
    of = F.transform(F.map_entries("fields"), lambda e: F.struct(F.concat(F.col("node_path"), F.lit("/"), e["key"]).alias("path"), e["value"].alias("value")))
    each = n.select("res_id", "tree", F.col("pre").alias("parent_pre"), F.col("node_path").alias("parent_path"), F.explode(F.concat(of, "items")).alias("v"))
    return each.select("res_id", "tree", "parent_pre", "parent_path", F.col("v.path").alias("value_path"), "v.value")


def node_table(all_nodes: DataFrame, tree: str, node_type: str, *fields: str) -> DataFrame:
    """The flat table of one type, its scalar fields as columns, with its labels and its parent's path."""
    own = all_nodes.where((F.col("tree") == tree) & (F.col("node_type") == node_type))
    return own.select("res_id", "node_path", "parent_path", "pre", "post", "parent_pre", *(F.col("fields")[f].alias(f) for f in fields))


def found(results: DataFrame) -> DataFrame:
    """(res_id, node_path, parent_path) of every node below a root."""
    return nodes(results).where(F.col("node_type") != ROOT).select("res_id", "node_path", "parent_path")


def by_type(results: DataFrame) -> DataFrame:
    """Profile of the node tables: rows, results and deepest level of each type."""
    return nodes(results).groupBy("tree", "node_type").agg(
        F.count("*").alias("n_nodes"), F.approx_count_distinct("res_id", 0.02).alias("n_results"), F.max("depth").alias("max_depth"),
    )


def orphans(results: DataFrame) -> DataFrame:
    """Nodes below a root, of whatever depth, whose encloser by number is missing, named otherwise or does not contain them: none.

    The containment is checked on the equi-join by ``parent_pre``, so no range join is planned.
    """
    n = nodes(results)
    up = n.select("res_id", "tree", F.col("pre").alias("parent_pre"), F.col("post").alias("up_post"), F.col("node_path").alias("up_path"))
    joined = n.where(F.col("node_type") != ROOT).join(up, ["res_id", "tree", "parent_pre"], "left")
    return joined.where("up_path is null or up_path <> parent_path or up_post <= post or parent_pre >= pre").select("res_id", "node_path", "parent_path")
