"""Queries of the nested-records operator, and their SQL."""

from __future__ import annotations

from doclattice.operators import nested
from doclattice.session import table


def _table(tree: str, kind: str, *fields: str):
    return lambda spark, d: nested.node_table(nested.nodes(table(spark, d, "results")), tree, kind, *fields)


def queries() -> dict:
    return {
        "p5_found": lambda spark, d: nested.found(table(spark, d, "results")),
        "p5_pages": _table("meta", "pages", "page", "chars"),
        "p5_images": _table("meta", "images", "asset", "part", "sha256", "bytes"),
        "p5_checks": lambda spark, d: nested.node_table(nested.check_nodes(table(spark, d, "results")), "checks", "checks", "item", "ok", "note"),
        "p5_values": lambda spark, d: nested.values(table(spark, d, "results")),
        "p5_types": lambda spark, d: nested.by_type(table(spark, d, "results")).drop("n_results"),
        "p5_orphans": lambda spark, d: nested.orphans(table(spark, d, "results")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p5_checks": """
            SELECT res_id, 'checks/' || CAST(pos - 1 AS VARCHAR) AS node_path, 'checks' AS parent_path,
                   CAST(len(list_filter(checks[1:pos], lambda x: x IS NOT NULL)) AS INTEGER) AS pre,
                   CAST(len(list_filter(checks[1:pos], lambda x: x IS NOT NULL)) - 1 AS INTEGER) AS post,
                   0 AS parent_pre, c.item AS item, CAST(c.ok AS VARCHAR) AS ok, c.note AS note
            FROM (SELECT res_id, checks, unnest(checks) AS c, generate_subscripts(checks, 1) AS pos FROM results)
            WHERE c IS NOT NULL""",
        "p5_orphans": "SELECT res_id, '' AS node_path, '' AS parent_path FROM results WHERE false",
    }
