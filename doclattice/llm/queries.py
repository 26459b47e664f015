"""Queries of the operators for training text, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.llm import confusables, leakage, mojibake, packing, quality, readability, scan_noise
from doclattice.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, run: Callable[..., DataFrame], *more: str) -> Query:
    return lambda spark, d: run(*(table(spark, d, t) for t in (name, *more)))


def _fills(documents: DataFrame, bins: DataFrame) -> DataFrame:
    """What any good filling must be: nothing lost, nothing over capacity, little left unused."""
    f = packing.filling(documents, bins)
    return f.select("bin_name", "capacity", F.col("most_used") <= F.col("capacity"), F.col("unused") < 0.06).toDF("bin_name", "capacity", "fits", "tight")


def queries() -> dict[str, Query]:
    return {
        "p1_found": _on("results", confusables.pairs),
        "p1_classes": _on("results", confusables.classes),
        "p1_consistent": _on("results", lambda r: confusables.consistent(r).select("res_id", "form")),
        "p2_found": _on("results", scan_noise.found),
        "p2_repaired": _on("results", scan_noise.repaired),
        "p3_found": _on("results", mojibake.found),
        "p3_repaired": _on("results", lambda r: mojibake.repaired(r).select("res_id", "field_name", F.array_join("chains", " ").alias("chains"), "restored")),
        "p4_found": _on("results", quality.found),
        "p4_statistics": _on("results", quality.kinds),
        "p6_found": _on("documents", packing.divided, "bins"),
        "p6_filling": _on("documents", packing.fill, "bins"),
        "p6_fits": _on("documents", _fills, "bins"),
        "p7_found": _on("documents", leakage.leaks, "eval_items"),
        "p8_found": _on("documents", readability.found, "level_labels"),
        "p8_profile": _on("documents", readability.profile, "level_labels"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": "SELECT DISTINCT b.bin_name, d.doc_id FROM documents d, bins b WHERE octet_length(encode(d.text)) + 1 > b.capacity",
        "p6_fits": "SELECT bin_name, capacity, true AS fits, true AS tight FROM bins WHERE EXISTS (SELECT 1 FROM documents WHERE text IS NOT NULL)",
    }
