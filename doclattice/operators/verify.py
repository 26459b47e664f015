"""Reconciliation of evidence with output, status lattice, batch summary, reuse and output selection.

Evidence is a bag of texts per document; what the output holds less often is a shortfall. Status
can only get worse; every outcome is an event, and the worst event of a document is its status.
Nulls: a null text is no evidence, a null severity counts as that of its status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclattice.functions import markdown as md

# Severity of each status.
RANK = {"success": 0, "unverified": 1, "partial": 2, "unsupported": 3, "skipped": 3, "failed": 4}


def rank(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in RANK.items():
        out = F.when(status == name, n).otherwise(out)
    return out


def evidence_of(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The counted inventory of a text's lines: (key, line, n)."""
    lines = docs.select(key, F.explode(F.split(text, "\n")).alias("line"))
    return lines.where(md.strip(F.col("line")) != "").groupBy(key, "line").agg(F.count("*").alias("n"))


def shortfall(evidence: DataFrame, output: DataFrame, key: str, text: str = "line", markdown: str = "markdown") -> DataFrame:
    """(key, text, wanted, got, lost) where the output holds a text less often than the evidence counts it.

    The join is on the document alone; each pair is decided by counting substrings in the JVM.
    """
    out = output.select(key, markdown).withColumn("_norm", md.normalize_md(F.col(markdown)))
    j = evidence.join(out, key)
    t, same = F.col(text), md.normalize_md(F.col(text))
    direct = F.greatest(md.occurrences(F.col(markdown), t), md.occurrences(F.col("_norm"), t))
    got = F.when(direct > 0, direct).when(md.strip(same) != "", md.occurrences(F.col("_norm"), same)).otherwise(F.lit(0).cast("bigint"))
    return j.withColumn("got", got).where("got < n").select(key, text, F.col("n").alias("wanted"), "got", (F.col("n") - F.col("got")).alias("lost"))


def report(missing: DataFrame, key: str, text: str = "line") -> DataFrame:
    """Per document: occurrences lost, distinct texts, five samples of 60 characters, by their spelling.

    The samples are limited before they are gathered, so that no document's losses are held whole.
    """
    totals = missing.groupBy(key).agg(F.sum("lost").alias("lost"), F.count("*").alias("kinds"))
    some = missing.select(key, F.substring(text, 1, 60).alias("_sample")).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_sample"))).where("_n <= 5")
    return totals.join(some.groupBy(key).agg(F.array_sort(F.collect_list("_sample")).alias("samples")), key)


def worst(events: DataFrame, key: str, status: str = "status") -> DataFrame:
    """The worst status of each document and its number of events; ties keep the name that sorts first."""
    e = events.where(F.col(status).isNotNull()).withColumn("_rank", F.coalesce(rank(F.col(status)), F.lit(0)))
    best = F.min(F.struct((-F.col("_rank")).alias("r"), F.col(status).alias("s"))).alias("w")
    return e.groupBy(key).agg(best, F.count("*").alias("n_events")).select(key, F.col("w.s").alias("status"), (-F.col("w.r")).alias("severity"), "n_events")


def summary(statuses: DataFrame, *by: str) -> DataFrame:
    """Counts of statuses, completeness and exit code of each batch."""
    ok = F.col("status").isin("success", "skipped")
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in RANK]
    return statuses.groupBy(*by).agg(F.count("*").alias("n"), *counts, F.coalesce(F.bool_and(ok), F.lit(True)).alias("complete"), F.coalesce(F.max(F.when(ok, 0).otherwise(1)), F.lit(0)).alias("exit_code"))


def distinct_files(files: DataFrame) -> DataFrame:
    """One row per document of the repeated deliveries: the earliest."""
    w = Window.partitionBy("doc_id").orderBy(F.col("ingested_at").asc_nulls_last(), "rel_path", "sha256")
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reusable(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose bytes, options and versions are those of a finished earlier run."""
    return files.join(manifest, ["rel_path", "sha256"], "left_semi")


def conflicts(wanted: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Outputs that are there already and may not be replaced."""
    return wanted.limit(0) if overwrite else wanted.join(existing, ["rel_path"], "left_semi")


def stale(existing: DataFrame, kept: DataFrame) -> DataFrame:
    return existing.join(kept, ["rel_path"], "left_anti")
