"""Incremental ingestion: a stream of files, converted once per content, into a result table and its manifest.

Every micro-batch is converted by the batch pipeline; files whose path, bytes and version a former
batch has finished are skipped by an anti-join with the manifest, whatever the stream's checkpoint
says. The result table is appended per batch id, so that a batch that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from doclattice.model import Limits
from doclattice.sources import convert

_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def _known(spark: SparkSession, out: str, batch: int) -> DataFrame | None:
    """What other batches have finished; a batch that is run again doesn't know its own first run."""
    try:
        return spark.read.parquet(f"{out}/manifest").where(F.col("batch") != batch).select("path", "sha256", "version")
    except AnalysisException:
        return None


def version(limits: Limits, encoding: str | None) -> str:
    """The converter with its options: results of other options are not reused."""
    return f"{convert.CONVERTER} {limits} {encoding or 'detected'}"


def write_batch(files: DataFrame, batch: int, out: str, limits: Limits = Limits(), encoding: str | None = None) -> None:
    """Converts the files of one batch that the manifest doesn't hold, and adds them to it."""
    spark = files.sparkSession
    new = files.withColumn("sha256", F.sha2("content", 256)).withColumn("version", F.lit(version(limits, encoding)))
    known = _known(spark, out, batch)
    if known is not None:
        new = new.join(known, ["path", "sha256", "version"], "left_anti")
    results = convert.convert(new.select("path", "content"), limits, encoding)
    results.join(new.select("path", "sha256", "version"), "path").write.mode("overwrite").parquet(f"{out}/results/batch={batch}")
    done = spark.read.parquet(f"{out}/results/batch={batch}").where("status <> 'failed'")
    done.select("path", "sha256", "version", "status").write.mode("overwrite").parquet(f"{out}/manifest/batch={batch}")


def ingest(spark: SparkSession, folder: str, out: str, limits: Limits = Limits(), encoding: str | None = None, recursive: bool = True):
    """Starts the stream over a folder; it ends when all files present are done.

    Files that can't be converted by suffix or size get their rows in ``refused``, as the folder now is.
    """
    convert.refused(spark, folder, recursive, limits).write.mode("overwrite").parquet(f"{out}/refused")
    stream = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    own = stream.where(convert.extension(F.col("path")).isin(*convert.SUPPORTED) & (F.col("length") <= limits.file_bytes)).select("path", "content")
    return own.writeStream.foreachBatch(lambda df, k: write_batch(df, k, out, limits, encoding)).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


def outcome(spark: SparkSession, out: str) -> DataFrame:
    """One row per file: the results, and the files that were refused, whose former results don't count."""
    refused = spark.read.parquet(f"{out}/refused")
    try:
        results = spark.read.parquet(f"{out}/results")
    except AnalysisException:  # no file was convertible
        return refused
    # a file that came again in other bytes or under other options has a row in each of its batches: the last one holds
    last = results.groupBy(F.col("path").alias("_path")).agg(F.max("batch").alias("_batch"))
    results = results.join(last, (F.col("path") == F.col("_path")) & (F.col("batch") == F.col("_batch")))
    return results.select(refused.columns).join(refused, "path", "left_anti").unionByName(refused)


def status_windows(events: DataFrame, watermark: str = "30 days", width: str = "1 day") -> DataFrame:
    """State changes per day and status; for a stream, late rows count until the watermark has passed.

    Rows delivered again are dropped within the watermark.
    """
    e = events.where("logged_at is not null")
    if events.isStreaming:
        e = e.withWatermark("logged_at", watermark).dropDuplicatesWithinWatermark(["doc_id", "status", "logged_at", "reason", "place"])
    else:
        e = e.dropDuplicates(["doc_id", "status", "logged_at", "reason", "place"])
    return e.groupBy(F.window("logged_at", width).alias("w"), "status").agg(F.count("*").alias("n"), F.max("severity").alias("severity")).select(F.col("w.start").alias("day"), "status", "n", "severity")
