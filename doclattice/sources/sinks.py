"""Sinks: Markdown files committed atomically from the executors, the run's summary, the reuse manifest."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.operators import verify

# How a status is told in a result.
LABELS = {
    "success": "success (전체 보존 검증 통과)", "partial": "partial (누락·변형 확인)", "unverified": "unverified (보존 확인 불가)",
    "failed": "failed", "unsupported": "unsupported", "skipped": "skipped",
}


def status_section(status: Column, checks: Column, warnings: Column, n_assets: Column) -> Column:
    """The section at a result's end that tells its status, checks and warnings."""
    label = F.coalesce(*(F.when(status == k, v) for k, v in LABELS.items()))
    none = F.array().cast("array<string>")
    told = F.transform(F.coalesce(checks, F.array()), lambda c: F.concat(F.lit("- 보존 검사 · "), F.coalesce(c["item"], F.lit("")), F.lit(": "), F.to_json(c)))
    said = F.transform(F.filter(F.coalesce(warnings, none), lambda w: w.isNotNull()), lambda w: F.concat(F.lit("- 경고: "), w))
    kept = F.when(n_assets > 0, F.array(F.concat(F.lit("- 보조 파일: "), n_assets.cast("string"), F.lit("개")))).otherwise(none)
    note = F.when(status != "success", F.array(F.lit(""), F.lit("> 이 결과는 완전 보존 검증을 통과하지 못했다. 원본을 대체하지 않는다."))).otherwise(none)
    head = F.array(F.lit(""), F.lit("---"), F.lit(""), F.lit("## 변환 상태"), F.lit(""), F.concat(F.lit("- 상태: **"), label, F.lit("**")))
    return F.concat(F.array_join(F.concat(head, told, said, kept, note), "\n"), F.lit("\n"))


def _commit(path: str, data: bytes, overwrite: bool) -> str:
    """Writes beside the target, moves into place and reads back; without overwriting, the first writer wins."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".part-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        if overwrite:
            os.replace(temp, path)
        else:
            with suppress(FileExistsError):  # a task that runs again finds its own file
                os.link(temp, path)
        with open(path, "rb") as f:
            return "written" if f.read() == data else "conflict"
    finally:
        if os.path.exists(temp):
            os.unlink(temp)


def target(path: str, root: str, folder: str, complete: bool, suffix: str) -> str:
    """Where an output belongs: the file's own place below the root, so that equal names in two folders don't meet; unfinished ones below ``_incomplete``."""
    bare, top = (re.sub(r"^[a-z]+:/+", "/", x) for x in (path, root))
    inside = os.path.relpath(bare, top) if top and os.path.commonpath([bare, top]) == top.rstrip("/") else bare.lstrip("/")
    return os.path.join(folder, *([] if complete else ["_incomplete"]), inside + suffix)


def export(results: DataFrame, folder: str, overwrite: bool = False, root: str = "", assets: DataFrame | None = None) -> DataFrame:
    """(path, target, outcome) of every file written into a folder that all executors share.

    Each result gives its Markdown with its status section, and a JSON file of what is known of it;
    each asset its bytes in the folder ``NAME.media`` that the Markdown's links name. Every file is
    read back: ``conflict`` is one that holds something else. With ``overwrite``, what a former run
    left of the same result in the other folder is removed.
    """
    checks = results["checks"] if "checks" in results.columns else F.array(F.struct(F.lit("shortfall").alias("item"), F.col("lost").alias("lost"), F.col("kinds").alias("kinds"))) if "lost" in results.columns else F.array().cast("array<struct<item:string>>")
    none = F.array().cast("array<string>")
    warnings = F.col("warnings") if "warnings" in results.columns else none
    n_assets = F.col("n_assets") if "n_assets" in results.columns else F.lit(0)
    told = [c for c in ("path", "fmt", "status", "warnings", "lost", "kinds", "n_assets") if c in results.columns]
    rows = results.select("path", "status", "markdown", status_section(F.col("status"), checks, warnings, n_assets).alias("section"), F.to_json(F.struct(*told)).alias("facts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, status, text, section, facts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                name = os.path.basename(path) + ".media/"
                body = (text or "").replace("](media/", f"]({name}")
                for suffix, data in ((".md", body + (section or "")), (".json", facts)):
                    at = target(path, root, folder, status == "success", suffix)
                    if overwrite:
                        with suppress(FileNotFoundError):
                            os.unlink(target(path, root, folder, status != "success", suffix))
                    out.append((path, at, _commit(at, data.encode("utf-8", "replace"), overwrite)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["path", "target", "outcome"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, status, name, sha256, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = os.path.join(target(path, root, folder, status == "success", ".media"), re.sub(r"^media/", "", name).replace("..", "_"))
                same = data is not None and hashlib.sha256(data).hexdigest() == sha256
                out.append((path, at, _commit(at, data, overwrite) if same else "damaged"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["path", "target", "outcome"])

    schema = "path string, target string, outcome string"
    written = rows.mapInArrow(run, schema)
    if assets is not None:
        each = assets.dropDuplicates(["path", "name"]).join(results.select("path", "status"), "path").select("path", "status", "name", "sha256", "data")
        written = written.unionByName(each.mapInArrow(keep, schema))
    return written


def write_summary(results: DataFrame, folder: str) -> str:
    """Writes ``summary.json`` of a run and gives its text."""
    told = summary(results)
    _commit(os.path.join(folder, "summary.json"), told.encode(), True)
    return told


def summary(results: DataFrame) -> str:
    """Counts, completeness and exit code of a run as JSON: a few numbers, whatever the run's size."""
    r = verify.summary(results.withColumn("_all", F.lit(1)), "_all").head()
    if r is None:
        return json.dumps({"n": 0, "complete": True, "exit_code": 0})
    return json.dumps({k: v for k, v in r.asDict().items() if k != "_all"}, ensure_ascii=False)
