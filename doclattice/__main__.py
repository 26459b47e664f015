"""python -m doclattice INPUT --out FOLDER: converts a folder; 0 all complete, 1 not all, 2 wrong options."""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="doclattice")
    p.add_argument("input")
    p.add_argument("--out", required=True)
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--encoding")
    p.add_argument("--max-cells", type=int, default=2_000_000)
    p.add_argument("--split-chars", type=int, default=0)
    p.add_argument("--reuse", action="store_true")
    a = p.parse_args(argv)
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", a.input) and not a.input.startswith("file://") or a.split_chars < 0 or a.max_cells < 1:
        print("an address is no input" if "://" in a.input else "wrong option", file=sys.stderr)
        return 2
    from doclattice.model import Limits
    from doclattice.operators import assemble
    from doclattice.session import cut
    from doclattice.sources import convert, sinks
    from doclattice.streaming import ingest

    spark = SparkSession.builder.getOrCreate()
    limits = Limits(cells=a.max_cells)
    if a.reuse:
        ingest.ingest(spark, a.input, a.out, limits, a.encoding, a.recursive).awaitTermination()
        results, assets = ingest.outcome(spark, a.out), None
    else:
        files = convert.read(spark, a.input, a.recursive, limits)
        elements = cut(convert.extract(files, limits, a.encoding))
        converted, assets = convert.judged(files, elements, limits, a.encoding), convert.assets(elements)
        results = cut(converted.unionByName(convert.refused(spark, a.input, a.recursive, limits)))
        convert.write(results, f"{a.out}/table")
    if a.split_chars:
        from pyspark.sql import functions as F

        assemble.chunks(results.select(F.xxhash64("path").alias("doc_id"), F.col("markdown").alias("text")), a.split_chars).write.mode("overwrite").parquet(f"{a.out}/chunks")
    outcome = sinks.export(results, a.out, a.overwrite, os.path.abspath(a.input.removeprefix("file://")), assets).groupBy("outcome").count().collect()
    print(sinks.write_summary(results, a.out))
    conflict = any(r.outcome != "written" for r in outcome)
    return int(conflict or results.where("status not in ('success', 'skipped')").limit(1).count() > 0)


if __name__ == "__main__":
    sys.exit(main())
