"""Session helpers: table reading, lineage cutting, shipping the package to executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application.

    In local mode nothing is sent where the workers' own path has the package already.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    local = sc.master.startswith("local[") or sc.master == "local"
    if sc.applicationId in _SHIPPED or local and root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    stem = os.path.join(tempfile.mkdtemp(), "doclattice_pkg")
    sc.addPyFile(shutil.make_archive(stem, "zip", root, "doclattice"))
    _SHIPPED.add(sc.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage by a reliable checkpoint.

    The folder is that of ``spark.checkpoint.dir``; only where the session has none (tests, local
    runs) a temporary one is set, and never on a cluster.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="doclattice-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def parallelism(df: DataFrame, least: int = 8) -> int:
    """The number of partitions that wide Python stages use: the session's shuffle setting."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
