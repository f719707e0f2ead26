"""Tables staged in the folder that all executors share.

Iterative operators cut their lineage by writing a table below
``spark.checkpoint.dir`` and reading it back: the files outlive any executor.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where it names none, a temporary one is made for a local session (tests, one
    machine) and removed at exit; a cluster's executors couldn't share such a folder, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        kept = spark.sparkContext.getCheckpointDir()
        if kept:
            path = kept
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="vouchline-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            path = "file://" + folder
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once a session, wherever the driver runs it from. The driver serves the
    file to every executor, also to one that comes later."""
    context = spark.sparkContext
    if getattr(context, "_vouchline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="vouchline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    packed = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(packed)
    context._vouchline_shipped = True


class Staging:
    """Written tables of one operator call; tables no longer needed are dropped early, the rest at exit."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.drop, self.root)

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def put(self, df: DataFrame) -> DataFrame:
        """Write df and return the written table, with ``staged_at`` as its path."""
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_at = path
        return out

    def drop(self, *paths: str | DataFrame | None) -> None:
        for path in paths:
            path = getattr(path, "staged_at", None) if isinstance(path, DataFrame) else path
            if not path:
                continue
            try:
                jvm = self.spark.sparkContext._jvm
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            except Exception:  # noqa: BLE001 - the session may be gone; nothing depends on the removal
                pass


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only when df is counted to hold at most ``rows`` rows; else Spark picks the join. For rows of a few
    short fields, of which the count bounds the size."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
