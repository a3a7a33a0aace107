"""What operators need from the running session: shared folder, sizes, shipping of this package."""

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


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; on a local master without one, a folder that goes with the process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="trovelle-")
        atexit.register(shutil.rmtree, named, True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


_TABLES: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the context is gone; a local folder goes all the same
        shutil.rmtree(path.removeprefix("file://"), True)


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_TABLES.items()):
        _remove(spark, path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Marks a folder of the shared folder as one that goes with the process."""
    _TABLES[path] = spark


def stored(df: DataFrame, parts: int = 0) -> DataFrame:
    """The rows of df from a compressed table in the shared folder, which cuts the lineage; the table goes with the process or by release().

    Once the table is written, the shuffle files of the step are not needed any more and are given back at once.
    `parts` raises the shuffle partitions of the step where the session has fewer; adaptive execution still splits and
    joins them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/trovelle-{uuid.uuid4().hex}"
    wanted = {_CLEANUP: "true", "spark.sql.shuffle.partitions": str(max(parts, partitions(spark)))}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _TABLES[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


cut = stored  # for steps whose rows are narrow


def release(df: DataFrame) -> None:
    """Deletes the table behind a DataFrame of stored() that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path is not None and _TABLES.pop(path, None) is not None:
        _remove(df.sparkSession, path)


def ship(spark: SparkSession) -> None:
    """Sends this package to workers that would not find it: once a context, and not where PYTHONPATH names its place already."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    found = any(os.path.realpath(p) == str(root.parent) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)
    if (found and sc.master.startswith("local")) or getattr(sc, "_trovelle_shipped", False):
        return
    shared = spark.conf.get("spark.checkpoint.dir", "").removeprefix("file://")
    if shared.startswith("/") and os.path.isdir(shared):
        folder = os.path.join(shared, f"trovelle-{uuid.uuid4().hex}")
        os.makedirs(folder)
    else:
        folder = tempfile.mkdtemp(prefix="trovelle-")  # the driver serves the file from here
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "trovelle.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(path)
    sc._trovelle_shipped = True


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def pages_for(df: DataFrame, text_cols: list[str], page_mb: float = 8.0) -> int:
    """How many pages of about page_mb hold the texts of df: one pass that reads only their lengths."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in text_cols), F.lit(0).cast("long"))
    total = df.select(F.sum(size).alias("n")).first()["n"] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, int(total / (page_mb * 1e6)) + 1)
