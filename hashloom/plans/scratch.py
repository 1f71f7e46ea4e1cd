"""Intermediate tables in shared storage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: a subfolder of spark.checkpoint.dir.

    Where that setting is absent, a temporary folder serves single-machine
    sessions only; on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="hashloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/hashloom-{spark.sparkContext.applicationId}"


#: Whether a query's shuffle files go when it ends, instead of when the driver next collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writers: dict[int, list] = {}  # by session: how many write now, and the setting before the first of them
_scopes = threading.local()


@contextmanager
def _released_shuffles(spark: SparkSession):
    """SHUFFLES_GO while tables are written; writers of one session may overlap, and the last one puts the setting back."""
    with _lock:
        held = _writers.setdefault(id(spark), [0, spark.conf.get(SHUFFLES_GO, "false")])
        held[0] += 1
        spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(SHUFFLES_GO, held[1])
                del _writers[id(spark)]


@contextmanager
def scope(spark: SparkSession):
    """Intermediate tables that this thread makes within are deleted at its end: what is wanted of them must be written or collected by then."""
    held = getattr(_scopes, "held", [])
    _scopes.held = [*held, []]
    try:
        yield
    finally:
        for path in _scopes.held[-1]:
            _delete(spark, path)
        _scopes.held = held


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application."""
    _delete(spark, scratch_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, which cuts its lineage.

    The files survive the loss of any executor, so the shuffles that made them are
    released at once. The table stays until its ``scope`` ends, or ``clear``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_scopes, "held", None):
        _scopes.held[-1].append(path)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with _released_shuffles(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
