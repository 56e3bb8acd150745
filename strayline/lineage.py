"""Cutting lineage, shared scratch folders and size-checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
# Deletes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back on a temporary folder: on a cluster it
    would not outlive the executor that wrote to it.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="strayline-")
    context.setCheckpointDir(made)
    return made


def scratch_root(spark: SparkSession) -> str:
    """The one folder that holds all scratch tables of this application."""
    return f"{shared_dir(spark).rstrip('/')}/strayline-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete every scratch table this application has written.

    Call it when no DataFrame that came from ``cut`` is needed any more. It also
    runs when the driver's Python ends, if the session still lives then.
    """
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    root.getFileSystem(context._jsc.hadoopConfiguration()).delete(root, True)


_OWNED: set[str] = set()


def _release_at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        release(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the application's scratch folder that nothing else uses."""
    root = scratch_root(spark)
    if root not in _OWNED:
        _OWNED.add(root)
        atexit.register(_release_at_exit, spark)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    if _JOBS:
        _JOBS[-1].append(path)
    return path


_JOBS: list[list[str]] = []


class Job:
    """What a job has written; ``keep`` writes a table that outlives it."""

    def __init__(self, tables: list[str]):
        self.tables = tables

    def keep(self, df: DataFrame) -> DataFrame:
        kept = cut(df)
        path = self.tables.pop()
        if len(_JOBS) > 1:
            _JOBS[-2].append(path)
        return kept


@contextmanager
def job(spark: SparkSession) -> Iterator[Job]:
    """Scratch tables made inside are deleted at the end, those of ``keep`` excepted.

    A result that is still to be computed reads such tables: keep it, or write it, before
    the end. Jobs may be nested; what an inner one keeps belongs to the outer one.
    """
    tables: list[str] = []
    _JOBS.append(tables)
    try:
        yield Job(tables)
    finally:
        _JOBS.remove(tables)
        context = spark.sparkContext
        for table in tables:
            path = context._jvm.org.apache.hadoop.fs.Path(table)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        # Spark drops broadcasts and shuffle files of plans that are gone once its driver has collected them.
        gc.collect()
        context._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written table.

    Unlike ``checkpoint``, the table is computed a single time, later reads are
    pruned to their columns, and its real size is known to the optimizer. What was
    shuffled for it is deleted once it is written, so a job of many steps holds one step's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast ``df`` when its known size is small, else leave the join to Spark."""
    if rows * row_bytes <= BROADCAST_LIMIT_BYTES:
        return F.broadcast(df)
    return df
