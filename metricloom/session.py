"""Session settings, shared scratch space and the size-checked small-table helper."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Literal tables up to this size are broadcast whatever the session's threshold.
LITERAL_BYTES = 1 << 20

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, app: str = "metricloom", **extra) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the transforms rely on to a session somebody else built."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset, as in tests, a folder
    of this machine, and only if the master is local and so has no other machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return os.path.join(tempfile.gettempdir(), f"metricloom-{os.getpid()}")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/metricloom/{label}-{uuid.uuid4().hex}"


_TEMPORARY: ContextVar[list[str] | None] = ContextVar("temporary tables", default=None)


@contextmanager
def temporary_tables(spark: SparkSession):
    """Remove the tables stored inside the block when it ends; their readers must be done by then."""
    paths: list[str] = []
    token = _TEMPORARY.set(paths)
    try:
        yield
    finally:
        _TEMPORARY.reset(token)
        for path in paths:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote, in whatever file system it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage to recompute when executors
    are lost, and no second run of a costly plan."""
    path = scratch_path(df.sparkSession, label)
    paths = _TEMPORARY.get()
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(df: DataFrame, label: str) -> DataFrame:
    """As ``stored``, and the shuffle files of the plan are removed once it is written, as no other plan reads them."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        return stored(df, label)
    finally:
        spark.conf.set(name, before)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Store a join side that is meant to be small, so that its size in bytes is known.

    The planner broadcasts it below ``spark.sql.autoBroadcastJoinThreshold`` and sort-merge joins it
    above, where AQE splits skewed keys.
    """
    return stored(df, label)


def dealt(df: DataFrame, keys: list[str], task_rows: int) -> DataFrame:
    """``df`` dealt by ``keys`` over so many tasks that each has about ``task_rows`` rows, however large the table.

    For rows that each become many of a group of their own: counted where they lie, they would take a map of all groups of
    an input split, and its size grows with the split. Grouping by these keys and others needs no further shuffle.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // task_rows))
    return df.repartition(tasks, *keys)


def literal_table(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """A table of the driver's own rows; the planner is told to broadcast it if its bytes, known here, are few."""
    table = pa.Table.from_pylist(rows, schema=schema)
    frame = spark.createDataFrame(table)
    return F.broadcast(frame) if table.nbytes <= LITERAL_BYTES else frame
