"""Line sources in batch and as file streams; both give ``path`` and ``value``."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.operators import logs
from metricloom.operators.logs import LogLayout


def _with_path(lines: DataFrame) -> DataFrame:
    """Filters on the file path alone choose files before any of them is opened."""
    return lines.select(F.regexp_replace("_metadata.file_path", r"^file:/+", "/").alias("path"), "value")


def read_lines(spark: SparkSession, paths, glob: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _with_path(reader.text(paths))


def stream_lines(spark: SparkSession, path: str, glob: str | None = None, files_per_trigger: int | None = None,
                 since: datetime.datetime | None = None) -> DataFrame:
    """Tail a folder. Positions live in the query's checkpoint, so a restart goes on where it was.

    Without ``since`` reading begins at the head. With it, files written before that moment are
    skipped; give the same moment again after a restart.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.text(path)
    if since is not None:
        lines = lines.where(F.col("_metadata.file_modification_time") >= F.lit(since))
    return _with_path(lines)


def container_logs(spark: SparkSession, layout: LogLayout) -> DataFrame:
    return logs.application_files(read_lines(spark, layout.containers), layout)


def data_plane_logs(spark: SparkSession, layout: LogLayout) -> DataFrame:
    return logs.data_plane_files(read_lines(spark, layout.containers), layout)


def journal_records(spark: SparkSession, path: str) -> DataFrame:
    fields = ", ".join(f"{name} string" for name in logs.JOURNAL_FIELDS)
    return logs.journal(spark.read.schema(fields).json(path))


def host_logs(spark: SparkSession, dmesg: str, messages: str, secure: str, parser) -> DataFrame:
    """dmesg lines raw under ``message``; messages and secure through the syslog parser."""
    raw = spark.read.text(dmesg).select(F.lit("host.dmesg").alias("tag"), F.col("value").alias("message"))
    parts = [
        logs.parsed(spark.read.text(path), parser).drop("value").withColumn("tag", F.lit(f"host.{name}"))
        for name, path in (("messages", messages), ("secure", secure))
    ]
    for part in parts:
        raw = raw.unionByName(part, allowMissingColumns=True)
    return raw


def collected_logs(spark: SparkSession, folder: str, layout: LogLayout, component: str, instance: str) -> DataFrame:
    """Every line under ``folder`` whose path, as seen on the host, is on the collect list."""
    lines = read_lines(spark, folder)
    on_host = lines.withColumn("path", F.replace(F.col("path"), F.lit(folder.rstrip("/")), F.lit("")))
    return logs.route(on_host, layout, F.lit(component), F.lit(instance)).where("route_no IS NOT NULL")
