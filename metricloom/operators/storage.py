"""Stored segments: what their files hold, layouts by day and by several columns, exact bitmaps in roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.operators.olap import TARGET_ROWS_PER_FILE, write_segments

# bits of a column in a clustering key: its values are cut into so many parts of about equal size
CLUSTER_BITS = 6


def segment_files(spark: SparkSession, path: str, columns: list[str], partitions: list[str]) -> DataFrame:
    """One row per file: its partition, bytes, rows, and the least and greatest value of each column.

    Only the named columns are read; path and size come from the files' own listing.
    """
    rows = spark.read.parquet(path)
    return rows.groupBy(*partitions, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[make(c).alias(f"{name}_{c}") for c in columns for name, make in (("min", F.min), ("max", F.max))])


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of every Parquet file below ``path`` as the file system lists them; no content is read."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return held.select(F.col("path").alias("file"), "length")


def segment_table(spark: SparkSession, path: str, ts: str, partitions: list[str]) -> DataFrame:
    """The system table of a stored table: files, bytes, rows, first and last time of every segment.

    ``complete`` tells whether every file of the segment is as long as the file system says.
    """
    files, listed = segment_files(spark, path, [ts], partitions), listed_files(spark, path)
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    own = listed.select(plain("file").alias("__file"), "length")
    return files.join(own, plain(F.col("file")) == F.col("__file"), "left").groupBy(*partitions).agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"),
        F.min(f"min_{ts}").alias("first"), F.max(f"max_{ts}").alias("last"),
        F.bool_and(F.coalesce(F.col("bytes") == F.col("length"), F.lit(False))).alias("complete"))


def write_days(rows: DataFrame, path: str, ts: str, day: str = "day", rows_per_file: int = TARGET_ROWS_PER_FILE) -> None:
    """A table laid out by day of ``ts``; rows without a time go to the default partition."""
    write_segments(rows.withColumn(day, F.to_date(ts)), path, day, [ts], rows_per_file)


def in_days(rows: DataFrame, ts: str, start: str, end: str, day: str = "day") -> DataFrame:
    """The rows of [start, end) of a table laid out by day: days are chosen by the folder, their rows by time."""
    low, high = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return rows.where((F.col(day) >= F.to_date(low)) & (F.col(day) <= F.to_date(high)) & (F.col(ts) >= low) & (F.col(ts) < high))


def bitmap_rollup(rows: DataFrame, ts: str, granularity: str, dims: list[str], number: str) -> DataFrame:
    """(time, dims, bucket, bits): which whole numbers occur, as bitmaps of 4 KiB for each 32,768 of them.

    Bitmaps of finer times or more dimensions add up to coarser ones without the rows. Null numbers aren't held.
    """
    return rows.where(F.col(number).isNotNull()).groupBy(
        F.date_trunc(granularity, ts).cast("timestamp_ntz").alias("time"), *dims, F.bitmap_bucket_number(number).alias("bucket"),
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def distinct_counts(rollup: DataFrame, granularity: str, dims: list[str]) -> DataFrame:
    """(time, dims, numbers): exact distinct numbers for each coarser time, from stored bitmaps alone."""
    time = F.date_trunc(granularity, "time").cast("timestamp_ntz").alias("time")
    merged = rollup.groupBy(time, *dims, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy("time", *dims).agg(F.sum(F.bitmap_count("bits")).alias("numbers"))


def part_of(value: Column, edges: list) -> Column:
    """How many of the rising edges lie below a value; a null has none."""
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, edges)), lambda edge: edge < value)), F.lit(0)) if edges else F.lit(0)


def interleaved(parts: list[Column], bits: int = CLUSTER_BITS) -> Column:
    """One number from the bits of several, highest first and in turns, so that rows near in all columns are near in it."""
    taken = [
        F.shiftleft(F.shiftright(part.cast("bigint"), bit).bitwiseAND(1), bit * len(parts) + len(parts) - 1 - i)
        for bit in range(bits) for i, part in enumerate(parts)]
    return reduce(lambda a, b: a.bitwiseOR(b), taken)


def cluster(rows: DataFrame, path: str, columns: list[str], files: int, bits: int = CLUSTER_BITS) -> None:
    """Write ``rows`` in ``files`` files, each of which holds a small range of all ``columns`` at once.

    Columns (numbers, dates or times) are cut at approximate quantiles, so skewed ones fill all parts; the order is that of
    the parts' interleaved bits. A value that a third of the rows have is spread over the other columns' parts.
    """
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    number = {c: F.col(c).cast("double") if kind not in ("date", "timestamp", "timestamp_ntz") else F.unix_micros(
        F.col(c).cast("timestamp")).cast("double") for c, kind in rows.dtypes if c in columns}
    found = rows.agg(*[F.percentile_approx(number[c], shares, 1_000).alias(c) for c in columns]).first()
    edges = {c: sorted(set(found[c] or [])) for c in columns}
    key = interleaved([part_of(number[c], edges[c]) for c in columns], bits)
    rows.withColumn("__key", key).repartitionByRange(files, "__key", *columns).sortWithinPartitions("__key", *columns).drop(
        "__key").write.parquet(path)


def files_to_open(files: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """The files whose least and greatest values leave room for a row with every column in its range."""
    for column, (low, high) in ranges.items():
        files = files.where((F.col(f"min_{column}") <= F.lit(high)) & (F.col(f"max_{column}") >= F.lit(low)))
    return files
