"""Query shapes, sketches, roll-up tables, overwrites, compaction and tiers."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.session import literal_table, settle

TARGET_ROWS_PER_FILE = 5_000_000
# rows that one task sorts to write them
TASK_ROWS = 1_000_000
# items of a sketch that is built by parts: an HLL sketch of so few keeps a hash of each (one pair of items in 200 million
# shares one), a theta sketch holds 4,096
PART_ITEMS = 64


def in_interval(rows: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Half-open time filter over constants, pushed to the scan."""
    at = F.col(ts)
    return rows.where((at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz")))


def timeseries(rows: DataFrame, ts: str, period: str, measures: list[Column]) -> DataFrame:
    return rows.groupBy(F.window(ts, period)["start"].alias("bucket")).agg(*measures)


def top_n(rows: DataFrame, dimension: str, measure: Column, threshold: int) -> DataFrame:
    """The ``threshold`` highest values of a dimension; ties go to the lower dimension value."""
    return rows.groupBy(dimension).agg(measure.alias("score")).orderBy(
        F.desc("score"), dimension
    ).limit(threshold)


def top_n_per_bucket(rows: DataFrame, ts: str, period: str, dimension: str, measure: Column,
                     threshold: int) -> DataFrame:
    """Top-N within every bucket, over aggregated rows; Spark prunes each task to N first."""
    scored = rows.groupBy(F.window(ts, period)["start"].alias("bucket"), dimension).agg(measure.alias("score"))
    order = W.partitionBy("bucket").orderBy(F.desc("score"), dimension)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= threshold)


def item_part(rows: DataFrame, item: str, held: int = PART_ITEMS) -> Column:
    """The part that an item is sketched in: so many parts that each holds about ``held`` items of ``rows``.

    A sketch of few items holds them all, so the parts' estimates are counts and add up to the count of all items.
    """
    items = rows.agg(F.approx_count_distinct(item)).first()[0]
    return F.pmod(F.xxhash64(item), F.lit(max(1, -(-items // held))))


def sketches(rows: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """Mergeable distinct and quantile sketches per key: store these, union them later."""
    return rows.groupBy(*keys).agg(
        F.hll_sketch_agg(item).alias("hll"),
        F.theta_sketch_agg(item).alias("theta"),
        F.kll_sketch_agg_double(F.col(value)).alias("kll"),
    )


def merge_sketches(stored: DataFrame, keys: list[str]) -> DataFrame:
    return stored.groupBy(*keys).agg(
        F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta").alias("theta")
    )


def rollup_table(rows: DataFrame, ts: str, granularity: str, dims: list[str], value: str) -> DataFrame:
    """Ingestion-time roll-up: one row per truncated time and dimension combination."""
    return rows.groupBy(F.date_trunc(granularity, F.col(ts)).cast("timestamp_ntz").alias("time"), *dims).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(value).alias("sum"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def write_segments(rows: DataFrame, path: str, partition: str, sort: list[str] | None = None,
                   rows_per_file: int = TARGET_ROWS_PER_FILE, mode: str = "overwrite", task_rows: int = TASK_ROWS) -> None:
    """Partitioned parquet whose files hold at most ``rows_per_file`` rows.

    A small table is rebalanced on the partition column, which lets Spark split a partition holding a
    third of the rows and join small ones; a larger one is dealt by counted rows. So no task sorts
    more than about ``task_rows`` of them, however large the table and however well it compresses.
    """
    laid_out = _laid_out(rows, partition, task_rows)
    if sort:
        laid_out = laid_out.sortWithinPartitions(partition, *sort)
    writer = laid_out.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _laid_out(rows: DataFrame, partition: str, task_rows: int) -> DataFrame:
    """Rows of one partition side by side, cut into tasks of equal size as if they were numbered in that order.

    The partitions' sizes, one small row each, are added up; a row takes a place among its partition's by a hash of where it was read.
    """
    sizes = settle(rows.groupBy(partition).agg(F.count(F.lit(1)).alias("__n")), "partition-sizes")
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    if total <= task_rows:
        return rows.hint("rebalance", partition)
    earlier = W.orderBy("__value").rowsBetween(W.unboundedPreceding, -1)
    begun = sizes.select(F.col(partition).alias("__value"), "__n").withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    placed = rows.withColumn("__read", F.monotonically_increasing_id()).join(begun, F.col(partition).eqNullSafe(F.col("__value")))
    task = (F.col("__before") + F.pmod(F.xxhash64("__read"), F.col("__n"))) / task_rows
    return placed.repartitionById(-(-total // task_rows), F.floor(task).cast("int")).select(*rows.columns)


def overwrite_interval(replacement: DataFrame, path: str, partition: str) -> None:
    """Replace just the partitions present in ``replacement``; all others stay."""
    write_segments(replacement, path, partition)


def newest_versions(rows: DataFrame, interval: list[str], version: str) -> DataFrame:
    """Rows of the newest version of each interval; older versions are overshadowed.

    The newest version per interval is a settled aggregate joined back: few intervals are
    broadcast and the rows not shuffled at all, and a large interval is never sorted in one task.
    """
    newest = settle(rows.groupBy(*interval).agg(F.max(version).alias(version)), "newest-versions")
    return rows.join(newest, [*interval, version], "left_semi")


def overshadowed(rows: DataFrame, interval: list[str], version: str) -> DataFrame:
    """Per interval: versions and rows a newer version hides."""
    versions = rows.groupBy(*interval, version).agg(F.count(F.lit(1)).alias("rows"))
    newest = W.partitionBy(*interval)
    hidden = versions.withColumn("__newest", F.max(version).over(newest)).where(F.col(version) < F.col("__newest"))
    return hidden.groupBy(*interval).agg(
        F.count(F.lit(1)).alias("versions"), F.sum("rows").alias("rows")
    )


def compact(spark: SparkSession, source: str, target: str, partition: str, sort: list[str],
            rows_per_file: int = TARGET_ROWS_PER_FILE) -> None:
    """Rewrite many small files as few sorted ones, partition by partition."""
    write_segments(spark.read.parquet(source), target, partition, sort, rows_per_file)


def system_columns(spark: SparkSession, database: str | None = None, like: str | None = None) -> DataFrame:
    """One row per column of the session catalog's tables and views: table, kind, column, type, place.

    It asks the catalog alone and scans no table.
    """
    rows = []
    for table in spark.catalog.listTables(database, like):
        place = table.name if table.isTemporary else ".".join([*(table.namespace or []), table.name])
        for i, column in enumerate(spark.catalog.listColumns(place), start=1):
            rows.append({"table_name": table.name, "table_type": table.tableType, "column_name": column.name,
                         "data_type": column.dataType, "position": i})
    return literal_table(spark, rows, pa.schema([
        ("table_name", pa.string()), ("table_type", pa.string()), ("column_name", pa.string()),
        ("data_type", pa.string()), ("position", pa.int64())]))


@contextmanager
def query_context(spark: SparkSession, **settings):
    """Settings in force for the actions inside the block, restored afterwards."""
    keys = {name.replace("__", "."): str(value) for name, value in settings.items()}
    before = {key: spark.conf.get(key, None) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        yield spark
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
