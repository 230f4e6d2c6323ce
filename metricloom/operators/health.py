"""Ingestion, lag, cache, task and segment health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.session import settle

LOAD_STATUS = "map<string,map<string,bigint>>"


def pending_segments(status: Column, tier: str) -> Column:
    """Pending segments of one tier, 0 where the tier is missing."""
    counts = F.map_values(F.try_element_at(status, F.lit(tier)))
    return F.coalesce(F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, v: a + v), F.lit(0).cast("bigint"))


def load_progress(lines: DataFrame, column: str, tier: str) -> DataFrame:
    status = F.from_json(F.col(column), LOAD_STATUS)
    return lines.withColumn("pending", pending_segments(status, tier)).withColumn("done", F.col("pending") == 0)


def ingestion_counters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counters per key from rows flagged ``unparseable``, ``thrown_away`` and ``duplicate``.

    Every parsed, punctual, first-seen row is processed; ``output`` counts the distinct roll-up
    keys, which the caller passes as ``rollup_key``.
    """
    good = ~(F.col("unparseable") | F.col("thrown_away") | F.col("duplicate"))
    # rows meet per (key, roll-up key) first, so a hot data source is counted in parallel
    partial = rows.groupBy(*keys, F.when(good, F.col("rollup_key")).alias("__rollup")).agg(
        F.count_if(good).alias("processed"),
        F.count_if("unparseable").alias("unparseable"),
        F.count_if(~F.col("unparseable") & F.col("thrown_away")).alias("thrown_away"),
        F.count_if(~F.col("unparseable") & ~F.col("thrown_away") & F.col("duplicate")).alias("duplicate"),
    )
    counters = ["processed", "unparseable", "thrown_away", "duplicate"]
    return partial.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in counters], F.count("__rollup").alias("output")
    ).withColumn("rollup_ratio", F.try_divide(F.col("output"), F.col("processed")))


def partition_lag(offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Newest minus committed offset of every partition, each from its newest report."""
    last = offsets.groupBy(*keys, "partition").agg(
        F.max("latest").alias("latest"), F.max("committed").alias("committed")
    )
    return last.withColumn("lag", F.greatest(F.lit(0), F.col("latest") - F.col("committed")))


def stream_lag(offsets: DataFrame, keys: list[str]) -> DataFrame:
    return partition_lag(offsets, keys).groupBy(*keys).agg(
        F.sum("lag").alias("lag"), F.max("lag").alias("max_lag"), F.avg("lag").alias("avg_lag")
    )


def message_gap(rows: DataFrame, keys: list[str], ts: str, as_of: str) -> DataFrame:
    """Milliseconds between ``as_of`` and the newest event of each key."""
    now = F.unix_millis(F.lit(as_of).cast("timestamp_ntz").cast("timestamp"))
    newest = rows.groupBy(*keys).agg(F.max(ts).alias("newest"))
    return newest.withColumn("gap_ms", now - F.unix_millis(F.col("newest").cast("timestamp")))


def cache_ratios(rows: DataFrame, keys: list[str], bucket: Column, hit: Column, size: Column) -> DataFrame:
    """Per bucket and in total: hits, misses, hit rate, average bytes.

    Totals and deltas run over buckets, never over rows.
    """
    delta = rows.groupBy(*keys, bucket.alias("bucket")).agg(
        F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.sum(size).alias("bytes"),
    )
    so_far = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    return delta.withColumns({
        "hit_rate": F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")),
        "average_bytes": F.try_divide(F.col("bytes"), F.col("hits") + F.col("misses")),
        "total_hits": F.sum("hits").over(so_far),
        "total_misses": F.sum("misses").over(so_far),
    })


def counter_deltas(totals: DataFrame, keys: list[str], columns: list[str], order: str = "bucket") -> DataFrame:
    """Total counters back to per-bucket differences; the first bucket keeps its total."""
    previous = W.partitionBy(*keys).orderBy(order)
    return totals.withColumns({
        f"delta_{c}": F.col(c) - F.coalesce(F.lag(c).over(previous), F.lit(0)) for c in columns
    })


def segment_inventory(segments: DataFrame, keys: list[str], capacity: float, target: int) -> DataFrame:
    return segments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("bytes").alias("size"),
        F.sum(F.when(F.col("available"), F.col("bytes")).otherwise(0.0)).alias("used"),
        F.count_if(~F.col("available")).alias("unavailable"),
        F.count_if(F.col("replicas") < target).alias("under_replicated"),
    ).withColumn("used_percent", F.try_divide(F.col("used"), F.lit(capacity)) * 100)


def compaction_inventory(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes, segments and distinct intervals per compaction status.

    Grouped by interval first: the distinct count needs no per-key set.
    """
    daily = segments.groupBy(*keys, "status", "day").agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("segments")
    )
    return daily.groupBy(*keys, "status").agg(
        F.sum("bytes").alias("bytes"), F.sum("segments").alias("segments"),
        F.count(F.lit(1)).alias("intervals"),
    )


def task_outcomes(tasks: DataFrame, keys: list[str], states: list[str]) -> DataFrame:
    """One count column per state, zeros included; the states are fixed, so pivot needs no scan."""
    return tasks.groupBy(*keys).pivot("state", states).count().na.fill(0, states)


def slot_totals(tasks: DataFrame, category: str) -> DataFrame:
    busy = F.col("state") == "running"
    return tasks.groupBy(category).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(busy).alias("used"), F.count_if(~busy).alias("idle")
    )


def late_rows(rows: DataFrame, ts: str, batch: str, delay_us: int, block: int = 1_000) -> DataFrame:
    """Add ``thrown_away``: older than the watermark its arrival batch started with.

    The watermark of a batch is the newest event time of all earlier batches minus the delay. It
    is a running maximum over one row for each batch, taken within blocks of batch numbers and then
    over the blocks, so that only one row in ``block`` batches meets all others. (A streaming query
    filters with the watermark one micro-batch older, so it may still let in a few rows this calls late.)
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    newest = rows.groupBy(batch).agg(F.max(micros).alias("__newest")).withColumn("__block", F.floor(F.col(batch) / block))
    earlier = W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = newest.groupBy("__block").agg(F.max("__newest").alias("__top")).select(
        "__block", F.max("__top").over(earlier).alias("__before"))
    inside = W.partitionBy("__block").orderBy(batch).rowsBetween(W.unboundedPreceding, -1)
    so_far = F.greatest(F.max("__newest").over(inside), F.col("__before"))
    marks = settle(newest.join(blocks, "__block").select(batch, (so_far - delay_us).alias("__mark")), "watermarks")
    late = F.coalesce(micros < F.col("__mark"), F.lit(False))
    return rows.join(marks, batch).withColumn("thrown_away", late).drop("__mark")


def by_priority(tiers: DataFrame, priority: str, ties: list[str]) -> DataFrame:
    """Highest priority first, a missing one counts as 0; ``tiers`` is one row per tier."""
    ranked = tiers.withColumn(priority, F.coalesce(priority, F.lit(0)))
    order = W.orderBy(F.desc(priority), *ties)
    return ranked.withColumn("position", F.row_number().over(order).cast("bigint")).orderBy("position")
