"""Segment loading, ingestion, lag, caches, tasks and tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.operators import health as H
from metricloom.plans.registry import query
from metricloom.plans.views import bucket, sql
from metricloom.sources import tables

AS_OF = "2024-02-01"


@query("S9 G5", sql("segments", """
SELECT day, coalesce(p, 0) AS pending, coalesce(p, 0) = 0 AS done
FROM (SELECT day, CAST(sum(rows % 4) FILTER (tier = 'hot') AS BIGINT) AS p FROM segments GROUP BY 1) s"""))
def load_status(spark, folder):
    """Daily load status as JSON text ``tier -> data source -> pending``, and its hot tier."""
    per_tier = tables.segments(spark, folder).groupBy("day", "tier", "data_source").agg(
        F.sum(F.col("rows") % 4).alias("pending"))
    # a day has at most tiers x data sources entries
    inner = per_tier.groupBy("day", "tier").agg(
        F.map_from_entries(F.collect_list(F.struct("data_source", "pending"))).alias("sources"))
    status = inner.groupBy("day").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("tier", "sources")))).alias("status"))
    return H.load_progress(status, "status", "hot").select("day", "pending", "done")


INGESTED = f""", batches AS (
  SELECT *, epoch_us(ts) + k * 60000000 AS arrived FROM ev),
sliced AS (SELECT *, arrived // 600000000 AS batch FROM batches),
marks AS (
  SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000000 AS mark
  FROM (SELECT batch, max(epoch_us(ts)) AS newest FROM sliced GROUP BY 1) b),
flagged AS (
  SELECT s.*, s.k % 13 = 0 AS unparseable, coalesce(epoch_us(s.ts) < m.mark, false) AS thrown_away,
    row_number() OVER (PARTITION BY user_id, event_type, {bucket('10 minutes')} ORDER BY event_id) > 1 AS duplicate
  FROM sliced s JOIN marks m USING (batch))"""


def flagged(spark, folder):
    """Events in arrival batches of 10 minutes; the k-th minute after the event is its arrival."""
    rows = tables.events(spark, folder)
    batch = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) + F.col("k") * 60_000_000) / 600_000_000)
    late = H.late_rows(rows.withColumn("batch", batch), "ts", "batch", 3_600_000_000)
    first = rows.groupBy("user_id", "event_type", F.window("ts", "10 minutes")["start"].alias("slot")).agg(
        F.min("event_id").alias("first_id"))
    return late.withColumn("slot", F.window("ts", "10 minutes")["start"]).join(
        first, ["user_id", "event_type", "slot"]
    ).select(
        "event_type", "user_id", "ts", "event_id", "thrown_away",
        (F.col("k") % 13 == 0).alias("unparseable"), (F.col("event_id") != F.col("first_id")).alias("duplicate"),
    )


@query("G8 T5 T6 T7", sql("ev", INGESTED + """
SELECT event_type AS data_source,
  count(*) FILTER (NOT unparseable AND NOT thrown_away AND NOT duplicate) AS processed,
  count(*) FILTER (unparseable) AS unparseable,
  count(*) FILTER (NOT unparseable AND thrown_away) AS thrown_away,
  count(*) FILTER (NOT unparseable AND NOT thrown_away AND duplicate) AS duplicate,
  count(DISTINCT CASE WHEN NOT unparseable AND NOT thrown_away AND NOT duplicate
    THEN user_id || '/' || date_trunc('day', ts) END) AS output,
  round(count(DISTINCT CASE WHEN NOT unparseable AND NOT thrown_away AND NOT duplicate
    THEN user_id || '/' || date_trunc('day', ts) END)
    / count(*) FILTER (NOT unparseable AND NOT thrown_away AND NOT duplicate), 6) AS rollup_ratio
FROM flagged GROUP BY 1"""))
def ingestion_health(spark, folder):
    rows = flagged(spark, folder).withColumnRenamed("event_type", "data_source").withColumn(
        "rollup_key", F.struct("user_id", F.date_trunc("day", "ts")))
    done = H.ingestion_counters(rows, ["data_source"])
    return done.withColumn("rollup_ratio", F.round("rollup_ratio", 6))


@query("T5", sql("ev", INGESTED + """
SELECT event_id, thrown_away FROM flagged"""))
def late_events(spark, folder):
    return flagged(spark, folder).select("event_id", "thrown_away")


@query("G9", sql("partition_lag", """
SELECT data_source, stream, part AS "partition", latest, committed, lag FROM partition_lag"""))
def partition_lag(spark, folder):
    return H.partition_lag(tables.offsets(spark, folder), ["data_source", "stream"])


@query("G9", sql("partition_lag", """
SELECT data_source, stream, CAST(sum(lag) AS BIGINT) AS lag, max(lag) AS max_lag, round(avg(lag), 6) AS avg_lag
FROM partition_lag GROUP BY 1, 2"""))
def stream_lag(spark, folder):
    return H.stream_lag(tables.offsets(spark, folder), ["data_source", "stream"]).withColumn(
        "avg_lag", F.round("avg_lag", 6))


@query("G10", f"""
SELECT event_type AS data_source, max(ts) AS newest,
  epoch_us(TIMESTAMP '{AS_OF}') // 1000 - epoch_us(max(ts)) // 1000 AS gap_ms FROM events GROUP BY 1""")
def message_gap(spark, folder):
    rows = tables.table(spark, folder, "events").withColumnRenamed("event_type", "data_source")
    return H.message_gap(rows, ["data_source"], "ts", AS_OF)


CACHE = f""", delta AS (
  SELECT event_type AS cache, {bucket('6 hours')} AS bucket, count(*) FILTER (k % 10 >= 3) AS hits,
    count(*) FILTER (k % 10 < 3) AS misses, CAST(sum(k) AS BIGINT) AS bytes FROM ev GROUP BY 1, 2),
totals AS (
  SELECT *, CAST(sum(hits) OVER w AS BIGINT) AS total_hits, CAST(sum(misses) OVER w AS BIGINT) AS total_misses
  FROM delta WINDOW w AS (PARTITION BY cache ORDER BY bucket))"""


def cache(spark, folder):
    rows = tables.events(spark, folder).withColumnRenamed("event_type", "cache")
    return H.cache_ratios(
        rows, ["cache"], F.window("ts", "6 hours")["start"], F.col("k") % 10 >= 3, F.col("k")
    )


@query("G11", sql("ev", CACHE + """
SELECT cache, bucket, hits, misses, bytes, round(hits / (hits + misses), 6) AS hit_rate,
  round(bytes / (hits + misses), 6) AS average_bytes, total_hits, total_misses FROM totals"""))
def cache_ratios(spark, folder):
    return cache(spark, folder).withColumns({
        "hit_rate": F.round("hit_rate", 6), "average_bytes": F.round("average_bytes", 6),
    })


@query("W7 G11", sql("ev", CACHE + """
SELECT cache, bucket, hits AS delta_total_hits, misses AS delta_total_misses FROM totals"""))
def counter_deltas(spark, folder):
    """Running totals turned back into per-period differences."""
    totals = cache(spark, folder).select("cache", "bucket", "total_hits", "total_misses")
    return H.counter_deltas(totals, ["cache"], ["total_hits", "total_misses"]).drop("total_hits", "total_misses")


@query("G12", sql("segments", """
SELECT data_source, tier, count(*) AS "count", sum(bytes) AS size,
  sum(CASE WHEN available THEN bytes ELSE 0 END) AS used, count(*) FILTER (NOT available) AS unavailable,
  count(*) FILTER (replicas < 2) AS under_replicated,
  round(sum(CASE WHEN available THEN bytes ELSE 0 END) / 1000000.0::DOUBLE * 100, 6) AS used_percent
FROM segments GROUP BY 1, 2"""))
def segment_inventory(spark, folder):
    done = H.segment_inventory(tables.segments(spark, folder), ["data_source", "tier"], 1_000_000.0, 2)
    return done.withColumn("used_percent", F.round("used_percent", 6))


@query("G13", sql("segments", """
SELECT data_source, status, sum(bytes) AS bytes, count(*) AS segments, count(DISTINCT day) AS intervals
FROM segments GROUP BY 1, 2"""))
def compaction_inventory(spark, folder):
    return H.compaction_inventory(tables.segments(spark, folder), ["data_source"])


STATES = ["success", "failed", "running", "pending", "waiting"]


@query("G14", sql("tasks", "SELECT data_source, " + ", ".join(
    f"count(*) FILTER (state = '{s}') AS {s}" for s in STATES) + " FROM tasks GROUP BY 1"))
def task_outcomes(spark, folder):
    return H.task_outcomes(tables.tasks(spark, folder), ["data_source"], STATES)


@query("G14", sql("tasks", """
SELECT category, count(*) AS total, count(*) FILTER (state = 'running') AS used,
  count(*) FILTER (state <> 'running') AS idle FROM tasks GROUP BY 1"""))
def slot_totals(spark, folder):
    return H.slot_totals(tables.tasks(spark, folder), "category")


@query("O2", sql("segments", """
SELECT data_source, tier, bytes, priority, row_number() OVER (ORDER BY priority DESC, data_source, tier) AS "position"
FROM (SELECT data_source, tier, sum(bytes) AS bytes,
    CASE data_source WHEN 'A' THEN 10 WHEN 'N' THEN 20 ELSE 0 END AS priority FROM segments GROUP BY 1, 2) t"""))
def tier_priority(spark, folder):
    """Tiers by priority, highest first; a tier without one counts as 0, ties keep their order."""
    tiers = tables.segments(spark, folder).groupBy("data_source", "tier").agg(F.sum("bytes").alias("bytes"))
    given = F.when(F.col("data_source") == "A", 10).when(F.col("data_source") == "N", 20)
    return H.by_priority(tiers.withColumn("priority", given), "priority", ["data_source", "tier"])
