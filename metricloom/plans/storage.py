"""Tables stored by the queries themselves: their system table, pruning, bitmaps and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.operators import storage as S
from metricloom.plans.registry import query
from metricloom.session import scratch_path, settle
from metricloom.sources import tables


def stored_days(spark, folder, label):
    path = scratch_path(spark, label)
    S.write_days(tables.table(spark, folder, "events"), path, "ts", rows_per_file=20_000)
    return path


@query("E4", """
SELECT CAST(ts AS DATE) AS day, count(*) AS rows, min(ts) AS first, max(ts) AS last,
  count(*) > 0 AS complete FROM events GROUP BY 1""")
def segments_table(spark, folder):
    """Rows, first and last time of each stored day, from the files as they lie there."""
    path = stored_days(spark, folder, "segments-table")
    found = S.segment_table(spark, path, "ts", ["day"])
    return found.select("day", "rows", "first", "last", (F.col("complete") & (F.col("files") > 0) & (F.col("bytes") > 0)).alias("complete"))


@query("E6 G17", """
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS events, round(sum(value), 6) AS total
FROM events WHERE ts >= TIMESTAMP '2024-01-09 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:30:00' GROUP BY 1, 2""")
def pruned_interval(spark, folder):
    """Only the folders of the interval's days are opened."""
    rows = S.in_days(spark.read.parquet(stored_days(spark, folder, "interval")), "ts", "2024-01-09 06:00:00", "2024-01-12 18:30:00")
    return rows.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("total"))


@query("E6 J8", """
WITH days AS (SELECT DATE '2024-01-01' + CAST(dayofyear(o_orderdate) - 1 AS INTEGER) AS day, count(*) AS orders FROM orders GROUP BY 1)
SELECT d.day, d.orders, e.event_type, count(*) AS events, round(sum(e.value), 6) AS total
FROM events e JOIN days d ON d.day = CAST(e.ts AS DATE) WHERE d.orders % 4 = 0 GROUP BY 1, 2, 3""")
def pruned_star(spark, folder):
    """Days chosen by a joined table: the planner passes the days it finds on to the scan."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.dayofyear("o_orderdate") - 1)
    days = settle(tables.table(spark, folder, "orders").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("orders")), "days")
    rows = spark.read.parquet(stored_days(spark, folder, "star"))
    return rows.join(days.where(F.col("orders") % 4 == 0), "day").groupBy("day", "orders", "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("total"))


@query("G16 E7", "\nUNION ALL\n".join(f"""
SELECT '{g}' AS granularity, CAST(date_trunc('{g}', ts) AS TIMESTAMP) AS time, event_type, count(DISTINCT user_id) AS users
FROM events GROUP BY 2, 3""" for g in ("hour", "day", "month")))
def distinct_users(spark, folder):
    """Exact distinct users of every hour, day and month from one stored hourly roll-up."""
    path = scratch_path(spark, "bitmaps")
    S.bitmap_rollup(tables.table(spark, folder, "events"), "ts", "hour", ["event_type"], "user_id").write.parquet(path)
    held = spark.read.parquet(path)
    parts = [S.distinct_counts(held, g, ["event_type"]).select(
        F.lit(g).alias("granularity"), "time", "event_type", F.col("numbers").alias("users")) for g in ("hour", "day", "month")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


CLUSTER_RANGES = {"o_custkey": (100, 400), "o_totalprice": (100_000.0, 200_000.0)}


@query("E9", """
SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_custkey BETWEEN 100 AND 400 AND o_totalprice BETWEEN 100000 AND 200000 GROUP BY 1""")
def clustered_orders(spark, folder):
    """A filter on two columns over files that hold a small range of both."""
    path = scratch_path(spark, "clustered")
    S.cluster(tables.table(spark, folder, "orders"), path, list(CLUSTER_RANGES), 16)
    rows = spark.read.parquet(path)
    for column, (low, high) in CLUSTER_RANGES.items():
        rows = rows.where(F.col(column).between(low, high))
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
