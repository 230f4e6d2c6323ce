"""Overlapping segments of several granularities, and what newer ones hide of older ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.operators import versions as V
from metricloom.plans.registry import query
from metricloom.plans.views import sql
from metricloom.sources import tables

# a third of the users are held in segments of a day, a week and a month each; versions change from interval to interval
LAID_OUT = """, laid AS (
  SELECT *, CASE user_id % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'week' ELSE 'month' END AS granularity FROM events),
begun AS (SELECT *, CAST(date_trunc(granularity, ts) AS TIMESTAMP) AS start FROM laid),
segments_of AS (
  SELECT event_id, event_type, ts, granularity, start,
    start + CASE granularity WHEN 'day' THEN INTERVAL 1 DAY WHEN 'week' THEN INTERVAL 7 DAY ELSE INTERVAL 1 MONTH END AS "end",
    CAST(CASE granularity WHEN 'day' THEN day(start) * 7 % 10 WHEN 'week' THEN day(start) * 3 % 8 ELSE 4 END AS BIGINT) AS version
  FROM begun),
listed AS (SELECT DISTINCT event_type, start, "end", version FROM segments_of)
"""


def laid_out(spark, folder):
    begun = F.when(F.col("granularity") == "day", F.date_trunc("day", "ts")).when(
        F.col("granularity") == "week", F.date_trunc("week", "ts")).otherwise(F.date_trunc("month", "ts"))
    rows = tables.table(spark, folder, "events").select(
        "event_id", "event_type", "ts",
        F.when(F.col("user_id") % 3 == 0, "day").when(F.col("user_id") % 3 == 1, "week").otherwise("month").alias("granularity"))
    rows = rows.withColumn("start", begun.cast("timestamp_ntz"))
    of = lambda day, week, month: F.when(F.col("granularity") == "day", day).when(
        F.col("granularity") == "week", week).otherwise(month)
    after = of(*[F.col("start") + F.expr(f"INTERVAL {step}") for step in ("1 DAY", "7 DAYS", "1 MONTH")])
    day = F.dayofmonth("start")
    return rows.withColumns({"end": after, "version": of(day * 7 % 10, day * 3 % 8, F.lit(4)).cast("bigint")})


@query("E8", sql("ev", LAID_OUT + """
SELECT event_id, event_type, granularity, version FROM segments_of s
WHERE NOT EXISTS (SELECT 1 FROM listed n WHERE n.event_type = s.event_type AND n.version > s.version AND n.start <= s.ts AND s.ts < n."end")"""))
def overlapping_versions(spark, folder):
    """Rows of day, week and month segments that no newer segment of their type covers."""
    return V.visible_rows(laid_out(spark, folder), ["event_type"], "ts", "start", "end", "version").select(
        "event_id", "event_type", "granularity", "version")


@query("E8", sql("ev", LAID_OUT + """
, cuts AS (SELECT event_type, start AS cut FROM listed UNION SELECT event_type, "end" FROM listed),
pieces AS (SELECT event_type, cut AS start, lead(cut) OVER (PARTITION BY event_type ORDER BY cut) AS "end" FROM cuts)
SELECT p.event_type, p.start, p."end", max(n.version) AS version FROM pieces p JOIN listed n
  ON n.event_type = p.event_type AND n.start <= p.start AND p.start < n."end" GROUP BY 1, 2, 3"""))
def version_timeline(spark, folder):
    """Which version is the newest, piece by piece of time."""
    return V.newest_pieces(laid_out(spark, folder), ["event_type"], "start", "end", "version")


@query("E8", sql("ev", LAID_OUT + """
, marked AS (
  SELECT s.*, NOT EXISTS (SELECT 1 FROM listed n WHERE n.event_type = s.event_type AND n.version > s.version AND n.start <= s.ts AND s.ts < n."end") AS shows
  FROM segments_of s)
SELECT event_type, start, "end", version, count(*) AS rows, count(*) FILTER (shows) AS shown, count(*) FILTER (shows) = 0 AS overshadowed
FROM marked GROUP BY 1, 2, 3, 4"""))
def hidden_segments(spark, folder):
    """How much of every segment is left to see."""
    return V.hidden_parts(laid_out(spark, folder), ["event_type"], "ts", "start", "end", "version")
