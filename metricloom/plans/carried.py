"""Streams that carry state across micro-batches: messages, late rows and bounded queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions import parsers as P
from metricloom.operators import logs as L
from metricloom.operators.prefix import number_block
from metricloom.plans.logs import reassembled
from metricloom.plans.registry import query
from metricloom.plans.streams import event_stream
from metricloom.plans.views import sql
from metricloom.session import scratch_path
from metricloom.sources import formats, tables
from metricloom.streaming import carried as C
from metricloom.streaming import jobs as J

ONCE = {"availableNow": True}


@query("W5 T9 P14", sql("log_lines", "SELECT path, stream, first, message, parts, complete, piece FROM (" + reassembled(
    "SELECT path, stream, event_id, log, logtag FROM log_lines", "path, stream", "event_id") + ") m WHERE complete"))
def streamed_messages(spark, folder):
    """Container messages whose lines come in three arrivals; what isn't closed by the end still waits."""
    path = scratch_path(spark, "messages")
    events, arrivals = event_stream(spark, folder)
    lines = L.parsed(tables.as_log_lines(tables.with_k(events)), P.parse_cri)
    for arrive in arrivals:
        arrive()
        C.join_messages(
            lines, path, f"{path}-checkpoint", ["path", "stream"], "event_id", "ts", number_block(F.col("event_id"), 1_000),
            hold="90 days", coarser=lambda block: number_block(block, 1_000), trigger=ONCE).awaitTermination()
    return J.read_epochs(spark, f"{path}/messages").select("path", "stream", "first", "message", "parts", "complete", "piece")


ARRIVALS = 5
# an event arrives k hours after its time
ARRIVED = f"""
, arrived AS (SELECT *, epoch_us(ts) + k * 3600000000 AS came FROM ev),
span AS (SELECT min(came) AS low, max(came) - min(came) + 1 AS width FROM arrived),
sliced AS (SELECT a.*, (came - low) * {ARRIVALS} // width AS slice FROM arrived a, span),
marks AS (SELECT slice, max(newest) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark
  FROM (SELECT slice, max(ts) AS newest FROM sliced GROUP BY 1) n)"""


def late_arrivals(spark, folder):
    """Events in the order of their arrival, a few slices after each other."""
    rows = tables.events(spark, folder).withColumn(
        "at", F.unix_micros(F.col("ts").cast("timestamp")) + F.col("k") * 3_600_000_000)
    low, high = rows.agg(F.min("at"), F.max("at")).first()
    slices = rows.withColumn("slice", F.floor((F.col("at") - low) * ARRIVALS / (high - low + 1))) if low is not None else rows
    path = scratch_path(spark, "late-arrivals")
    kept = rows.columns
    rows.limit(0).write.parquet(path)
    calls = [slices.where(F.col("slice") == i).select(*kept).write.mode("append").parquet for i in range(ARRIVALS if low is not None else 0)]
    return formats.stream_events(spark, path, rows.schema), [lambda c=c: c(path) for c in calls]


@query("T5 G8", sql("ev", ARRIVED + """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, count(*) FILTER (NOT coalesce(ts < mark - INTERVAL '1 hour', false)) AS punctual,
  count(*) FILTER (coalesce(ts < mark - INTERVAL '1 hour', false)) AS late FROM sliced JOIN marks USING (slice) GROUP BY 1"""))
def streamed_late(spark, folder):
    """Late rows counted per day of their time while the stream runs."""
    path = scratch_path(spark, "late")
    events, arrivals = late_arrivals(spark, folder)
    for arrive in arrivals:
        arrive()
        C.split_late(events, path, f"{path}-checkpoint", "ts", "1 hour", "1 day", ONCE).awaitTermination()
    return J.read_epochs(spark, f"{path}/counts").groupBy("bucket").agg(
        F.sum("punctual").alias("punctual"), F.sum("late").alias("late"))


TURNS, ITEM, HELD, DRAINED = 3, 100, 300, 250

QUEUED = f"""
, edges AS (SELECT min(ts) AS first, max(ts) - min(ts) AS span FROM events),
turned AS (SELECT e.*, CASE WHEN ts < first + span / {TURNS} THEN 0 WHEN ts < first + span * 2 / {TURNS} THEN 1 ELSE 2 END AS turn FROM ev e, edges),
numbered AS (SELECT *, row_number() OVER (PARTITION BY event_type, turn ORDER BY ts, event_id) AS rn FROM turned),
arrivals AS (SELECT t.event_type, g.turn, count(n.event_id) AS n FROM (SELECT DISTINCT event_type FROM ev) t
  CROSS JOIN (SELECT unnest(range({TURNS})) AS turn) g LEFT JOIN numbered n ON n.event_type = t.event_type AND n.turn = g.turn GROUP BY 1, 2),
turns AS (
  SELECT event_type, turn, least(n, {HELD}) AS admitted, 0::BIGINT AS waited, least({DRAINED}, least(n, {HELD})) AS sent FROM arrivals WHERE turn = 0
  UNION ALL
  SELECT a.event_type, a.turn, least(a.n, {HELD} - (t.waited + t.admitted - t.sent)), t.waited + t.admitted - t.sent,
    least({DRAINED}, t.waited + t.admitted - t.sent + least(a.n, {HELD} - (t.waited + t.admitted - t.sent)))
  FROM turns t JOIN arrivals a ON a.event_type = t.event_type AND a.turn = t.turn + 1),
sums AS (SELECT *, sum(sent) OVER (PARTITION BY event_type ORDER BY turn) AS sent_so_far FROM turns),
entered AS (SELECT n.event_id, n.event_type, n.turn, n.rn <= t.admitted AS enters,
    row_number() OVER (PARTITION BY n.event_type, n.rn <= t.admitted ORDER BY n.ts, n.event_id) AS place
  FROM numbered n JOIN turns t USING (event_type, turn))
"""


@query("T3 K2 T1", sql("ev", QUEUED + """
SELECT event_id, event_type, 'lost' AS fate, CAST(turn AS INTEGER) AS turn FROM entered WHERE NOT enters
UNION ALL
SELECT event_id, event_type, CASE WHEN s.turn IS NULL THEN 'waiting' ELSE 'sent' END, CAST(s.turn AS INTEGER) FROM (
  SELECT e.event_id, e.event_type, min(s.turn) AS turn FROM entered e LEFT JOIN sums s
    ON s.event_type = e.event_type AND s.sent_so_far >= e.place WHERE e.enters GROUP BY 1, 2) s""").replace("WITH ", "WITH RECURSIVE ", 1))
def streamed_queue(spark, folder):
    """Queues that a slow sender doesn't empty: what is left takes room from what arrives next."""
    path = scratch_path(spark, "queue")
    events, arrivals = event_stream(spark, folder)
    items = events.select("event_id", "event_type", "ts", F.lit(ITEM).cast("bigint").alias("size"))
    for arrive in arrivals:
        arrive()
        C.bounded_queue(
            items, path, f"{path}-checkpoint", ["event_type"], ["ts", "event_id"], F.window("ts", "6 hours")["start"], "size",
            HELD * ITEM, DRAINED, ONCE).awaitTermination()
    fates = [spark.read.parquet(f"{path}/{name}").select(
        "event_id", "event_type", F.lit(name).alias("fate"), F.col("epoch").cast("int").alias("turn")) for name in ("sent", "lost")]
    last = spark.read.parquet(f"{path}/queue").where(F.col("epoch") == TURNS - 1).select(
        "event_id", "event_type", F.lit("waiting").alias("fate"), F.lit(None).cast("int").alias("turn"))
    return fates[0].unionByName(fates[1]).unionByName(last)


@query("S12 T8", """
SELECT event_id, event_type, user_id % 4 AS "partition" FROM events WHERE NOT (user_id % 4 = 1 AND event_id < 100)""")
def streamed_topic(spark, folder):
    """Events as a topic of four partitions, a tenth of each arrival sent again with the next; one partition begins at offset 100."""
    rows = tables.table(spark, folder, "events").select(
        "event_id", "event_type", (F.col("user_id") % 4).alias("partition"), F.col("event_id").alias("offset"))
    path = scratch_path(spark, "topic")
    rows.limit(0).write.parquet(f"{path}/in")
    low, high = rows.agg(F.min("offset"), F.max("offset")).first()
    slices = rows.withColumn("slice", F.floor((F.col("offset") - low) * 3 / (high - low + 1)) if low is not None else F.lit(0))
    stream = formats.stream_events(spark, f"{path}/in", rows.schema)
    for i in range(3):
        again = (F.col("slice") == i - 1) & (F.col("offset") % 10 == 0)
        slices.where((F.col("slice") == i) | again).select(*rows.columns).write.mode("append").parquet(f"{path}/in")
        C.consume_topic(stream, f"{path}/out", f"{path}/checkpoint", {1: 100}, trigger=ONCE).awaitTermination()
    return J.read_epochs(spark, f"{path}/out/records").select("event_id", "event_type", "partition")
