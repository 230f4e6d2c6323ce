"""The streaming jobs run over the given tables as file streams until they are used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.catalog import AlarmRule, EmitterSettings
from metricloom.plans.logs import LAYOUT
from metricloom.plans.registry import query
from metricloom.plans.sinks import UNUSABLE, nameless
from metricloom.plans.views import bucket, sql
from metricloom.session import scratch_path
from metricloom.sources import formats, tables
from metricloom.streaming import jobs as J

SETTINGS = EmitterSettings()
DELAY = "1 hour"


SLICES = 3


def event_stream(spark, folder):
    """The table's rows as they arrive, and the calls that bring each next slice of time.

    Every slice is one micro-batch or more, and the query starts anew from its checkpoint for each.
    """
    events = tables.table(spark, folder, "events")
    path = scratch_path(spark, "arrivals")
    events.limit(0).write.parquet(path)
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    edges = [first + (last - first) * i / SLICES for i in range(1, SLICES)] if first else []
    ts, calls = F.col("ts"), []
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        begun = F.lit(True) if low is None else ts >= F.lit(low).cast("timestamp_ntz")
        part = events.where(begun & (F.lit(True) if high is None else ts < F.lit(high).cast("timestamp_ntz")))
        calls.append(part.write.mode("append").parquet)
    return formats.stream_events(spark, path, events.schema), [lambda c=c: c(path) for c in calls]


@query("T4 G1 W1", f"""
SELECT event_type, {bucket('6 hours')} AS bucket, round(sum(value), 6) AS "sum", round(avg(value), 6) AS "avg",
  count(*) AS "count" FROM events GROUP BY 1, 2
HAVING {bucket('6 hours')} + INTERVAL '6 hours' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'""")
def streamed_statistics(spark, folder):
    """Closed windows only: the watermark is an hour behind the newest event."""
    events, arrivals = event_stream(spark, folder)
    done = J.drain(J.windowed_statistics(events, ["event_type"], "6 hours", DELAY), "statistics", arrivals)
    return done.withColumns({"sum": F.round("sum", 6), "avg": F.round("avg", 6)})


@query("T6", """
SELECT user_id, event_type, count(*) AS events, count(DISTINCT event_id) AS ids FROM events GROUP BY 1, 2""")
def streamed_first_copies(spark, folder):
    """Every event sent twice; the second copy is dropped."""
    once, arrivals = event_stream(spark, folder)
    twice = once.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    done = J.drain(J.first_copies(twice, ["event_id"], DELAY, salts=8), "first-copies", arrivals)
    return done.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("ids"))


@query("T7", """
SELECT event_type, count(*) FILTER (user_id % 9 = 0) AS unparseable, count(*) FILTER (user_id % 9 <> 0) AS parsed,
  CAST(sum(CASE WHEN user_id % 9 <> 0 THEN CAST(props->>'k' AS BIGINT) ELSE 0 END) AS BIGINT) AS total
FROM events GROUP BY 1""")
def streamed_unparseable(spark, folder):
    """A ninth of the users send broken JSON."""
    broken = F.when(F.col("user_id") % 9 == 0, F.concat(F.lit("<"), F.col("props"))).otherwise(F.col("props"))
    events, arrivals = event_stream(spark, folder)
    lines = events.withColumn("line", broken)
    done = J.drain(
        J.split_parsed(lines, "line", "k bigint").select("event_type", "unparseable", "body.k"), "parsed", arrivals)
    return done.groupBy("event_type").agg(
        F.count_if("unparseable").alias("unparseable"), F.count_if(~F.col("unparseable")).alias("parsed"),
        F.sum(F.when(~F.col("unparseable"), F.col("k")).otherwise(0)).alias("total"))


@query("T2 K3", sql("metric_events", f"""
SELECT {bucket('1 day')} AS bucket, count(*) FILTER (kind = 'other') AS invalid,
  count(*) FILTER (kind = 'metric' AND {UNUSABLE}) AS fatal
FROM metric_events GROUP BY 1
HAVING {bucket('1 day')} + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'"""))
def streamed_loss_counts(spark, folder):
    """Some metrics come without a name."""
    events, arrivals = event_stream(spark, folder)
    rows = nameless(tables.as_metric_events(tables.with_k(events)))
    return J.drain(J.loss_counts(rows, "1 day", DELAY), "loss-counts", arrivals)


FLUSH_BOUND, FLUSH_PERIOD, ITEM_BYTES = 2_000, "6 hours", 100

# items are all of one size, so the first so many of a queue, service and flush enter; slices cut flushes
OFFERED = f"""
, offered AS (
  SELECT event_id, 'metric' AS queue, name, service, ts FROM datums WHERE NOT ({UNUSABLE})
  UNION ALL SELECT event_id, 'alert', 'Engine.Alert', service, ts FROM metric_events WHERE kind = 'alert'),
edges AS (SELECT min(ts) AS first, max(ts) - min(ts) AS span FROM events),
sliced AS (SELECT o.*, {bucket(FLUSH_PERIOD)} AS flush,
    CASE WHEN ts < first + span / {SLICES} THEN 0 WHEN ts < first + span * 2 / {SLICES} THEN 1 ELSE 2 END AS slice
  FROM offered o, edges),
decided AS (SELECT *, row_number() OVER (PARTITION BY queue, service, flush, slice ORDER BY ts, event_id)
    <= {FLUSH_BOUND // ITEM_BYTES} AS admitted FROM sliced)
"""


@query("T1 T2 T3 K1 K2 K3 K5", sql("metric_events datums rollup_map", OFFERED + f"""
SELECT 'requests' AS sink, name, count(*) AS rows FROM decided WHERE admitted GROUP BY 2
UNION ALL SELECT 'statsd', metric, count(*) FROM metric_events JOIN rollup_map USING (metric)
WHERE kind = 'metric' AND NOT ({UNUSABLE}) GROUP BY 2
UNION ALL SELECT 'lost', 'Emitter.MetricLost', count(*) FROM decided WHERE queue = 'metric' AND NOT admitted
UNION ALL SELECT 'lost', 'Emitter.AlertLost', count(*) FROM decided WHERE queue = 'alert' AND NOT admitted
UNION ALL SELECT 'lost', 'Emitter.InvalidLost', count(*) FROM metric_events WHERE kind = 'other'
UNION ALL SELECT 'lost', 'Emitter.Fatal', count(*) FROM metric_events WHERE kind = 'metric' AND {UNUSABLE}"""))
def streamed_flush(spark, folder):
    """The emitter as a stream: both sinks hold what gets in, and the losses count all the rest."""
    path = scratch_path(spark, "flush")
    events, arrivals = event_stream(spark, folder)
    rows = nameless(tables.as_metric_events(tables.with_k(events)))
    for arrive in arrivals:
        arrive()
        J.flush_datums(
            rows, path, f"{path}-checkpoint", SETTINGS, F.lit(ITEM_BYTES).cast("bigint"), flush=FLUSH_PERIOD,
            block="1 hour", bound=FLUSH_BOUND, trigger={"availableNow": True}, loss_period="1 hour",
        ).awaitTermination()
    requests = J.read_epochs(spark, f"{path}/requests").select(F.lit("requests").alias("sink"), "name")
    statsd = J.read_epochs(spark, f"{path}/statsd").select(F.lit("statsd").alias("sink"), F.col("metric").alias("name"))
    sent = requests.unionByName(statsd).groupBy("sink", "name").agg(F.count(F.lit(1)).alias("rows"))
    lost = J.read_epochs(spark, f"{path}/losses").groupBy(F.lit("lost").alias("sink"), F.col("counter").alias("name")).agg(
        F.sum("value").cast("bigint").alias("rows"))
    return sent.unionByName(lost)


@query("T9 T8 P14 P19 P20 K6", sql("log_lines", f"""
SELECT 'application-node-a-' AS stream_prefix, '{LAYOUT.group}' AS log_group, stream, logtag, log LIKE '{{%' AS merged,
  count(*) AS lines FROM log_lines
WHERE path NOT LIKE '%/network-node%' AND path NOT LIKE '%/kube-proxy%' GROUP BY ALL"""))
def streamed_logs(spark, folder):
    path = scratch_path(spark, "logs")
    events, arrivals = event_stream(spark, folder)
    lines = tables.as_log_lines(tables.with_k(events)).select("path", "value")
    for arrive in arrivals:
        arrive()
        J.route_logs(
            lines, path, f"{path}-checkpoint", LAYOUT, F.lit("node-a"), trigger={"availableNow": True}
        ).awaitTermination()
    return J.read_epochs(spark, path).groupBy(
        "stream_prefix", "log_group", "stream", "logtag", F.col("log_processed").isNotNull().alias("merged")
    ).agg(F.count(F.lit(1)).alias("lines"))


WATCHED = [AlarmRule(f"{t} low", t, "avg", "6 hours", "<", 50, 2, 3, "missing") for t in ("click", "view", "error", "signup", "purchase")]


@query("W2 W4 T4", sql("ev", f"""
, points AS (
  SELECT event_type || ' low' AS alarm, {bucket('6 hours')} AS bucket, avg(value) AS value FROM ev
  GROUP BY 1, 2
  HAVING {bucket('6 hours')} + INTERVAL '6 hours' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'),
grid AS (SELECT alarm, unnest(generate_series(min(bucket), (SELECT max(bucket) FROM points), INTERVAL '6 hours')) AS bucket
  FROM points GROUP BY 1),
sums AS (
  SELECT alarm, bucket, sum(CASE WHEN value < 50 THEN 1 ELSE 0 END) OVER w AS breaches, count(value) OVER w AS present
  FROM grid LEFT JOIN points USING (alarm, bucket)
  WINDOW w AS (PARTITION BY alarm ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
states AS (SELECT *, CASE WHEN present = 0 THEN 'INSUFFICIENT_DATA' WHEN breaches >= 2 THEN 'ALARM' ELSE 'OK' END AS state
  FROM sums)
SELECT alarm, bucket, coalesce(previous, 'NONE') AS previous, state FROM (
  SELECT *, lag(state) OVER (PARTITION BY alarm ORDER BY bucket) AS previous FROM states) s
WHERE previous IS NULL OR previous <> state"""))
def streamed_alarms(spark, folder):
    """Alarms over closed windows; every epoch appends the state changes it brings."""
    path = scratch_path(spark, "alarms")
    events, arrivals = event_stream(spark, folder)
    closed = J.windowed_statistics(events, ["event_type"], "6 hours", DELAY)
    points = closed.select(F.concat(F.col("event_type"), F.lit(" low")).alias("alarm"), "bucket", F.col("avg").alias("value"))
    for arrive in arrivals:
        arrive()
        J.watch_alarms(points, [], WATCHED, "6 hours", path, f"{path}-checkpoint").awaitTermination()
    return J.read_epochs(spark, f"{path}/transitions")
