"""Request batches, bounded admission, loss counters and deep storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.catalog import EmitterSettings
from metricloom.functions import dims as D
from metricloom.operators import batching as B
from metricloom.operators import normalize as N
from metricloom.operators import olap
from metricloom.operators.prefix import time_block
from metricloom.plans.normalise import dims_text
from metricloom.plans.registry import query
from metricloom.plans.views import bucket, sql
from metricloom.session import scratch_path, stored
from metricloom.sources import tables

SETTINGS = EmitterSettings()
FLUSH = "12 hours"
BOUND = 4_000
BATCH = 20

# some metrics come without a name, which is fatal for them
UNUSABLE = "event_id % 89 = 0"


def nameless(events):
    return events.withColumn("metric", F.when(F.col("event_id") % 89 != 0, F.col("metric")))


ALL_DATUMS = f"""SELECT event_id, ts, service, 'metric' AS queue, name FROM datums
UNION ALL SELECT event_id, ts, service, 'alert', '{SETTINGS.alert_name}' FROM metric_events WHERE kind = 'alert'"""


@query("K1 O1", sql("datums metric_events", f"""
SELECT event_id, queue, flush, CAST(rn AS BIGINT) AS rn, CAST((rn - 1) // {BATCH} AS BIGINT) AS batch_id FROM (
  SELECT *, row_number() OVER (PARTITION BY queue, flush ORDER BY ts, event_id) AS rn
  FROM (SELECT *, {bucket(FLUSH)} AS flush FROM ({ALL_DATUMS}) d) f) r"""))
def request_batches(spark, folder):
    datums = N.datums(tables.metric_events(spark, folder), SETTINGS)
    numbered = B.request_batches(datums, FLUSH, "1 minute", BATCH)
    return numbered.select("event_id", "queue", "flush", "rn", "batch_id")


@query("K1 O1", sql("datums metric_events", f"""
SELECT flush, queue, batch_id, datums,
  row_number() OVER (PARTITION BY flush ORDER BY queue DESC, batch_id) AS request_no FROM (
  SELECT flush, queue, CAST((rn - 1) // {BATCH} AS BIGINT) AS batch_id, count(*) AS datums FROM (
    SELECT *, row_number() OVER (PARTITION BY queue, flush ORDER BY ts, event_id) AS rn
    FROM (SELECT *, {bucket(FLUSH)} AS flush FROM ({ALL_DATUMS}) d) f) r GROUP BY 1, 2, 3) q"""))
def request_order(spark, folder):
    """Requests in sending order: the metrics queue is drained before the alerts queue."""
    datums = N.datums(tables.metric_events(spark, folder), SETTINGS)
    return B.requests(B.request_batches(datums, FLUSH, "1 minute", BATCH))


ALERT_BOUND = 150

SIZED = f"""
, sized AS (
  SELECT d.event_id, d.ts, 'metric' AS queue, d.service, {bucket(FLUSH, 'd.ts')} AS flush, {BOUND} AS bound,
    strlen(d.name || '|' || d.unit || '|{SETTINGS.service_dim}=' || d.service || ';{SETTINGS.cluster_dim}={SETTINGS.cluster};'
      || t.dims) + (d.k % 5) * 60 AS size
  FROM datums d JOIN dims_text t USING (event_id) WHERE NOT (d.{UNUSABLE})
  UNION ALL
  SELECT event_id, ts, 'alert', service, {bucket(FLUSH)}, {ALERT_BOUND},
    strlen('{SETTINGS.alert_name}|Count|{SETTINGS.service_dim}=' || service || ';{SETTINGS.cluster_dim}={SETTINGS.cluster}')
  FROM metric_events WHERE kind = 'alert'),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY queue, service, flush ORDER BY ts, event_id) AS rn FROM sized),
folded AS (
  SELECT queue, service, flush, rn, event_id, size, CASE WHEN size <= bound THEN size ELSE 0 END AS used,
    size <= bound AS admitted FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.queue, n.service, n.flush, n.rn, n.event_id, n.size,
    CASE WHEN f.used + n.size <= n.bound THEN f.used + n.size ELSE f.used END, f.used + n.size <= n.bound
  FROM folded f JOIN numbered n ON n.queue = f.queue AND n.service = f.service AND n.flush = f.flush AND n.rn = f.rn + 1)"""


def sized(spark, folder):
    """Datums of both queues with the UTF-8 length of their text; the length of the data source pads it.

    Normalised once and written as narrow rows, since admission looks at them several times.
    """
    datums = N.datums(nameless(tables.metric_events(spark, folder)), SETTINGS)
    body = B.datum_text([F.col("name"), F.col("unit"), dims_text()])
    source = F.coalesce(F.right(D.dim_value(F.col("dims"), "dataSource"), F.lit(1)).cast("bigint"), F.lit(0))
    return stored(datums.select(
        "event_id", "ts", "queue", "service", F.window("ts", FLUSH)["start"].alias("flush"),
        (F.octet_length(body) + source * 60).cast("bigint").alias("size"),
    ), "sized")


@query("K2 T3", sql("datums dims_text metric_events", SIZED + """
SELECT event_id, queue, service, flush, CAST(size AS BIGINT) AS size, admitted FROM folded""").replace(
    "WITH ", "WITH RECURSIVE ", 1))
def bounded_admission(spark, folder):
    """Metrics and alerts have queues of their own, each with its bound."""
    rows = sized(spark, folder)
    done = [
        B.admit(rows.where(F.col("queue") == queue), ["queue", "service", "flush"], ["ts", "event_id"],
                time_block(F.col("ts"), "10 minutes"), bound=bound)
        for queue, bound in (("metric", BOUND), ("alert", ALERT_BOUND))]
    return done[0].unionByName(done[1]).select("event_id", "queue", "service", "flush", "size", "admitted")


@query("K3 G6 T2", sql("metric_events datums dims_text", SIZED + f"""
, routed AS (
  SELECT {bucket('1 hour', 'm.ts')} AS bucket,
    CASE WHEN m.kind = 'other' THEN 'invalid' WHEN m.kind = 'metric' AND m.{UNUSABLE} THEN 'fatal' ELSE m.kind END AS route,
    coalesce(NOT f.admitted, false) AS lost FROM metric_events m LEFT JOIN folded f USING (event_id)),
grid AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL '1 hour')) AS bucket FROM routed),
counted AS (SELECT bucket, count(*) FILTER (route = 'metric' AND lost) AS a, count(*) FILTER (route = 'invalid') AS b,
    count(*) FILTER (route = 'alert' AND lost) AS c, count(*) FILTER (route = 'fatal') AS d FROM routed GROUP BY 1)
SELECT bucket, 'Emitter.MetricLost' AS counter, CAST(coalesce(a, 0) AS DOUBLE) AS value
  FROM grid LEFT JOIN counted USING (bucket)
UNION ALL SELECT bucket, 'Emitter.InvalidLost', CAST(coalesce(b, 0) AS DOUBLE) FROM grid LEFT JOIN counted USING (bucket)
UNION ALL SELECT bucket, 'Emitter.AlertLost', CAST(coalesce(c, 0) AS DOUBLE) FROM grid LEFT JOIN counted USING (bucket)
UNION ALL SELECT bucket, 'Emitter.Fatal', CAST(coalesce(d, 0) AS DOUBLE) FROM grid LEFT JOIN counted USING (bucket)
""").replace("WITH ", "WITH RECURSIVE ", 1))
def loss_counters(spark, folder):
    admitted = bounded_admission(spark, folder).select("event_id", (~F.col("admitted")).alias("lost"))
    routed = N.dispatch(nameless(tables.metric_events(spark, folder))).select("event_id", "ts", "route")
    joined = routed.join(admitted, "event_id", "left").na.fill(False, ["lost"])
    return B.loss_counters(joined, "1 hour")


@query("K7 S11", """
SELECT l_returnflag AS data_source, year(l_shipdate) AS year, count(*) AS rows, sum(l_quantity) AS quantity,
  count(DISTINCT l_shipdate) AS days
FROM lineitem GROUP BY 1, 2""")
def deep_storage(spark, folder):
    """Lines written as yearly segments through the Hadoop file system, and read back."""
    path = scratch_path(spark, "segments")
    lines = tables.table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("data_source"), "l_quantity", "l_shipdate",
        F.year("l_shipdate").cast("bigint").alias("year"),
    )
    olap.write_segments(lines, path, "year", ["l_shipdate"])
    back = spark.read.parquet(path)
    return back.groupBy("data_source", F.col("year").cast("bigint").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity"),
        F.count_distinct("l_shipdate").alias("days"),
    )
