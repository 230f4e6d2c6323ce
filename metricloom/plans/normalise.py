"""Queries over the metric-event path: dispatch, allow-list, units, values, dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.catalog import EmitterSettings, unit_table
from metricloom.functions import dims as D
from metricloom.operators import normalize as N
from metricloom.operators.olap import write_segments
from metricloom.plans.registry import query
from metricloom.plans.views import sql
from metricloom.session import scratch_path
from metricloom.sources import tables

SETTINGS = EmitterSettings()


def dims_text(column="dims"):
    return F.array_join(
        F.transform(column, lambda d: F.concat(d["name"], F.lit("="), d["value"])), ";"
    )


@query("S1 P1", sql("metric_events", """
SELECT CASE kind WHEN 'other' THEN 'invalid' ELSE kind END AS route, service, count(*) AS events,
  count(DISTINCT host) AS hosts
FROM metric_events GROUP BY 1, 2"""))
def events_dispatch(spark, folder):
    return N.dispatch(tables.metric_events(spark, folder)).groupBy("route", "service").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("host").alias("hosts")
    )


@query("P2 J1", sql("metric_events units", """
SELECT metric, count(*) AS events, round(sum(value), 2) AS total FROM metric_events
WHERE kind = 'metric' AND metric IN (SELECT metric FROM units) GROUP BY 1"""))
def metric_allow_list(spark, folder):
    events = tables.metric_events(spark, folder).where("kind = 'metric'")
    kept = events.join(unit_table(spark), "metric", "left_semi")
    return kept.groupBy("metric").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("total")
    )


@query("P3 J1", sql("metric_events units", """
SELECT m.metric, coalesce(u.unit, 'Count') AS unit, count(*) AS events
FROM metric_events m LEFT JOIN units u USING (metric) WHERE m.kind = 'metric' GROUP BY 1, 2"""))
def metric_units(spark, folder):
    events = tables.metric_events(spark, folder).where("kind = 'metric'")
    return N.with_unit(events.groupBy("metric").agg(F.count(F.lit(1)).alias("events")))


@query("P4", sql("datums", "SELECT event_id, name, value FROM datums"))
def stored_values(spark, folder):
    return N.metric_datums(tables.metric_events(spark, folder), SETTINGS).select("event_id", "name", "value")


@query("P5 P6 P7 P8", sql("dims_text", "SELECT event_id, dims FROM dims_text"))
def clean_dimensions(spark, folder):
    events = tables.metric_events(spark, folder)
    return events.select("event_id", dims_text(D.clean_dims(F.col("dims"))).alias("dims"))


@query("P2 P3 P4 P9 J1", sql("datums dims_text", f"""
SELECT d.event_id, d.name, d.value, d.unit, d.ts, '{SETTINGS.namespace}' AS namespace,
  '{SETTINGS.service_dim}=' || d.service || ';{SETTINGS.cluster_dim}={SETTINGS.cluster};' || t.dims AS dims
FROM datums d JOIN dims_text t USING (event_id)"""))
def metric_datums(spark, folder):
    return N.metric_datums(tables.metric_events(spark, folder), SETTINGS).select(
        "event_id", "name", "value", "unit", "ts", "namespace", dims_text().alias("dims")
    )


@query("P10", sql("metric_events", f"""
SELECT event_id, '{SETTINGS.alert_name}' AS name, 1.0::DOUBLE AS value, 'Count' AS unit, ts,
  '{SETTINGS.service_dim}=' || service || ';{SETTINGS.cluster_dim}={SETTINGS.cluster}' AS dims
FROM metric_events WHERE kind = 'alert'"""))
def alert_datums(spark, folder):
    return N.alert_datums(tables.metric_events(spark, folder), SETTINGS).select(
        "event_id", "name", "value", "unit", "ts", dims_text().alias("dims")
    )


ROLLED = """
SELECT m.event_id, m.metric, r.rollup_kind, m.host,
  CASE WHEN r.convert_range THEN m.value * 100 ELSE m.value END AS value,
  coalesce((SELECT string_agg(c.name || '=' || c.value, ';' ORDER BY c.ord) FROM clean_dims c
    WHERE c.event_id = m.event_id AND r.keep_dims LIKE '%,' || c.name || ',%'), '') AS dims
FROM metric_events m JOIN rollup_map r USING (metric) WHERE m.kind = 'metric'"""


@query("J2 P11", sql("metric_events clean_dims rollup_map", f"""
SELECT event_id, metric, rollup_kind, value, dims FROM ({ROLLED}) r"""))
def rollup_dimensions(spark, folder):
    rolled = N.statsd_rows(tables.metric_events(spark, folder), SETTINGS)
    return rolled.select("event_id", "metric", "rollup_kind", "value", dims_text().alias("dims"))


@query("K4", sql("metric_events clean_dims rollup_map", f"""
SELECT rollup_kind, metric, dims, 'cluster_name:{SETTINGS.cluster}' AS tags, count(*) AS rows,
  count(DISTINCT host) AS hosts FROM ({ROLLED}) r GROUP BY 1, 2, 3"""))
def statsd_sink(spark, folder):
    """Mapped rows written by kind, and the written table read back."""
    path = scratch_path(spark, "statsd")
    rows = N.statsd_rows(tables.metric_events(spark, folder), SETTINGS)
    write_segments(rows.select(
        "event_id", "metric", "rollup_kind", "value", "host_tag", dims_text().alias("dims"),
        F.array_join("tags", ",").alias("tags"),
    ), path, "rollup_kind")
    return spark.read.parquet(path).groupBy("rollup_kind", "metric", "dims", "tags").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("host_tag").alias("hosts")
    )
