"""Alarm states, their changes, and scaling steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from metricloom.catalog import ALARM_RULES, IGNORED_FILE_SYSTEMS, AlarmRule
from metricloom.operators import alarms as A
from metricloom.operators import coordination as C
from metricloom.operators import metrics as M
from metricloom.plans.registry import query
from metricloom.plans.views import bucket, sql, values_list
from metricloom.session import literal_table
from metricloom.sources import tables

PERIOD = "1 hour"

# One rule per shape of the catalogue, over event types as metrics; the events are too sparse
# for the catalogue's 5-minute periods.
RULES = [
    AlarmRule("click sum high", "click", "sum", PERIOD, ">", 60, 3, 5, "not_breaching"),
    AlarmRule("view avg high", "view", "avg", PERIOD, ">", 45, 3, 5, "missing"),
    AlarmRule("signup avg high short", "signup", "avg", PERIOD, ">=", 50, 3, 3, "missing"),
    AlarmRule("purchase avg low", "purchase", "avg", PERIOD, "<=", 50, 3, 5, "missing"),
    AlarmRule("error sum low", "error", "sum", PERIOD, "<", 60, 2, 4, "not_breaching"),
    AlarmRule("click avg any", "click", "avg", PERIOD, ">", 0, 1, 3, "missing"),
]

def states_sql(points: str, rules: list[AlarmRule], period: str) -> str:
    """CTEs from ``points`` (alarm, part, bucket, value) to ``states``, by a self-join per frame.

    Every series is evaluated up to the newest event of any.
    """
    rows = values_list([
        (r.name, r.metric, r.statistic, r.compare, float(r.threshold), r.datapoints, r.evaluations, r.missing)
        for r in rules
    ])
    return f""", rules AS (SELECT * FROM ({rows}) t(alarm, metric, statistic, compare, threshold, m, n, missing)),
points AS ({points}),
grid AS (
  SELECT alarm, part, unnest(generate_series(min(bucket), (SELECT max(ts) FROM events), INTERVAL '{period}')) AS bucket
  FROM points GROUP BY 1, 2),
flags AS (
  SELECT g.alarm, g.part, g.bucket, p.value, r.m, r.n, r.missing,
    CASE WHEN p.value IS NULL THEN 0 ELSE 1 END AS present,
    CASE WHEN p.value IS NULL THEN 0
      WHEN (r.compare = '>' AND p.value > r.threshold) OR (r.compare = '>=' AND p.value >= r.threshold)
        OR (r.compare = '<' AND p.value < r.threshold) OR (r.compare = '<=' AND p.value <= r.threshold)
      THEN 1 ELSE 0 END AS breach,
    row_number() OVER (PARTITION BY g.alarm, g.part ORDER BY g.bucket) AS i
  FROM grid g JOIN rules r USING (alarm) LEFT JOIN points p USING (alarm, part, bucket)),
sums AS (
  SELECT a.alarm, a.part, a.bucket, a.value, a.m, a.missing, sum(b.breach) AS breaches, sum(b.present) AS datapoints
  FROM flags a JOIN flags b ON b.alarm = a.alarm AND b.part = a.part AND b.i BETWEEN a.i - a.n + 1 AND a.i
  GROUP BY ALL),
states AS (
  SELECT alarm, part, bucket, value, CAST(breaches AS BIGINT) AS breaches, CAST(datapoints AS BIGINT) AS datapoints,
    CASE WHEN missing = 'missing' AND datapoints = 0 THEN 'INSUFFICIENT_DATA'
      WHEN breaches >= m THEN 'ALARM' ELSE 'OK' END AS state
  FROM sums)
"""


STATES = states_sql(f"""
  SELECT r.alarm, user_id % 4 AS part, {bucket(PERIOD)} AS bucket,
    CASE r.statistic WHEN 'sum' THEN sum(value) ELSE avg(value) END AS value
  FROM ev JOIN rules r ON r.metric = ev.event_type GROUP BY r.alarm, r.statistic, 2, 3""", RULES, PERIOD)


def newest(spark, folder):
    return tables.table(spark, folder, "events").agg(F.max("ts")).first()[0]


def states(spark, folder):
    rules = literal_table(
        spark, [{"alarm": r.name, "event_type": r.metric, "statistic": r.statistic} for r in RULES],
        pa.schema([(n, pa.string()) for n in ("alarm", "event_type", "statistic")]),
    )
    rows = tables.table(spark, folder, "events").withColumn("part", F.col("user_id") % 4)
    stats = M.windowed(rows, ["event_type", "part"], PERIOD, ["sum", "avg"])
    value = F.when(F.col("statistic") == "sum", F.col("sum")).otherwise(F.col("avg"))
    points = stats.join(rules, "event_type").select("alarm", "part", "bucket", value.alias("value"))
    return A.evaluate(points, ["part"], RULES, PERIOD, newest(spark, folder))


@query("W2 W3 P24 G1", sql("ev", STATES + """
SELECT alarm, part, bucket, round(value, 6) AS value, breaches, datapoints, state FROM states"""))
def alarm_states(spark, folder):
    return states(spark, folder).withColumn("value", F.round("value", 6))


@query("W4", sql("ev", STATES + """
SELECT alarm, part, bucket, coalesce(previous, 'NONE') AS previous, state FROM (
  SELECT *, lag(state) OVER (PARTITION BY alarm, part ORDER BY bucket) AS previous FROM states) s
WHERE previous IS NULL OR previous <> state"""))
def alarm_transitions(spark, folder):
    return A.transitions(states(spark, folder), ["part"])


SHOWN = "SELECT alarm, part, bucket, round(value, 6) AS value, breaches, datapoints, state FROM states"

RATIO_RULES = [
    AlarmRule("group memory", "mem_used/mem_total", "avg", PERIOD, ">", 5.5, 3, 5, "not_breaching"),
    AlarmRule("group disk", "disk_used/disk_total", "sum", PERIOD, ">", 6.0, 3, 5, "not_breaching"),
]


@query("W2 W3 P22 G1", sql("host_metrics", states_sql(f"""
  SELECT 'group memory' AS alarm, asg AS part, {bucket(PERIOD)} AS bucket,
    avg(mem_used) / avg(mem_total) * 100 AS value FROM host_metrics GROUP BY 2, 3
  UNION ALL SELECT 'group disk', asg, {bucket(PERIOD)}, sum(used) / sum(total) * 100 FROM host_metrics
  WHERE fstype NOT IN ('sysfs', 'devtmpfs', 'tmpfs') GROUP BY 2, 3""", RATIO_RULES, PERIOD) + SHOWN))
def ratio_alarms(spark, folder):
    """Alarms on used / total of memory (averages) and disk (sums) per group."""
    hosts = tables.host_metrics(spark, folder).withColumnRenamed("asg", "part")
    disks = hosts.where(~F.col("fstype").isin(*IGNORED_FILE_SYSTEMS))
    memory = M.ratio(hosts, ["part"], PERIOD, F.col("mem_used"), F.col("mem_total"), "avg")
    disk = M.ratio(disks, ["part"], PERIOD, F.col("used"), F.col("total"), "sum")
    points = memory.withColumn("alarm", F.lit("group memory")).unionByName(
        disk.withColumn("alarm", F.lit("group disk")))
    done = A.evaluate(
        points.select("alarm", "part", "bucket", F.col("percent").alias("value")), ["part"], RATIO_RULES, PERIOD,
        newest(spark, folder))
    return done.withColumn("value", F.round("value", 6))


NODE_RULES = [
    AlarmRule("node latency", "zk_max_latency", "p99", "1 day", ">", 90, 3, 5, "missing"),
    AlarmRule("node average", "zk_avg_latency", "p99", "1 day", ">", 95, 3, 3, "missing"),
]


@query("W2 W3 G1 S2 P13", sql("last_scrapes", states_sql(f"""
  SELECT r.alarm, s.node AS part, {bucket('1 day', 's.scrape')} AS bucket,
    quantile_cont(CAST(s.text AS DOUBLE), 0.99) AS value
  FROM last_scrapes s JOIN rules r ON r.metric = s.metric GROUP BY 1, 2, 3""", NODE_RULES, "1 day") + SHOWN))
def node_alarms(spark, folder):
    """Coordination alarms per node on the p99 of its scrapes."""
    values = C.scrape_values(tables.scrapes(spark, folder), ["node", "scrape"], "line_no")
    datums = C.coordination_datums(values, "node").withColumnRenamed("number", "value")
    alarm = F
    for rule in NODE_RULES:
        alarm = alarm.when(F.col("name") == rule.metric, F.lit(rule.name))
    rows = datums.withColumn("alarm", alarm).where("alarm IS NOT NULL").withColumnRenamed("node", "part")
    points = M.windowed(rows, ["alarm", "part"], "1 day", ["p99"], ts="scrape", stored=True)
    done = A.evaluate(
        points.withColumnRenamed("p99", "value"), ["part"], NODE_RULES, "1 day", newest(spark, folder))
    return done.withColumn("value", F.round("value", 6))


# every metric that a rule of the catalogue reads; an event stands for one of them
WATCHED = list(dict.fromkeys(m for rule in ALARM_RULES for m in (rule.metric.split("/") if rule.ratio else [rule.metric])))

CATALOGUE = f"""
, datums AS (
  SELECT e.ts, m.metric, e.value * CASE WHEN m.metric = 'zk_max_latency' THEN 40 ELSE 1 END AS value,
    CASE e.user_id % 4 WHEN 0 THEN 'broker' WHEN 1 THEN 'historical' WHEN 2 THEN 'middleManager' ELSE 'overlord' END AS service,
    CASE WHEN e.user_id % 2 = 0 THEN 'database' ELSE 'group' END AS namespace
  FROM ev e JOIN ({values_list(list(enumerate(WATCHED)))}) m(slot, metric) ON m.slot = e.k % {len(WATCHED)}),
rules AS (SELECT * FROM ({values_list([
    (r.name, r.metric, r.statistic, r.period, r.compare, float(r.threshold), r.datapoints, r.evaluations, r.missing,
     r.dims.get("service"), r.dims.get("namespace"), r.ratio) for r in ALARM_RULES
])}) t(alarm, metric, statistic, period, compare, threshold, m, n, missing, service, namespace, ratio)),
served AS (
  SELECT r.*, d.metric AS own, d.value, CASE r.period WHEN '1 minute' THEN {bucket('1 minute', 'd.ts')}
    ELSE {bucket('5 minutes', 'd.ts')} END AS bucket
  FROM rules r JOIN datums d ON list_contains(CASE WHEN r.ratio THEN string_split(r.metric, '/') ELSE [r.metric] END, d.metric)
    AND (r.service IS NULL OR r.service = d.service) AND (r.namespace IS NULL OR r.namespace = d.namespace)),
points AS (
  SELECT alarm, bucket, CASE
    WHEN any_value(ratio) AND any_value(statistic) = 'sum' THEN
      100 * sum(value) FILTER (own = split_part(metric, '/', 1)) / sum(value) FILTER (own = split_part(metric, '/', 2))
    WHEN any_value(ratio) THEN
      100 * avg(value) FILTER (own = split_part(metric, '/', 1)) / avg(value) FILTER (own = split_part(metric, '/', 2))
    WHEN any_value(statistic) = 'sum' THEN sum(value) WHEN any_value(statistic) = 'avg' THEN avg(value)
    ELSE quantile_cont(value, 0.99) END AS value
  FROM served GROUP BY 1, 2),
grid AS (
  SELECT alarm, unnest(CASE any_value(r.period)
    WHEN '1 minute' THEN generate_series(min(bucket), (SELECT max(ts) FROM events), INTERVAL '1 minute')
    ELSE generate_series(min(bucket), (SELECT max(ts) FROM events), INTERVAL '5 minutes') END) AS bucket
  FROM points JOIN rules r USING (alarm) GROUP BY 1),
flags AS (
  SELECT g.alarm, g.bucket, r.m, r.n, r.missing, CASE WHEN p.value IS NULL THEN 0 ELSE 1 END AS present,
    CASE WHEN p.value IS NULL THEN 0
      WHEN (r.compare = '>' AND p.value > r.threshold) OR (r.compare = '>=' AND p.value >= r.threshold)
        OR (r.compare = '<' AND p.value < r.threshold) OR (r.compare = '<=' AND p.value <= r.threshold)
      THEN 1 ELSE 0 END AS breach
  FROM grid g JOIN rules r USING (alarm) LEFT JOIN points p USING (alarm, bucket)),
sums AS (
  SELECT alarm, bucket, m, missing,
    CASE n WHEN 3 THEN sum(breach) OVER three ELSE sum(breach) OVER five END AS breaches,
    CASE n WHEN 3 THEN sum(present) OVER three ELSE sum(present) OVER five END AS datapoints FROM flags
  WINDOW three AS (PARTITION BY alarm ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
    five AS (PARTITION BY alarm ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
states AS (SELECT alarm, bucket, CASE WHEN missing = 'missing' AND datapoints = 0 THEN 'INSUFFICIENT_DATA'
    WHEN breaches >= m THEN 'ALARM' ELSE 'OK' END AS state FROM sums)
SELECT alarm, bucket, coalesce(previous, 'NONE') AS previous, state FROM (
  SELECT *, lag(state) OVER (PARTITION BY alarm ORDER BY bucket) AS previous FROM states) s
WHERE previous IS NULL OR previous <> state"""


@query("W2 W3 W4 G1 P22 P24", sql("ev", CATALOGUE))
def alarm_catalogue(spark, folder):
    """State changes of all rules of the catalogue, each at its own period and dimensions."""
    slot, user = F.col("k") % len(WATCHED), F.col("user_id")
    metric = tables.choose(slot, WATCHED)
    datums = tables.events(spark, folder).select(
        "ts", metric.alias("metric"),
        (F.col("value") * F.when(metric == "zk_max_latency", 40).otherwise(1)).alias("value"),
        tables.choose(user % 4, ["broker", "historical", "middleManager", "overlord"]).alias("service"),
        F.when(user % 2 == 0, "database").otherwise("group").alias("namespace"))
    return A.transitions(A.catalogue_states(datums, ALARM_RULES, newest(spark, folder)), [])


STEPS = [(None, 30.0, -1), (60.0, 80.0, 1), (80.0, None, 3)]


@query("J6", sql("host_metrics", f"""
, load AS (
  SELECT asg, {bucket('1 hour')} AS bucket, round(avg(cpu_usage_active), 6) AS value FROM host_metrics GROUP BY 1, 2),
steps AS (SELECT * FROM ({values_list(STEPS)}) t(lower, upper, change))
SELECT l.asg, l.bucket, l.value, CAST(coalesce(s.change, 0) AS BIGINT) AS change
FROM load l LEFT JOIN steps s
  ON (s.lower IS NULL OR l.value >= s.lower) AND (s.upper IS NULL OR l.value < s.upper)"""))
def scaling_steps(spark, folder):
    hosts = tables.host_metrics(spark, folder)
    load = M.windowed(hosts, ["asg"], "1 hour", ["avg"], value="cpu_usage_active")
    return A.scaling_change(load.select("asg", "bucket", F.round("avg", 6).alias("value")), STEPS)
