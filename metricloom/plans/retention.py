"""Rule chains over shipped lines and segments, tier replicas, purges."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.operators import lookups as L
from metricloom.operators import retention as R
from metricloom.operators.retention import Rule
from metricloom.plans.registry import query
from metricloom.plans.views import sql
from metricloom.sources import tables

AS_OF = "2001-11-05"
NOW = f"TIMESTAMP '{AS_OF}'"

LOAD = [
    Rule("loadByPeriod", period="P1M", replicants={"hot": 3, "default": 1}),
    Rule("loadByInterval", interval="1999-01-01/2000-01-01", replicants={"default": 2}),
    Rule("loadByPeriod", period="P1Y2M10D", include_future=True, replicants={"default": 1}),
    Rule("loadForever", replicants={"cold": 1}),
]
DROP = [
    Rule("dropByInterval", interval="1998-03-01/1998-06-15"),
    Rule("dropBeforeByPeriod", period="P5Y"),
    Rule("dropByPeriod", period="P2W"),
    Rule("loadByPeriod", period="P3Y", replicants={"hot": 2}),
    Rule("dropForever"),
]
BROADCAST = [
    Rule("broadcastByPeriod", period="P6M", include_future=True),
    Rule("broadcastByInterval", interval="1996-01-01/1997-01-01"),
    Rule("dropByPeriod", period="P2Y"),
    Rule("broadcastForever"),
]

LOAD_CASE = f"""CASE
  WHEN t >= {NOW} - INTERVAL 1 MONTH AND t < {NOW} THEN 1
  WHEN t >= TIMESTAMP '1999-01-01' AND t < TIMESTAMP '2000-01-01' THEN 2
  WHEN t >= {NOW} - INTERVAL 14 MONTH - INTERVAL 10 DAY THEN 3
  ELSE 4 END"""
DROP_CASE = f"""CASE
  WHEN t >= TIMESTAMP '1998-03-01' AND t < TIMESTAMP '1998-06-15' THEN 1
  WHEN t < {NOW} - INTERVAL 5 YEAR THEN 2
  WHEN t >= {NOW} - INTERVAL 14 DAY AND t < {NOW} THEN 3
  WHEN t >= {NOW} - INTERVAL 3 YEAR AND t < {NOW} THEN 4
  ELSE 5 END"""
BROADCAST_CASE = f"""CASE
  WHEN t >= {NOW} - INTERVAL 6 MONTH THEN 1
  WHEN t >= TIMESTAMP '1996-01-01' AND t < TIMESTAMP '1997-01-01' THEN 2
  WHEN t >= {NOW} - INTERVAL 2 YEAR AND t < {NOW} THEN 3
  ELSE 4 END"""


def chain_sql(case: str, actions: str) -> str:
    return f"""SELECT l_returnflag AS data_source, rule_no, CASE rule_no {actions} END AS action, count(*) AS rows,
  sum(l_quantity) AS bytes FROM (SELECT *, {case} AS rule_no FROM (SELECT *, l_shipdate AS t FROM lineitem) x) y
GROUP BY 1, 2, 3"""


def chain(spark, folder, rules):
    lines = R.apply_retention(tables.table(spark, folder, "lineitem"), "l_shipdate", rules, AS_OF)
    return lines.groupBy(F.col("l_returnflag").alias("data_source"), "rule_no", "action").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("bytes")
    )


@query("R1 R2 R3 J7", chain_sql(LOAD_CASE, "WHEN 1 THEN 'load' WHEN 2 THEN 'load' WHEN 3 THEN 'load' ELSE 'load'"))
def retention_load(spark, folder):
    return chain(spark, folder, LOAD)


@query("R4 R5 R6 R7 R1 J7", chain_sql(DROP_CASE, "WHEN 4 THEN 'load' ELSE 'drop'"))
def retention_drop(spark, folder):
    return chain(spark, folder, DROP)


@query("R8 R9 R10 R4 J7", chain_sql(BROADCAST_CASE, "WHEN 3 THEN 'drop' ELSE 'broadcast'"))
def retention_broadcast(spark, folder):
    return chain(spark, folder, BROADCAST)


@query("R4 R5 R6 R7", f"""
SELECT l_returnflag AS data_source, l_linestatus AS status, count(*) AS rows, min(l_shipdate) AS first,
  max(l_shipdate) AS last
FROM (SELECT *, l_shipdate AS t FROM lineitem) x WHERE ({DROP_CASE}) = 4 GROUP BY 1, 2""")
def retained_rows(spark, folder):
    kept = R.retained(tables.table(spark, folder, "lineitem"), "l_shipdate", DROP, AS_OF)
    return kept.groupBy(F.col("l_returnflag").alias("data_source"), F.col("l_linestatus").alias("status")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last")
    )


@query("R11 E10", sql("segments", f"""
SELECT tier, sum(bytes * replicas) AS bytes, CAST(sum(replicas) AS BIGINT) AS copies FROM (
  SELECT s.bytes, r.tier, r.replicas FROM (SELECT bytes, {LOAD_CASE} AS rule_no FROM
    (SELECT *, day AS t FROM segments) x) s
  JOIN (VALUES (1, 'hot', 3), (1, 'default', 1), (2, 'default', 2), (3, 'default', 1), (4, 'cold', 1))
    r(rule_no, tier, replicas) USING (rule_no)) y GROUP BY 1"""))
def tier_replicas(spark, folder):
    return R.tier_bytes(tables.segments(spark, folder), "day", LOAD, AS_OF)


@query("R12 R6", sql("segments", f"""
SELECT data_source, day AS modified, '60 days' AS kept, bytes FROM segments
WHERE tier = 'hot' AND day < {NOW} - INTERVAL 60 DAY
UNION ALL SELECT data_source, day, '14 days', bytes FROM segments
WHERE tier = 'cold' AND day < {NOW} - INTERVAL 14 DAY"""))
def file_purge(spark, folder):
    """Files past their age, by kind of file: 60 days for one tier, 14 for the other."""
    files = tables.segments(spark, folder).withColumnRenamed("day", "modified")
    old = [
        R.purge(files.where(F.col("tier") == tier), "modified", period, AS_OF).select(
            "data_source", "modified", F.lit(kept).alias("kept"), "bytes")
        for tier, period, kept in (("hot", "P60D", "60 days"), ("cold", "P14D", "14 days"))
    ]
    return old[0].unionByName(old[1])


@query("J9 R8 R9", sql("segments", f"""
SELECT l_returnflag AS data_source, count(*) AS lines, sum(s.bytes) AS bytes
FROM lineitem l JOIN segments s ON s.data_source = l_returnflag AND s.day = l_shipdate
  AND s.tier = CASE WHEN l_linestatus = 'O' THEN 'hot' ELSE 'cold' END
WHERE s.day >= {NOW} - INTERVAL 6 MONTH GROUP BY 1"""))
def broadcast_rules(spark, folder):
    """Segments the rules replicate to every node, joined with the lines they hold."""
    rules = [Rule("broadcastByPeriod", period="P6M", include_future=True), Rule("dropForever")]
    small = L.replicated(tables.segments(spark, folder), "day", rules, AS_OF)
    lines = tables.table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("data_source"), F.col("l_shipdate").alias("day"),
        F.when(F.col("l_linestatus") == "O", "hot").otherwise("cold").alias("tier"),
    )
    return lines.join(small, ["data_source", "day", "tier"]).groupBy("data_source").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("bytes").alias("bytes")
    )
