"""Claims, permissions, decisions, secured scans and group-mapping sync."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from metricloom import catalog
from metricloom.operators import access as A
from metricloom.operators import setops as S
from metricloom.plans.registry import query
from metricloom.plans.views import sql
from metricloom.session import dealt, literal_table, settle
from metricloom.sources import tables


PERMISSIONS = catalog.role_rows() + tables.CUSTOM_PERMISSIONS


def role_permissions(spark):
    return literal_table(spark, PERMISSIONS, pa.schema([
        (n, pa.string()) for n in ("role", "resource_type", "name_pattern", "action")
    ]))


@query("P25", sql("claimed_groups", """
SELECT principal, string_agg("group", '|' ORDER BY "group") AS groups FROM claimed_groups GROUP BY 1"""))
def claim_groups(spark, folder):
    people = tables.principals(spark, folder).where("claim IS NOT NULL")
    groups = F.array_sort(A.claim_groups(F.col("claim")))
    return people.select("principal", F.array_join(groups, "|").alias("groups"))


# principals whose permissions one task counts
PRINCIPALS = 100_000


@query("J3 X2", sql("claimed_groups group_roles permissions", """
SELECT c.principal, p.resource_type, p.action, count(*) AS permissions
FROM claimed_groups c JOIN group_roles g USING ("group") JOIN permissions p ON p.role = g.role GROUP BY 1, 2, 3"""))
def permission_bag(spark, folder):
    # every principal is a group of its own; the few groups are settled, so that no join deals the principals anew
    people = dealt(tables.principals(spark, folder), ["principal"], PRINCIPALS)
    bag = A.permissions(people, settle(tables.group_roles(spark, folder), "group-roles"), role_permissions(spark))
    return bag.groupBy("principal", "resource_type", "action").agg(F.count(F.lit(1)).alias("permissions"))


DECISIONS = """
SELECT q.request_id, CASE WHEN q.principal IS NULL THEN 'no principal'
    WHEN NOT q.has_context THEN 'no context' WHEN q.claim IS NULL THEN 'no claim'
    WHEN g.request_id IS NOT NULL THEN 'permission' ELSE 'no permission' END AS reason,
  g.request_id IS NOT NULL AND q.claim IS NOT NULL AS allowed
FROM access_requests q LEFT JOIN granted g USING (request_id)"""


@query("A1 J3 J4 G7", sql("access_requests granted", DECISIONS))
def access_decisions(spark, folder):
    done = A.authorise(
        tables.access_requests(spark, folder), tables.group_roles(spark, folder), role_permissions(spark)
    )
    return done.select("request_id", "reason", "allowed")


@query("A1", sql("access_requests", """
SELECT has_context AS allowed, CASE WHEN has_context THEN 'no claim configured' ELSE 'no context' END AS reason,
  count(*) AS requests FROM access_requests GROUP BY 1, 2"""))
def access_without_claims(spark, folder):
    """No group claim configured: every request with a principal and a context is allowed."""
    done = A.authorise(
        tables.access_requests(spark, folder), tables.group_roles(spark, folder), role_permissions(spark), False
    )
    return done.groupBy("allowed", "reason").agg(F.count(F.lit(1)).alias("requests"))


@query("A2 J4", sql("access_requests roles", """
SELECT r.role, q.resource_type, q.action, count(*) AS requests FROM access_requests q
JOIN roles r ON r.resource_type = q.resource_type AND r.action = q.action
  AND regexp_full_match(q.resource_name, r.name_pattern) GROUP BY 1, 2, 3"""))
def default_role_reach(spark, folder):
    """Requests each default role alone would allow."""
    requests = tables.access_requests(spark, folder).groupBy(*A.RESOURCE).agg(F.count(F.lit(1)).alias("requests"))
    allowed = A.allowed_resources(requests, catalog.role_table(spark))
    return requests.join(allowed, A.RESOURCE).groupBy("role", "resource_type", "action").agg(
        F.sum("requests").alias("requests")
    )


VISIBLE = """, visible AS (
  SELECT DISTINCT c.claim, n.dataset FROM claimed_groups c JOIN group_roles g USING ("group")
  JOIN permissions p ON p.role = g.role AND p.resource_type = 'DATASOURCE' AND p.action = 'READ'
  JOIN (SELECT DISTINCT lower(replace(o_orderpriority, ' ', '_')) AS dataset FROM orders) n
    ON regexp_full_match(n.dataset, p.name_pattern)),
rows AS (SELECT lower(replace(o_orderpriority, ' ', '_')) AS dataset, o_totalprice FROM orders)"""


def _datasets(spark, folder):
    name = F.lower(F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("_")))
    return tables.table(spark, folder, "orders").select("o_orderkey", "o_totalprice", name.alias("dataset"))


@query("A3", sql("claimed_groups group_roles permissions", VISIBLE + """
SELECT v.claim, count(*) AS datasets, CAST(sum(r.rows) AS BIGINT) AS rows FROM visible v
JOIN (SELECT dataset, count(*) AS rows FROM rows GROUP BY 1) r USING (dataset) GROUP BY 1"""))
def visible_rows(spark, folder):
    """Data sets and rows every claim may read; rows are counted before claims fan out."""
    rows = _datasets(spark, folder)
    visible = A.visible_datasets(
        rows, "dataset", tables.principals(spark, folder), tables.group_roles(spark, folder), role_permissions(spark)
    )
    counts = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"))
    return visible.join(counts, "dataset").groupBy("claim").agg(
        F.count(F.lit(1)).alias("datasets"), F.sum("rows").alias("rows")
    )


@query("A3", sql("claimed_groups group_roles permissions", """
SELECT o_orderkey, o_totalprice, lower(replace(o_orderpriority, ' ', '_')) AS dataset FROM orders
WHERE regexp_full_match(lower(replace(o_orderpriority, ' ', '_')), '[12]-.*')"""))
def secured_scan(spark, folder):
    """The order rows a claim of one nation may read."""
    return A.secured(
        _datasets(spark, folder), "dataset", "someone , nation-0", tables.group_roles(spark, folder),
        role_permissions(spark)
    )


@query("X1", sql("claimed_groups group_roles", """
SELECT "group", count(DISTINCT principal) AS principals FROM claimed_groups
WHERE "group" IN (SELECT "group" FROM group_roles) GROUP BY 1"""))
def stored_groups_claimed(spark, folder):
    claimed = tables.principals(spark, folder).where("claim IS NOT NULL").select(
        "principal", F.explode(F.array_distinct(A.claim_groups(F.col("claim")))).alias("group")
    )
    kept = S.stored_intersection(claimed, tables.group_roles(spark, folder), "group")
    return kept.groupBy("group").agg(F.count(F.lit(1)).alias("principals"))


# parts stand for the stored mapping, customers for the desired one; their keys overlap in part
STORED = "SELECT p_partkey + 500 AS key, p_size % 25 AS value FROM part"
DESIRED = "SELECT c_custkey AS key, c_nationkey AS value FROM customer"


def _mappings(spark, folder):
    stored = tables.table(spark, folder, "part").select(
        (F.col("p_partkey") + 500).alias("key"), (F.col("p_size") % 25).alias("value"))
    desired = tables.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("value"))
    return stored, desired


@query("X3", f"""
SELECT coalesce(d.key, s.key) AS key, CASE WHEN d.key IS NULL THEN 'delete' WHEN s.key IS NULL THEN 'create'
  WHEN s.value <> d.value THEN 'update' ELSE 'keep' END AS change, coalesce(d.value, s.value) AS value
FROM ({STORED}) s FULL OUTER JOIN ({DESIRED}) d ON s.key = d.key""")
def mapping_sync(spark, folder):
    stored, desired = _mappings(spark, folder)
    return S.minimal_changes(stored, desired, ["key"])


@query("X3 X2", f"""
SELECT value, change, count(*) AS rows FROM (
  SELECT value, 'delete' AS change FROM ({STORED}) s UNION ALL SELECT value, 'create' FROM ({DESIRED}) d) u
GROUP BY 1, 2""")
def mapping_replace(spark, folder):
    stored, desired = _mappings(spark, folder)
    return S.replace_changes(stored, desired).groupBy("value", "change").agg(F.count(F.lit(1)).alias("rows"))


@query("X4", sql("claimed_groups", """
, items AS (
  SELECT principal, 1 AS side, 1 AS pos, 'BUILDING' AS item FROM (SELECT DISTINCT principal FROM claimed_groups) p
  UNION ALL SELECT principal, 1, 2, 'nation-3' FROM (SELECT DISTINCT principal FROM claimed_groups) p
  UNION ALL SELECT principal, 2, CASE WHEN "group" LIKE 'nation-%' THEN 2 ELSE 1 END, "group" FROM claimed_groups)
SELECT principal, string_agg(item, '|' ORDER BY side, pos) AS groups FROM (
  SELECT *, row_number() OVER (PARTITION BY principal, item ORDER BY side, pos) AS rn FROM items) i
WHERE rn = 1 GROUP BY 1"""))
def required_then_claimed(spark, folder):
    """Two required groups first, then the claimed ones, without repeats."""
    required = F.array(F.lit("BUILDING"), F.lit("nation-3"))
    people = tables.principals(spark, folder).where("claim IS NOT NULL")
    groups = S.ordered_distinct(required, A.claim_groups(F.col("claim")))
    return people.select("principal", F.array_join(groups, "|").alias("groups"))
