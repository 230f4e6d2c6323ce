"""The derived views once more, as SQL text for the independent check."""

from __future__ import annotations

from metricloom import catalog


def quoted(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def values_list(rows: list[tuple]) -> str:
    def cell(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return str(v) if isinstance(v, (int, float)) else quoted(v)

    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


BLOCKED = ", ".join(quoted(d) for d in catalog.BLOCKED_DIMS)
UNITS = values_list([(r["metric"], r["unit"]) for r in catalog.unit_rows()])
ROLLUP = values_list([
    (r["metric"], r["rollup_kind"], "," + ",".join(r["keep_dims"]) + ",", r["convert_range"])
    for r in catalog.rollup_rows()
])
ROLES = values_list([tuple(r.values()) for r in catalog.role_rows()])

VIEWS = {
    "ev": "SELECT *, CAST(props->>'k' AS BIGINT) AS k FROM events",
    "units": f"SELECT * FROM ({UNITS}) t(metric, unit)",
    "rollup_map": f"SELECT * FROM ({ROLLUP}) t(metric, rollup_kind, keep_dims, convert_range)",
    "roles": f"SELECT * FROM ({ROLES}) t(role, resource_type, name_pattern, action)",
    "metric_events": """
        SELECT event_id, ts, user_id, event_type, k,
          CASE WHEN event_id % 97 = 0 THEN 'other' WHEN event_type = 'error' THEN 'alert' ELSE 'metric' END AS kind,
          CASE user_id % 4 WHEN 0 THEN 'svc/broker' WHEN 1 THEN 'svc/historical'
            WHEN 2 THEN 'svc/middleManager' ELSE 'svc/overlord' END AS service,
          'node-' || user_id AS host,
          CASE event_type WHEN 'signup' THEN 'task/success/count' WHEN 'purchase' THEN 'query/time'
            WHEN 'click' THEN 'jvm/gc/cpu'
            WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'query/cache/total/hitRate'
              ELSE 'sys/disk/write/count' END END AS metric,
          CASE event_type WHEN 'click' THEN value * 1e6 WHEN 'view' THEN value / 500 ELSE value END AS value
        FROM ev""",
    "metric_dims": """
        SELECT event_id, 1 AS ord, 'dataSource' AS name, '[ds: ' || (k % 5) || ']' AS raw FROM ev
        UNION ALL SELECT event_id, 2, 'success', CASE WHEN k % 10 = 0 THEN 'false' ELSE 'true' END FROM ev
        UNION ALL SELECT event_id, 3, 'server', 'host-' || (user_id % 7) FROM ev
        UNION ALL SELECT event_id, 4, 'id', CAST(event_id AS VARCHAR) FROM ev
        UNION ALL SELECT event_id, 5, 'blank', '[ ]' FROM ev""",
    "clean_dims": f"""
        SELECT event_id, ord, name, value FROM (
          SELECT event_id, ord, name,
            trim(replace(regexp_replace(raw, '[\\[\\]\\s]', '', 'g'), ':', '-')) AS value
          FROM metric_dims WHERE name NOT IN ({BLOCKED})) d
        WHERE length(value) > 0""",
    "dims_text": """
        SELECT event_id, string_agg(name || '=' || value, ';' ORDER BY ord) AS dims
        FROM clean_dims GROUP BY event_id""",
    "datums": """
        SELECT m.event_id, m.ts, m.service, m.k, m.metric AS name, u.unit,
          CASE WHEN m.metric = 'jvm/gc/cpu' THEN CAST(CAST(trunc(m.value) AS BIGINT) // 1000000 AS DOUBLE)
            ELSE m.value END AS value
        FROM metric_events m JOIN units u USING (metric) WHERE m.kind = 'metric'""",
    "host_metrics": """
        SELECT event_id, ts, 'asg-' || (user_id % 3) AS asg, 'i-' || user_id AS instance,
          CASE WHEN user_id % 2 = 0 THEN 'large' ELSE 'small' END AS instance_type,
          CASE k % 4 WHEN 0 THEN 'xfs' WHEN 1 THEN 'ext4' WHEN 2 THEN 'tmpfs' ELSE 'sysfs' END AS fstype,
          '/mnt/' || (k % 2) AS path, value AS used, 1000.0::DOUBLE AS total, 1000.0::DOUBLE - value AS free,
          value * 2 AS mem_used, 2000.0::DOUBLE AS mem_total, CAST(k AS DOUBLE) AS cpu_usage_active,
          100.0::DOUBLE - k AS cpu_usage_idle
        FROM ev""",
    "segments": """
        SELECT *, rows % 5 <> 0 AS available, CAST(rows % 3 + 1 AS INTEGER) AS replicas,
          CASE WHEN bytes < 100 THEN 'waiting' WHEN rows % 7 = 0 THEN 'skipped' ELSE 'compacted' END AS status
        FROM (SELECT l_returnflag AS data_source,
            CASE WHEN l_linestatus = 'O' THEN 'hot' ELSE 'cold' END AS tier,
            CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS day,
            sum(l_quantity) AS bytes, count(*) AS rows
          FROM lineitem GROUP BY 1, 2, 3) s""",
    "principals": """
        SELECT c_custkey AS principal,
          CASE WHEN c_custkey % 11 = 0 THEN NULL
            WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' , nation-' || c_nationkey
            ELSE '["' || c_mktsegment || '","nation-' || c_nationkey || '"]' END AS claim
        FROM customer""",
    "claimed_groups": """
        SELECT principal, claim, trim(g) AS "group" FROM (
          SELECT principal, claim, unnest(string_split(
            CASE WHEN claim LIKE '[%' THEN replace(replace(replace(claim, '[', ''), ']', ''), '"', '')
              ELSE claim END, ',')) AS g
          FROM principals WHERE claim IS NOT NULL) s""",
    "access_requests": """
        SELECT o_orderkey AS request_id, o_custkey AS principal,
          CASE o_orderstatus WHEN 'F' THEN 'DATASOURCE' WHEN 'O' THEN 'STATE' ELSE 'CONFIG' END AS resource_type,
          lower(replace(o_orderpriority, ' ', '_')) AS resource_name,
          CASE WHEN o_totalprice < 250000 THEN 'READ' ELSE 'WRITE' END AS action,
          o_totalprice < 490000 AS has_context, p.claim
        FROM orders LEFT JOIN principals p ON p.principal = o_custkey""",
    "group_roles": """
        SELECT DISTINCT c_mktsegment AS "group", r.role FROM customer
        JOIN (VALUES ('BUILDING', 'read'), ('BUILDING', 'urgent'), ('MACHINERY', 'write'),
          ('HOUSEHOLD', 'administrator'), ('HOUSEHOLD', 'read')) r(g, role) ON r.g = c_mktsegment
        UNION ALL
        SELECT 'nation-' || n_nationkey, CASE WHEN n_regionkey = 0 THEN 'urgent' ELSE 'manage_low' END FROM nation""",
    "permissions": """
        SELECT * FROM roles UNION ALL SELECT * FROM (VALUES
          ('urgent', 'DATASOURCE', '[12]-.*', 'READ'), ('urgent', 'STATE', '1-urgent', 'WRITE'),
          ('manage_low', 'CONFIG', '.*low', 'READ'), ('manage_low', 'CONFIG', 'low', 'WRITE')
        ) t(role, resource_type, name_pattern, action)""",
    "granted": """
        SELECT DISTINCT q.request_id FROM access_requests q
        JOIN claimed_groups c ON c.principal = q.principal
        JOIN group_roles g ON g."group" = c."group"
        JOIN permissions p ON p.role = g.role AND p.resource_type = q.resource_type AND p.action = q.action
          AND regexp_full_match(q.resource_name, p.name_pattern)
        WHERE q.has_context""",
    "log_lines": """
        SELECT event_id, ts,
          '/var/log/containers/' || CASE user_id % 6 WHEN 0 THEN 'web' WHEN 1 THEN 'fluent-bit'
            WHEN 2 THEN 'metric-agent' WHEN 3 THEN 'network-node' WHEN 4 THEN 'kube-proxy' ELSE 'api' END
            || '-' || user_id || '.log' AS path,
          strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS time,
          CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS stream,
          CASE WHEN event_id % 5 = 0 THEN 'P' ELSE 'F' END AS logtag,
          CASE WHEN k % 4 = 0 THEN 'plain ' || event_id ELSE props END AS log, k
        FROM ev""",
    "scrapes": """
        SELECT user_id % 3 + 1 AS node, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS scrape,
          event_id AS line_no,
          CASE event_type WHEN 'click' THEN 'zk_avg_latency' WHEN 'view' THEN 'zk_max_latency'
            WHEN 'signup' THEN 'zk_server_state' END AS metric,
          CASE WHEN event_type = 'signup' THEN CASE WHEN k % 2 = 0 THEN 'leader' ELSE 'follower' END
            ELSE CAST(k AS VARCHAR) END AS text
        FROM ev WHERE event_type IN ('click', 'view', 'signup')""",
    "last_scrapes": """
        SELECT node, scrape, metric, arg_max(text, line_no) AS text FROM scrapes GROUP BY 1, 2, 3""",
    "offsets": """
        SELECT data_source, 'topic-' || data_source AS stream, part, hour, latest, latest - k AS committed FROM (
          SELECT event_type AS data_source, user_id % 4 AS part,
            time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS hour,
            max(event_id) AS latest, max(k) AS k
          FROM ev GROUP BY 1, 2, 3) o""",
    "partition_lag": """
        SELECT data_source, stream, part, max(latest) AS latest, max(committed) AS committed,
          greatest(0, max(latest) - max(committed)) AS lag
        FROM offsets GROUP BY 1, 2, 3""",
    "tasks": """
        SELECT o_orderkey AS task_id, o_orderpriority AS data_source, 'category-' || (o_custkey % 4) AS category,
          CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_totalprice < 450000 THEN 'success' ELSE 'failed' END
            WHEN 'O' THEN 'running'
            ELSE CASE WHEN o_totalprice < 250000 THEN 'pending' ELSE 'waiting' END END AS state
        FROM orders""",
}

NEEDS = {
    "metric_events": ["ev"], "metric_dims": ["ev"], "clean_dims": ["metric_dims"], "dims_text": ["clean_dims"],
    "datums": ["metric_events", "units"], "host_metrics": ["ev"], "claimed_groups": ["principals"],
    "access_requests": ["principals"], "permissions": ["roles"],
    "granted": ["access_requests", "claimed_groups", "group_roles", "permissions"],
    "log_lines": ["ev"], "scrapes": ["ev"], "last_scrapes": ["scrapes"], "offsets": ["ev"],
    "partition_lag": ["offsets"],
}


def bucket(period: str, ts: str = "ts") -> str:
    return f"time_bucket(INTERVAL '{period}', {ts}, TIMESTAMP '1970-01-01')"


def sql(views: str, body: str) -> str:
    """``body`` behind a WITH clause of the named views and those they need."""
    ordered: list[str] = []

    def add(name):
        for other in NEEDS.get(name, []):
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in views.split():
        add(name)
    heads = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    return f"WITH {heads}\n{body}" if heads else body
