"""Log parsing, file choice, reassembly, routing and coordination scrapes."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from metricloom.catalog import EmitterSettings
from metricloom.functions import parsers as P
from metricloom.operators import coordination as C
from metricloom.operators import logs as L
from metricloom.operators.logs import LogLayout
from metricloom.operators.olap import write_segments
from metricloom.operators.prefix import number_block
from metricloom.plans.normalise import dims_text
from metricloom.plans.registry import query
from metricloom.plans.views import sql, values_list
from metricloom.session import scratch_path
from metricloom.sources import tables, text

LAYOUT = LogLayout(
    cluster="cluster-a", group_root="/metricloom", home="/srv/engine", coordination_home="/srv/coordination",
    agent_log="/opt/agent/logs/agent.log", containers="/var/log/containers",
    excluded=("metric-agent", "fluent-bit", "network-node", "kube-proxy"),
    readmitted=("fluent-bit", "metric-agent"), data_plane=("network-node", "kube-proxy"),
)
SETTINGS = EmitterSettings()


@query("P14 S3", sql("log_lines", """
SELECT event_id, stream, logtag, log, epoch_us(ts) AS time_us FROM log_lines"""))
def container_lines(spark, folder):
    lines = L.parsed(tables.log_lines(spark, folder), P.parse_cri)
    return lines.select(
        "event_id", "stream", "logtag", "log", F.unix_micros(P.cri_time(F.col("time"))).alias("time_us")
    )


@query("S3", sql("log_lines", """
SELECT path, count(*) AS lines FROM log_lines
WHERE path NOT LIKE '%/network-node%' AND path NOT LIKE '%/kube-proxy%' GROUP BY 1"""))
def application_files(spark, folder):
    lines = L.application_files(tables.log_lines(spark, folder), LAYOUT)
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"))


@query("S4", sql("log_lines", """
SELECT path, count(*) AS lines FROM log_lines
WHERE path LIKE '%/network-node%' OR path LIKE '%/kube-proxy%' GROUP BY 1"""))
def data_plane_files(spark, folder):
    lines = L.data_plane_files(tables.log_lines(spark, folder), LAYOUT)
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"))


@query("S5 P18", sql("ev", """
SELECT 'host-' || user_id AS hostname,
  CASE user_id % 3 WHEN 0 THEN 'docker.service' ELSE 'kubelet.service' END AS systemd_unit, props AS message
FROM ev WHERE user_id % 3 <> 2"""))
def journal_records(spark, folder):
    unit = tables.choose(F.col("user_id") % 3, ("docker.service", "kubelet.service", "sshd.service"))
    records = tables.events(spark, folder).select(
        F.concat(F.lit("host-"), tables.text("user_id")).alias("_HOSTNAME"), unit.alias("_SYSTEMD_UNIT"),
        F.col("props").alias("MESSAGE"), F.col("event_type").alias("_COMM"),
    )
    return L.journal(records)


def _syslog_line():
    day = F.lpad(F.date_format("ts", "d"), 2, " ")
    pid = F.when(F.col("k") % 2 == 0, F.concat(F.lit("["), tables.text("k"), F.lit("]"))).otherwise("")
    return F.concat(
        F.date_format("ts", "MMM"), F.lit(" "), day, F.lit(" "), F.date_format("ts", "HH:mm:ss"), F.lit(" host-"),
        tables.text("user_id"), F.lit(" "), F.col("event_type"), pid, F.lit(": value is "), tables.text("k"),
    )


@query("P15", sql("ev", """
SELECT event_id, 'host-' || user_id AS host, event_type AS ident,
  CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE '' END AS pid, 'value is ' || k AS message,
  epoch(date_trunc('second', ts))::BIGINT AS time_s FROM ev"""))
def syslog_lines(spark, folder):
    """Events rendered as syslog lines, with and without a process number, and parsed again."""
    lines = L.parsed(tables.events(spark, folder).select("event_id", _syslog_line().alias("value")), P.parse_syslog)
    seconds = F.unix_seconds(P.syslog_time(F.col("time"), 2024)).alias("time_s")
    return lines.select("event_id", "host", "ident", "pid", "message", seconds)


def _json_line(log):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    stream = F.when(F.col("event_type") == "error", "stderr").otherwise("stdout")
    return F.concat(
        F.lit('{"log":"'), log, F.lit('","stream":"'), stream, F.lit('","time":"'), stamp, F.lit('Z"}')
    ).alias("value")


@query("P16", sql("ev", """
SELECT event_id, event_type || ' by ' || user_id AS log,
  CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS stream,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS time FROM ev"""))
def container_first_lines(spark, folder):
    log = F.concat(F.col("event_type"), F.lit(" by "), tables.text("user_id"))
    return L.parsed(
        tables.events(spark, folder).select("event_id", _json_line(log)), P.parse_container_first_line
    ).drop("value")


@query("P17", sql("ev", """
SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') || ' ' || event_type AS log,
  CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS stream,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS time FROM ev WHERE k % 2 = 0"""))
def agent_first_lines(spark, folder):
    """Only lines whose body starts with a date are first lines."""
    dated = F.concat(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.lit(" "), F.col("event_type"))
    log = F.when(F.col("k") % 2 == 0, dated).otherwise(F.col("event_type"))
    return L.parsed(
        tables.events(spark, folder).select("event_id", _json_line(log)), P.parse_agent_first_line
    ).drop("value")


@query("P19", sql("log_lines", """
SELECT event_id, CASE WHEN log LIKE '{%' THEN log->>'k' END AS k, log LIKE '{%' AS merged FROM log_lines"""))
def json_bodies(spark, folder):
    lines = L.parsed(tables.log_lines(spark, folder), P.parse_cri)
    merged = L.merge_json_body(lines, keep_log=False)
    return merged.select(
        "event_id", F.try_element_at("log_processed", F.lit("k")).alias("k"),
        F.col("log_processed").isNotNull().alias("merged"),
    )


@query("P20", """
SELECT source, lang, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS characters
FROM (SELECT source, lang, unnest(string_split(text, chr(10))) AS line FROM documents) l
WHERE strlen(line) <= 400 GROUP BY 1, 2""")
def long_lines(spark, folder):
    """Document lines up to 400 bytes; longer ones are skipped whole."""
    lines = tables.table(spark, folder, "documents").select(
        "source", "lang", F.explode(F.split("text", "\n")).alias("value"))
    return L.skip_long_lines(lines, "value", 400).groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("value").cast("bigint")).alias("characters")
    )


@query("S6 P15", sql("ev", """
SELECT tag, host, ident, count(*) AS lines, count(*) FILTER (pid <> '') AS with_pid FROM (
  SELECT 'host.dmesg' AS tag, NULL AS host, NULL AS ident, NULL AS pid FROM ev WHERE user_id % 3 = 0
  UNION ALL SELECT CASE user_id % 3 WHEN 1 THEN 'host.messages' ELSE 'host.secure' END, 'host-' || user_id, event_type,
    CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE '' END FROM ev WHERE user_id % 3 > 0) l GROUP BY 1, 2, 3"""))
def host_logs(spark, folder):
    """Three host logs written as files, and their union read back: one raw, two through the syslog parser."""
    path = scratch_path(spark, "host-logs")
    events = tables.events(spark, folder)
    lines = {"dmesg": F.concat(F.lit("[0.0] "), F.col("event_type")), "messages": _syslog_line(), "secure": _syslog_line()}
    for i, (name, line) in enumerate(lines.items()):
        events.where(F.col("user_id") % 3 == i).select(line.alias("value")).write.text(f"{path}/{name}")
    read = text.host_logs(spark, *[f"{path}/{name}" for name in lines], P.parse_syslog)
    return read.groupBy("tag", "host", "ident").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("pid") != "").alias("with_pid"))


@query("S3 S4", sql("ev", """
SELECT kind, path, count(*) AS lines FROM (
  SELECT CASE user_id % 4 WHEN 1 THEN 'data plane' ELSE 'application' END AS kind,
    CASE user_id % 4 WHEN 0 THEN 'web-1.log' WHEN 1 THEN 'network-node-2.log' WHEN 2 THEN 'fluent-bit-3.log' END AS path
  FROM ev WHERE user_id % 4 < 3) f GROUP BY 1, 2"""))
def container_files(spark, folder):
    """Container logs written as files; each reader opens its own choice of them."""
    path = scratch_path(spark, "containers")
    layout = dataclasses.replace(LAYOUT, containers=path)
    names = ("web-1.log", "network-node-2.log", "fluent-bit-3.log", "web-4.txt")
    for i, name in enumerate(names):
        tables.events(spark, folder).where(F.col("user_id") % 4 == i).select("props").write.text(f"{path}/{name}")
    kinds = {"application": L.application_files, "data plane": L.data_plane_files}
    # a written file is a folder of parts here: the folder's name is the log's
    lines = text.read_lines(spark, path).withColumn("path", F.regexp_replace("path", "/[^/]*$", "")).withColumn(
        "path", F.concat(F.lit(f"{path}/"), F.element_at(F.split("path", "/"), -1)))
    parts = [choose(lines, layout).withColumn("kind", F.lit(kind)) for kind, choose in kinds.items()]
    return parts[0].unionByName(parts[1]).groupBy("kind", F.element_at(F.split("path", "/"), -1).alias("path")).agg(
        F.count(F.lit(1)).alias("lines"))


def reassembled(source: str, keys: str, order: str) -> str:
    return f"""SELECT {keys}, message_no, min({order}) AS first, string_agg(log, '' ORDER BY {order}) AS message,
  count(*) AS parts, bool_or(logtag = 'F') AS complete, CAST(0 AS BIGINT) AS piece FROM (
    SELECT *, CAST(count(*) FILTER (logtag = 'F') OVER (PARTITION BY {keys} ORDER BY {order}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS message_no FROM ({source}) s) m
GROUP BY {keys}, message_no"""


@query("W5", reassembled(
    "SELECT conv_id, turn, text AS log, CASE WHEN role = 'assistant' THEN 'F' ELSE 'P' END AS logtag "
    "FROM conversations", "conv_id", "turn"))
def conversation_messages(spark, folder):
    """Turns as partial lines; every assistant turn closes a message."""
    turns = tables.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.col("text").alias("log"),
        F.when(F.col("role") == "assistant", "F").otherwise("P").alias("logtag"),
    )
    return L.join_partial_lines(turns, ["conv_id"], "turn", number_block(F.col("turn"), 1000))


@query("W5 P14", sql("log_lines", reassembled("SELECT path, stream, event_id, log, logtag FROM log_lines",
                                              "path, stream", "event_id")))
def container_messages(spark, folder):
    lines = L.parsed(tables.log_lines(spark, folder), P.parse_cri)
    return L.join_partial_lines(
        lines, ["path", "stream"], "event_id", number_block(F.col("event_id"), 1_000),
        coarser=lambda block: number_block(block, 1_000))


# events spread over host paths on and off the collect list
HOST_PATHS = [
    "/var/log/messages", "/var/log/cloud-init-output.log", "/srv/engine/log/broker.log",
    "/srv/engine/log/indexer/task/a.log", "/var/log/supervisor/x/y.log", "/srv/coordination/logs/zookeeper.log",
    "/var/log/secure", "/srv/engine/log/historical.log.1", "/opt/agent/logs/agent.log", "/var/log/audit/audit.log",
]
EXPECTED_ROUTES = [
    (0, 3, "engine/{i}/var/log/messages"), (1, 2, "engine/{i}/var/log/cloud-init-output.log"),
    (2, 9, "engine/{i}/srv/engine/log/broker.log"), (3, 11, "engine/{i}/srv/engine/indexer/logs"),
    (4, 4, "engine/{i}/var/log/supervisor/supervisord.log"),
    (5, 13, "zookeeper/{i}/srv/coordination/logs/zookeeper.log"), (6, None, None), (7, None, None),
    (8, 1, "engine/{i}/opt/agent/logs/agent.log"), (9, 5, "engine/{i}/var/log/audit/audit.log"),
]


@query("J5 S7", sql("ev", f"""
SELECT e.event_id, CAST(r.route_no AS INTEGER) AS route_no,
  CASE WHEN r.route_no IS NOT NULL THEN '{LAYOUT.group}' END AS log_group,
  replace(r.stream, '{{i}}', 'i-' || e.user_id) AS log_stream
FROM ev e JOIN ({values_list(EXPECTED_ROUTES)}) r(slot, route_no, stream) ON r.slot = e.k % 10"""))
def collected_routes(spark, folder):
    lines = tables.events(spark, folder).select(
        "event_id", "user_id", tables.choose(F.col("k") % 10, HOST_PATHS).alias("path"))
    routed = L.route(lines, LAYOUT, F.lit("engine"), F.concat(F.lit("i-"), tables.text("user_id")))
    return routed.select("event_id", "route_no", "log_group", "log_stream")


TAGS = ("application.web", "dataplane.tail.proxy", "host.messages", "kube.web", "other.thing")


@query("K6", sql("ev", f"""
SELECT CASE event_type WHEN 'click' THEN 'application-node-' || user_id || '-'
    WHEN 'view' THEN 'dataplane-node-' || user_id || '-' WHEN 'purchase' THEN 'host-node-' || user_id || '-'
    ELSE 'from-fluent-bit-' END AS stream_prefix, '{LAYOUT.group}' AS log_group, count(*) AS lines
FROM ev WHERE event_type <> 'error' GROUP BY 1, 2"""))
def log_sink(spark, folder):
    """Routed lines written by tag family, and the written table read back."""
    path = scratch_path(spark, "log-sink")
    tag = F.create_map(*[F.lit(x) for pair in zip(("click", "view", "purchase", "signup", "error"), TAGS)
                         for x in pair])[F.col("event_type")]
    lines = tables.events(spark, folder).select("event_id", "user_id", "props", tag.alias("tag"))
    host = F.concat(F.lit("node-"), tables.text("user_id"))
    routed = L.sink_route(lines, LAYOUT, host).where("log_group IS NOT NULL")
    write_segments(routed.withColumn("family", F.split_part("tag", F.lit("."), F.lit(1))), path, "family")
    return spark.read.parquet(path).groupBy("stream_prefix", "log_group").agg(F.count(F.lit(1)).alias("lines"))


@query("S2 W6", sql("last_scrapes", "SELECT node, scrape, metric, text FROM last_scrapes"))
def scrape_values(spark, folder):
    return C.scrape_values(tables.scrapes(spark, folder), ["node", "scrape"], "line_no")


@query("P12 P13 S2", sql("last_scrapes", f"""
SELECT node, scrape, CASE metric WHEN 'zk_server_state' THEN 'zk_leader' ELSE metric END AS name,
  CASE metric WHEN 'zk_server_state' THEN 3.0::DOUBLE ELSE TRY_CAST(text AS DOUBLE) END AS number,
  CASE metric WHEN 'zk_server_state' THEN 'None' ELSE 'Milliseconds' END AS unit,
  '{SETTINGS.service_dim}=ZooKeeper;{SETTINGS.cluster_dim}={SETTINGS.cluster}'
    || CASE metric WHEN 'zk_server_state' THEN '' ELSE ';ZooKeeper.ID=' || node END AS dims
FROM last_scrapes WHERE metric <> 'zk_server_state' OR text = 'leader'"""))
def coordination_datums(spark, folder):
    values = C.scrape_values(tables.scrapes(spark, folder), ["node", "scrape"], "line_no")
    return C.coordination_datums(values, "node", SETTINGS).select(
        "node", "scrape", "name", "number", "unit", dims_text().alias("dims")
    )
