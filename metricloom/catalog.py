"""Constant tables: metric units, roll-up map, default roles, alarm and routing rules."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from metricloom.session import literal_table

# Metric name and unit, one per line.
METRIC_UNITS = (
    ("jvm/gc/mem/capacity", "Bytes"),
    ("jvm/gc/mem/used", "Bytes"),
    ("jvm/gc/mem/init", "Bytes"),
    ("jvm/gc/mem/max", "Bytes"),
    ("jvm/gc/count", "Count"),
    ("jvm/gc/cpu", "Milliseconds"),
    ("jvm/mem/used", "Bytes"),
    ("jvm/mem/max", "Bytes"),
    ("jetty/numOpenConnections", "Count"),
    ("jetty/threadPool/total", "Count"),
    ("jetty/threadPool/idle", "Count"),
    ("jetty/threadPool/busy", "Count"),
    ("jetty/threadPool/queueSize", "Count"),
    ("query/cache/total/averageBytes", "Bytes"),
    ("query/cache/total/hitRate", "Percent"),
    ("query/cache/total/timeouts", "Count"),
    ("query/cache/total/errors", "Count"),
    ("query/cache/total/evictions", "Count"),
    ("query/cache/total/misses", "Count"),
    ("query/cache/total/hits", "Count"),
    ("query/cache/total/sizeBytes", "Bytes"),
    ("query/cache/total/numEntries", "Count"),
    ("query/cache/total/put/ok", "Count"),
    ("query/cache/total/put/error", "Count"),
    ("query/cache/total/put/oversized", "Count"),
    ("query/time", "Milliseconds"),
    ("query/bytes", "Bytes"),
    ("query/node/time", "Milliseconds"),
    ("query/node/bytes", "Bytes"),
    ("query/node/ttfb", "Milliseconds"),
    ("query/intervalChunk/time", "Milliseconds"),
    ("query/success/count", "Count"),
    ("query/failed/count", "Count"),
    ("query/interrupted/count", "Count"),
    ("query/count", "Count"),
    ("sqlQuery/time", "Milliseconds"),
    ("sqlQuery/bytes", "Bytes"),
    ("query/segment/time", "Milliseconds"),
    ("query/wait/time", "Milliseconds"),
    ("segment/scan/pending", "Count"),
    ("query/segmentAndCache/time", "Milliseconds"),
    ("query/cpu/time", "Microseconds"),
    ("segment/max", "Bytes"),
    ("segment/used", "Bytes"),
    ("segment/usedPercent", "Percent"),
    ("segment/pendingDelete", "Bytes"),
    ("segment/loadQueue/failed", "Count"),
    ("segment/loadQueue/count", "Count"),
    ("segment/size", "Bytes"),
    ("segment/count", "Count"),
    ("segment/assigned/count", "Count"),
    ("segment/moved/count", "Count"),
    ("segment/dropped/count", "Count"),
    ("segment/deleted/count", "Count"),
    ("segment/unneeded/count", "Count"),
    ("segment/loadQueue/size", "Count"),
    ("segment/dropQueue/count", "Count"),
    ("segment/unavailable/count", "Count"),
    ("segment/underReplicated/count", "Count"),
    ("tier/historical/count", "Count"),
    ("tier/replication/factor", "Count"),
    ("tier/required/capacity", "Bytes"),
    ("tier/total/capacity", "Bytes"),
    ("ingest/events/thrownAway", "Count"),
    ("ingest/events/unparseable", "Count"),
    ("ingest/events/processed", "Count"),
    ("ingest/rows/output", "Count"),
    ("ingest/persists/count", "Count"),
    ("ingest/persists/time", "Milliseconds"),
    ("ingest/persists/backPressure", "Milliseconds"),
    ("ingest/persists/failed", "Count"),
    ("ingest/handoff/failed", "Count"),
    ("ingest/merge/time", "Milliseconds"),
    ("ingest/handoff/count", "Count"),
    ("ingest/sink/count", "Count"),
    ("ingest/events/messageGap", "Milliseconds"),
    ("ingest/kafka/lag", "Count"),
    ("task/run/time", "Milliseconds"),
    ("segment/added/bytes", "Bytes"),
    ("segment/moved/bytes", "Bytes"),
    ("segment/nuked/bytes", "Bytes"),
    ("task/success/count", "Count"),
    ("task/failed/count", "Count"),
    ("task/running/count", "Count"),
    ("task/pending/count", "Count"),
    ("task/waiting/count", "Count"),
    ("taskSlot/total/count", "Count"),
    ("taskSlot/idle/count", "Count"),
    ("taskSlot/used/count", "Count"),
    ("taskSlot/lazy/count", "Count"),
    ("taskSlot/blacklisted/count", "Count"),
)

# Metric name, kind, kept dimensions, "range" where 0..1 becomes percent.
ROLLUP_MAP = (
    ("query/time", "timer", ("dataSource", "type"), False),
    ("query/bytes", "count", ("dataSource", "type"), False),
    ("query/node/time", "timer", ("server",), False),
    ("query/node/ttfb", "timer", ("server",), False),
    ("query/node/bytes", "count", ("server",), False),
    ("query/node/backpressure", "timer", ("server",), False),
    ("query/segment/time", "timer", (), False),
    ("query/wait/time", "timer", (), False),
    ("segment/scan/pending", "gauge", (), False),
    ("query/segmentAndCache/time", "timer", (), False),
    ("query/cpu/time", "timer", ("dataSource", "type"), False),
    ("query/count", "count", (), False),
    ("query/success/count", "count", (), False),
    ("query/failed/count", "count", (), False),
    ("query/interrupted/count", "count", (), False),
    ("query/timeout/count", "count", (), False),
    ("query/cache/delta/numEntries", "count", (), False),
    ("query/cache/delta/sizeBytes", "count", (), False),
    ("query/cache/delta/hits", "count", (), False),
    ("query/cache/delta/misses", "count", (), False),
    ("query/cache/delta/evictions", "count", (), False),
    ("query/cache/delta/hitRate", "count", (), True),
    ("query/cache/delta/averageBytes", "count", (), False),
    ("query/cache/delta/timeouts", "count", (), False),
    ("query/cache/delta/errors", "count", (), False),
    ("query/cache/total/numEntries", "gauge", (), False),
    ("query/cache/total/sizeBytes", "gauge", (), False),
    ("query/cache/total/hits", "gauge", (), False),
    ("query/cache/total/misses", "gauge", (), False),
    ("query/cache/total/evictions", "gauge", (), False),
    ("query/cache/total/hitRate", "gauge", (), True),
    ("query/cache/total/averageBytes", "gauge", (), False),
    ("query/cache/total/timeouts", "gauge", (), False),
    ("query/cache/total/errors", "gauge", (), False),
    ("ingest/events/thrownAway", "count", ("dataSource",), False),
    ("ingest/events/unparseable", "count", ("dataSource",), False),
    ("ingest/events/duplicate", "count", ("dataSource",), False),
    ("ingest/events/processed", "count", ("dataSource",), False),
    ("ingest/events/messageGap", "gauge", ("dataSource",), False),
    ("ingest/rows/output", "count", ("dataSource",), False),
    ("ingest/persists/count", "count", ("dataSource",), False),
    ("ingest/persists/time", "timer", ("dataSource",), False),
    ("ingest/persists/cpu", "timer", ("dataSource",), False),
    ("ingest/persists/backPressure", "gauge", ("dataSource",), False),
    ("ingest/persists/failed", "count", ("dataSource",), False),
    ("ingest/handoff/failed", "count", ("dataSource",), False),
    ("ingest/merge/time", "timer", ("dataSource",), False),
    ("ingest/merge/cpu", "timer", ("dataSource",), False),
    ("ingest/kafka/lag", "gauge", ("dataSource", "stream"), False),
    ("ingest/kafka/maxLag", "gauge", ("dataSource", "stream"), False),
    ("ingest/kafka/avgLag", "gauge", ("dataSource", "stream"), False),
    ("ingest/kafka/partitionLag", "gauge", ("dataSource", "stream", "partition"), False),
    ("task/success/count", "count", ("dataSource",), False),
    ("task/failed/count", "count", ("dataSource",), False),
    ("task/running/count", "gauge", ("dataSource",), False),
    ("task/pending/count", "gauge", ("dataSource",), False),
    ("task/waiting/count", "gauge", ("dataSource",), False),
    ("worker/task/failed/count", "count", ("category", "workerVersion"), False),
    ("worker/task/success/count", "count", ("category", "workerVersion"), False),
    ("worker/taskSlot/idle/count", "gauge", ("category", "workerVersion"), False),
    ("worker/taskSlot/total/count", "gauge", ("category", "workerVersion"), False),
    ("worker/taskSlot/used/count", "gauge", ("category", "workerVersion"), False),
    ("taskSlot/total/count", "gauge", ("category",), False),
    ("taskSlot/idle/count", "gauge", ("category",), False),
    ("taskSlot/used/count", "gauge", ("category",), False),
    ("taskSlot/lazy/count", "gauge", ("category",), False),
    ("taskSlot/blacklisted/count", "gauge", ("category",), False),
    ("task/run/time", "timer", ("dataSource", "taskType"), False),
    ("segment/added/bytes", "count", ("dataSource", "taskType"), False),
    ("segment/moved/bytes", "count", ("dataSource", "taskType"), False),
    ("segment/nuked/bytes", "count", ("dataSource", "taskType"), False),
    ("segment/assigned/count", "count", ("tier",), False),
    ("segment/moved/count", "count", ("tier",), False),
    ("segment/dropped/count", "count", ("tier",), False),
    ("segment/deleted/count", "count", ("tier",), False),
    ("segment/unneeded/count", "count", ("tier",), False),
    ("segment/unavailable/count", "gauge", ("dataSource",), False),
    ("segment/underReplicated/count", "gauge", ("dataSource", "tier"), False),
    ("segment/cost/raw", "count", ("tier",), False),
    ("segment/cost/normalization", "count", ("tier",), False),
    ("segment/cost/normalized", "count", ("tier",), False),
    ("segment/loadQueue/size", "gauge", ("server",), False),
    ("segment/loadQueue/failed", "gauge", ("server",), False),
    ("segment/loadQueue/count", "gauge", ("server",), False),
    ("segment/dropQueue/count", "gauge", ("server",), False),
    ("segment/size", "gauge", ("dataSource",), False),
    ("segment/overShadowed/count", "gauge", (), False),
    ("segment/max", "gauge", (), False),
    ("segment/used", "gauge", ("dataSource", "tier", "priority"), False),
    ("segment/usedPercent", "gauge", ("dataSource", "tier", "priority"), True),
    ("segment/pendingDelete", "gauge", (), False),
    ("jvm/pool/committed", "gauge", ("poolKind", "poolName"), False),
    ("jvm/pool/init", "gauge", ("poolKind", "poolName"), False),
    ("jvm/pool/max", "gauge", ("poolKind", "poolName"), False),
    ("jvm/pool/used", "gauge", ("poolKind", "poolName"), False),
    ("jvm/bufferpool/count", "gauge", ("bufferpoolName",), False),
    ("jvm/bufferpool/used", "gauge", ("bufferpoolName",), False),
    ("jvm/bufferpool/capacity", "gauge", ("bufferpoolName",), False),
    ("jvm/mem/init", "gauge", ("memKind",), False),
    ("jvm/mem/max", "gauge", ("memKind",), False),
    ("jvm/mem/used", "gauge", ("memKind",), False),
    ("jvm/mem/committed", "gauge", ("memKind",), False),
    ("jvm/gc/count", "count", ("gcName", "gcGen"), False),
    ("jvm/gc/cpu", "count", ("gcName", "gcGen"), False),
    ("ingest/events/buffered", "gauge", ("serviceName", "bufferCapacity"), False),
    ("sys/swap/free", "gauge", (), False),
    ("sys/swap/max", "gauge", (), False),
    ("sys/swap/pageIn", "gauge", (), False),
    ("sys/swap/pageOut", "gauge", (), False),
    ("sys/disk/write/count", "count", ("fsDevName",), False),
    ("sys/disk/read/count", "count", ("fsDevName",), False),
    ("sys/disk/write/size", "count", ("fsDevName",), False),
    ("sys/disk/read/size", "count", ("fsDevName",), False),
    ("sys/net/write/size", "count", (), False),
    ("sys/net/read/size", "count", (), False),
    ("sys/fs/used", "gauge", ("fsDevName", "fsDirName", "fsTypeName", "fsSysTypeName", "fsOptions"), False),
    ("sys/fs/max", "gauge", ("fsDevName", "fsDirName", "fsTypeName", "fsSysTypeName", "fsOptions"), False),
    ("sys/mem/used", "gauge", (), False),
    ("sys/mem/max", "gauge", (), False),
    ("sys/storage/used", "gauge", ("fsDirName",), False),
    ("sys/cpu", "gauge", ("cpuName", "cpuTime"), False),
    ("coordinator-segment/count", "gauge", ("dataSource",), False),
    ("historical-segment/count", "gauge", ("dataSource", "tier", "priority"), False),
    ("jetty/numOpenConnections", "gauge", (), False),
    ("jetty/threadPool/total", "gauge", (), False),
    ("jetty/threadPool/idle", "gauge", (), False),
    ("jetty/threadPool/busy", "gauge", (), False),
    ("jetty/threadPool/isLowOnThreads", "gauge", (), False),
    ("jetty/threadPool/min", "gauge", (), False),
    ("jetty/threadPool/max", "gauge", (), False),
    ("jetty/threadPool/queueSize", "gauge", (), False),
    ("coordinator/time", "timer", (), False),
    ("coordinator/global/time", "timer", (), False),
    ("tier/required/capacity", "gauge", ("tier",), False),
    ("tier/total/capacity", "gauge", ("tier",), False),
    ("tier/replication/factor", "gauge", ("tier",), False),
    ("tier/historical/count", "count", ("tier",), False),
    ("compact/task/count", "count", (), False),
    ("compactTask/maxSlot/count", "count", (), False),
    ("compactTask/availableSlot/count", "count", (), False),
    ("segment/waitCompact/bytes", "gauge", ("dataSource",), False),
    ("segment/waitCompact/count", "count", ("dataSource",), False),
    ("interval/waitCompact/count", "count", ("dataSource",), False),
    ("segment/skipCompact/bytes", "gauge", ("dataSource",), False),
    ("segment/skipCompact/count", "count", ("dataSource",), False),
    ("interval/skipCompact/count", "count", ("dataSource",), False),
    ("segment/compacted/bytes", "gauge", ("dataSource",), False),
    ("segment/compacted/count", "count", ("dataSource",), False),
    ("interval/compacted/count", "count", ("dataSource",), False),
    ("namespace/cache/numEntries", "gauge", (), False),
    ("namespace/cache/heapSizeInBytes", "gauge", (), False),
    ("service/heartbeat", "count", ("leader",), False),
)

# User dimensions that never reach a datum.
BLOCKED_DIMS = (
    "gcGenSpaceName", "context", "dimension", "duration", "hasFilters", "id", "interval",
    "numComplexMetrics", "numDimensions", "numMetrics", "remoteAddress", "threshold",
    "taskId", "segment",
)

# Coordination metrics and their units.
COORDINATION_UNITS = {
    "zk_avg_latency": "Milliseconds",
    "zk_max_latency": "Milliseconds",
    "zk_min_latency": "Milliseconds",
    "zk_num_alive_connections": "Count",
    "zk_outstanding_requests": "Count",
    "zk_znode_count": "Count",
    "zk_watch_count": "Count",
    "zk_watch_bytes": "Bytes",
    "zk_approximate_data_size": "Bytes",
    "zk_packets_sent": "Count",
    "zk_packets_received": "Count",
    "zk_connection_drop_count": "Count",
    "zk_server_state": "None",
}

# Host measurements per family, and file systems left out.
HOST_MEASURES = {
    "cpu": ("cpu_usage_active", "cpu_usage_idle", "cpu_usage_guest", "cpu_usage_system"),
    "disk": ("free", "total", "used"),
    "diskio": ("reads", "writes", "read_time", "write_time", "io_time"),
    "mem": ("mem_used", "mem_cached", "mem_total"),
}
IGNORED_FILE_SYSTEMS = ("sysfs", "devtmpfs", "tmpfs")
CPU_TOTAL = "cpu-total"

# Resource types, and the default roles as role -> (types, actions).
RESOURCE_TYPES = ("CONFIG", "QUERY_CONTEXT", "SYSTEM_TABLE", "EXTERNAL", "DATASOURCE", "STATE", "VIEW")
DEFAULT_ROLES = {
    "administrator": (RESOURCE_TYPES, ("READ", "WRITE")),
    "manage": (("DATASOURCE", "STATE", "CONFIG"), ("WRITE", "READ")),
    "read": (("DATASOURCE", "STATE"), ("READ",)),
    "write": (("DATASOURCE", "STATE"), ("WRITE", "READ")),
}


@dataclass(frozen=True)
class EmitterSettings:
    """Names a deployment puts on its own datums."""

    cluster: str = "cluster-a"
    namespace: str = "Metricloom"
    prefix: str = "Engine"

    @property
    def service_dim(self) -> str:
        return f"{self.prefix}.Service"

    @property
    def cluster_dim(self) -> str:
        return f"{self.prefix}.Cluster"

    @property
    def alert_name(self) -> str:
        return f"{self.prefix}.Alert"


@dataclass(frozen=True)
class AlarmRule:
    name: str
    metric: str
    statistic: str
    period: str
    compare: str
    threshold: float
    datapoints: int
    evaluations: int
    missing: str
    dims: dict = field(default_factory=dict, hash=False)
    # "a/b": the share of the first metric in the second, in percent
    ratio: bool = False


# The alarm catalogue.
ALARM_RULES = (
    AlarmRule("database cpu", "CPUUtilization", "avg", "5 minutes", ">", 75, 3, 5, "not_breaching", {"namespace": "database"}),
    AlarmRule("coordination latency", "zk_max_latency", "p99", "5 minutes", ">", 3000, 3, 5, "missing"),
    AlarmRule("coordination queue", "zk_outstanding_requests", "p99", "5 minutes", ">", 50, 3, 3, "missing"),
    AlarmRule("lb 4xx", "HTTPCode_ELB_4XX_Count", "sum", "5 minutes", ">", 50, 3, 5, "not_breaching"),
    AlarmRule("lb 5xx", "HTTPCode_ELB_5XX_Count", "sum", "5 minutes", ">", 10, 3, 5, "not_breaching"),
    AlarmRule("healthy hosts", "HealthyHostCount", "avg", "5 minutes", "<=", 1, 3, 5, "missing"),
    AlarmRule("query failures", "query/failed/count", "avg", "5 minutes", ">", 5, 3, 5, "not_breaching",
              {"service": "historical"}),
    AlarmRule("group cpu", "CPUUtilization", "avg", "1 minute", ">", 85, 3, 5, "not_breaching", {"namespace": "group"}),
    AlarmRule("group memory", "mem_used/mem_total", "avg", "1 minute", ">", 85, 3, 5, "not_breaching", ratio=True),
    AlarmRule("group disk", "disk_used/disk_total", "sum", "1 minute", ">", 85, 3, 5, "not_breaching", ratio=True),
    AlarmRule("failed nodes", "cluster_failed_node_count", "avg", "5 minutes", ">", 0, 3, 5, "not_breaching"),
    AlarmRule("pod count", "service_number_of_running_pods", "avg", "5 minutes", "<", 1, 3, 5, "not_breaching"),
    AlarmRule("pod cpu", "pod_cpu_utilization", "avg", "5 minutes", ">", 85, 3, 5, "not_breaching"),
    AlarmRule("pod memory", "pod_memory_utilization", "avg", "5 minutes", ">", 85, 3, 5, "not_breaching"),
)

# Dashboard panels as (metric, statistic, period); "a/b" is a share in percent.
DASHBOARD_PANELS = {
    "canary status": (("SuccessPercent", "avg", "5 minutes"),),
    "lb requests": (("RequestCount", "sum", "1 minute"),),
    "lb response time": (("TargetResponseTime", "avg", "1 minute"),),
    "lb connections": (
        ("ActiveConnectionCount", "sum", "1 minute"),
        ("NewConnectionCount", "sum", "1 minute"),
        ("RejectedConnectionCount", "sum", "1 minute"),
    ),
    "lb response codes": (
        ("HTTPCode_Target_5XX_Count", "sum", "1 minute"),
        ("HTTPCode_Target_4XX_Count", "sum", "1 minute"),
        ("HTTPCode_Target_2XX_Count", "sum", "1 minute"),
        ("HTTPCode_Target_3XX_Count", "sum", "1 minute"),
    ),
    "deep storage": (("BucketSizeBytes", "avg", "1 day"), ("NumberOfObjects", "avg", "1 day")),
    "ingestion count": (
        ("ingest/events/processed", "sum", "1 minute"),
        ("ingest/events/duplicate", "sum", "1 minute"),
        ("ingest/rows/output", "sum", "1 minute"),
    ),
    "query count": (
        ("query/count", "avg", "1 minute"),
        ("query/success/count", "avg", "1 minute"),
        ("query/failed/count", "avg", "1 minute"),
        ("query/interrupted/count", "avg", "1 minute"),
    ),
    "query time": (("query/time", "tm99", "1 minute"),),
    "group load": (
        ("CPUUtilization", "avg", "1 minute"),
        ("NetworkIn", "avg", "1 minute"),
        ("NetworkOut", "avg", "1 minute"),
    ),
    "database": (
        ("CPUUtilization", "avg", "1 minute"),
        ("DatabaseConnections", "avg", "1 minute"),
        ("ReadThroughput", "avg", "1 minute"),
        ("WriteThroughput", "avg", "1 minute"),
        ("FreeableMemory", "avg", "1 minute"),
        ("ReadLatency", "avg", "1 minute"),
        ("WriteLatency", "avg", "1 minute"),
    ),
    "serverless database": (
        ("CPUUtilization", "avg", "1 minute"),
        ("DatabaseConnections", "avg", "1 minute"),
        ("ReadThroughput", "avg", "1 minute"),
        ("WriteThroughput", "avg", "1 minute"),
        ("ReadLatency", "avg", "1 minute"),
        ("WriteLatency", "avg", "1 minute"),
        ("ServerlessDatabaseCapacity", "avg", "1 minute"),
    ),
    "group memory": (("mem_used/mem_total", "avg", "1 minute"),),
    "group disk": (("disk_used/disk_total", "sum", "1 minute"),),
    "nodes": (
        ("cluster_failed_node_count", "avg", "5 minutes"),
        ("cluster_node_count", "avg", "5 minutes"),
    ),
    "pods": (
        ("service_number_of_running_pods", "avg", "5 minutes"),
        ("pod_cpu_utilization", "avg", "5 minutes"),
        ("pod_memory_utilization", "avg", "5 minutes"),
    ),
}

# What a panel's series must hold, and the dimension that makes a series of each of its values.
PANEL_TOKENS = {
    "ingestion count": {"service": "middleManager"},
    "query count": {"service": "historical"},
    "query time": {"service": "broker", "success": "true"},
    "database": {"namespace": "database"},
    "serverless database": {"namespace": "database"},
    "group load": {"namespace": "group"},
}
PANEL_FAN_OUT = {"ingestion count": "data_source", "query time": "data_source", "pods": "service"}


@dataclass(frozen=True)
class PanelLine:
    panel: str
    metric: str
    statistic: str
    period: str
    tokens: tuple[tuple[str, str], ...] = ()
    by: str | None = None

    @property
    def ratio(self) -> bool:
        return "/" in self.metric and self.panel.startswith("group ")


def panel_lines() -> list[PanelLine]:
    return [
        PanelLine(panel, *line, tuple(PANEL_TOKENS.get(panel, {}).items()), PANEL_FAN_OUT.get(panel))
        for panel, lines in DASHBOARD_PANELS.items() for line in lines
    ]


def unit_rows() -> list[dict]:
    return [{"metric": metric, "unit": unit} for metric, unit in METRIC_UNITS]


def rollup_rows() -> list[dict]:
    return [
        {"metric": metric, "rollup_kind": kind, "keep_dims": list(dims), "convert_range": convert}
        for metric, kind, dims, convert in ROLLUP_MAP
    ]


def role_rows(roles=None) -> list[dict]:
    return [
        {"role": role, "resource_type": kind, "name_pattern": ".*", "action": action}
        for role, (kinds, actions) in (roles or DEFAULT_ROLES).items()
        for kind in kinds
        for action in actions
    ]


def unit_table(spark: SparkSession) -> DataFrame:
    return literal_table(spark, unit_rows(), pa.schema([("metric", pa.string()), ("unit", pa.string())]))


def rollup_table(spark: SparkSession) -> DataFrame:
    return literal_table(spark, rollup_rows(), pa.schema([
        ("metric", pa.string()), ("rollup_kind", pa.string()),
        ("keep_dims", pa.list_(pa.string())), ("convert_range", pa.bool_()),
    ]))


def role_table(spark: SparkSession, roles=None) -> DataFrame:
    return literal_table(spark, role_rows(roles), pa.schema([
        ("role", pa.string()), ("resource_type", pa.string()),
        ("name_pattern", pa.string()), ("action", pa.string()),
    ]))
