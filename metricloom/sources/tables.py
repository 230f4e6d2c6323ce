"""The given tables, and the operational views derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.dims import RAW_DIMS

SERVICES = ("svc/broker", "svc/historical", "svc/middleManager", "svc/overlord")
FILE_SYSTEMS = ("xfs", "ext4", "tmpfs", "sysfs")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def choose(index: Column, names) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def text(column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return with_k(table(spark, folder, "events"))


def with_k(rows: DataFrame) -> DataFrame:
    return rows.withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))


def as_metric_events(rows: DataFrame) -> DataFrame:
    """The ``events`` table read as a stream of service metric, alert and other events."""
    kind = F.when(F.col("event_id") % 97 == 0, "other").when(F.col("event_type") == "error", "alert")
    of_type = F.col("event_type")
    even = F.col("event_id") % 2 == 0
    metric = (
        F.when(of_type == "signup", "task/success/count")
        .when(of_type == "purchase", "query/time")
        .when(of_type == "click", "jvm/gc/cpu")
        .when(of_type == "view", F.when(even, "query/cache/total/hitRate").otherwise("sys/disk/write/count"))
    )
    value = (
        F.when(of_type == "click", F.col("value") * 1e6)
        .when(of_type == "view", F.col("value") / 500)
        .otherwise(F.col("value"))
    )
    return rows.select(
        "event_id", "ts", "user_id", "event_type", "k",
        kind.otherwise("metric").alias("kind"),
        choose(F.col("user_id") % 4, SERVICES).alias("service"),
        F.concat(F.lit("node-"), text("user_id")).alias("host"),
        metric.alias("metric"),
        value.alias("value"),
        raw_dims().alias("dims"),
    )


def raw_dims() -> Column:
    def entry(name, string=None, items=None, other=None):
        return F.struct(
            F.lit(name).alias("name"),
            (F.lit(None) if string is None else string).cast("string").alias("str"),
            (F.lit(None) if items is None else items).cast("array<string>").alias("list"),
            (F.lit(None) if other is None else other).cast("string").alias("other"),
        )

    k, user = F.col("k"), F.col("user_id")
    everywhere = F.array(
        entry("dataSource", F.concat(F.lit("[ds: "), text(k % 5), F.lit("]"))),
        entry("success", F.when(k % 10 == 0, "false").otherwise("true")),
        entry("server", items=F.array(F.concat(F.lit("host-"), text(user % 7)))),
        entry("id", text("event_id")),
        entry("numMetrics", other=text(k)),
        entry("blank", F.lit("[ ]")),
        entry("partition", other=text(k % 3)),
    )
    typed = F.array(entry("type", items=F.array(F.lit("a"), F.lit("b"))))
    none = F.array().cast(RAW_DIMS)
    return F.concat(everywhere, F.when(k % 3 == 0, typed).otherwise(none)).cast(RAW_DIMS)


def metric_events(spark: SparkSession, folder: str) -> DataFrame:
    return as_metric_events(events(spark, folder))


def host_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder)
    return rows.select(
        "event_id", "ts",
        F.concat(F.lit("asg-"), text(F.col("user_id") % 3)).alias("asg"),
        F.concat(F.lit("i-"), text("user_id")).alias("instance"),
        F.when(F.col("user_id") % 2 == 0, "large").otherwise("small").alias("instance_type"),
        choose(F.col("k") % 4, FILE_SYSTEMS).alias("fstype"),
        F.concat(F.lit("/mnt/"), text(F.col("k") % 2)).alias("path"),
        F.col("value").alias("used"),
        F.lit(1000.0).alias("total"),
        (F.lit(1000.0) - F.col("value")).alias("free"),
        (F.col("value") * 2).alias("mem_used"),
        F.lit(2000.0).alias("mem_total"),
        F.col("k").cast("double").alias("cpu_usage_active"),
        (F.lit(100.0) - F.col("k")).alias("cpu_usage_idle"),
    )


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """One segment per data source, tier and shipping day."""
    lines = table(spark, folder, "lineitem")
    return lines.groupBy(
        F.col("l_returnflag").alias("data_source"),
        F.when(F.col("l_linestatus") == "O", "hot").otherwise("cold").alias("tier"),
        F.to_date("l_shipdate").cast("timestamp_ntz").alias("day"),
    ).agg(F.sum("l_quantity").alias("bytes"), F.count(F.lit(1)).alias("rows")).withColumns({
        "available": F.col("rows") % 5 != 0,
        "replicas": (F.col("rows") % 3 + 1).cast("int"),
        "status": F.when(F.col("bytes") < 100, "waiting").when(F.col("rows") % 7 == 0, "skipped")
        .otherwise("compacted"),
    })


def principals(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with a group claim: comma text, JSON list, or none."""
    own, key = F.col("c_mktsegment"), F.col("c_custkey")
    extra = F.concat(F.lit("nation-"), text("c_nationkey"))
    claim = (
        F.when(key % 11 == 0, F.lit(None))
        .when(key % 2 == 0, F.concat(own, F.lit(" , "), extra))
        .otherwise(F.concat(F.lit('["'), own, F.lit('","'), extra, F.lit('"]')))
    )
    return table(spark, folder, "customer").select(key.alias("principal"), claim.alias("claim"))


def access_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every order is one access request by its customer."""
    orders = table(spark, folder, "orders")
    asked = orders.select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("principal"),
        F.when(F.col("o_orderstatus") == "F", "DATASOURCE").when(F.col("o_orderstatus") == "O", "STATE")
        .otherwise("CONFIG").alias("resource_type"),
        F.lower(F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("_"))).alias("resource_name"),
        F.when(F.col("o_totalprice") < 250000, "READ").otherwise("WRITE").alias("action"),
        (F.col("o_totalprice") < 490000).alias("has_context"),
    )
    return asked.join(principals(spark, folder), "principal", "left")


def group_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Stored groups: the market segments in use, and the nations, each with its roles."""
    segments_used = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("group")).distinct()
    by_segment = (
        F.when(F.col("group") == "BUILDING", F.array(F.lit("read"), F.lit("urgent")))
        .when(F.col("group") == "MACHINERY", F.array(F.lit("write")))
        .when(F.col("group") == "HOUSEHOLD", F.array(F.lit("administrator"), F.lit("read")))
        .otherwise(F.array().cast("array<string>"))
    )
    nations = table(spark, folder, "nation")
    by_nation = F.when(F.col("n_regionkey") == 0, F.array(F.lit("urgent"))).otherwise(F.array(F.lit("manage_low")))
    return (
        segments_used.select("group", F.explode(by_segment).alias("role"))
        .unionByName(nations.select(
            F.concat(F.lit("nation-"), text("n_nationkey")).alias("group"), F.explode(by_nation).alias("role")
        ))
    )


CUSTOM_PERMISSIONS = [
    {"role": "urgent", "resource_type": "DATASOURCE", "name_pattern": "[12]-.*", "action": "READ"},
    {"role": "urgent", "resource_type": "STATE", "name_pattern": "1-urgent", "action": "WRITE"},
    {"role": "manage_low", "resource_type": "CONFIG", "name_pattern": ".*low", "action": "READ"},
    {"role": "manage_low", "resource_type": "CONFIG", "name_pattern": "low", "action": "WRITE"},
]


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    return as_log_lines(events(spark, folder))


def as_log_lines(rows: DataFrame) -> DataFrame:
    """Events rendered as container log lines, with the file they came from."""
    stream = F.when(F.col("event_type") == "error", "stderr").otherwise("stdout")
    tag = F.when(F.col("event_id") % 5 == 0, "P").otherwise("F")
    body = F.when(F.col("k") % 4 == 0, F.concat(F.lit("plain "), text("event_id"))).otherwise(F.col("props"))
    names = ("web", "fluent-bit", "metric-agent", "network-node", "kube-proxy", "api")
    workload = choose(F.col("user_id") % 6, names)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return rows.select(
        "event_id", "ts",
        F.concat(F.lit("/var/log/containers/"), workload, F.lit("-"), text("user_id"), F.lit(".log")).alias("path"),
        F.concat_ws(" ", F.concat(stamp, F.lit("+00:00")), stream, tag, body).alias("value"),
    )


def scrapes(spark: SparkSession, folder: str) -> DataFrame:
    """Events rendered as coordination scrape lines, one scrape per node and 6 hours."""
    of_type = F.col("event_type")
    line = (
        F.when(of_type == "click", F.concat(F.lit("zk_avg_latency\t"), text("k")))
        .when(of_type == "view", F.concat(F.lit("  zk_max_latency "), text("k"), F.lit(" extra")))
        .when(of_type == "purchase", F.concat(F.lit("zk_unknown_metric "), text("k")))
        .when(of_type == "signup", F.concat(
            F.lit("zk_server_state\t"), F.when(F.col("k") % 2 == 0, "leader").otherwise("follower")))
        .when(F.col("k") % 3 == 0, "zk_version\t3.8.1 zk_avg_latency")
        .when(F.col("k") % 3 == 1, "   ")
        .otherwise("zk_packets_sent")
    )
    return events(spark, folder).select(
        (F.col("user_id") % 3 + 1).alias("node"),
        F.window("ts", "6 hours")["start"].alias("scrape"),
        F.col("event_id").alias("line_no"),
        line.alias("value"),
    )


def offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Newest and committed offset per data source, stream, partition and hour."""
    hourly = events(spark, folder).groupBy(
        F.col("event_type").alias("data_source"), (F.col("user_id") % 4).alias("partition"),
        F.window("ts", "1 hour")["start"].alias("hour"),
    ).agg(F.max("event_id").alias("latest"), F.max("k").alias("k"))
    return hourly.select(
        "data_source", F.concat(F.lit("topic-"), F.col("data_source")).alias("stream"), "partition", "hour",
        "latest", (F.col("latest") - F.col("k")).alias("committed"),
    )


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Orders read as ingestion tasks."""
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    state = (
        F.when(status == "F", F.when(price < 450000, "success").otherwise("failed"))
        .when(status == "O", "running")
        .otherwise(F.when(price < 250000, "pending").otherwise("waiting"))
    )
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("data_source"),
        F.concat(F.lit("category-"), text(F.col("o_custkey") % 4)).alias("category"), state.alias("state"),
        F.col("o_orderdate").alias("started"),
    )
