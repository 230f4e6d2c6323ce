"""Streaming jobs: the batch transforms on file streams, with restartable file sinks.

Every job takes a streaming DataFrame and gives a started query or, for ``drain``, the table
written by a query that stops when its input is used up. Sinks write files, never to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metricloom.catalog import EmitterSettings
from metricloom.functions import parsers as P
from metricloom.operators import alarms as A
from metricloom.operators import batching as B
from metricloom.operators import logs as L
from metricloom.operators import normalize as N
from metricloom.operators.olap import write_segments
from metricloom.operators.prefix import time_block
from metricloom.session import discard, scratch_path, stored, temporary_tables

FLUSH = "10 seconds"
LOG_FLUSH = "5 seconds"
LOSS_PERIOD = "1 minute"


def with_watermark(rows: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need a zoned timestamp; the session runs in UTC."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def start(rows: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict | None = None,
          partition: list[str] | None = None) -> StreamingQuery:
    writer = rows.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint)
    if partition:
        writer = writer.partitionBy(*partition)
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)


def start_batches(rows: DataFrame, write, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def drain(rows: DataFrame, label: str, arrivals=(None,)) -> DataFrame:
    """Run until the input is used up and read what was written.

    ``arrivals`` are calls that bring more input; after each the query is started again from its checkpoint.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, label)
    for arrive in arrivals:
        if arrive:
            arrive()
        start(rows, path, f"{path}-checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


def windowed_statistics(rows: DataFrame, keys: list[str], period: str, delay: str, value: str = "value",
                        ts: str = "ts") -> DataFrame:
    """Sum, average and count per closed window (append mode)."""
    marked = with_watermark(rows, ts, delay)
    return marked.groupBy(*keys, F.window(ts, period).alias("w")).agg(
        F.sum(value).alias("sum"), F.avg(value).alias("avg"), F.count(F.lit(1)).alias("count")
    ).select(*keys, F.col("w.start").cast("timestamp_ntz").alias("bucket"), "sum", "avg", "count")


def first_copies(rows: DataFrame, ids: list[str], delay: str, ts: str = "ts", salts: int = 1) -> DataFrame:
    """Rows whose id was not seen within the watermark.

    A stream keeps no map-side state, so an id with very many copies would send them all to one
    task. With ``salts`` the copies of every input task group meet first, and at most ``salts``
    of them go on to meet each other.
    """
    marked = with_watermark(rows, ts, delay)
    if salts > 1:
        marked = marked.withColumn("__salt", F.spark_partition_id() % salts).dropDuplicatesWithinWatermark(
            [*ids, "__salt"]).drop("__salt")
    return marked.dropDuplicatesWithinWatermark(ids)


def split_parsed(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse JSON text; ``unparseable`` marks the lines that are not of the schema."""
    parsed = F.from_json(F.col(column), f"{schema}, _corrupt string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.withColumn("body", parsed)
    bad = F.col("body").isNull() | F.col("body._corrupt").isNotNull()
    return rows.withColumn("unparseable", bad)


def loss_counts(events: DataFrame, period: str, delay: str) -> DataFrame:
    """Loss counters per closed window; a new window starts from zero."""
    marked = with_watermark(N.dispatch(events), "ts", delay)
    return marked.groupBy(F.window("ts", period).alias("w")).agg(
        F.count_if(F.col("route") == "invalid").alias("invalid"), F.count_if(F.col("route") == "fatal").alias("fatal")
    ).select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "invalid", "fatal")


def flush_datums(events: DataFrame, path: str, checkpoint: str, settings: EmitterSettings, size: Column,
                 flush: str = FLUSH, block: str = "10 milliseconds", bound: int = B.QUEUE_BYTES,
                 batch_size: int = B.BATCH_SIZE, trigger: dict | None = None,
                 loss_period: str = LOSS_PERIOD) -> StreamingQuery:
    """Normalise, admit by bytes, number into requests and write to both sinks; count what is lost.

    A micro-batch is one turn of the emitter. Its datums go to ``path/requests`` and, under
    their mapped dimensions, to ``path/statsd``. ``path/losses`` has the four loss counters of every
    ``loss_period`` the batch spans, zeros included; a period that several batches touch has a row
    from each, to be added up. Every epoch overwrites its own folder, so a repeated epoch after a
    failure leaves one copy.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        with temporary_tables(batch.sparkSession):
            flush_one(batch, epoch)

    def flush_one(batch: DataFrame, epoch: int) -> None:
        # stored and not kept in memory: what reads them again takes only the columns and splits it needs, however many rows
        # a file of the stream brought
        parsed = stored(batch, "parsed")
        datums = stored(N.datums(parsed, settings).withColumns({"size": size, "flush": F.window("ts", flush)["start"]}), "datums")
        decided = stored(B.admit(
            datums, ["queue", "service", "flush"], ["ts", "event_id"], time_block(F.col("ts"), block),
            bound=bound,
        ), "decided")
        unusable = N.dispatch(parsed).where("route in ('invalid', 'fatal')").select("ts", "route", F.lit(False).alias("lost"))
        offered = decided.select("ts", F.col("queue").alias("route"), (~F.col("admitted")).alias("lost"))
        B.loss_counters(unusable.unionByName(offered), loss_period).write.mode("overwrite").parquet(
            f"{path}/losses/epoch={epoch}")
        admitted = decided.where("admitted")
        requests = B.request_batches(admitted.drop("flush", "admitted"), flush, block, batch_size)
        requests.write.mode("overwrite").parquet(f"{path}/requests/epoch={epoch}")
        statsd = N.statsd_rows(parsed, settings).select(
            "event_id", "metric", "rollup_kind", "value", "dims", "tags", "host_tag")
        statsd.write.mode("overwrite").parquet(f"{path}/statsd/epoch={epoch}")

    return start_batches(events, write, checkpoint, trigger or {"processingTime": flush})


def route_logs(lines: DataFrame, path: str, checkpoint: str, layout: L.LogLayout, host: Column,
               trigger: dict | None = None) -> StreamingQuery:
    """Parse container lines, merge JSON bodies, route them and write by tag family."""
    short = L.skip_long_lines(L.application_files(lines, layout))
    parsed = L.merge_json_body(L.parsed(short, P.parse_cri))
    tagged = parsed.withColumn("tag", F.concat(F.lit("application"), F.replace(F.col("path"), F.lit("/"), F.lit("."))))
    routed = L.sink_route(tagged, layout, host).withColumn("family", F.split_part("tag", F.lit("."), F.lit(1)))

    def write(batch: DataFrame, epoch: int) -> None:
        write_segments(batch, f"{path}/epoch={epoch}", "family")

    return start_batches(routed, write, checkpoint, trigger or {"processingTime": LOG_FLUSH})


def watch_alarms(points: DataFrame, keys: list[str], rules, period: str, path: str, checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """Append the state changes each batch of closed windows brings.

    ``points`` are closed windows (append mode) with ``alarm``, ``keys``, ``bucket``, ``value``. All
    series are evaluated up to the newest closed window of any, so one that stops reporting changes its
    state too. Between epochs only the newest N + 1 points of every series and the time reached are
    carried, so an epoch costs series x N rows however long the stream has run.
    """
    series = ["alarm", *keys]
    carried = max(rule.evaluations for rule in rules) + 1

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = batch.select(*series, F.col("bucket").cast("timestamp_ntz"), "value", F.lit(None).cast("timestamp_ntz").alias("reached"))
        if epoch > 0:
            known = spark.read.parquet(f"{path}/tail/epoch={epoch - 1}").unionByName(known)
        known = known.persist()
        try:
            reached, newest = known.agg(F.max("reached"), F.max("bucket")).first()
            since = None if reached is None else F.lit(reached) - F.expr(f"INTERVAL {period}") * carried
            states = A.evaluate(known.drop("reached"), keys, rules, period, newest if reached is None else max(reached, newest), since)
            changes = A.transitions(states, keys)
            fresh = changes if reached is None else changes.where(F.col("bucket") > F.lit(reached))
            fresh.write.mode("overwrite").parquet(f"{path}/transitions/epoch={epoch}")
            youngest = W.partitionBy(*series).orderBy(F.desc("bucket"))
            tail = known.withColumn("__age", F.row_number().over(youngest)).where(F.col("__age") <= carried).drop("__age")
            upto = F.greatest(F.lit(reached).cast("timestamp_ntz"), F.lit(newest).cast("timestamp_ntz"))
            tail.withColumn("reached", upto).write.mode("overwrite").parquet(f"{path}/tail/epoch={epoch}")
        finally:
            known.unpersist()
        if epoch > 1:
            discard(spark, f"{path}/tail/epoch={epoch - 2}")

    return start_batches(points, write, checkpoint, trigger)


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("epoch")
