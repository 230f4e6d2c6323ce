import datetime
import glob

import duckdb
import pytest
from pyspark.sql import functions as F

from metricloom import plans, session
from metricloom.operators import health as H
from metricloom.operators import lookups as K
from metricloom.operators import olap as O
from metricloom.operators.retention import Rule
from metricloom.sources import formats, tables
from tests.compare import difference


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_formats_round_trip(spark, folder, tmp_path, format):
    events = tables.table(spark, folder, "events").drop("props")
    formats.write_table(events, f"{tmp_path}/t", format)
    back = formats.read_table(spark, f"{tmp_path}/t", format, events.schema)
    assert back.exceptAll(events).isEmpty() and events.exceptAll(back).isEmpty()


@pytest.mark.parametrize("format", ["avro", "kafka"])
def test_missing_packages_are_named(spark, tmp_path, format):
    with pytest.raises(RuntimeError, match="package"):
        formats.read_table(spark, str(tmp_path), format)


def test_missing_stream_connector_is_named(spark):
    with pytest.raises(RuntimeError, match="package"):
        formats.stream_topic(spark, "localhost:1", "t", "a int")


def test_event_reader_ignores_empty_rows(spark, tmp_path):
    (tmp_path / "e.json").write_text(
        '{"kind":"metric","metric":"query/time","value":1.5,"ts":"2024-01-01T00:00:00","dims":[{"name":"a","str":"b"}]}\n'
        "{}\nnull\n")
    rows = formats.metric_events(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["dims"][0]["str"] == "b"


def test_landed_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("GET 200 /x\nPUT 500 /y\n")
    assert formats.landed_logs(spark, str(tmp_path)).columns == ["value"]
    got = formats.landed_logs(spark, str(tmp_path), "verb string, code int, path string")
    assert got.where("code = 500").first()["path"] == "/y"


def test_system_columns(spark, folder):
    tables.table(spark, folder, "nation").createOrReplaceTempView("catalogued_nation")
    got = O.system_columns(spark, like="catalogued_*").orderBy("position").collect()
    assert [(r["column_name"], r["data_type"]) for r in got] == [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")]


def test_query_context_is_scoped(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with O.query_context(spark, spark__sql__shuffle__partitions=3, spark__sql__metricloom__unset="x"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("spark.sql.metricloom.unset", None) is None


def test_compaction_reduces_files(spark, folder, tmp_path):
    orders = tables.table(spark, folder, "orders")
    orders.repartition(12).write.partitionBy("o_orderstatus").parquet(f"{tmp_path}/small")
    O.compact(spark, f"{tmp_path}/small", f"{tmp_path}/big", "o_orderstatus", ["o_orderdate"])
    count = lambda name: len(glob.glob(f"{tmp_path}/{name}/*/*.parquet"))
    assert count("small") > 30 and count("big") == 3
    assert spark.read.parquet(f"{tmp_path}/big").count() == orders.count()


def test_overwrite_keeps_other_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "v int, day string")
    O.write_segments(rows, f"{tmp_path}/t", "day")
    O.overwrite_interval(spark.createDataFrame([(9, "b")], "v int, day string"), f"{tmp_path}/t", "day")
    assert sorted((r["v"], r["day"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, "a"), (9, "b")]


def test_load_status(spark):
    rows = spark.createDataFrame([('{"hot":{"a":1,"b":2},"cold":{"a":0}}',), ('{"cold":{}}',), ('{"hot":{"a":0}}',)], "s string")
    assert [(r["pending"], r["done"]) for r in H.load_progress(rows, "s", "hot").collect()] == [
        (3, False), (0, True), (0, True)]


def test_lookup_defaults(spark):
    rows = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    table = spark.createDataFrame([("a", "one")], "k string, v string")
    assert [r["v"] for r in K.lookup(rows, "k", table, "v", "?").orderBy("k").collect()] == ["?", "one", "?"]
    assert [r[0] for r in rows.select(K.lookup_map(F.col("k"), {"a": "one"}, "?")).collect()] == ["one", "?", "?"]


def test_replication_leaves_the_choice_to_the_planner(spark):
    rows = spark.createDataFrame([(i, datetime.datetime(2024, 1, 1)) for i in range(20)], "i int, t timestamp_ntz")
    other = spark.range(20).select(F.col("id").cast("int").alias("i"))
    table = K.replicated(rows, "t", [Rule("broadcastForever")], "2024-02-01")
    for threshold, kind in (("10m", "BroadcastHashJoin"), (-1, "SortMergeJoin")):
        with O.query_context(spark, spark__sql__autoBroadcastJoinThreshold=threshold):
            assert kind in other.join(table, "i")._jdf.queryExecution().executedPlan().toString()


def test_literal_tables_of_any_size(spark):
    import pyarrow as pa

    left = spark.range(10)
    for n, kind in ((10, "BroadcastHashJoin"), (300_000, "SortMergeJoin")):
        table = session.literal_table(spark, [{"id": i} for i in range(n)], pa.schema([("id", pa.int64())]))
        assert table.count() == n
        with O.query_context(spark, spark__sql__autoBroadcastJoinThreshold=-1):
            assert kind in left.join(table, "id")._jdf.queryExecution().executedPlan().toString()


def test_late_rows_by_blocks(spark):
    rows = [(i, b, t) for i, (b, t) in enumerate([(0, 50), (1, 100), (2, 20), (2, 95), (5, 90), (7, 300), (9, 250), (12, 299)])]
    start = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, b, start + datetime.timedelta(seconds=t)) for i, b, t in rows], "i int, batch bigint, ts timestamp_ntz")
    want = {i: t < max((u for _, c, u in rows if c < b), default=-10**9) - 10 for i, b, t in rows}
    for block in (1, 2, 3, 1000):
        got = H.late_rows(df, "ts", "batch", 10_000_000, block).collect()
        assert {r["i"]: r["thrown_away"] for r in got} == want


def test_priorities(spark):
    tiers = spark.createDataFrame([("x", 1), ("y", None), ("z", 5), ("w", 0), ("v", -1)], "tier string, priority int")
    got = [r["tier"] for r in H.by_priority(tiers, "priority", ["tier"]).collect()]
    assert got == ["z", "x", "w", "y", "v"]


def test_interval_filter_reaches_the_scan(spark, folder):
    rows = O.in_interval(tables.table(spark, folder, "events"), "ts", "2024-01-05", "2024-01-20").select("user_id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00), LessThan(ts,2024-01-20T00:00)" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_interval_prunes_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-0{i}") for i in range(1, 6)], "v int, day string")
    O.write_segments(rows.withColumn("day", F.to_date("day")), f"{tmp_path}/t", "day")
    kept = O.in_interval(spark.read.parquet(f"{tmp_path}/t"), "day", "2024-01-02", "2024-01-04")
    assert sorted(r["v"] for r in kept.collect()) == [2, 3]
    assert "PartitionFilters: [isnotnull(day" in kept._jdf.queryExecution().executedPlan().toString()


def test_estimates_of_many_values_are_close(spark):
    rows = spark.range(200_000).select((F.col("id") % 5).alias("part"), F.floor(F.col("id") / 2).alias("user"), F.col("id").cast("double").alias("value"))
    merged = O.merge_sketches(O.sketches(rows.withColumn("kind", F.lit("x")), ["kind", "part"], "user", "value"), ["kind"])
    got = merged.select(F.hll_sketch_estimate("hll"), F.theta_sketch_estimate("theta")).first()
    assert all(abs(x - 100_000) < 5_000 for x in got)


@pytest.mark.parametrize("name", ["sketch_estimates", "sketch_set_operations"])
def test_sketches_of_many_users_hold_them_all(spark, tmp_path, name):
    n = F.col("id")
    spark.range(60_000).select(
        n.alias("event_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(n % 29).cast("int"))).alias("ts"),
        (n % 24_000).alias("user_id"), F.when(n % 3 == 0, "a").otherwise("b").alias("event_type"), (n % 100).cast("double").alias("value"),
    ).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert difference(plans.queries()[name](spark, str(tmp_path)), con, plans.statements()[name]) is None


def test_tasks_write_no_more_rows_than_they_may(spark, tmp_path):
    n = F.col("id")
    day = F.when(n % 3 == 0, "hot").when(n % 1000 == 1, F.lit(None)).otherwise(F.concat(F.lit("d"), (n % 40).cast("string")))
    rows = spark.range(60_000).select(n, day.alias("day"), F.lit(0).alias("same"))
    O.write_segments(rows, f"{tmp_path}/t", "day", task_rows=5_000)
    back = spark.read.parquet(f"{tmp_path}/t")
    assert back.count() == 60_000 and back.select(*rows.columns).exceptAll(rows).isEmpty()
    name = F.regexp_extract(F.col("_metadata.file_path"), r"part-(\d+)-", 1)
    tasks = [r["n"] for r in back.groupBy(name).agg(F.count("*").alias("n")).collect()]
    # one hash spreads a partition over its tasks, so they are near 5,000 but not just that
    assert len(tasks) == 12 and max(tasks) < 5_600
    # only a partition that a border of two tasks cuts has two files more than it needs
    assert len(glob.glob(f"{tmp_path}/t/day=hot/*.parquet")) <= 6


@pytest.mark.parametrize("name, key", [("host_measures", "instance"), ("permission_bag", "principal")])
def test_rows_are_dealt_before_they_become_many(spark, folder, name, key):
    plan = plans.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString().split("Final Plan")[-1]
    lines = plan.splitlines()
    deals = [i for i, line in enumerate(lines) if f"Exchange hashpartitioning({key}" in line]
    assert len(deals) == 1 and "REPARTITION_BY_NUM" in lines[deals[0]]
    # both counts and what makes the rows many stand above the one exchange
    assert all(max(i for i, line in enumerate(lines[:deals[0]]) if word in line) >= 0 for word in ("HashAggregate", "Generate"))
    assert sum("HashAggregate" in line for line in lines[:deals[0]]) == 2
