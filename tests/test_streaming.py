import dataclasses
import datetime
import os
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from metricloom import session
from metricloom.catalog import AlarmRule, EmitterSettings
from metricloom.operators import alarms as A
from metricloom.plans.logs import LAYOUT
from metricloom.sources import formats, text
from metricloom.sources.formats import EVENT_SCHEMA
from metricloom.streaming import jobs as J

T0 = datetime.datetime(2024, 1, 1)


def put(spark, path, name, rows, schema):
    """One file per call, in the order of the calls."""
    frame = spark.createDataFrame(rows, schema).coalesce(1)
    frame.write.parquet(f"{path}/{name}")


def stream(spark, path, schema):
    return (spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
            .parquet(str(path)))


VALUE = "id bigint, ts timestamp_ntz, value double"


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def test_late_rows_and_copies_are_dropped(spark, tmp_path):
    put(spark, tmp_path / "in", "a", [(1, at(0), 1.0), (1, at(0), 1.0), (2, at(200), 2.0)], VALUE)
    put(spark, tmp_path / "in", "b", [(4, at(190), 3.0), (2, at(200), 2.0)], VALUE)
    put(spark, tmp_path / "in", "c", [(3, at(10), 5.0), (5, at(1000), 9.0)], VALUE)
    rows = J.first_copies(stream(spark, tmp_path / "in", VALUE), ["id"], "1 hour")
    query = J.start(rows, f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination()
    got = sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # 3 is 190 minutes behind the newest event of the files before, beyond the hour
    assert got == [1, 2, 4, 5]
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped == 1


def test_copies_in_many_tasks_are_dropped(spark, tmp_path):
    rows = [(i % 7 if i % 3 else 0, at(i % 50), 1.0) for i in range(300)]
    for name in "ab":
        spark.createDataFrame(rows, VALUE).repartition(6).write.parquet(f"{tmp_path}/in/{name}")
    stream_rows = spark.readStream.schema(VALUE).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    J.start(J.first_copies(stream_rows, ["id"], "2 hours", salts=4), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(7))


def test_restart_reads_only_new_files(spark, tmp_path):
    schema = "id bigint"
    put(spark, tmp_path / "in", "a", [(1,), (2,)], schema)
    for _ in range(2):
        J.start(stream(spark, tmp_path / "in", schema), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    put(spark, tmp_path / "in", "b", [(3,)], schema)
    J.start(stream(spark, tmp_path / "in", schema), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


def test_unparseable_lines_are_marked(spark):
    lines = spark.createDataFrame([('{"a":1}',), ('{"a":"x"}',), ("nope",), (None,), ("{}",)], "line string")
    got = [(r["unparseable"], r["body"]["a"] if r["body"] else None) for r in J.split_parsed(lines, "line", "a bigint").collect()]
    assert [g[0] for g in got] == [False, True, True, True, False] and got[0][1] == 1


@pytest.mark.parametrize("seed", [0, 1])
def test_streamed_alarms_equal_batch_alarms(spark, tmp_path, seed):
    rng = random.Random(seed)
    rules = [AlarmRule("a", "m", "avg", "5 minutes", ">", 5.0, 2, 3, "missing"),
             AlarmRule("b", "m", "avg", "5 minutes", ">", 5.0, 3, 5, "not_breaching")]
    schema = "alarm string, part int, bucket timestamp_ntz, value double"
    rows = [(rule.name, part, at(5 * i), rng.uniform(0, 10)) for rule in rules for part in (1, 2)
            for i in range(60) if rng.random() < (0.7 if part == 1 else 0.15)]
    # one series stops early; the others go on
    rows += [("a", 3, at(5 * i), 9.0) for i in range(10)]
    # closed windows of one time come together
    for n, start in enumerate(range(0, 60, 13)):
        put(spark, tmp_path / "in", f"{n:02d}", [r for r in rows if at(5 * start) <= r[2] < at(5 * (start + 13))], schema)
    J.watch_alarms(stream(spark, tmp_path / "in", schema), ["part"], rules, "5 minutes", f"{tmp_path}/out",
                   f"{tmp_path}/ck").awaitTermination()
    streamed = J.read_epochs(spark, f"{tmp_path}/out/transitions")
    until = max(r[2] for r in rows)
    batch = A.transitions(A.evaluate(spark.createDataFrame(rows, schema), ["part"], rules, "5 minutes", until), ["part"])
    key = lambda r: (r["alarm"], r["part"], r["bucket"], r["previous"], r["state"])
    assert sorted(map(key, streamed.collect())) == sorted(map(key, batch.collect()))
    stopped = [r for r in streamed.collect() if r["alarm"] == "a" and r["part"] == 3]
    assert max(stopped, key=lambda r: r["bucket"])["state"] == "INSUFFICIENT_DATA"


def test_flush_admits_by_bytes_and_survives_a_repeat(spark, tmp_path):
    def row(i, kind, metric, second):
        return i, kind, T0 + datetime.timedelta(seconds=second), "svc", "h", metric, 1.0, None, None, []

    rows = [row(i, "metric", "query/time", i) for i in range(30)]
    rows += [row(100 + i, "alert", None, 5) for i in range(6)] + [row(200, "other", None, 70), row(201, "metric", None, 3)]
    put(spark, tmp_path / "in", "a", rows, EVENT_SCHEMA)
    for _ in range(2):
        J.flush_datums(
            stream(spark, tmp_path / "in", EVENT_SCHEMA), f"{tmp_path}/out", f"{tmp_path}/ck", EmitterSettings(),
            F.lit(10).cast("bigint"), bound=45, batch_size=3, trigger={"availableNow": True},
        ).awaitTermination()
    every = J.read_epochs(spark, f"{tmp_path}/out/requests").collect()
    sent = [r for r in every if r["queue"] == "metric"]
    # four of the ten datums of every 10 s flush fit into 45 bytes
    assert sorted(r["event_id"] for r in sent) == [0, 1, 2, 3, 10, 11, 12, 13, 20, 21, 22, 23]
    assert {r["event_id"]: r["batch_id"] for r in sent}[13] == 1
    assert J.read_epochs(spark, f"{tmp_path}/out/statsd").count() == 30
    lost = {(r["bucket"].minute, r["counter"].split(".")[1]): r["value"] for r in J.read_epochs(spark, f"{tmp_path}/out/losses").collect()}
    assert len(lost) == 8
    assert {k: v for k, v in lost.items() if v} == {
        (0, "MetricLost"): 18, (0, "AlertLost"): 2, (1, "InvalidLost"): 1, (0, "Fatal"): 1}
    # sent + lost = offered
    assert len(every) + sum(lost.values()) == len(rows)


def test_streams_read_a_file_and_a_folder_of_files(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/table/events.parquet")
    for base in (folder, str(tmp_path / "table")):
        rows = formats.stream_events(spark, f"{base}/events.parquet", events.schema)
        assert J.drain(rows, "whole").count() == events.count()


def test_tail_routes_lines(spark, tmp_path):
    folder = tmp_path / "containers"
    folder.mkdir()
    (folder / "web-1.log").write_text('2024-01-01T00:00:00Z stdout F {"a":1}\nbroken\n')
    (folder / "kube-proxy-1.log").write_text("2024-01-01T00:00:00Z stdout F x\n")
    layout = dataclasses.replace(LAYOUT, containers=str(folder))
    lines = text.stream_lines(spark, str(folder), "*.log", files_per_trigger=1)
    J.route_logs(lines, f"{tmp_path}/out", f"{tmp_path}/ck", layout, F.lit("n1"), {"availableNow": True}).awaitTermination()
    got = J.read_epochs(spark, f"{tmp_path}/out").collect()
    assert [(r["log_processed"], r["stream_prefix"], r["family"]) for r in got] == [({"a": "1"}, "application-n1-", "application")]
    assert formats.BUILT_IN[0] == "parquet"


def test_tail_may_skip_what_is_there(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "old.log").write_text("before\n")
    os.utime(folder / "old.log", (1_700_000_000, 1_700_000_000))
    (folder / "new.log").write_text("after\n")
    since = datetime.datetime(2023, 12, 1, tzinfo=datetime.UTC)
    for moment, want in ((None, ["after", "before"]), (since, ["after"])):
        lines = text.stream_lines(spark, str(folder), "*.log", since=moment).select("value")
        assert sorted(r["value"] for r in J.drain(lines, "tail").collect()) == want


def test_an_epoch_leaves_no_tables_behind(spark, tmp_path):
    rows = [(i, "metric", T0 + datetime.timedelta(seconds=i), "svc", "h", "query/time", 1.0, None, None, []) for i in range(5)]
    put(spark, tmp_path / "in", "a", rows, EVENT_SCHEMA)
    scratch = pathlib.Path(session.scratch_root(spark)) / "metricloom"
    before = {p.name for p in scratch.iterdir()} if scratch.exists() else set()
    J.flush_datums(
        stream(spark, tmp_path / "in", EVENT_SCHEMA), f"{tmp_path}/out", f"{tmp_path}/ck", EmitterSettings(),
        F.lit(10).cast("bigint"), trigger={"availableNow": True}).awaitTermination()
    assert {p.name for p in scratch.iterdir()} == before


def test_a_flush_keeps_no_rows_in_memory(spark, tmp_path, monkeypatch):
    def kept(frame, *_):
        raise AssertionError("a task would read all of what an input file became")

    rows = [(i, "metric", T0 + datetime.timedelta(seconds=i), "svc", "h", "query/time", 1.0, None, None, []) for i in range(5)]
    put(spark, tmp_path / "in", "a", rows, EVENT_SCHEMA)
    monkeypatch.setattr(type(spark.range(1)), "persist", kept)
    J.flush_datums(
        stream(spark, tmp_path / "in", EVENT_SCHEMA), f"{tmp_path}/out", f"{tmp_path}/ck", EmitterSettings(),
        F.lit(10).cast("bigint"), trigger={"availableNow": True}).awaitTermination()
    assert J.read_epochs(spark, f"{tmp_path}/out/requests").count() == 5
