"""Streams with carried state against one pass over all rows, restarted in the middle."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from metricloom import session
from metricloom.operators import health as H
from metricloom.operators import logs as L
from metricloom.operators.olap import query_context
from metricloom.operators.prefix import number_block
from metricloom.streaming import carried as C
from metricloom.streaming import jobs as J

T0 = datetime.datetime(2024, 1, 1)
LINE = "n bigint, file string, ts timestamp_ntz, logtag string, log string"
ITEM = "id bigint, queue string, ts timestamp_ntz, size bigint"
ONCE = {"availableNow": True}


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def fed(spark, path, schema, parts, run):
    """Write a part, run the job to its end, and so on: every part is a micro-batch after a restart."""
    spark.createDataFrame([], schema).write.parquet(f"{path}/in/none")
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/in/{i}")
        run(rows).awaitTermination()


def messages(spark, path, parts, **settings):
    fed(spark, path, LINE, parts, lambda rows: C.join_messages(
        rows, f"{path}/out", f"{path}/checkpoint", ["file"], "n", "ts", number_block(F.col("n"), 4), trigger=ONCE, **settings))
    return sorted((r["file"], r["first"], r["message"], r["parts"], r["complete"], r["piece"])
                  for r in J.read_epochs(spark, f"{path}/out/messages").collect())


def test_a_message_over_three_batches_comes_once(spark, tmp_path):
    parts = [[(1, "f", at(1), "P", "a"), (2, "g", at(1), "F", "x")], [(3, "f", at(2), "P", "b")],
             [(4, "f", at(3), "F", "c"), (5, "f", at(4), "P", "d"), (6, "g", at(4), "F", "y")]]
    assert messages(spark, tmp_path, parts) == [("f", 1, "abc", 3, True, 0), ("g", 2, "x", 1, True, 0), ("g", 6, "y", 1, True, 0)]
    waiting = spark.read.parquet(f"{tmp_path}/out/tail").where("epoch = 2").collect()
    assert [(r["n"], r["log"]) for r in waiting] == [(5, "d")]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_gives_what_one_batch_gives(spark, tmp_path, seed):
    rng = random.Random(seed)
    lines = [(i, rng.choice("fgh"), at(i), rng.choice("PPF"), f"{i},") for i in range(80)]
    cuts = sorted(rng.sample(range(1, 80), 3))
    parts = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, 80], strict=True)]
    whole = L.join_partial_lines(spark.createDataFrame(lines, LINE), ["file"], "n", number_block(F.col("n"), 4))
    expected = sorted((r["file"], r["first"], r["message"], r["parts"], True, 0) for r in whole.where("complete").collect())
    assert messages(spark, tmp_path, parts, hold="1 day") == expected


def test_what_is_never_closed_comes_after_a_while(spark, tmp_path):
    parts = [[(1, "f", at(1), "P", "a")], [(2, "g", at(30), "F", "x")], [(3, "f", at(31), "F", "b")]]
    assert messages(spark, tmp_path, parts, hold="20 seconds") == [
        ("f", 1, "a", 1, False, 0), ("f", 3, "b", 1, True, 0), ("g", 2, "x", 1, True, 0)]


def test_no_key_carries_more_than_its_bound(spark, tmp_path):
    parts = [[(i + 10 * b, "f", at(i), "P", str(i)) for i in range(10)] for b in range(3)]
    got = messages(spark, tmp_path, parts, hold="1 day", most_parts=4)
    assert sum(r[3] for r in got) + spark.read.parquet(f"{tmp_path}/out/tail").where("epoch = 2").count() == 30
    assert all(r[3] <= 4 and not r[4] for r in got)


def test_late_rows_are_counted_and_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "q", at(i * 60 - rng.choice([0, 0, 0, 5000, 9000])), i // 40) for i in range(160)] + [(999, "q", None, 2)]
    schema = "id bigint, queue string, ts timestamp_ntz, part bigint"
    fed(spark, tmp_path, schema, [[r for r in rows if r[3] == p] for p in range(4)], lambda stream: C.split_late(
        stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "ts", "1 hour", "1 hour", ONCE))
    whole = H.late_rows(spark.createDataFrame(rows, schema), "ts", "part", 3_600_000_000)
    late = sorted(r["id"] for r in whole.where("thrown_away").collect())
    assert sorted(r["id"] for r in J.read_epochs(spark, f"{tmp_path}/out/late").collect()) == late and late
    counts = J.read_epochs(spark, f"{tmp_path}/out/counts").agg(F.sum("late"), F.sum("punctual")).first()
    assert tuple(counts) == (len(late), 161 - len(late))
    assert J.read_epochs(spark, f"{tmp_path}/out/punctual").count() == 161 - len(late)


def plain_queue(parts, bound, drained):
    waiting, sent, lost = {}, [], []
    for turn, part in enumerate(parts):
        for item in sorted(part, key=lambda r: (r[2], r[0])):
            held = waiting.setdefault(item[1], [])
            if sum(r[3] for r in held) + item[3] <= bound:
                held.append(item)
            else:
                lost.append((turn, item[0]))
        for queue, held in waiting.items():
            sent += [(turn, r[0]) for r in held[:drained]]
            waiting[queue] = held[drained:]
    return sorted(sent), sorted(lost), sorted(r[0] for held in waiting.values() for r in held)


@pytest.mark.parametrize("seed", [5, 6])
def test_a_queue_lives_across_turns(spark, tmp_path, seed):
    rng = random.Random(seed)
    parts, n = [], 0
    for turn in range(4):
        part = []
        for _ in range(rng.randint(5, 40)):
            part.append((n, rng.choice("ab"), at(1000 * turn + n), rng.choice([0, 1, 5, 30, 90])))
            n += 1
        parts.append(part)
    fed(spark, tmp_path, ITEM, parts, lambda rows: C.bounded_queue(
        rows, f"{tmp_path}/out", f"{tmp_path}/checkpoint", ["queue"], ["ts", "id"], F.window("ts", "10 seconds")["start"], "size",
        200, 3, ONCE))
    sent, lost, waiting = plain_queue(parts, 200, 3)
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    assert sorted((r["epoch"], r["id"]) for r in read("sent").collect()) == sent
    assert sorted((r["epoch"], r["id"]) for r in read("lost").collect()) == lost
    assert sorted(r["id"] for r in read("queue").where("epoch = 3").collect()) == waiting
    # a queue that began empty at each turn would have taken more
    alone = [plain_queue([part], 200, 3)[1] for part in parts]
    assert len(lost) > sum(map(len, alone))


def test_a_topic_is_read_once_from_the_offsets_on(spark, tmp_path):
    record = "partition int, offset bigint, value string"
    parts = [[(0, 0, "a"), (0, 1, "b"), (1, 5, "x"), (1, 6, "y"), (0, 1, "b")], [(0, 1, "b"), (0, 2, "c"), (1, 7, "z"), (2, 9, "n")],
             [(1, 6, "y"), (2, 9, "n"), (None, 1, "-"), (2, None, "-"), (2, 12, "m")]]
    fed(spark, tmp_path, record, parts, lambda rows: C.consume_topic(
        rows, f"{tmp_path}/out", f"{tmp_path}/checkpoint", {1: 6}, trigger=ONCE))
    got = sorted((r["partition"], r["offset"], r["value"]) for r in J.read_epochs(spark, f"{tmp_path}/out/records").collect())
    assert got == [(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (1, 6, "y"), (1, 7, "z"), (2, 9, "n"), (2, 12, "m")]
    progress = spark.read.parquet(f"{tmp_path}/out/progress").where("epoch = 2").collect()
    assert {r["partition"]: r["next"] for r in progress} == {0: 3, 1: 8, 2: 13}


def test_unclosed_messages_meet_the_lines_where_these_lie(spark):
    late = F.lit(at(300)).cast("timestamp_ntz")
    rows = session.stored(spark.range(20_000).select(
        (F.col("id") % 50).alias("k"), "id", F.when(F.col("id") < 19_975, F.lit(T0)).otherwise(F.lit(at(300))).cast("timestamp_ntz").alias("ts")), "lines")
    messages = session.stored(rows.select("k", F.col("id").alias("first"), (F.col("id") < 19_950).alias("complete"), F.md5(
        F.col("id").cast("string")).alias("message")), "messages")
    with query_context(spark, spark__sql__autoBroadcastJoinThreshold=50_000):
        waiting = C._begun_since(rows, messages.where("not complete"), ["k"], "id", "ts", late)
        plan = waiting._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        assert sorted(tuple(r) for r in waiting.collect()) == [(i % 50, i) for i in range(19_975, 20_000)]
