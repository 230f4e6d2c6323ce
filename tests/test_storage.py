"""Stored tables: their files, pruning as the plan and the scan's own counters show it, bitmaps, clustering."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from metricloom.operators import storage as S

T0 = datetime.datetime(2024, 1, 1)
ROW = "id bigint, ts timestamp_ntz, kind string, day_no bigint"


@pytest.fixture(scope="module")
def days(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(i, T0 + datetime.timedelta(minutes=rng.randrange(20 * 1440)), rng.choice("ab"), None) for i in range(3000)]
    path = str(tmp_path_factory.mktemp("days") / "table")
    S.write_days(spark.createDataFrame(rows, ROW), path, "ts", rows_per_file=100)
    return path, rows


def scanned_files(df):
    """The number of files that the scans of an executed plan have read."""
    df.collect()

    def leaves(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return leaves(plan.executedPlan())
        if "QueryStage" in name:
            return leaves(plan.plan())
        children = plan.children()
        found = [leaf for i in range(children.size()) for leaf in leaves(children.apply(i))]
        return found or [plan]

    total = 0
    for leaf in leaves(df._jdf.queryExecution().executedPlan()):
        metric = leaf.metrics().get("numFiles")
        total += metric.get().value() if metric.isDefined() and "day" in leaf.toString() else 0
    return total


def test_the_segment_table_tells_what_the_files_hold(spark, days):
    path, rows = days
    found = {r["day"]: r for r in S.segment_table(spark, path, "ts", ["day"]).collect()}
    for day in {r[1].date() for r in rows}:
        own = [r[1] for r in rows if r[1].date() == day]
        got = found[day]
        assert (got["rows"], got["first"], got["last"], got["complete"]) == (len(own), min(own), max(own), True)
        assert got["files"] >= len(own) // 100 and got["bytes"] > 0
    assert len(found) == 20


def test_an_interval_opens_its_days_alone(spark, days):
    path, rows = days
    table = spark.read.parquet(path)
    chosen = S.in_days(table, "ts", "2024-01-04 12:00:00", "2024-01-06 00:00:00")
    # a scan counts its files when a plan runs for the first time
    opened = scanned_files(chosen)
    low, high = datetime.datetime(2024, 1, 4, 12), datetime.datetime(2024, 1, 6)
    assert sorted(r["id"] for r in chosen.collect()) == sorted(r[0] for r in rows if low <= r[1] < high)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(ts)" in plan
    files = table.select("_metadata.file_path").distinct().count()
    assert 0 < opened <= files / 5


def test_a_joined_table_chooses_the_days(spark, days, tmp_path):
    path, rows = days
    dimension = spark.createDataFrame([(T0.date() + datetime.timedelta(days=i), i) for i in range(20)], "day date, number bigint")
    dimension.write.parquet(f"{tmp_path}/dimension")
    star = spark.read.parquet(path).join(spark.read.parquet(f"{tmp_path}/dimension").where("number % 10 = 3"), "day")
    plan = star._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    opened = scanned_files(star)
    assert sorted(r["id"] for r in star.collect()) == sorted(r[0] for r in rows if (r[1].date() - T0.date()).days % 10 == 3)
    files = spark.read.parquet(path).select("_metadata.file_path").distinct().count()
    assert 0 < opened < files / 2


def test_bitmaps_add_up_exactly(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0, 1, 5, 32768, 32769, 10 ** 12, rng.randrange(90_000)]), T0 + datetime.timedelta(hours=rng.randrange(100)),
             rng.choice("ab"), None) for _ in range(2000)] + [(None, T0, "a", None)]
    held = S.bitmap_rollup(spark.createDataFrame(rows, ROW), "ts", "hour", ["kind"], "id")
    for granularity, cut in (("hour", 13), ("day", 10)):
        expected = {}
        for number, ts, kind, _ in rows:
            if number is not None:
                expected.setdefault((str(ts)[:cut], kind), set()).add(number)
        got = {(str(r["time"])[:cut], r["kind"]): r["numbers"] for r in S.distinct_counts(held, granularity, ["kind"]).collect()}
        assert got == {k: len(v) for k, v in expected.items()}
    assert {r["numbers"] for r in S.distinct_counts(held, "day", []).agg(F.max("numbers").alias("numbers")).collect()} == {
        max(len({r[0] for r in rows if r[0] is not None and r[1].day == d}) for d in range(1, 6))}


def test_clustered_files_are_opened_seldom(spark, tmp_path):
    rng = random.Random(3)
    # a third of the rows have one value of a
    rows = [(i, 500 if i % 3 == 0 else rng.randrange(1000), rng.random() ** 3 * 100, T0) for i in range(8000)]
    frame = spark.createDataFrame(rows, "id bigint, a bigint, b double, ts timestamp_ntz")
    frame.repartition(32).write.parquet(f"{tmp_path}/dealt")
    S.cluster(frame, f"{tmp_path}/clustered", ["a", "b"], 32)
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/clustered").collect()) == list(range(8000))
    ranges = {"a": (100, 150), "b": (2.0, 4.0)}
    opened = [S.files_to_open(S.segment_files(spark, f"{tmp_path}/{n}", ["a", "b"], []), ranges).count() for n in ("dealt", "clustered")]
    assert opened[0] == 32 and opened[1] <= 6
    sizes = [r["rows"] for r in S.segment_files(spark, f"{tmp_path}/clustered", ["a"], []).collect()]
    assert max(sizes) < 8 * 8000 / 32


def test_interleaving_takes_bits_in_turns(spark):
    row = spark.range(1).select(S.interleaved([F.lit(0b101), F.lit(0b011)], 3).alias("k"), S.part_of(F.lit(None).cast("double"), [1.0]).alias("n"))
    assert tuple(row.first()) == (0b100111, 0)
