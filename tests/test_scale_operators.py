"""Brute-force checks of the operators that split hot groups."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.operators import batching as B
from metricloom.operators import logs as L
from metricloom.operators import prefix
from metricloom.operators.orderstats import Percentile, TrimmedMean, order_stats

STATS = [Percentile("p0", 0.0), Percentile("p50", 0.5), Percentile("p99", 0.99), Percentile("p100", 1.0),
         TrimmedMean("tm99", 99), TrimmedMean("tm50", 50)]


def expected(values):
    values = np.sort(np.array(values, dtype=float))
    out = {name: float(np.quantile(values, q)) for name, q in (("p0", 0), ("p50", .5), ("p99", .99), ("p100", 1))}
    for name, percent in (("tm99", 99), ("tm50", 50)):
        out[name] = float(values[: math.ceil(percent * len(values) / 100)].mean())
    return out


@pytest.mark.parametrize("small_bin", [200_000, 3])
def test_order_stats(spark, small_bin):
    rng = random.Random(7)
    groups = {
        "hot": [rng.gauss(50, 20) for _ in range(3000)],
        "negative": [rng.uniform(-1e6, 10) for _ in range(500)],
        "tight": [1.7e12 + rng.randrange(1000) for _ in range(800)],
        "constant": [4.25] * 400,
        "ties": [float(rng.randrange(5)) for _ in range(700)],
        "single": [3.0],
        "pair": [-1.0, 2.0],
        None: [float(i) for i in range(100)],
        "outlier": [rng.random() for _ in range(300)] + [1e300],
    }
    rows = [(key, v) for key, values in groups.items() for v in values] + [("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in order_stats(df, ["g"], "v", STATS, small_bin).collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert got[key]["n"] == len(values)
        for name, value in expected(values).items():
            assert got[key][name] == pytest.approx(value, rel=1e-9, abs=1e-9), (key, name)


def test_running_matches_plain_scan(spark):
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.1 else rng.choice("aab"), i, rng.randrange(10)) for i in range(1000)]
    df = spark.createDataFrame(rows, "key string, at bigint, v bigint").repartition(6)
    got = prefix.running(df, ["key"], ["at"], prefix.number_block(F.col("at"), 37), {"s": F.col("v")}).collect()
    before = prefix.running(
        df, ["key"], ["at"], prefix.number_block(F.col("at"), 37), {"s": F.col("v")}, inclusive=False).collect()
    sums, want, want_before = {}, {}, {}
    for key, at, v in rows:
        want_before[(key, at)] = sums.get(key, 0)
        sums[key] = sums.get(key, 0) + v
        want[(key, at)] = sums[key]
    assert {(r["key"], r["at"]): r["s"] for r in got} == want
    assert {(r["key"], r["at"]): r["s"] for r in before} == want_before


def test_running_over_two_block_levels(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), i, rng.randrange(10)) for i in range(600)]
    df = spark.createDataFrame(rows, "key string, at bigint, v bigint").repartition(6)
    fine, coarse = prefix.number_block(F.col("at"), 5), lambda b: prefix.number_block(b, 7)
    got = prefix.running(df, ["key"], ["at"], fine, {"s": F.col("v"), "n": F.lit(1)}, coarser=coarse).collect()
    sums, want = {}, {}
    for key, at, v in rows:
        total, count = sums.get(key, (0, 0))
        sums[key] = want[(key, at)] = (total + v, count + 1)
    assert {(r["key"], r["at"]): (r["s"], r["n"]) for r in got} == want


def fold(sizes, bound):
    used, flags = 0, []
    for size in sizes:
        fits = used + size <= bound
        used += size if fits else 0
        flags.append(fits)
    return flags


def admitted(spark, groups, bound, block=10, fold_rows=B.FOLD_ROWS):
    rows = [(key, i, size) for key, sizes in groups.items() for i, size in enumerate(sizes)]
    df = spark.createDataFrame(rows, "key string, item bigint, size bigint").repartition(4)
    done = B.admit(df, ["key"], ["item"], prefix.number_block(F.col("item"), block), bound=bound, fold_rows=fold_rows)
    out = {}
    for r in done.orderBy("key", "item").collect():
        out.setdefault(r["key"], []).append(r["admitted"])
    return out


def test_admission_examples(spark):
    assert admitted(spark, {"q": [12]}, 10) == {"q": [False]}
    assert admitted(spark, {"q": [2, 2, 2, 2, 2]}, 10) == {"q": [True] * 5}
    assert admitted(spark, {"q": [6, 6, 4, 1]}, 10) == {"q": [True, False, True, False]}
    assert admitted(spark, {"q": [0, 11, 10, 0, 1]}, 10) == {"q": [True, False, True, True, False]}


@pytest.mark.parametrize("seed", range(4))
def test_admission_matches_fold(spark, seed):
    rng = random.Random(seed)
    groups = {
        "hot": [rng.choice([0, 1, 2, 3, 7, 50, 90, 400]) for _ in range(600)],
        "big": [rng.randrange(50, 300) for _ in range(80)],
        "oversize": [1000, 5, 2000, 5, 990, 1],
        "fits": [1, 2, 3],
        "small": [1] * 700,
    }
    bound = rng.choice([300, 997, 650])
    want = {key: fold(sizes, bound) for key, sizes in groups.items()}
    assert admitted(spark, groups, bound, rng.choice([1, 8, 64, 10_000]), [0, 20, 100, 1_000][seed]) == want


def test_batches_of_one_hundred(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [("metric", i, start + datetime.timedelta(milliseconds=40 * i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "queue string, event_id bigint, ts timestamp_ntz").repartition(5)
    got = {r["event_id"]: (r["flush"], r["rn"], r["batch_id"]) for r in B.request_batches(df).collect()}
    for _, i, at in rows:
        # 250 datums per 10 s flush
        assert got[i] == (start + datetime.timedelta(seconds=at.second // 10 * 10), i % 250 + 1, i % 250 // 100)


def test_loss_counters_include_empty_periods(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(at, "metric", True), (at, "metric", False), (at, "invalid", False),
            (at + datetime.timedelta(minutes=2), "alert", True), (at + datetime.timedelta(minutes=2), "fatal", False)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, route string, lost boolean")
    got = {(r["bucket"].minute, r["counter"]): r["value"] for r in B.loss_counters(df).collect()}
    assert len(got) == 12
    assert {k for k, v in got.items() if v} == {
        (0, "Emitter.MetricLost"), (0, "Emitter.InvalidLost"), (2, "Emitter.AlertLost"), (2, "Emitter.Fatal")}


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_partial_lines(spark, block):
    rng = random.Random(block)
    rows, want = [], {}
    for stream in ("hot", "cold"):
        parts, number = [], 0
        for i in range(200 if stream == "hot" else 9):
            flag = rng.choice("PPF")
            rows.append((stream, i, flag, f"{i} "))
            parts.append(f"{i} ")
            if flag == "F":
                want[(stream, number)] = ("".join(parts), True)
                parts, number = [], number + 1
        if parts:
            want[(stream, number)] = ("".join(parts), False)
    df = spark.createDataFrame(rows, "stream string, at bigint, logtag string, log string").repartition(4)
    got = L.join_partial_lines(df, ["stream"], "at", prefix.number_block(F.col("at"), block)).collect()
    assert {(r["stream"], r["message_no"]): (r["message"], r["complete"]) for r in got} == want


def test_a_message_without_end_comes_in_pieces(spark):
    rows = [("s", i, "P", f"{i} ") for i in range(95)] + [("t", 0, "P", "a"), ("t", 1, "F", "b")]
    df = spark.createDataFrame(rows, "stream string, at bigint, logtag string, log string").repartition(4)
    got = L.join_partial_lines(df, ["stream"], "at", prefix.number_block(F.col("at"), 8), most_parts=30).orderBy("stream", "first").collect()
    assert "".join(r["message"] for r in got if r["stream"] == "s") == "".join(f"{i} " for i in range(95))
    assert [(r["piece"], r["parts"]) for r in got if r["stream"] == "s"] == [(1, 30), (2, 30), (3, 30), (4, 5)]
    assert [(r["message"], r["piece"], r["complete"]) for r in got if r["stream"] == "t"] == [("ab", 0, True)]


def test_reassembly_follows_the_order_column_alone(spark):
    # times that disagree with the order
    rows = [("s", i, 1000 - i, "F" if i % 4 == 3 else "P", str(i % 10)) for i in range(40)]
    df = spark.createDataFrame(rows, "stream string, at bigint, ts bigint, logtag string, log string").repartition(3)
    got = L.join_partial_lines(df, ["stream"], "at", prefix.number_block(F.col("at"), 5)).orderBy("first").collect()
    assert [r["message"] for r in got] == ["".join(str(j % 10) for j in range(i, i + 4)) for i in range(0, 40, 4)]


def test_an_oversized_item_costs_no_long_fold(spark):
    sizes = [10**9] + [200] * 5000
    assert admitted(spark, {"q": sizes}, 100_000_000, 500, fold_rows=100) == {"q": [False] + [True] * 5000}
