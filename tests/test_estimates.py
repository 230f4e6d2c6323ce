"""Sketches on more items than they hold exactly: every estimate within the error that it promises."""

import random

from pyspark.sql import functions as F

from metricloom.operators import estimates as E

RANKS = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


def test_merged_quantiles_keep_their_error(spark):
    rng = random.Random(1)
    rows = [(k, i % 30, rng.lognormvariate(0, 3) if k == "x" else float(rng.randrange(500))) for k in "xy" for i in range(60_000)]
    rows += [("x", 0, None), ("x", 1, float("nan"))]
    frame = spark.createDataFrame(rows, "k string, day int, v double")
    merged = E.merge_quantiles(E.quantile_sketches(frame, ["k", "day"], "v"), ["k"])
    found = E.quantile_estimates(merged, ["k"], RANKS).collect()
    assert len(found) == 2 * len(RANKS) and {r["n"] for r in found} == {60_000}
    values = {k: sorted(r[2] for r in rows if r[0] == k and r[2] is not None and r[2] == r[2]) for k in "xy"}
    for r in found:
        low = sum(v < r["estimate"] for v in values[r["k"]]) / 60_000
        high = sum(v <= r["estimate"] for v in values[r["k"]]) / 60_000
        assert low - 2 * E.rank_error() <= r["rank"] <= high + 2 * E.rank_error()
    # they are estimates: not every one is the very value at its rank
    assert any(r["estimate"] != values[r["k"]][int(r["rank"] * 59_999)] for r in found)


def test_true_ranks_equal_a_plain_count(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), float(rng.randrange(20))) for _ in range(500)]
    guesses = [(k, r, float(rng.randrange(22) - 1)) for k in "ab" for r in (0.1, 0.5, 0.9)]
    estimates = spark.createDataFrame(guesses, "k string, rank double, estimate double")
    got = {(r["k"], r["rank"]): (round(r["low"], 9), round(r["high"], 9)) for r in E.true_ranks(
        spark.createDataFrame(rows, "k string, v double"), ["k"], "v", estimates).collect()}
    for k, rank, guess in guesses:
        own = [v for key, v in rows if key == k]
        assert got[k, rank] == (round(sum(v < guess for v in own) / len(own), 9), round(sum(v <= guess for v in own) / len(own), 9))


def test_frequent_items_keep_their_error(spark):
    rng = random.Random(3)
    items = [rng.randrange(10) if rng.random() < 0.5 else 100 + rng.randrange(30_000) for _ in range(60_000)]
    frame = spark.createDataFrame([(i % 12, x) for i, x in enumerate(items)], "day int, item bigint").withColumn("k", F.lit("a"))
    merged = E.merge_frequent(E.frequent_sketches(frame, ["k", "day"], "item", 200), ["k"], 200)
    found = E.frequent_items(merged, ["k"], 10).collect()
    error = spark.range(1).select(E.frequency_error(F.lit(len(items)), 200)).first()[0]
    assert {r["item"] for r in found} == set(range(10))
    assert all(abs(r["estimate"] - items.count(r["item"])) <= error for r in found)


def test_empty_tables(spark):
    frame = spark.createDataFrame([], "k string, day int, v double, item bigint")
    assert E.quantile_estimates(E.merge_quantiles(E.quantile_sketches(frame, ["k", "day"], "v"), ["k"]), ["k"], RANKS).count() == 0
    assert E.frequent_items(E.merge_frequent(E.frequent_sketches(frame, ["k", "day"], "item"), ["k"]), ["k"], 3).count() == 0
