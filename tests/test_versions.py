"""Overlapping segment versions against a look at every pair."""

import datetime
import random

import pytest

from metricloom.operators import versions as V

T0 = datetime.datetime(2024, 1, 1)
ROW = "id bigint, source string, ts timestamp_ntz, start timestamp_ntz, end timestamp_ntz, version bigint, __key string"


def at(unit, n):
    return T0 + n * unit


def drawn(seed, unit, n=200, spread=300):
    rng = random.Random(seed)
    segments = []
    for _ in range(60):
        low = rng.randrange(spread)
        segments.append((rng.choice(["a", "b", None]), low, low + rng.choice([1, 1, 2, 7, 30, 64, 128, 200]), rng.randrange(12)))
    rows = []
    for i in range(n):
        source, low, high, version = rng.choice(segments)
        ts = at(unit, low) + datetime.timedelta(microseconds=rng.randrange((high - low) * unit // datetime.timedelta(microseconds=1)))
        rows.append((i, source, ts, at(unit, low), at(unit, high), version, "x"))
    return rows


def plain(rows):
    return sorted(r[0] for r in rows if r[2] is not None and r[5] is not None and not any(
        o[1] == r[1] and o[5] is not None and o[5] > r[5] and o[3] <= r[2] < o[4] for o in rows))


@pytest.mark.parametrize("unit", [datetime.timedelta(days=1), datetime.timedelta(minutes=7), datetime.timedelta(microseconds=3)])
def test_rows_show_where_no_newer_version_covers_them(spark, unit):
    rows = drawn(unit.days + 1, unit)
    frame = spark.createDataFrame(rows, ROW)
    got = sorted(r["id"] for r in V.visible_rows(frame, ["source"], "ts", "start", "end", "version").collect())
    assert got == plain(rows) and 0 < len(got) < len(rows)


def test_pieces_are_disjoint_and_newest(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_CUTS", 3)
    unit = datetime.timedelta(hours=1)
    rows = drawn(5, unit)
    pieces = V.newest_pieces(spark.createDataFrame(rows, ROW), ["source"], "start", "end", "version").collect()
    for source in ("a", "b", None):
        own = sorted((p["start"], p["end"], p["version"]) for p in pieces if p["source"] == source)
        assert all(x[1] <= y[0] for x, y in zip(own, own[1:]))
        for n in range(520):
            moment = at(unit, n)
            covering = [r[5] for r in rows if r[1] == source and r[3] <= moment < r[4]]
            held = [v for s, e, v in own if s <= moment < e]
            assert held == ([max(covering)] if covering else [])


def test_one_version_hides_nothing_and_ties_show_both(spark):
    day = datetime.timedelta(days=1)
    rows = [(1, "a", at(day, 2), at(day, 0), at(day, 7), 3, "x"), (2, "a", at(day, 2), at(day, 2), at(day, 3), 3, "x"),
            (3, "b", at(day, 2), at(day, 0), at(day, 9), 1, "x")]
    frame = spark.createDataFrame(rows, ROW)
    assert sorted(r["id"] for r in V.visible_rows(frame, ["source"], "ts", "start", "end", "version").collect()) == [1, 2, 3]


def test_odd_rows(spark):
    day = datetime.timedelta(days=1)
    rows = [(1, "a", None, at(day, 0), at(day, 7), 0, "x"), (2, "a", at(day, 2), at(day, 2), at(day, 2), 9, "x"),
            (3, "a", at(day, 2), at(day, 0), at(day, 9), None, "x"), (4, "a", at(day, 2), at(day, 0), at(day, 9), 1, "x"),
            (4, "a", at(day, 2), at(day, 0), at(day, 9), 1, "x"), (5, "a", at(day, 3), None, at(day, 9), 8, "x")]
    frame = spark.createDataFrame(rows, ROW)
    assert sorted(r["id"] for r in V.visible_rows(frame, ["source"], "ts", "start", "end", "version").collect()) == [4, 4]
    hidden = {(r["start"], r["version"]): (r["rows"], r["shown"], r["overshadowed"]) for r in V.hidden_parts(
        frame, ["source"], "ts", "start", "end", "version").collect()}
    assert hidden[at(day, 0), 1] == (2, 2, False) and hidden[None, 8] == (1, 0, True)
    assert V.visible_rows(frame.limit(0), ["source"], "ts", "start", "end", "version").count() == 0


def test_the_tree_is_joined_by_equality(spark):
    """No plan compares intervals with each other; the tree has at most two nodes a level for an interval."""
    unit = datetime.timedelta(minutes=1)
    frame = spark.createDataFrame(drawn(7, unit), ROW)
    shown = V.visible_rows(frame, ["source"], "ts", "start", "end", "version")
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    from pyspark.sql import functions as F

    for low, high in ((0, 1), (3, 1021), (1, 1024), (511, 513), (0, 1024)):
        nodes = spark.range(1).select(V.tree_nodes(F.lit(low).cast("bigint"), F.lit(high).cast("bigint"), 10).alias("n")).first()["n"]
        covered = sorted(x for n in nodes for x in range(n["node"] << n["level"], (n["node"] + 1) << n["level"]))
        assert covered == list(range(low, high)) and len(nodes) <= 20
