"""Hard negatives: the index and the whole search against plain ones."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from metricloom.llm import negatives as N


def table(spark, rows, extra=False):
    columns = {
        "vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())),
        "label": pa.array([r[2] for r in rows], pa.int32())}
    if extra:
        for name in ("uid", "vector", "anchor", "positive", "row", "score", "rank", "rb", "ab", "windows"):
            columns[name] = pa.array([1] * len(rows), pa.int32())
    return spark.createDataFrame(pa.table(columns))


def plain(rows):
    """The contract, row by row."""
    held = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        held.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = []
    for i, (a_id, a, a_label) in enumerate(held):
        if a_id is None or a_id % 50:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(a, b, strict=False)), b_id is None, b_id or 0, j) for j, (b_id, b, _) in enumerate(held) if j != i)
        for s, none, b_id, _ in [x for x in scored if held[x[3]][2] == a_label][:5]:
            fits = [x for x in scored if held[x[3]][2] != a_label and -50 * s <= -100 * x[0] <= -95 * s][:3]
            out += [(a_id, None if none else b_id, rank, None if x[1] else x[2], -s, -x[0]) for rank, x in enumerate(fits, 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def vectors(seed, n, width=6, ids=None):
    rng = random.Random(seed)
    return [(ids(rng) if ids else i, [round(rng.uniform(-1, 1), 1) for _ in range(width)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("levels", [3, 5])
def test_a_search_equals_a_plain_one(spark, levels, monkeypatch):
    monkeypatch.setattr(N, "LEVELS", levels)
    rows = vectors(1, 300)
    assert found(N.hard_negatives(table(spark, rows))) == plain(rows)


def test_odd_rows(spark):
    rows = vectors(2, 120, ids=lambda rng: rng.choice([None, 0, 50, 100, 7, 350, 3, 9]))
    rows += rows[:20]
    rows += [(50, None, 1), (50, [1.0, None], 1), (50, [float("nan")] * 6, 1), (50, [float("inf")] * 6, 1), (100, [0.5] * 6, None),
             (150, [], 1), (200, [0.25, 0.5], 2), (250, [0.1] * 9, -4), (300, [0.0] * 6, 0), (350, [-0.5] * 6, 2147483647)]
    assert found(N.hard_negatives(table(spark, rows, extra=True))) == plain(rows)
    assert N.hard_negatives(table(spark, [])).count() == 0


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    rows = vectors(3, 200)
    monkeypatch.setattr(N, "ROW_BLOCK", 17)
    monkeypatch.setattr(N, "ANCHOR_BLOCK", 2)
    assert found(N.hard_negatives(table(spark, rows))) == plain(rows)


def test_large_values(spark):
    rows = [(i, [(-1) ** i * 3e6 + i, 2.5e6 - i, 1.0], i % 2) for i in range(60)] + [(50, [3e38] * 3, 1)]
    assert found(N.hard_negatives(table(spark, rows))) == plain(rows[:-1])


def test_the_index_loses_no_pair_and_leaves_dimensions_out():
    rng = np.random.default_rng(4)
    # few strong dimensions, so that the weak ones can be left out
    spread = np.array([200] * 4 + [6] * 28)
    rows = (rng.normal(0, 1, (500, 32)) * spread).astype(np.int64)
    anchors = (rng.normal(0, 1, (40, 32)) * spread).astype(np.int64)
    scores = anchors @ rows.T
    for threshold in (0, 20_000, 120_000, 250_000):
        index = N.Index(rows, anchors, threshold)
        a, r = index.candidates(0, 40, np.full(40, float(threshold)))
        assert {*zip(*np.nonzero(scores >= threshold), strict=True)} <= {*zip(a.tolist(), r.tolist(), strict=True)}
        if threshold >= 120_000:
            assert index.lengths.sum() < rows.size / 2 and len(a) < rows.shape[0] * 40 / 4


def test_the_window_is_the_best_below_its_top(spark):
    anchor = (50, [1.0, 0.0], 1)
    rows = [anchor, (1, [1.0, 0.0], 1)] + [(i, [0.5 + 0.05 * (i - 20), 0.0], 2) for i in range(20, 32) if i % 7]
    scores = [r[5] for r in found(N.hard_negatives(table(spark, rows)))]
    assert sorted(scores, reverse=True) == sorted((r[5] for r in plain(rows)), reverse=True)
    assert len(scores) == 3 and max(scores) <= 0.95 * 256 * 256
