import math
import random
import uuid

import pytest

from metricloom.llm import codes, mixing
from metricloom.llm.queries import tokenizer_definition
from metricloom.session import scratch_path
from tests.llm.support import documents, odd_rows, prose, rows_of


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, open_, target = share * sum(sizes.values()), set(order), {}
    while True:
        level = total - sum(target.values())
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] / w > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] / w for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over


def test_targets_match_resharing(spark):
    rng = random.Random(2)
    for _ in range(3):
        sizes = {rng.choice(["", "x"]) + str(i): rng.choice([0, 1, 10, 1000, 50_000]) for i in range(11)} | {None: 70}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
        for s, t in brute_targets(sizes).items():
            assert got[s] == pytest.approx(t, abs=1e-6)


def mix(spark, n=300, seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join(prose(rng, rng.randint(0, 40))), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]
    return rows, documents(spark, rows, extra=True)


def test_takes_reach_targets(spark):
    rows, docs = mix(spark)
    got = mixing.mixed_sizes(docs).collect()
    assert len(got) == len(rows)
    taken, target = {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    assert rows_of(mixing.mixed_sizes(docs)) == rows_of(mixing.mixed_sizes(docs.repartition(7)))


def test_positions_follow_the_curriculum(spark):
    _, docs = mix(spark, 900)
    got = [r for r in mixing.mixed_sizes(docs).collect() if r["position"] is not None]
    places = [r["position"] for r in got]
    assert places == sorted(places)
    whole = sum(r["taken"] for r in got)
    assert 0 <= places[0] and places[-1] < whole
    # the first source's weight falls from 7.5 to 2.5: more of it stands early
    early = [p for r, p in zip(got, places, strict=True) if r["source"] == "a"]
    assert sum(p < whole / 2 for p in early) > len(early) * 0.6


def test_due_inverts_demand(spark):
    rows = spark.createDataFrame([(float(u), s) for u in (0, 1, 250, 999) for s in (-0.9, -0.5, 0.0, 0.4, 1.0)], "u double, s double")
    for u, s, t in rows.select("u", "s", mixing.due(rows["u"], mixing.F.lit(1000.0), rows["s"])).collect():
        assert 0 <= t <= 1 and math.isclose(1000 * (t + s * (t * t - t)), u, abs_tol=1e-6)


def test_mixed_documents_hold_what_is_taken(spark):
    rows, docs = mix(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len((r["text"] or "").split())
        assert r["n_chars"] == len(r["text"])
    assert words == {r["doc_id"]: r["taken"] for r in mixing.mixed_sizes(docs).collect() if r["taken"]}


def test_token_files_follow_the_curriculum(spark):
    definition, files = tokenizer_definition(), []
    _, docs = mix(spark)
    for schedules in (mixing.SCHEDULES, [(b, a) for a, b in mixing.SCHEDULES]):
        out = mixing.mixed_documents(docs, place="position", schedules=schedules)
        path = scratch_path(spark, "placed-" + uuid.uuid4().hex)
        codes.write_tokens(out, path, definition, order="position")
        files.append([r["doc_id"] for r in sorted(codes.read_documents(spark, path).collect(), key=lambda r: r["start"])])
        assert files[-1] == [r["doc_id"] for r in sorted(out.collect(), key=lambda r: (r["position"], r["doc_id"]))]
    assert files[0] != files[1] and sorted(files[0]) == sorted(files[1])


def test_odd_and_empty_tables(spark):
    rows = odd_rows()
    docs = documents(spark, rows, extra=True)
    got = mixing.mixed_sizes(docs).collect()
    assert len(got) == len(rows)
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(docs).count() > 0
    none = documents(spark, [])
    assert mixing.mixed_sizes(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    blank = documents(spark, [(1, " ", "en", "a"), (2, None, "en", "b")])
    assert [r["taken"] for r in mixing.mixed_sizes(blank).collect()] == [0, 0]
