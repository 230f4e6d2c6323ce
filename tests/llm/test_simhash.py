import random

import pytest
import xxhash

from metricloom.llm import simhash
from metricloom.llm.components import components
from tests.llm.support import documents, odd_rows, prose, rows_of


def plain_fingerprint(text, shingle=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    ones = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_components(rows):
    """rows of (doc_id, fp); the smallest reachable id of each."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f, least.get(find(f))) for d, f in rows]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def test_fingerprint_of_odd_texts():
    for text in (None, "", " \n", "a", "A b", "a b c", "É é A", "x " * 500, "word" * 3000, " ".join(prose(random.Random(1), 700))):
        assert simhash.fingerprint(text) == signed(plain_fingerprint(text))


@pytest.mark.parametrize("segment_bits", [2, 4, 8])
def test_links_match_brute_force(spark, segment_bits):
    rng = random.Random(segment_bits)
    fps = {0, -1, 1, -2}
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(8):
            fps.add(signed(f))
            for _ in range(rng.randint(0, 4)):
                f ^= 1 << rng.randrange(64)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    for most in (0, 2, 3):
        got = {tuple(sorted(r)) for r in simhash.links(nodes, most, segment_bits).collect()}
        want = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= most}
        assert got == want
    with pytest.raises(ValueError):
        simhash.links(nodes, 4)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    rows = odd_rows()
    for i in range(20, 60):
        w = prose(rng, 120)
        rows.append((i, " ".join(w)))
        for j in range(rng.randint(0, 3)):
            w = [*w[:-1], rng.choice(w)]
            rows.append((1000 - i * 4 - j, " ".join(w)))
    found = simhash.near_duplicates(documents(spark, rows, extra=True))
    want = brute_components([(r[0], signed(plain_fingerprint(r[1]))) for r in rows])
    assert ordered(tuple(r) for r in found.collect()) == ordered(want)
    assert any(d != c for d, _, c in want if d is not None and d > 100)


def test_one_of_each(spark):
    rows = odd_rows()
    docs = documents(spark, rows, extra=True)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = rows_of(kept.select("doc_id", "text"))
    # the texts without words, the copies of one text, two texts of one id, and four others
    assert len(got) == 8
    assert (4, rows[3][1]) in got and got.count((4, rows[3][1])) == 1
    assert all(d is not None for d, _ in got)


def test_only_null_ids(spark):
    docs = documents(spark, [(None, "same words here"), (None, "same words here"), (None, "others stand over there")])
    assert [r[2] for r in rows_of(simhash.near_duplicates(docs))] == [None] * 3
    assert simhash.one_of_each(docs).count() == 2


def test_empty_table(spark):
    docs = documents(spark, [])
    assert simhash.near_duplicates(docs).count() == 0 and simhash.one_of_each(docs).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(200, 400)] + [(1, i) for i in range(500, 900)] + [(7, 7), (None, 3), (5, 4), (4, 5)]
    got = dict(rows_of(components(spark.createDataFrame(pairs, "x bigint, y bigint"))))
    want = {i: 200 for i in range(201, 401)} | {i: 1 for i in range(500, 900)} | {5: 4}
    assert {k: v for k, v in got.items() if k != v} == want
    assert components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0
