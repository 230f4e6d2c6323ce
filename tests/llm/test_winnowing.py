import random
import re

import pytest
from pyspark.sql import functions as F

from metricloom.llm import winnowing
from tests.llm.support import documents, items, odd_rows, prose, rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower().decode())


def brute(docs, bench):
    windows = {}
    for item, text in bench:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in range(1, 11):
            for i in range(len(w) - n + 1):
                named = windows.get(tuple(w[i:i + n]))
                if named:
                    hit |= set(range(i, i + n))
                    found |= named
        out.append((doc_id, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return sorted(out, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def run(docs, bench):
    found = winnowing.contamination(docs, bench).select("doc_id", "n_words", "n_hit", "items")
    made = [(r[0], r[1], r[2], tuple(r[3])) for r in found.collect()]
    return sorted(made, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    few = ["aa", "bb", "cc"] if seed == 2 else prose(rng, 400)
    bench = [(i, " ".join(rng.choices(few, k=rng.choice([0, 1, 4, 9, 10, 11, 25, 40])))) for i in range(25)]
    bench += [(100, None), (101, "?!"), (102, bench[3][1]), (103, "Two Words")]
    docs = []
    for i in range(60):
        parts = rng.choices(few, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            w = words(rng.choice(bench)[1])
            a = rng.randint(0, max(0, len(w) - 1))
            at = rng.randint(0, len(parts))
            parts[at:at] = w[a:a + rng.choice([5, 9, 10, 12, 40])]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(parts)))
    docs += [(200, "say TWO-words now"), (201, "two")]
    want = brute(docs, bench)
    assert run(documents(spark, docs), items(spark, bench)) == want
    assert any(r[2] for r in want)


def test_odd_tables(spark):
    rows = odd_rows()
    bench = [(1, " ".join(rows[3][1].split()[20:35])), (2, None), (3, ""), (None, rows[3][1])]
    docs = documents(spark, rows, extra=True)
    assert run(docs, items(spark, bench)) == brute([r[:2] for r in rows], bench)
    kept = winnowing.clean(docs, items(spark, bench))
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) - 4


def test_empty_tables(spark):
    docs, bench = documents(spark, []), items(spark, [])
    assert winnowing.contamination(docs, items(spark, [(1, "a b")])).count() == 0
    assert rows_of(winnowing.contamination(documents(spark, [(1, "a b")]), bench).select("n_words", "n_hit")) == [(2, 0)]
    assert winnowing.clean(documents(spark, [(1, "a b")]), bench).count() == 1


def test_hot_passage_and_copies(spark):
    passage = " ".join(prose(random.Random(9), 30))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(passage + " "), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).otherwise("x")).alias("text"))
    found = winnowing.contamination(docs, items(spark, [(1, passage), (2, passage)]))
    assert found.where("n_hit = 30 and size(items) = 2").count() == 3000
