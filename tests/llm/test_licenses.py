import random
import re

from pyspark.sql import functions as F

from metricloom.llm import licenses
from tests.llm.support import documents, odd_rows, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower().decode())


def brute(text, template):
    """The largest share of the template's shingles in any stretch of the class's window length."""
    t = words(template)
    k = min(5, len(t))
    wanted = {tuple(t[i:i + k]) for i in range(len(t) - k + 1)}
    size = licenses._class(len(wanted))
    w = words(text)
    shingles = [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]
    return max((len(wanted & set(shingles[i:i + 2 * size])) / len(wanted) for i in range(0, max(1, len(shingles)), size)), default=0)


def rows(seed=1):
    rng = random.Random(seed)
    made = [(i, t) for i, (t, *_) in enumerate([(r[1],) for r in odd_rows()], 1000)]
    for i in range(120):
        parts = prose(rng, rng.randint(0, 200))
        for _ in range(rng.randint(0, 2)):
            t = words(rng.choice(licenses.TEMPLATES)[1])
            if rng.random() < 0.5:
                t[rng.randrange(len(t))] = "changed"
            at = rng.randint(0, len(parts))
            parts[at:at] = t
        made.append((i, rng.choice([" ", "\n", ", "]).join(parts)))
    return made


def test_matches_brute_force(spark):
    made = rows()
    got = {(r["doc_id"], r["license"]): round(r["containment"], 9) for r in licenses.licenses(documents(spark, made, extra=True)).collect()}
    want = {(i, n): round(c, 9) for i, text in made for n, t in licenses.TEMPLATES if (c := brute(text, t)) >= 0.8}
    assert got == want and len(want) > 80


def test_bands_meet_their_bound():
    for size in (1, 2, 4, 8, 64):
        least = licenses.least_overlap(size)
        assert 0.15 < least <= 1 and (1 - least) ** licenses.bands(size) <= licenses.MISS


def test_place_and_repeats(spark):
    text = "one two three. Released under the MIT License. four"
    got = licenses.licenses(documents(spark, [(1, text), (1, text), (2, text), (None, text), (None, "All rights reserved")])).collect()
    assert sorted((r["doc_id"] or 0, r["license"]) for r in got) == [(0, "All rights reserved"), (0, "MIT"), (1, "MIT"), (2, "MIT")]
    assert all(r["first_word"] in (2, 3) for r in got if r["license"] == "MIT")


def test_own_templates_and_empty_tables(spark):
    docs = documents(spark, [(1, "a b c d e f g"), (2, "x")])
    got = licenses.licenses(docs, [("own", "B c d e f"), ("none", "?!"), ("empty", "")]).collect()
    assert [(r["doc_id"], r["license"]) for r in got] == [(1, "own")]
    assert licenses.licenses(documents(spark, [])).count() == 0


def test_a_line_in_every_document(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Released under the MIT License. "), F.col("id").cast("string")).alias("text"))
    assert licenses.licenses(docs).count() == 4000
