"""Phrase mining against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest

from metricloom.llm import phrases as P
from tests.llm.support import documents, odd_rows, prose


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, top, least):
    """The contract, phrase by phrase."""
    counts, totals = Counter(), Counter()
    for row in rows:
        lang = row[2] if len(row) > 2 and row[2] is not None else "und"
        for piece in re.split("[.,;:!?\n-\r]", lower(row[1] or "")):
            words = tuple(re.findall("[^ \t]+", piece))
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, words[i:i + k]] += 1
    held = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= least}
    gone = set()
    for (lang, words), a in held.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if 100 * a >= 80 * held[lang, words[i:i + k]]:
                    gone.add((lang, words[i:i + k]))
    out = []
    for lang in totals:
        best = []
        for (own, words), a in held.items():
            if own == lang and (own, words) not in gone:
                score, _, left, right = min(
                    (2_000_000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k, counts[lang, words[:k]],
                     counts[lang, words[k:]]) for k in range(1, len(words)))
                best.append((-score, -a, " ".join(words).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def corpus(seed, n, words=12):
    rng = random.Random(seed)
    names = prose(rng, words)
    fixed = [" ".join(rng.choices(names, k=rng.randint(2, 6))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(names) for _ in range(rng.randint(0, 30))]
        text = "".join(p + rng.choice([" ", " ", " ", ", ", ".\n", "  ", "\t"]) for p in parts)
        rows.append((i, text if rng.random() < 0.9 else text.upper(), rng.choice(["en", "fr", None])))
    return rows


@pytest.mark.parametrize(("top", "least"), [(3, 2), (10, 5), (2000, 2)])
def test_phrases_equal_a_plain_count(spark, top, least):
    rows = corpus(top, 80)
    assert found(P.phrases(documents(spark, rows), top, least)) == plain(rows, top, least)


def test_thresholds_are_lowered_until_enough_survive(spark, monkeypatch):
    # pairs inside of phrases of four words score best and go, so the first threshold leaves too few
    parts = [f"{'. '.join([f'a{i} b{i} c{i} d{i}'] * 10)}. {'. '.join([f'a{i}'] * i)}" for i in range(40)]
    rows, rounds = [(i, text, "en") for i, text in enumerate(parts)], []
    lowered = P._thresholds
    monkeypatch.setattr(P, "_thresholds", lambda *a: rounds.append(1) or lowered(*a))
    assert found(P.phrases(documents(spark, rows), 25, 2)) == plain(rows, 25, 2)
    assert len(rounds) > 2


def test_many_ties(spark):
    rows = [(i, " ".join(f"{a}{i}" for a in "xy") + ". " + f"p{i % 7} q{i % 7}", "en") for i in range(60)] * 2
    assert found(P.phrases(documents(spark, rows), 5, 2)) == plain(rows, 5, 2)


def test_odd_tables(spark):
    rows = odd_rows() + [(90, "A\x00b A\x00b\tA\x00b;é É é", None, None)] * 2
    assert found(P.phrases(documents(spark, rows, extra=True), 50, 2)) == plain(rows, 50, 2)
    assert P.phrases(documents(spark, []), 5, 2).count() == 0
    assert P.phrases(documents(spark, [(1, None), (2, "one word")]), 5, 2).count() == 0


def test_small_buffers_and_spans_change_nothing(spark, monkeypatch):
    rows = corpus(4, 60)
    long = ". ".join(r[1] for r in rows)
    rows.append((99, long, "en"))
    monkeypatch.setattr(P, "HELD", 64)
    monkeypatch.setattr(P.S, "SLICE_BYTES", 200)
    assert found(P.phrases(documents(spark, rows), 20, 2)) == plain(rows, 20, 2)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 10 ** 14 + 7, 3 * 10 ** 14, 5 * 10 ** 14 + 1
    row = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    made = row.select(P._floor(P._score(row["a"], row["l"], row["r"]))).first()[0]
    assert made == 2_000_000 * a // (left + right)


def test_a_bound_is_never_below_a_grown_phrase(spark):
    rows = corpus(11, 100)
    counts = {(r[0], r[2]): r for r in plain(rows, 10 ** 6, 2)}
    words = Counter(w for r in rows if r[2] == "en" for w in lower(r[1]).replace(".", " ").replace(",", " ").split())
    for (lang, phrase), r in counts.items():
        if lang == "en":
            assert r[7] <= 2_000_000 * r[3] // (words[phrase.split()[0]] + r[3])
