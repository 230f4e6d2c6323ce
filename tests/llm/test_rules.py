import random
import re
from collections import Counter

from metricloom.llm import rules
from tests.llm.support import documents, odd_rows, prose, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often, hit = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            hit |= set(range(i, i + 5))
    return (doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_measures_match_a_plain_version(spark):
    rng = random.Random(1)
    rows = odd_rows()
    for i in range(100, 160):
        few = prose(rng, rng.choice([2, 4, 30]))
        rows.append((i, "".join(rng.choice(few) + rng.choice([" ", " ", "\n", "\n\n", "\t", " # ", "<b> "]) for _ in range(rng.randint(0, 80)))))
    rows += [(200, "a b c d e a b c d e"), (201, "x " * 9 + "y"), (202, "\na\na\n a\n\n"), (203, "é" * 12)]
    got = rules.text_measures(documents(spark, rows, extra=True))
    want = sorted((brute(r[0], r[1]) for r in rows), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))
    assert rows_of(got.select(*COLUMNS)) == want


def test_bins_keep_seven_digits(spark):
    values = [0, 1, 127, 128, 129, 255, 256, 12_345, 10**12]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "value bigint").select(rules.bin_of(rules.F.col("value"))).collect()]
    assert got == [v >> max(0, v.bit_length() - 7) << max(0, v.bit_length() - 7) for v in values]
    assert all(v - b <= v / 64 for v, b in zip(values, got, strict=True))


def groups(seed=2):
    rng = random.Random(seed)
    short, long = prose(rng, 200), ["".join(prose(rng, 4)) for _ in range(200)]
    rows = []
    for i in range(400):
        source = "long" if i % 2 else "short"
        rows.append((i, " ".join(rng.choices(long if i % 2 else short, k=50)), "en", source))
    rows += [(1000, " ".join(rng.choices(long, k=50)), "en", "short"), (1001, " ".join(rng.choices(short, k=50)), "en", "long"),
             (1002, " ".join(f"{w}***" for w in rng.choices(short, k=50)), "en", "short"), (1003, "too few", "en", "short")]
    return rows


def test_thresholds_adapt_to_the_group(spark):
    kept = {r["doc_id"]: r["kept"] for r in rules.judged(documents(spark, groups(), extra=True)).collect()}
    assert not any(kept[i] for i in (1000, 1001, 1002, 1003))
    assert sum(kept[i] for i in range(400)) > 390


def test_sketches_merge(spark):
    docs = documents(spark, groups())
    rows = rules.text_measures(docs)
    halves = [rules.sketches(rows.where(f"doc_id % 2 = {i}")) for i in (0, 1)]
    merged = halves[0].union(halves[1]).groupBy("lang", "source", "measure", "bin").agg(rules.F.sum("n").alias("n"))
    assert rows_of(merged) == rows_of(rules.sketches(rows))


def test_small_groups_take_wider_fences(spark):
    rows = groups() + [(2000, groups()[0][1], "en", "rare"), (2001, groups()[2][1], "xx", None), (2002, groups()[4][1], None, None)]
    kept = {r["doc_id"]: r["kept"] for r in rules.judged(documents(spark, rows)).collect()}
    assert kept[2000] and kept[2001] and kept[2002]


def plain_fences(values, prior):
    """(low, high) of word length and high of symbols for each group, in fractions."""
    from fractions import Fraction

    def share(rows):
        own = Counter(rows)
        return {b: Fraction(n, len(rows)) for b, n in own.items()}

    out = {}
    for measure, (steps, times, lower) in rules.FENCES.items():
        bins = {k: [v >> max(0, v.bit_length() - 7) << max(0, v.bit_length() - 7) for v in vs[measure]] for k, vs in values.items()}
        everything = share([b for bs in bins.values() for b in bs])
        for (lang, source), own in bins.items():
            of_lang = [b for k, bs in bins.items() if k[0] == lang for b in bs]
            wider = {b: (of_lang.count(b) + prior * everything[b]) / (len(of_lang) + prior) for b in everything}
            mixed = {b: own.count(b) + prior * wider[b] for b in everything}
            total = sum(mixed.values())
            reached = lambda p: min(b for b in mixed if sum(w for c, w in mixed.items() if c <= b) * 10 >= p * total)
            q10, q50, q90 = reached(1), reached(5), reached(9)
            excess = int(10 * sum(max(b - q90, 0) * w for b, w in mixed.items()) / total)
            out[lang, source, measure] = (q10 - steps * (q50 - q10) if lower else None, q90 + max(steps * (q90 - q50), times * excess))
    return out


def test_fences_match_a_plain_version_and_have_no_step(spark):
    rng = random.Random(3)
    values = {}
    for key in [("en", "a"), ("en", "b"), ("fr", "a"), (None, "a"), ("fr", None)]:
        n = rng.choice([1, 3, 30, 99, 101])
        values[key] = {m: [rng.choice([0, 0, 0, rng.randrange(9000)]) for _ in range(n)] for m in rules.FENCES}
    bins = spark.createDataFrame(
        [(lang, source, m, v >> max(0, v.bit_length() - 7) << max(0, v.bit_length() - 7)) for (lang, source), vs in values.items()
         for m, own in vs.items() for v in own], "lang string, source string, measure string, bin bigint").groupBy(
        "lang", "source", "measure", "bin").agg(rules.F.count("*").alias("n"))
    want = plain_fences(values, 7)
    for r in rules.fences(bins, 7).collect():
        for m, (_, _, lower) in rules.FENCES.items():
            low, high = want[r["lang"], r["source"], m]
            assert r[f"high_{m}"] == high
            assert not lower or r[f"low_{m}"] == low


def test_fences_of_all_measures_differ_between_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = rules.stored(rules.text_measures(docs).withColumn("base_failed", rules.base_failed()), "measures")
    limits = rules.fences(rules.sketches(rows.where("not base_failed"))).collect()
    assert all(len({r[f"high_{m}"] for r in limits}) > 5 for m in rules.FENCES)


def test_odd_and_empty_tables(spark):
    rows = odd_rows()
    got = rules.judged(documents(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 10)
    assert rules.judged(documents(spark, [])).count() == 0
