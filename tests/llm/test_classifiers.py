import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from metricloom.llm import chargrams, language, resampling, toxicity
from tests.llm.support import documents, labels, odd_rows, prose, rows_of

INSULTS = ["scoundrel", "nitwit", "blockhead", "halfwit"]


def toxic_rows(n=500, seed=1):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        w = prose(rng, rng.randint(10, 120))
        bad = rng.random() < 0.3
        if bad:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(INSULTS)
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(bad)))
    return rows, marks


def test_gram_places_belong_to_their_rows():
    chars = chargrams.characters(pa.array(["ab", None, "", "c d", "Éx!"], pa.string()))
    for n, expected in ((1, [2, 0, 0, 2, 2]), (2, [3, 0, 0, 4, 3]), (3, [2, 0, 0, 2, 2])):
        [(bucket, counts)] = chargrams.grams(chars, (n,), 12)
        assert chargrams.row_sums(chars, counts.astype(float)).tolist() == expected, n
        assert bucket.min() >= 0 and bucket.max() < 1 << 12


def test_toxicity_finds_held_out_and_misspelt_words(spark):
    rows, marks = toxic_rows()
    docs = documents(spark, rows, extra=True)
    got = {r["doc_id"]: r for r in toxicity.scores(docs, labels(spark, marks)).collect()}
    held = [(i, t) for i, _, t in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == t for i, t in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    rng = random.Random(3)
    fresh = documents(spark, rows + [(10_000, " ".join(prose(rng, 30) + ["scoundrell", "nitwitt"] + prose(rng, 30))), (10_001, " ".join(prose(rng, 60)))])
    again = {r["doc_id"]: r["score"] for r in toxicity.scores(fresh, labels(spark, marks)).where("doc_id >= 10000").collect()}
    assert again[10_000] > again[10_001]


def test_long_clean_documents_stay_clean(spark):
    rows, marks = toxic_rows()
    rng = random.Random(9)
    rows += [(1000 + i, " ".join(prose(rng, 6_000))) for i in range(60)]
    marks += [(1000 + i, 1, 0) for i in range(60)]
    taken = toxicity.examples(documents(spark, rows), labels(spark, marks))
    assert sum(len(t) > 20_000 for t in taken["text"].to_pylist()) > 30
    assert toxicity.examples(documents(spark, rows), labels(spark, marks), most=60_000)["toxic"].to_pylist().count(0) < 150
    got = {r["doc_id"]: r for r in toxicity.scores(documents(spark, rows), labels(spark, marks)).collect()}
    held = [i for i, _, t in marks if zlib.crc32(str(i).encode()) % 5 == 0 and not t]
    long = [got[i]["predicted"] for i in held if i >= 1000]
    assert len(long) > 5 and sum(long) == 0
    assert np.mean([got[i]["predicted"] for i in held]) < 0.05


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, marks = toxic_rows(200)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in marks]
    docs = documents(spark, rows)
    assert rows_of(toxicity.scores(docs, labels(spark, marks))) == rows_of(toxicity.scores(docs, labels(spark, turned)))


def test_toxicity_of_odd_and_empty_tables(spark):
    rows = odd_rows()
    docs = documents(spark, rows, extra=True)
    _, marks = toxic_rows(10)
    for given in (marks + [(None, 1, 1), (4, None, None), (5, 1, 0), (5, 1, 1)], []):
        got = toxicity.scores(docs, labels(spark, given)).collect()
        assert len(got) == len(rows)
        assert all(r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3, 8))
    assert toxicity.clean(docs, labels(spark, [])).columns == docs.columns
    assert toxicity.scores(documents(spark, []), labels(spark, marks)).count() == 0


def sentences(lang, rng, n):
    words = {"en": "the and of is house water green quickly", "de": "der und von ist haus wasser grün schnell", "fr": "le et de est maison eau vert vite"}[lang].split()
    return " ".join(rng.choices(words, k=n))


def test_language_of_held_out_rows(spark):
    rng = random.Random(4)
    rows = [(i, sentences(lang := rng.choice(["en", "de", "fr"]), rng, rng.randint(3, 30)), lang) for i in range(300)]
    got = {r["doc_id"]: r for r in language.predictions(documents(spark, rows, extra=True)).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.97
    swapped = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    assert rows_of(language.predictions(documents(spark, swapped))) == rows_of(language.predictions(documents(spark, rows)))


def test_languages_beyond_a_block_are_predicted(spark):
    rng = random.Random(10)
    rows = [(i, sentences(lang := ["en", "en", "de", "de", "fr"][i % 5], rng, 20), lang) for i in range(200)]
    docs = documents(spark, rows)
    got = rows_of(language.predictions(docs, languages=2))
    whole = rows_of(language.predictions(docs))
    assert {r[1] for r in got} == {"en", "de", "fr"} and [r[:2] for r in got] == [r[:2] for r in whole]
    assert np.allclose([r[2] for r in got], [r[2] for r in whole], rtol=1e-9)
    assert rows_of(language.gram_counts(docs, 1)) == rows_of(language.gram_counts(docs))


def test_posteriors_match_a_plain_version(spark):
    rng = random.Random(12)
    rows = [(i, "".join(rng.choices("aábc d", k=rng.randint(1, 9))), rng.choice(["x", "y", "z"])) for i in range(60)]
    grams = {i: _plain_grams(t) for i, t, _ in rows}
    learned = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    counts = {lang: np.zeros(1 << language.BITS) + language.SMOOTHING for lang in "xyz"}
    for i, lang in learned:
        np.add.at(counts[lang], grams[i], 1)
    got = {r["doc_id"]: r for r in language.predictions(documents(spark, rows), languages=2).collect()}
    for i, text, _ in rows:
        if any(c.isalpha() for c in text):
            logs = {lang: np.log(sum(x == lang for _, x in learned) / len(learned)) + np.log(own[grams[i]] / own.sum()).sum()
                    for lang, own in counts.items()}
            sums = {lang: np.exp(v - max(logs.values())) for lang, v in logs.items()}
            assert got[i]["lang_pred"] == max(sums, key=sums.get)
            assert abs(got[i]["score"] - max(sums.values()) / sum(sums.values())) < 1e-4


def _plain_grams(text):
    """Buckets of the n-grams of one text, gathered place by place."""
    codes = [0, *[ord(c.lower()) if c.isalnum() else 0 for c in text], 0]
    out = []
    for n in language.SIZES:
        for at in range(len(codes) - n + 1):
            own = codes[at:at + n]
            inside = own[1:-1] if n > 2 else own
            if (all(inside) if n > 2 else any(inside)):
                value = 0
                for c in own:
                    value = (value * int(language.C.STEP) + c + 1) % (1 << 64)
                out.append(int(language.S.mixed(np.array([value + n], np.uint64))[0]) >> (64 - language.BITS))
    return out


def test_many_languages_take_the_memory_of_a_block(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(prose(rng, 4)), f"l{i % 500:04d}") for i in range(1500)]
    held = [m.nbytes for _, m in language.learned(documents(spark, rows), languages=64)]
    assert len(held) == 8 and max(held) <= 64 * ((1 << language.BITS) + 1) * 4
    got = language.predictions(documents(spark, rows), languages=64).collect()
    assert len(got) == 1500 and len({r["lang_pred"] for r in got}) > 100


def test_naive_bayes_counts_match_a_plain_version(spark):
    rows = [(0, "aba ab", "x"), (2, "b", "y"), (4, "abab", "x")]
    counted = {(r["lang"], r["bucket"]): r["n"] for r in language.gram_counts(documents(spark, rows)).collect()}
    assert counted[("x", -1)] == 2 and counted[("y", -1)] == 1
    # one character: 1 gram, 2 pairs with a blank, 1 triple with two
    assert sum(n for (lang, b), n in counted.items() if lang == "y" and b >= 0) == 4


def test_language_of_odd_and_empty_tables(spark):
    rows = odd_rows()
    got = language.predictions(documents(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3, 8))
    assert all(r["lang_pred"] in {"en", "fr", "de"} for r in got if r["doc_id"] in (4, 5, 6, 7, 9, 10))
    assert language.predictions(documents(spark, [])).count() == 0
    nothing = language.predictions(documents(spark, [(1, "abc"), (2, "def")])).collect()
    assert [r["lang_pred"] for r in nothing] == ["und", "und"]


def quality_rows(seed=5):
    rng = random.Random(seed)
    good = prose(rng, 300)
    rows = [(i, " ".join(rng.choices(good, k=60))) for i in range(180)]
    rows += [(1000 + i, " ".join(f"{w}%%%" for w in rng.choices(good, k=60))) for i in range(20)]
    return rows, [(i, 1, 0) for i in range(0, 180, 2)] + [(1000 + i, 0, 0) for i in range(0, 20, 2)]


def test_resampling_keeps_what_looks_like_the_target(spark):
    rows, marks = quality_rows()
    got = {r["doc_id"]: r for r in resampling.resample(documents(spark, rows, extra=True), labels(spark, marks), share=0.9).collect()}
    assert len(got) == len(rows)
    assert sum(r["kept"] for r in got.values()) == 180
    assert all(not got[1000 + i]["kept"] for i in range(20))


def test_resampling_draws_the_k_largest(spark):
    rows, marks = quality_rows()
    for share in (0.1, 0.5, 1.0):
        got = resampling.resample(documents(spark, rows), labels(spark, marks), share=share).collect()
        order = sorted(got, key=lambda r: -r["draw"])
        k = int(len(rows) * share)
        assert [r["kept"] for r in order] == [True] * k + [False] * (len(rows) - k)


def test_draws_are_gumbel(spark):
    docs = documents(spark, [(i, "same text") for i in range(20_000)])
    draws = np.array([r["draw"] for r in resampling.importance(docs, labels(spark, [])).collect()])
    assert abs(draws.mean() - 0.5772) < 0.05 and abs(draws.std() - 1.2825) < 0.05


def test_resampling_of_odd_and_empty_tables(spark):
    rows = odd_rows()
    _, marks = quality_rows()
    got = resampling.resample(documents(spark, rows, extra=True), labels(spark, marks + [(None, 1, 1), (4, 1, 0)])).collect()
    assert len(got) == len(rows)
    assert all(r["log_weight"] is None and not r["kept"] for r in got if r["doc_id"] in (1, 2, 3))
    assert resampling.resample(documents(spark, []), labels(spark, marks)).count() == 0
    assert resampling.resample(documents(spark, [(1, None)]), labels(spark, marks)).collect()[0]["kept"] is False


def test_log_weights_match_a_plain_version(spark):
    rng = random.Random(21)
    few = prose(rng, 12) + ["É漢", "x9"]
    rows = [(i, "".join(rng.choice(few) + rng.choice([" ", ", ", "--", "\n", "."]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    marks = [(i, i % 2, 0) for i in range(0, 60, 3)]

    def buckets(text):
        tokens = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", text.lower())
        one = [int(resampling._buckets(pa.array([t]))[0][0]) for t in tokens]
        two = [int(resampling._buckets(pa.array([f"{a} {b}"]))[0][2]) for a, b in zip(tokens, tokens[1:])]
        return one + two

    every, wanted = Counter(), Counter()
    for i, text in rows:
        every.update(buckets(text))
        if (i, 1, 0) in marks:
            wanted.update(buckets(text))
    n = 1 << resampling.BITS

    def weight(text):
        return sum(np.log((wanted[b] + 1) / (sum(wanted.values()) + n)) - np.log((every[b] + 1) / (sum(every.values()) + n))
                   for b in buckets(text))

    got = {r["doc_id"]: r for r in resampling.importance(documents(spark, rows), labels(spark, marks)).collect()}
    for i, text in rows:
        assert got[i]["n_tokens"] == len(buckets(text))
        assert (got[i]["log_weight"] is None) == (not buckets(text))
        if buckets(text):
            assert abs(got[i]["log_weight"] - weight(text)) < 1e-9


def test_toxicity_scores_match_a_plain_version():
    rng = np.random.default_rng(5)
    weights, bias = rng.normal(0, 1, 1 << toxicity.BITS).astype(np.float32), -1.25
    words = prose(random.Random(6), 40) + ["a", "É", "x1"]
    texts = [" ".join(random.Random(i).choices(words, k=k)) for i, k in enumerate([1, 2, 8, 9, 17, 60])] + ["", "...", "a.b,c"]

    def grams(word):
        codes, out = [0, *[ord(c.lower()) for c in word], 0], []
        for n in toxicity.SIZES:
            for at in range(len(codes) - n + 1):
                value = 0
                for c in codes[at:at + n]:
                    value = (value * int(chargrams.STEP) + c + 1) % (1 << 64)
                out.append(int(chargrams.mixed(np.array([value + n], np.uint64))[0]) >> (64 - toxicity.BITS))
        return out

    def plain(text):
        own = re.findall(r"[a-z0-9É]+", text, re.IGNORECASE)
        if not own:
            return 0.0
        means = [np.mean([float(weights[b]) for b in grams(w)]) if len(w) else 0.0 for w in own]
        passages = [np.mean(means[i:i + toxicity.PASSAGE]) for i in range(0, len(means), toxicity.PASSAGE)]
        odds = np.log(np.exp(passages).sum()) + bias
        return 1 / (1 + np.exp(-odds))

    got = toxicity.score(pa.array(texts), weights, bias)
    assert np.allclose(got, [plain(t) for t in texts], atol=1e-9)
