"""Collocations: the best phrases of each language by best-first branch and bound.

A phrase of a occurrences that is cut into two parts of l and r scores ``2a / (l + r)`` in millionths, rounded
down, at its lowest-scoring cut. A phrase that begins with ``prefix`` has at most a = f(prefix) occurrences, and so has
its rest behind the first word; so no phrase grown from a prefix scores beyond ``2a / (f(first word) + a)``, and the
bound falls as the prefix grows. Single words have the bound 1, so all frequent pairs are counted. From there on only
prefixes whose bound reaches a language's threshold are grown, and the threshold is lowered until the
wanted number of phrases that survive lies at or above it. All phrases at or above it are known then, ties included.

Every step counts in one pass over the texts: numpy finds the wanted n-grams of a slice of texts and merges equal
ones within the task, Spark adds up what the tasks have found. A fixed-size bitmap of n-grams tells the tasks
what is wanted; what it lets through beyond that is counted rightly and does no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm import segments as S
from metricloom.session import stored

TOP, LEAST, LONGEST = 2000, 30, 4
SCALE = 1_000_000
# a phrase goes if one that holds it has this many hundredths of its occurrences
COVERED = 80
FILTER_BITS = 1 << 26
# n-grams that a task merges before it passes them on
HELD = 1 << 20
# width of a step of the histogram of scores
STEP = 64

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = SEPARATORS.copy()
BETWEEN[[0x20, 0x09]] = True
_CUT = re.compile(rb"[.,;:!?\n-\r]")
_SECOND_VALUES = np.random.default_rng(11).integers(1, 1 << 64, 256, dtype=np.uint64)

# what a gram in the bitmap is wanted for
FREQUENT, GROWN, CHECKED, EXACT = range(4)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(langs, texts) of about SLICE_BYTES; a longer text goes in spans cut where pieces end."""
    for low, high in S.slices(batch.column(1)):
        langs, texts = batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low)
        if high - low > 1 or (texts.nbytes or 0) <= 2 * S.SLICE_BYTES:
            yield langs, texts
            continue
        data, at = (texts[0].as_py() or "").encode(), 0
        while at < len(data):
            found = _CUT.search(data, min(at + S.SLICE_BYTES, len(data)))
            end = found.end() if found else len(data)
            yield langs, pa.array([data[at:end].decode()], pa.large_string())
            at = end


def _language_key(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{lang}".encode(), digest_size=8).digest(), "little")


def _tokens(langs: pa.Array, texts: pa.Array, seed: int) -> tuple[S.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the key of each (word, language), a second hash of the word, and the piece each lies in."""
    found = S.words(texts, BETWEEN)
    coded = langs.dictionary_encode()
    keys = np.array([_language_key(x, seed) for x in coded.dictionary.to_pylist()] or [0], np.uint64)
    lang = keys[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else keys[:0]
    ids = S.mixed(found.hashes() ^ lang[found.row])
    second = S.place_hashes(_SECOND_VALUES[found.data], found.starts, found.ends)
    piece = np.cumsum(SEPARATORS[found.data])[found.starts] if len(found.starts) else np.zeros(0, np.int64)
    return found, ids, second, piece + found.row


class Tally:
    """Counts of equal rows of 64-bit columns, merged within the task."""

    def __init__(self, width: int):
        self.width, self.size, self.full = width, 0, False
        self.parts: list[list[np.ndarray]] = []

    def add(self, columns: list[np.ndarray], counts: np.ndarray | None = None) -> None:
        made = _merged([*columns, np.ones(len(columns[0]), np.int64) if counts is None else counts])
        self.parts.append(made)
        self.size += len(made[0])
        if self.size > HELD:
            self.merge()
            self.full = self.size > HELD // 2

    def merge(self) -> list[np.ndarray]:
        whole = [np.concatenate(c) for c in zip(*self.parts, strict=True)] if self.parts else [
            *[np.zeros(0, np.uint64)] * self.width, np.zeros(0, np.int64)]
        self.parts = [_merged(whole)]
        self.size = len(self.parts[0][0])
        return self.parts[0]

    def drain(self) -> list[np.ndarray]:
        made = self.merge()
        self.parts, self.size, self.full = [], 0, False
        return made


def _merged(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Equal neighbours in the order of a hash become one; where hashes collide rows may stay apart."""
    *keys, counts = columns
    if not len(counts):
        return columns
    order = np.argsort(_gram(keys, 0) if len(keys) > 1 else keys[0])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return [*[k[first] for k in keys], np.add.reduceat(counts[order], first)]


def _gram(keys: list[np.ndarray], role: int) -> np.ndarray:
    """A hash of n-grams for one role in the bitmap."""
    out = np.full(len(keys[0]), np.uint64(len(keys) * 8 + role), np.uint64)
    for key in keys:
        out = S.mixed(out * S.BASE ^ key)
    return out


class Spellings:
    """The language and spelling of each id met so far, as Arrow arrays."""

    def __init__(self):
        self.ids, self.langs, self.words = [np.zeros(0, np.uint64)], [], []

    def add(self, found: S.Words, ids: np.ndarray, langs: pa.Array) -> None:
        new, at = np.unique(ids, return_index=True)
        fresh = ~np.isin(new, self.ids[0], assume_unique=True)
        new, at = new[fresh], at[fresh]
        if not len(new):
            return
        sizes = found.ends[at] - found.starts[at]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        data = found.data[np.repeat(found.starts[at] - offsets[:-1], sizes) + np.arange(offsets[-1])]
        self.words.append(pa.Array.from_buffers(
            pa.large_string(), len(new), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]))
        self.langs.append(langs.take(pa.array(found.row[at])))
        # all ids in one sorted array, and again in the order of the spellings
        self.ids[0] = np.union1d(self.ids[0], new)
        self.ids.append(new)

    def drain(self, ids: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """(langs, words) of the given ids; then all are forgotten."""
        own = np.concatenate(self.ids[1:])
        order = np.argsort(own)
        at = pa.array(order[np.searchsorted(own[order], ids)])
        made = pa.concat_arrays(self.langs).cast(pa.string()).take(at), pa.concat_arrays(self.words).cast(pa.string()).take(at)
        self.ids, self.langs, self.words = [np.zeros(0, np.uint64)], [], []
        return made


def _word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(id, second, lang, word, n): every word of every language with its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, names = Tally(2), Spellings()

        def emit() -> pa.RecordBatch:
            ids, second, counts = tally.drain()
            langs, words = names.drain(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids.view(np.int64)), pa.array(second.view(np.int64)), langs, words, pa.array(counts)],
                ["id", "second", "lang", "word", "n"])

        for batch in batches:
            for langs, texts in _texts(batch):
                found, ids, second, _ = _tokens(langs, texts, seed)
                if len(ids):
                    names.add(found, ids, langs)
                    tally.add([ids, second])
                    if tally.full:
                        yield emit()
        if tally.size:
            yield emit()

    return docs.mapInArrow(run, "id bigint, second bigint, lang string, word string, n bigint").groupBy(
        "id", "second").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), F.sum("n").alias("n"))


def _bitmap(wanted: list[tuple[DataFrame, list[str], int]]) -> np.ndarray | None:
    """One bitmap of the n-grams of all roles; its size is fixed."""
    kind = "cell int, bits bigint"

    def marks(role: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(FILTER_BITS // 64, np.uint64)
            for batch in batches:
                if len(batch):
                    bit = _gram([c.to_numpy().view(np.uint64) for c in batch.columns], role) % np.uint64(FILTER_BITS)
                    np.bitwise_or.at(bits, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
            at = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bits[at].view(np.int64))], ["cell", "bits"])
        return run

    parts = None
    for rows, columns, role in wanted:
        made = rows.select(*columns).mapInArrow(marks(role), kind)
        parts = made if parts is None else parts.union(made)
    cells = parts.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return bits.view(np.uint64)


def _columns(width: int) -> list[str]:
    return [f"w{i}" for i in range(1, width + 1)]


def _gram_counts(docs: DataFrame, width: int, wanted: list[tuple[DataFrame, list[str], int]], exact: bool, seed: int,
                 least: int) -> DataFrame:
    """(w1 .. w<width>, a) of n-grams with ``least`` occurrences; stored.

    Wanted are those whose shorter n-grams are all frequent and whose first n-1 words are to be grown or last n-1
    checked, or with ``exact`` those that are named themselves.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))
    names = _columns(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, tally = shared.value, Tally(width)

        def held(keys: list[np.ndarray], role: int) -> np.ndarray:
            bit = _gram(keys, role) % np.uint64(FILTER_BITS)
            return (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0

        def emit() -> pa.RecordBatch:
            *keys, counts = tally.drain()
            return pa.RecordBatch.from_arrays([*[pa.array(k.view(np.int64)) for k in keys], pa.array(counts)], [*names, "n"])

        def window(ids: np.ndarray, at: np.ndarray, low: int, n: int) -> list[np.ndarray]:
            return [ids[at + low + j] for j in range(n)]

        for batch in batches:
            for langs, texts in _texts(batch):
                _, ids, _, piece = _tokens(langs, texts, seed)
                if len(ids) < width:
                    continue
                at = np.flatnonzero(piece[:len(piece) - width + 1] == piece[width - 1:])
                if exact:
                    at = at[held(window(ids, at, 0, width), EXACT)]
                else:
                    part = 1 if width == 2 else 2
                    fits = held([ids] if part == 1 else [ids[:-1], ids[1:]], FREQUENT)
                    for j in range(width - part + 1):
                        at = at[fits[at + j]]
                    if width > 2:
                        grown = held(window(ids, at, 0, width - 1), GROWN)
                        at = at[grown | held(window(ids, at, 1, width - 1), CHECKED)]
                if len(at):
                    tally.add(window(ids, at, 0, width))
                    if tally.full:
                        yield emit()
        if tally.size:
            yield emit()

    rows = docs.mapInArrow(run, ", ".join(f"{n} bigint" for n in names) + ", n bigint")
    return stored(rows.groupBy(*names).agg(F.sum("n").alias("a")).where(F.col("a") >= least), f"grams-{width}")


def _score(a: Column, left: Column, right: Column) -> Column:
    """Millionths, rounded down; in decimals, as products may pass 64 bits."""
    return (F.lit(2 * SCALE).cast("decimal(20,0)") * a.cast("decimal(18,0)"), left + right)


def _floor(parts: tuple[Column, Column]) -> Column:
    top, whole = parts
    # a decimal's remainder is exact, so the quotient has no fraction to round
    return ((top - top % whole.cast("decimal(19,0)")) / whole.cast("decimal(19,0)")).cast("bigint")


def _bound(a: Column, first: Column) -> Column:
    """The most that a phrase grown from a prefix of ``a`` occurrences can score."""
    return _floor(_score(a, first, a))


def _named(rows: DataFrame, counts: DataFrame, at: list[str], alias: str, how: str = "inner") -> DataFrame:
    """Add the count of the n-gram in the columns ``at``."""
    own = counts.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(_columns(len(at)))], F.col("a").alias(alias))
    return rows.join(own, [F.col(c) == F.col(f"k{i}") for i, c in enumerate(at)], how).drop(
        *[f"k{i}" for i in range(len(at))])


def _cuts(rows: DataFrame, width: int, counts: dict[int, DataFrame], how: str = "inner") -> DataFrame:
    """Add the counts l<k>, r<k> of both parts of every cut; unknown ones are null with a left join."""
    names = _columns(width)
    for k in range(1, width):
        rows = _named(rows, counts[k], names[:k], f"l{k}", how if k > 2 else "inner")
        rows = _named(rows, counts[width - k], names[k:], f"r{k}", how if width - k > 2 else "inner")
    return rows


def _scored(rows: DataFrame, width: int) -> DataFrame:
    """(lang, w.., a, l, r, score, bound, k) at the lowest-scoring cut, ties to the first."""
    cuts = [F.struct(_floor(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}"))).alias("score"), F.lit(k).alias("k"),
                     F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, width)]
    least = cuts[0] if len(cuts) == 1 else F.least(*cuts)
    return rows.withColumn("cut", least).select(
        "lang", *_columns(width), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"),
        _bound(F.col("a"), F.col("l1")).alias("bound"))


def _dropped(rows: DataFrame, longer: DataFrame, width: int) -> DataFrame:
    """Without the phrases of which a longer one has COVERED hundredths of the occurrences.

    One more word is enough to look at: what is inside a still longer phrase is inside the one between.
    """
    names = _columns(width + 1)
    ends = [longer.select(*[F.col(c).alias(f"w{i + 1}") for i, c in enumerate(part)], "a") for part in (names[:-1], names[1:])]
    most = ends[0].unionByName(ends[1]).groupBy(*_columns(width)).agg(F.max("a").alias("most"))
    joined = _named(rows, most.withColumnRenamed("most", "a"), _columns(width), "most", "left")
    wide = "decimal(24,0)"
    return joined.where(~F.coalesce(
        F.col("most").cast(wide) * 100 >= F.col("a").cast(wide) * COVERED, F.lit(False))).drop("most")


def _thresholds(survivors: DataFrame, before: DataFrame, goal: int, top: int) -> DataFrame:
    """(lang, t, before): where a language's ``goal``-th score lies, below the last threshold; settled ones keep it."""
    steps = survivors.groupBy("lang", F.floor(F.col("score") / STEP).alias("step")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("step")))
    found = steps.withColumn("upto", upto).where(F.col("upto") >= goal).groupBy("lang").agg(
        (F.max("step") * STEP).alias("found"))
    settled = survivors.join(before.select("lang", F.col("t").alias("low")), "lang").where("score >= low").groupBy("lang").agg(
        F.count("*").alias("n_settled"))
    return before.select("lang", F.col("t").alias("before")).join(found, "lang", "left").join(settled, "lang", "left").select(
        "lang", "before", F.when(F.coalesce("n_settled", F.lit(0)) >= top, F.col("before")).otherwise(
            F.least(F.coalesce("found", F.lit(0)), F.floor(F.col("before") / 2))).cast("bigint").alias("t"))


def _leading(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """(rows, rank) of the first ``n`` rows of each language; no task meets more than some 4 n rows of one."""
    while (most := rows.groupBy("lang").count().agg(F.max("count")).first()[0] or 0) > 4 * n:
        split = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(-(-most // (4 * n))))).orderBy(*order)
        rows = stored(rows.withColumn("rank", F.row_number().over(split)).where(F.col("rank") <= n).drop("rank"), "leading")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= n)


def phrases(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` phrases of 2 to 4 words in ``docs`` (text, lang).

    A-Z are lower-cased; words are runs without blanks and tabs inside pieces, which end at ``.,;:!?`` and line ends.
    Phrases need ``least`` occurrences; one that lies inside a longer one with 80 % of its occurrences is left
    out. They come by score, occurrences and the phrase itself, so ties have one order.

    A null lang is the language ``und``; null and empty texts have no words. Every row counts, repeated ones too. A text
    of any length is read in spans of some 2 MB cut where pieces end; one piece beyond that is held whole (some 100 bytes a
    byte). A table without frequent pairs gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text"))
    for seed in range(8):
        words = stored(_word_counts(texts, seed), "phrase-words")
        # two words of one key would be counted as one; another seed tells them apart
        if not words.groupBy("id").count().where("count > 1").limit(1).count():
            break
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    frequent = stored(words.where(F.col("n") >= least).select(F.col("id").alias("w1"), "lang", F.col("n").alias("a")), "frequent")
    counts = {1: frequent.drop("lang")}
    langs = frequent.select(F.col("w1").alias("own"), "lang")

    def with_lang(rows: DataFrame) -> DataFrame:
        return rows.join(langs, F.col("w1") == F.col("own")).drop("own")

    counts[2] = _gram_counts(texts, 2, [(counts[1], ["w1"], FREQUENT)], False, seed, least)
    known = {2: stored(_scored(_cuts(with_lang(counts[2]), 2, counts), 2), "pairs")}
    empty = {w: spark.createDataFrame([], ", ".join(f"{c} bigint" for c in [*_columns(w), "a"])) for w in (3, 4)}
    counts |= empty
    limits = totals.select("lang", F.lit(SCALE + 1).cast("bigint").alias("t"))
    survivors, goal = known[2], 2 * top
    while True:
        limits = stored(_thresholds(survivors.select("lang", "score"), limits, goal, top), "thresholds")
        if not limits.where("t < before").limit(1).count():
            break
        goal *= 2

        def due(rows: DataFrame, by: str, limits: DataFrame = limits) -> DataFrame:
            return rows.join(limits, "lang").where((F.col(by) >= F.col("t")) & (F.col(by) < F.col("before")))

        for width in (3, 4):
            shorter, names = known[width - 1], _columns(width - 1)
            wanted = [(counts[2], _columns(2), FREQUENT), (due(shorter, "bound"), names, GROWN), (due(shorter, "score"), names, CHECKED)]
            more = _gram_counts(texts, width, wanted, False, seed, least)
            counts[width] = stored(counts[width].unionByName(more).dropDuplicates(_columns(width)), f"phrases-{width}")
            found = with_lang(counts[width])
            if width == 4:
                # a last part that was not wanted for itself is counted where the other cuts leave the phrase a chance
                open_ones = _cuts(found, 4, counts, "left").where("r1 is null").join(limits, "lang").where(
                    F.least(*[_floor(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}"))) for k in (2, 3)]) >= F.col("t"))
                parts = stored(open_ones.select(*[F.col(f"w{i + 1}").alias(f"w{i}") for i in (1, 2, 3)]).distinct(), "last-parts")
                if parts.limit(1).count():
                    last = _gram_counts(texts, 3, [(parts, _columns(3), EXACT)], True, seed, least)
                    counts[3] = stored(counts[3].unionByName(last).dropDuplicates(_columns(3)), "phrases-3")
                    known[3] = stored(_scored(_cuts(with_lang(counts[3]), 3, counts), 3), "known-3")
            known[width] = stored(_scored(_cuts(found, width, counts), width), f"known-{width}")
        left = [_dropped(known[2], counts[3], 2), _dropped(known[3], counts[4], 3), known[4]]
        for i, rows in enumerate(left):
            left[i] = rows.select("lang", F.array(*_columns(i + 2)).alias("words"), "a", "l", "r", "score")
        survivors = stored(left[0].unionByName(left[1]).unionByName(left[2]), "survivors")
    if "words" not in survivors.columns:
        survivors = survivors.select("lang", F.array("w1", "w2").alias("words"), "a", "l", "r", "score")
    best = survivors.join(limits.select("lang", "t"), "lang").where("score >= t").drop("t")
    spelled = words.select(F.col("id").alias("word_id"), "word")
    best = best.select("lang", "words", "a", "l", "r", "score", F.posexplode("words").alias("at", "word_id")).join(
        spelled, "word_id").groupBy("lang", "words", "a", "l", "r", "score").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return _leading(stored(best.drop("words"), "best"), order, top).join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
