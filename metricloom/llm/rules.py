"""Quality rules with thresholds that adapt to each language and source, with DataFrame operations only.

Measures are whole numbers (thousandths). Their distribution in a group is kept as counts of bins that
hold a number's seven highest binary digits: such a sketch is at most 1/64 off, its size doesn't grow
with the rows, and sketches merge by adding counts.

Every group's sketch is blended with that of its language, and this with that of all rows, as if each held a few rows more
of the wider one; so a group's fences move from the wider ones to its own as it grows, without a step. A fence
lies beyond the outer tenth of the blended sketch, by a multiple of that tenth's distance from the median or, for measures
that are zero in most texts and so have no such distance, of the mean excess of the outer tenth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.session import stored

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 5
# rows of the wider sketch that are blended into a group's
PRIOR_ROWS = 20
# of each measure: times the distance from the median to the outer tenth, times the mean excess of that tenth, and whether
# there is a lower fence too. Repeats are common in clean pages, so their excess counts more often.
FENCES = {"word_length": (2, 0, True), "symbols": (2, 1, False), "dup_lines": (2, 5, False), "repeats": (2, 5, False)}


def text_measures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every row.

    Arrays that several expressions read stand in a projection of their own, so that each is made
    once. The windows of a text are hashed, sorted and compared with their neighbours in its own row.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    cut = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), docs["lang"].cast("string").alias("lang"),
        docs["source"].cast("string").alias("source"), text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)).alias("lines"),
    )
    windows = F.when(F.size("words") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW),
        lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(WINDOW)]),
    )).otherwise(F.array().cast("array<bigint>"))
    counted = cut.select(
        "doc_id", "lang", "source", F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    # most texts repeat no window, and are done here
    ordered = counted.withColumn("windows", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    twice = F.filter("windows", lambda w, i: (
        F.coalesce(F.get("windows", i - 1)["h"] == w["h"], F.lit(False))
        | F.coalesce(F.get("windows", i + 1)["h"] == w["h"], F.lit(False))))
    places = ordered.withColumn("places", F.array_sort(F.transform(twice, lambda w: w["i"])))
    covered = F.aggregate(
        "places", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, i: F.struct(
            (s["n"] + i + WINDOW - F.greatest(s["to"], i)).alias("n"), (i + WINDOW).alias("to")),
        lambda s: s["n"])
    return places.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        covered.cast("bigint").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _measures() -> dict[str, Column]:
    def per(part: str, whole: str) -> Column:
        return F.call_function("div", 1000 * F.col(part), F.greatest(F.col(whole), F.lit(1)))

    return {
        "word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words")}


def bin_of(value: Column) -> Column:
    """The value with all but its seven highest binary digits set to zero."""
    low = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n) from rows with lang, source and measures; counts add up where the rows lie."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), c.cast("bigint").alias("value")) for m, c in _measures().items()])
    flat = rows.select("lang", "source", F.explode(pairs).alias("m")).select("lang", "source", "m.*")
    return flat.groupBy("lang", "source", "measure", bin_of(F.col("value")).alias("bin")).agg(F.count("*").alias("n"))


def blended(bins: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """(lang, source, measure, bin, w): each group's sketch with ``prior_rows`` rows of its language's, which has as many
    of all rows'. Weights are whole numbers, as all shares are brought to one denominator."""
    wide = "decimal(38,0)"
    own = bins.select(F.struct("lang", "source").alias("group"), "measure", "bin", F.col("n").cast(wide).alias("n_own"))
    of_lang = bins.groupBy(F.struct("lang").alias("of"), "measure", "bin").agg(F.sum("n").cast(wide).alias("n_lang"))
    of_all = bins.groupBy("measure", "bin").agg(F.sum("n").cast(wide).alias("n_all"))
    groups = own.select("group", "measure").distinct()
    # a sketch has some hundred bins, so a group has as many rows here
    grid = groups.join(of_all, "measure").withColumn("of", F.struct(F.col("group.lang").alias("lang")))
    filled = grid.join(of_lang, ["of", "measure", "bin"], "left").join(own, ["group", "measure", "bin"], "left").na.fill(
        0, ["n_lang", "n_own"])
    whole = W.partitionBy("group", "measure")
    total = filled.withColumns({"t_lang": F.sum("n_lang").over(whole).cast(wide), "t_all": F.sum("n_all").over(whole).cast(wide)})
    prior = F.lit(prior_rows).cast(wide)
    weight = F.col("n_own") * ((F.col("t_all") * (F.col("t_lang") + prior).cast(wide)).cast(wide)) + prior * (
        (F.col("n_lang") * F.col("t_all")).cast(wide) + (prior * F.col("n_all")).cast(wide)).cast(wide)
    return total.select("group.lang", "group.source", "measure", "bin", weight.cast(wide).alias("w"))


def fences(bins: DataFrame, prior_rows: int = PRIOR_ROWS, fences: dict = FENCES) -> DataFrame:
    """(lang, source, low_<measure>, high_<measure>) of every group in ``bins``."""
    group = ["lang", "source", "measure"]
    whole = W.partitionBy(*group)
    # some hundred rows for each group, read several times
    placed = blended(stored(bins, "quality-sketches"), prior_rows).withColumns({
        "upto": F.sum("w").over(whole.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("w").over(whole)})

    def reached(tenths: int) -> Column:
        """The first bin up to which so many tenths of the sketch lie."""
        return F.min(F.when(10 * F.col("upto") >= tenths * F.col("total"), F.col("bin"))).over(whole)

    marked = placed.withColumns({"q10": reached(1), "q50": reached(5), "q90": reached(9)})
    read = marked.groupBy(*group, "q10", "q50", "q90").agg(F.call_function(
        "div", 10 * F.sum(F.greatest(F.col("bin") - F.col("q90"), F.lit(0)) * F.col("w")), F.max("total")).alias("excess"))
    made = []
    for name, (steps, times, lower) in fences.items():
        here = F.col("measure") == name
        beyond = F.greatest(steps * (F.col("q90") - F.col("q50")), times * F.col("excess"))
        made.append(F.max(F.when(here, F.col("q90") + beyond)).alias(f"high_{name}"))
        if lower:
            made.append(F.max(F.when(here, F.col("q10") - steps * (F.col("q50") - F.col("q10")))).alias(f"low_{name}"))
    return read.groupBy("lang", "source").agg(*made)


def judged(docs: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """Every row's measures, ``base_failed`` and ``kept``.

    ``docs`` has doc_id, text, lang and source. A row is kept if it passes the base rules and no
    measure lies beyond its group's fences, which are made from the rows that pass the base rules. A
    null lang or source is a group of its own; a null or empty text has no words and fails the base;
    repeated rows count as often as they stand; an empty table gives no rows. A text is measured whole in its
    own row, which takes some 40 bytes a character while it is. Other columns are ignored.
    """
    rows = stored(text_measures(docs).withColumn("base_failed", base_failed()), "quality-measures")
    limits = fences(sketches(rows.where("not base_failed")), prior_rows).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    # one row for each language and source: narrow, and stored so that its size is known before the join
    limits = stored(limits, "quality-fences")
    joined = rows.join(
        limits, rows["lang"].eqNullSafe(limits["of_lang"]) & rows["source"].eqNullSafe(limits["of_source"]), "left")
    inside = F.lit(True)
    for name, measure in _measures().items():
        inside &= measure <= F.col(f"high_{name}")
        if FENCES[name][2]:
            inside &= measure >= F.col(f"low_{name}")
    return joined.select(*rows.columns, (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
