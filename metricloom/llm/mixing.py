"""Mixing sources to target weights along a time-varying curriculum, with DataFrame operations only.

Every source has a weight that moves in a straight line over the training run. The integral of that
line is the source's share of the tokens; its running integral is the source's token demand up to a
moment. A document's offset in its source's shuffled stream, put through the inverse of that demand,
gives the moment it is due.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.operators.prefix import running
from metricloom.session import stored

# weight at the start and at the end of training, given to the sources in turn; their means are 5, 2 and 1
SCHEDULES = ((7.5, 2.5), (2.0, 2.0), (0.5, 1.5))
ROWS_PER_BLOCK = 1_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, schedules=SCHEDULES, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, quota, slope, total, tilt) from (source, source_size).

    Sources in code point order, null last, take ``schedules`` in turn. Their weights share
    ``share`` times all sizes; a target stops at ``most`` times its source's size and the excess goes
    to the others by weight. One row for each source, so the windows hold no documents.
    """
    if share > most:
        raise ValueError("no mix can take more than the most of every source")
    kinds = len(schedules)
    turn = F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(kinds))
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), turn + 1)
    rows = sizes.select(
        "source", "source_size",
        pick([(a + b) / 2 for a, b in schedules]).alias("weight"),
        pick([(b - a) / (b + a) for a, b in schedules]).alias("slope"),
        F.sum("source_size").over(W.partitionBy()).alias("all"),
    )
    # the source that reaches its limit first comes first; from the first one that doesn't, none does
    first = [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    full = F.coalesce(F.sum("source_size").over(W.orderBy(*first).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(W.orderBy(*first).rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("level", (F.lit(share) * F.col("all") - F.lit(most) * full) / rest)
    rows = rows.withColumn("open", F.col("level") * F.col("weight") < F.lit(most) * F.col("source_size"))
    level = F.max(F.when(F.col("open"), F.col("level"))).over(W.partitionBy())
    target = F.when(F.col("open"), level * F.col("weight")).otherwise(F.lit(most) * F.col("source_size"))
    rows = rows.withColumn("target", target).withColumn("quota", F.floor(F.col("target") + 0.5).cast("bigint"))
    return rows.select(
        "source", "source_size", "target", "quota", "slope",
        F.sum("quota").over(W.partitionBy()).alias("total"),
        F.sum(F.col("quota") * F.col("slope")).over(W.partitionBy()).alias("tilt"),
    )


def order_key(doc_id: Column) -> Column:
    """Where a document stands in its source's shuffled stream."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def due(offset: Column, quota: Column, slope: Column) -> Column:
    """The moment in 0 to 1 at which a source's demand, t + slope * (t * t - t) of its quota, reaches ``offset``."""
    u, flat = offset / quota, F.lit(1.0) - slope
    return F.when(u > 0, F.lit(2.0) * u / (flat + F.sqrt(flat * flat + F.lit(4.0) * slope * u))).otherwise(0.0)


def mixture(rows: DataFrame, schedules=SCHEDULES, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, quota, slope, total, tilt, before, taken) of every row.

    ``rows`` has doc_id, source, size and row (anything that travels along). Each source's documents
    stand in the order of a hash of doc_id (then size and doc_id), pass after pass, and the mix takes
    the first ``quota`` words of that stream: ``before`` is the document's offset in a pass, ``taken``
    its words in all passes. The last document taken may be cut; no source is off its rounded target.

    A null source is one more source; a null doc_id hashes as an empty one; a document without words
    has taken 0. Repeated rows are mixed as rows of their own. An empty table gives no rows.
    """
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(per_source, schedules, share, most).withColumnRenamed("source", "of")
    # hex digits of the order key that cut a source into blocks, from the number of rows alone
    digits = max(1, math.ceil(math.log(max(rows.count(), 1) / ROWS_PER_BLOCK + 1, 16)))
    keyed = rows.withColumn("at", order_key(F.col("doc_id")))
    placed = running(
        keyed, ["source"], ["at", "size", "doc_id"], F.substring("at", 1, digits), {"before": F.col("size")},
        inclusive=False, coarser=lambda block: F.substring(block, 1, max(1, digits // 2)))
    joined = placed.join(plan, placed["source"].eqNullSafe(plan["of"]))
    passes = F.floor(F.col("quota") / F.greatest("source_size", F.lit(1))).cast("bigint")
    rest = F.col("quota") - passes * F.col("source_size")
    part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), rest - F.col("before")))
    taken = F.when(F.col("size") > 0, passes * F.col("size") + part).otherwise(F.lit(0).cast("bigint"))
    return joined.withColumn("taken", taken).drop("at", "of")


def position(copy: Column) -> Column:
    """Words of the whole mix before a document's pass number ``copy`` (from 0) begins."""
    t = due(copy * F.col("source_size") + F.col("before"), F.greatest("quota", F.lit(1)), F.col("slope"))
    return F.col("total") * t + F.col("tilt") * (t * t - t)


def mixed_sizes(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, position) of every row of ``docs`` in training order.

    ``docs`` has doc_id, text and source; other columns are ignored. ``position`` is the document's
    first place in the mix, null if nothing of it is taken; such rows come last.
    """
    rows = stored(docs.select(
        docs["doc_id"].cast("bigint"), docs["source"].cast("string"), word_count(docs["text"]).alias("size"),
        F.lit(True).alias("row")), "mixing")
    out = mixture(rows, **settings)
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "taken",
        F.when(F.col("taken") > 0, position(F.lit(0))).alias("position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, place: str | None = None, **settings) -> DataFrame:
    """The rows of the mix in training order, with the columns of ``docs``: one row for each pass that takes words.

    A row that a target cuts holds its first words only, joined by single blanks, and n_chars (where
    ``docs`` has it) counts what is left. Rows of which nothing is taken are gone. Nulls, repeated
    rows and empty tables as in ``mixture``; other columns stay, whatever their names. With ``place``, a
    further column of that name has the row's first place in the mix.
    """
    columns = docs.columns
    rows = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"].cast("string").alias("source"),
        word_count(docs["text"]).alias("size"), F.struct(*[docs[c] for c in columns]).alias("row"))
    out = mixture(rows, **settings).where("taken > 0")
    last = F.ceil(F.col("taken") / F.col("size")).cast("int") - 1
    copies = out.withColumn("copy", F.explode(F.sequence(F.lit(0), last)))
    got = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    placed = copies.select("row", "size", got.alias("got"), position(F.col("copy")).alias("position"), "doc_id")
    text = F.col("row")["text"]
    cut = F.array_join(F.slice(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), 1, F.col("got").cast("int")), " ")
    whole = F.col("got") == F.col("size")
    made = placed.withColumn("cut", F.when(whole, text).otherwise(cut))
    values = {
        "text": F.col("cut"),
        "n_chars": F.when(whole, F.col("row")["n_chars"]).otherwise(F.length("cut")) if "n_chars" in columns else None,
    }
    return made.orderBy("position", "doc_id").select(
        *[(values[c] if c in values else F.col("row")[c]).alias(c) for c in columns],
        *([] if place is None else [F.col("position").alias(place)]))
