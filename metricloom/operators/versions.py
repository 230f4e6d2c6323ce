"""Segment versions whose intervals overlap in part: what of each a newer version hides.

Intervals are half-open and given per key (a data source). The newest version at a moment is found with a
segment tree that is laid out as a table: an interval is covered by the few nodes of a binary tree over time that it
fills and whose parent it doesn't fill, and a moment lies in one node of every level. Both sides join by equality,
so intervals are never compared with each other, and the number of rows is proportional to the intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.session import settle, stored

# units that interval ends may be whole multiples of, in microseconds, coarsest first
UNITS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)
# cuts of one key that one task puts in order, on average
BLOCK_CUTS = 10_000


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def _moment(number: Column, unit: int) -> Column:
    return F.timestamp_micros(number * unit).cast("timestamp_ntz")


def _unit(intervals: DataFrame) -> int:
    """The coarsest unit that all ends are whole multiples of; fewer levels are needed with it."""
    rest = intervals.agg(*[
        F.max(F.greatest(F.pmod("__from", F.lit(u)), F.pmod("__to", F.lit(u)))).alias(str(u)) for u in UNITS]).first()
    return next(u for u in UNITS if not rest[str(u)])


def tree_nodes(start: Column, end: Column, levels: int) -> Column:
    """The nodes (level, node) that together make up [start, end) of numbers below ``2 ** levels``.

    On every level an odd start is a node that the level above would miss, and so is the one before an odd end.
    """
    def on(level):
        # the bits of a level that is a column itself
        low = F.call_function("shiftright", start + F.call_function("shiftleft", F.lit(1).cast("bigint"), level) - 1, level)
        high = F.call_function("shiftright", end, level)
        node = lambda at: F.struct(level.alias("level"), at.alias("node"))
        return F.filter(F.array(
            F.when((low < high) & (low % 2 == 1), node(low)),
            F.when((low < high) & (high % 2 == 1), node(high - 1)),
        ), lambda n: n.isNotNull())

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), on)))


def newest_pieces(segments: DataFrame, keys: list[str], start: str, end: str, version: str) -> DataFrame:
    """(keys, start, end, version): disjoint pieces of time in which one version is the newest.

    ``segments`` may list an interval any number of times. Null keys are keys of their own; rows with a null end or
    version and empty intervals hold nothing. Time that nothing covers has no piece.
    """
    held = segments.select(
        F.struct(*keys).alias("__key"), _micros(F.col(start)).alias("__from"), _micros(F.col(end)).alias("__to"),
        F.col(version).alias("__version")).where("__from < __to and __version is not null").distinct()
    held = stored(held, "intervals")
    unit = _unit(held)
    span = held.agg(F.min("__from"), F.max("__to"), F.count("*")).first()
    if span[0] is None:
        # no interval, no piece
        return segments.select(*keys, start, end, version).limit(0)
    origin = span[0] // unit
    levels = max(1, (span[1] // unit - origin).bit_length())
    whole = held.select(
        "__key", (F.expr(f"__from div {unit}") - origin).alias("__a"), (F.expr(f"__to div {unit}") - origin).alias("__b"), "__version")
    tree = whole.select("__key", F.explode(tree_nodes(F.col("__a"), F.col("__b"), levels)).alias("__at"), "__version").groupBy(
        "__key", "__at").agg(F.max("__version").alias("__version"))
    tree = settle(tree, "interval-tree")
    cuts = stored(whole.select("__key", F.explode(F.array("__a", "__b")).alias("__a")).distinct(), "interval-cuts")
    # the moment a piece begins lies in one node of each level; levels without nodes aren't asked for
    used = [r[0] for r in tree.select("__at.level").distinct().collect()]
    asked = cuts.select("__key", "__a", F.explode(F.array([
        F.struct(F.lit(level).alias("level"), F.shiftright("__a", level).alias("node")) for level in sorted(used)])).alias("__at"))
    newest = asked.join(tree, ["__key", "__at"]).groupBy("__key", "__a").agg(F.max("__version").alias(version))

    # where each piece ends: the next cut, in blocks of time so that no task has all cuts of a key
    width = max(1, (span[1] // unit - origin) * BLOCK_CUTS // max(span[2], 1))
    blocked = cuts.withColumn("__block", F.expr(f"__a div {width}"))
    inside = W.partitionBy("__key", "__block").orderBy("__a")
    firsts = blocked.groupBy("__key", "__block").agg(F.min("__a").alias("__first"))
    following = firsts.select("__key", "__block", F.lead("__first").over(W.partitionBy("__key").orderBy("__block")).alias("__next"))
    ends = blocked.withColumn("__b", F.lead("__a").over(inside)).join(following, ["__key", "__block"]).select(
        "__key", "__a", F.coalesce("__b", "__next").alias("__b"))
    return newest.join(ends, ["__key", "__a"]).select(
        *[F.col("__key")[k].alias(k) for k in keys], _moment(F.col("__a") + origin, unit).alias(start),
        _moment(F.col("__b") + origin, unit).alias(end), version)


def visible_rows(rows: DataFrame, keys: list[str], ts: str, start: str, end: str, version: str, bin_width: str = "1 day") -> DataFrame:
    """The rows whose time no newer version of their key covers, with all their columns.

    ``rows`` carry the interval and the version of the segment they are in. Pieces of time meet rows by key and time bin;
    pieces are disjoint, so a bin has those that begin in it and one more. The pieces are stored first: few are broadcast,
    and many are joined with the rows dealt by key and bin, where a hot bin is split. A row with a null time or version is
    in no segment and doesn't show.
    """
    pieces = settle(newest_pieces(rows, keys, start, end, version), "newest-pieces")
    bin_of = lambda at: F.window(at, bin_width)["start"]
    step = F.expr(f"INTERVAL {bin_width}")
    binned = pieces.select(
        F.struct(*keys).alias("__key"), F.col(start).alias("__from"), F.col(end).alias("__to"), F.col(version).alias("__newest"),
        F.explode(F.sequence(bin_of(start), bin_of(F.col(end) - F.expr("INTERVAL 1 MICROSECOND")), step)).alias("__bin"))
    # one struct holds the row's own columns, whatever their names
    placed = rows.where(F.col(ts).isNotNull()).select(
        F.struct("*").alias("__row"), F.struct(*keys).alias("__own"), bin_of(ts).alias("__in"), F.col(ts).alias("__at"),
        F.col(version).alias("__version"))
    on = (F.col("__own") == F.col("__key")) & (F.col("__in") == F.col("__bin")) & (F.col("__at") >= F.col("__from")) & (
        F.col("__at") < F.col("__to")) & (F.col("__version") == F.col("__newest"))
    return placed.join(binned, on, "left_semi").select("__row.*")


def hidden_parts(rows: DataFrame, keys: list[str], ts: str, start: str, end: str, version: str) -> DataFrame:
    """Per segment: its rows, how many of them show, and whether all of it is overshadowed."""
    segment = [*keys, start, end, version]
    shown = visible_rows(rows, keys, ts, start, end, version).groupBy(*segment).agg(F.count("*").alias("shown"))
    counted = rows.groupBy(*segment).agg(F.count("*").alias("rows"))
    on = [counted[c].eqNullSafe(shown[c]) for c in segment]
    return counted.join(shown, on, "left").select(
        *[counted[c] for c in segment], "rows", F.coalesce("shown", F.lit(0).cast("bigint")).alias("shown"),
        F.coalesce(F.col("shown") == 0, F.lit(True)).alias("overshadowed"))
