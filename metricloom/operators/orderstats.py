"""Exact percentiles and trimmed means per group without gathering a group in one task.

Values are binned by a monotone function. Bin counts and sums are partially aggregated where the
rows lie, a running count over the bins finds the one or two bins holding the wanted rank, and
only the rows of those bins are looked at again. Bins that stay large are cut further, along
their own lowest and highest value, until they are small or hold a single value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.session import settle

BINS_PER_OCTAVE = 128
CUTS = 65_536
SMALL_BIN = 200_000


@dataclass(frozen=True)
class Percentile:
    """Linear interpolation between the two neighbouring ranks."""

    name: str
    fraction: float

    def ranks(self, n: Column) -> list[Column]:
        at = F.lit(self.fraction) * (n - 1)
        return [F.floor(at), F.ceil(at)]


@dataclass(frozen=True)
class TrimmedMean:
    """Mean of the ``ceil(percent / 100 * n)`` smallest values."""

    name: str
    percent: int

    def kept(self, n: Column) -> Column:
        return F.floor((n * self.percent + 99) / 100)

    def ranks(self, n: Column) -> list[Column]:
        return [self.kept(n) - 1]


def _log_bin(value: Column) -> Column:
    size = F.least(F.abs(value), F.lit(1.7976931348623157e308))
    return (F.signum(value) * F.floor(F.log2(1 + size) * BINS_PER_OCTAVE)).cast("bigint")


def _linear_cut(value: Column) -> Column:
    width = F.col("__hi") - F.col("__lo")
    return F.when(width > 0, F.floor((value - F.col("__lo")) / width * CUTS)).otherwise(0).cast("bigint")


def _wanted(stats) -> Column:
    """The bin holds at least one wanted rank."""
    first, size = F.col("__before"), F.col("__size")
    hit = F.lit(False)
    for stat in stats:
        for rank in stat.ranks(F.col("__n")):
            hit |= (rank >= first) & (rank < first + size)
    return hit


BIN_MEASURES = {
    "__size": lambda v: F.count(F.lit(1)), "__sum": F.sum, "__lo": F.min, "__hi": F.max,
}


def _measures() -> list[Column]:
    return [make(F.col("__value")).alias(name) for name, make in BIN_MEASURES.items()]


def _running(column: str, partition: list[str], order: str, zero) -> Column:
    below = W.partitionBy(*partition).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(below), F.lit(zero))


def _marks(bins: DataFrame, keys: list[str]) -> DataFrame:
    """One row per bin to look into; ``__before`` is the first rank in it and names it."""
    return bins.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__bin").alias("__k___bin"),
        "__n", "__before", "__below", "__size", "__lo", "__hi",
    )


def _rows_inside(rows: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    same += [F.col("__bin") == F.col("__k___bin"), F.col("__value").between(F.col("__lo"), F.col("__hi"))]
    return rows.join(marks, same)


def _cut_further(rows: DataFrame, marks: DataFrame, keys: list[str], stats) -> DataFrame:
    outer = [*keys, "__bin", "__n", "__before", "__below"]
    inside = _rows_inside(rows, marks, keys).withColumn("__cut", _linear_cut(F.col("__value")))
    parts = inside.groupBy(*outer, "__cut").agg(*_measures())
    bin_keys = [*keys, "__bin", "__before"]
    placed = parts.withColumns({
        "__first": F.col("__before") + _running("__size", bin_keys, "__cut", 0),
        "__lower": F.col("__below") + _running("__sum", bin_keys, "__cut", 0.0),
    }).drop("__before", "__below").withColumnsRenamed({"__first": "__before", "__lower": "__below"})
    return _marks(placed.where(_wanted(stats)), keys)


def order_stats(df: DataFrame, keys: list[str], value: str, stats, small_bin: int = SMALL_BIN) -> DataFrame:
    """One row per group: ``keys``, ``n`` and one column per entry of ``stats``.

    Nulls and NaN are ignored. Two column-pruned scans with partial aggregation replace the
    full shuffle and per-group sort of a windowed rank; the marked bins are written to the
    shared folder, so the second scan joins them by broadcast only when they are small.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__value"))
    rows = rows.where("__value IS NOT NULL AND NOT isnan(__value)")
    rows = rows.withColumn("__bin", _log_bin(F.col("__value")))
    bins = rows.groupBy(*keys, "__bin").agg(*_measures()).withColumns({
        "__n": F.sum("__size").over(W.partitionBy(*keys)),
        "__before": _running("__size", keys, "__bin", 0),
        "__below": _running("__sum", keys, "__bin", 0.0),
    })
    marks = settle(_marks(bins.where(_wanted(stats)), keys), "order-stats")
    while not marks.where((F.col("__size") > small_bin) & (F.col("__lo") < F.col("__hi"))).isEmpty():
        marks = settle(_cut_further(rows, marks, keys, stats), "order-stats")

    outer = [*keys, "__n", "__before", "__below", "__size"]
    values = _rows_inside(rows, marks, keys).groupBy(*outer, "__value").agg(
        F.count(F.lit(1)).alias("__count")
    )
    ranked = values.withColumn(
        "__rank", F.col("__before") + _running("__count", [*keys, "__before"], "__value", 0)
    )
    return ranked.groupBy(*keys, F.col("__n").alias("n")).agg(
        *[_percentile(s) if isinstance(s, Percentile) else _trimmed_mean(s) for s in stats]
    )


def _percentile(stat: Percentile) -> Column:
    def at_rank(rank: Column) -> Column:
        holds = (rank >= F.col("__rank")) & (rank < F.col("__rank") + F.col("__count"))
        return F.max(F.when(holds, F.col("__value")))

    lower, upper = stat.ranks(F.col("__n"))
    share = F.max(F.lit(stat.fraction) * (F.col("__n") - 1) - lower)
    return (at_rank(lower) * (1 - share) + at_rank(upper) * share).alias(stat.name)


def _trimmed_mean(stat: TrimmedMean) -> Column:
    kept = stat.kept(F.col("__n"))
    last_bin = (kept - 1 >= F.col("__before")) & (kept - 1 < F.col("__before") + F.col("__size"))
    taken = F.greatest(F.lit(0), F.least(F.col("__count"), kept - F.col("__rank")))
    total = F.max(F.when(last_bin, F.col("__below"))) + F.sum(F.when(last_bin, F.col("__value") * taken))
    return (total / F.max(kept)).alias(stat.name)
