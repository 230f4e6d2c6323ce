"""Mergeable sketches with the error they promise: quantiles, frequent items and distinct counts.

Sketches are built per key and period, stored, and merged later; the rows aren't needed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KLL_K = 200
TRACKED = 10_000


def rank_error(k: int = KLL_K) -> float:
    """How far the rank of a KLL estimate may be off, as a share of all rows, in 99 of 100 cases."""
    return 2.296 / k ** 0.9021


def quantile_sketches(rows: DataFrame, keys: list[str], value: str, k: int = KLL_K) -> DataFrame:
    """(keys, kll) of the values that aren't null or NaN."""
    number = F.col(value).cast("double")
    return rows.where(~F.isnan(number)).groupBy(*keys).agg(F.kll_sketch_agg_double(number, F.lit(k)).alias("kll"))


def merge_quantiles(sketches: DataFrame, keys: list[str], k: int = KLL_K) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("kll", F.lit(k)).alias("kll"))


def quantile_estimates(merged: DataFrame, keys: list[str], ranks: list[float]) -> DataFrame:
    """(keys, n, rank, estimate): one row for each rank between 0 and 1."""
    each = [F.struct(F.lit(r).alias("rank"), F.kll_sketch_get_quantile_double("kll", F.lit(r)).alias("estimate")) for r in ranks]
    return merged.select(*keys, F.kll_sketch_get_n_double("kll").alias("n"), F.inline(F.array(*each)))


def true_ranks(rows: DataFrame, keys: list[str], value: str, estimates: DataFrame) -> DataFrame:
    """Estimates with the exact share of the key's values below each (``low``) and up to it (``high``).

    One pass over the rows does for all ranks: a row is put between two of its key's estimates, and rows of one
    place are counted where they lie. ``keys`` hold no nulls.
    """
    listed = estimates.groupBy(*keys).agg(F.array_sort(F.collect_set("estimate")).alias("__at"))
    number = F.col(value).cast("double")
    placed = rows.where(~F.isnan(number)).join(listed, keys).select(
        *keys, "__at", F.size(F.filter("__at", lambda x: x < number)).alias("__less"),
        F.exists("__at", lambda x: x == number).cast("int").alias("__same"))
    counted = placed.groupBy(*keys, "__at", "__less", "__same").agg(F.count("*").alias("__n"))
    # a key has two rows for each of its estimates by now
    shares = counted.select(*keys, "__less", "__same", "__n", F.posexplode("__at").alias("__place", "estimate")).groupBy(
        *keys, "estimate").agg(
        (F.sum(F.when(F.col("__less") + F.col("__same") <= F.col("__place"), F.col("__n")).otherwise(0)) / F.sum("__n")).alias("low"),
        (F.sum(F.when(F.col("__less") <= F.col("__place"), F.col("__n")).otherwise(0)) / F.sum("__n")).alias("high"))
    return estimates.join(shares, [*keys, "estimate"])


def within(rank: Column, low: Column, high: Column, error: float) -> Column:
    """Whether a rank lies at most ``error`` outside what a value covers."""
    return (rank >= low - error) & (rank <= high + error)


def frequent_sketches(rows: DataFrame, keys: list[str], item: str, tracked: int = TRACKED) -> DataFrame:
    """(keys, top): counters of at most ``tracked`` items for each key."""
    return rows.groupBy(*keys).agg(F.expr(f"approx_top_k_accumulate(`{item}`, {tracked})").alias("top"))


def merge_frequent(sketches: DataFrame, keys: list[str], tracked: int = TRACKED) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.expr(f"approx_top_k_combine(top, {tracked})").alias("top"))


def frequent_items(merged: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, item, estimate) of the ``n`` items with the highest counters."""
    return merged.select(*keys, F.explode(F.expr(f"approx_top_k_estimate(top, {n})")).alias("x")).select(
        *keys, F.col("x.item").alias("item"), F.col("x.count").cast("bigint").alias("estimate"))


def frequency_error(n: Column, tracked: int = TRACKED) -> Column:
    """How far a counter may be off: a map of at most ``tracked`` counters, three quarters full, gives up the median."""
    return F.ceil(n * 3.5 / tracked)
