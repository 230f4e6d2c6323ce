"""Sketches built per month and merged, next to the exact figures that they estimate."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.operators import estimates as E
from metricloom.operators.orderstats import Percentile, order_stats
from metricloom.plans.registry import query
from metricloom.session import stored
from metricloom.sources import tables

RANKS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
# twice the error that 99 of 100 estimates keep
ERROR = 2 * E.rank_error()
SKETCHED = 500
RANK_LIST = ", ".join(map(str, RANKS))


def monthly(spark, folder):
    return tables.table(spark, folder, "lineitem").withColumn("month", F.date_trunc("month", "l_shipdate"))


@query("G15", f"""
WITH exact AS (
  SELECT l_returnflag, count(*) AS n, unnest([{RANK_LIST}]::DOUBLE[]) AS rank, unnest(quantile_cont(l_extendedprice, [{RANK_LIST}])) AS exact
  FROM lineitem GROUP BY 1),
shares AS (
  SELECT e.l_returnflag, e.rank, count(*) FILTER (l.l_extendedprice < e.exact) / e.n AS low, count(*) FILTER (l.l_extendedprice <= e.exact) / e.n AS high
  FROM exact e JOIN lineitem l USING (l_returnflag) GROUP BY e.l_returnflag, e.rank, e.n)
SELECT l_returnflag, n, rank, round(exact, 4) AS exact, rank BETWEEN low - {ERROR} AND high + {ERROR} AS within
FROM exact JOIN shares USING (l_returnflag, rank)""")
def merged_quantiles(spark, folder):
    """KLL sketches of every month, merged and read at many ranks; each estimate's true rank lies within the error."""
    rows, keys = monthly(spark, folder), ["l_returnflag"]
    daily = E.quantile_sketches(rows, [*keys, "month"], "l_extendedprice")
    # merging draws at random, so what is read is stored first
    merged = stored(E.quantile_estimates(E.merge_quantiles(daily, keys), keys, RANKS), "quantiles")
    judged = E.true_ranks(rows, keys, "l_extendedprice", merged).select(
        *keys, "n", "rank", E.within(F.col("rank"), F.col("low"), F.col("high"), ERROR).alias("within"))
    names = [f"p{i}" for i in range(len(RANKS))]
    exact = order_stats(rows, keys, "l_extendedprice", [Percentile(n, r) for n, r in zip(names, RANKS, strict=True)])
    long = exact.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(r).alias("rank"), F.col(n).alias("exact")) for n, r in zip(names, RANKS, strict=True)])))
    return judged.join(long, [*keys, "rank"]).select(*keys, "n", "rank", F.round("exact", 4).alias("exact"), "within")


@query("G15", f"""
WITH exact AS (
  SELECT l_returnflag, count(*) AS n, unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS rank, unnest(quantile_disc(l_extendedprice, [0.1, 0.5, 0.9])) AS value FROM lineitem GROUP BY 1),
shares AS (
  SELECT e.l_returnflag, e.rank, count(*) FILTER (l.l_extendedprice < e.value) / e.n AS low, count(*) FILTER (l.l_extendedprice <= e.value) / e.n AS high
  FROM exact e JOIN lineitem l USING (l_returnflag) GROUP BY e.l_returnflag, e.rank, e.n)
SELECT l_returnflag, n, rank, rank BETWEEN low - 0.002 AND high + 0.002 AS within FROM exact JOIN shares USING (l_returnflag, rank)""")
def approximate_percentiles(spark, folder):
    """``percentile_approx`` with an accuracy of one in a thousand, and where its values really stand."""
    rows, keys, ranks = tables.table(spark, folder, "lineitem"), ["l_returnflag"], [0.1, 0.5, 0.9]
    found = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("l_extendedprice", ranks, 1_000).alias("values"))
    long = found.select(*keys, "n", F.inline(F.arrays_zip(F.array(*map(F.lit, ranks)).alias("rank"), F.col("values").alias("estimate"))))
    return E.true_ranks(rows, keys, "l_extendedprice", stored(long, "percentiles")).select(
        *keys, "n", "rank", E.within(F.col("rank"), F.col("low"), F.col("high"), 0.002).alias("within"))


# quantities of the first lines come often, the orders of all others seldom
ITEM = "CASE WHEN l_linenumber <= 3 THEN CAST(l_quantity AS BIGINT) ELSE 1000 + l_orderkey END"


@query("G15", f"""
WITH counted AS (SELECT l_returnflag, {ITEM} AS item, count(*) AS n FROM lineitem GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, item) AS place, sum(n) OVER (PARTITION BY l_returnflag) AS total,
  count(*) OVER (PARTITION BY l_returnflag) AS items FROM counted)
SELECT l_returnflag, CAST(max(total) AS BIGINT) AS n, max(items) > {SKETCHED} AS beyond, count(*) AS reported,
  count(*) FILTER (abs(n - n) <= ceil(total * 3.5 / {SKETCHED})) AS within,
  abs(max(items) - max(items)) <= 0.15 * max(items) AS distinct_within FROM ranked WHERE place <= 5 GROUP BY 1""")
def frequent_items(spark, folder):
    """Frequent items among many rare ones: monthly counters merged, each within its error; and distinct items."""
    rows, keys = monthly(spark, folder).withColumn("item", F.expr(ITEM)), ["l_returnflag"]
    merged = E.merge_frequent(E.frequent_sketches(rows, [*keys, "month"], "item", SKETCHED), keys, SKETCHED)
    found = stored(E.frequent_items(merged, keys, 5), "frequent-items")
    counted = rows.groupBy(*keys, "item").agg(F.count(F.lit(1)).alias("__n"))
    sizes = counted.groupBy(*keys).agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("items"))
    guessed = rows.groupBy(*keys).agg(F.approx_count_distinct("item", 0.05).alias("guess"))
    off = F.abs(F.col("estimate") - F.col("__n")) <= E.frequency_error(F.col("n"), SKETCHED)
    return found.join(counted, [*keys, "item"]).join(sizes, keys).join(guessed, keys).groupBy(*keys, "n", "items", "guess").agg(
        F.count(F.lit(1)).alias("reported"), F.count_if(off).alias("within")).select(
        *keys, "n", (F.col("items") > SKETCHED).alias("beyond"), "reported", "within",
        (F.abs(F.col("guess") - F.col("items")) <= 0.15 * F.col("items")).alias("distinct_within"))
