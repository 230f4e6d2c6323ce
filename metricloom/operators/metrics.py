"""Windowed statistics, ratios, searches, grouping sets and kind-aware roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom import session
from metricloom.catalog import CPU_TOTAL, HOST_MEASURES, IGNORED_FILE_SYSTEMS, PanelLine
from metricloom.functions import dims as D
from metricloom.functions import values as V
from metricloom.operators.normalize import pin
from metricloom.operators.orderstats import Percentile, TrimmedMean, order_stats

RANK_STATISTICS = {"p99": Percentile("p99", 0.99), "tm99": TrimmedMean("tm99", 99)}
PLAIN_STATISTICS = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": lambda c: F.count(F.lit(1)),
}


def bucket(ts: Column, period: str) -> Column:
    """Start of the epoch-aligned ``[start, end)`` period holding ``ts``."""
    return F.window(ts, period)["start"]


def search(datums: DataFrame, metric: str, tokens: dict, by: str, namespace: str | None = None) -> DataFrame:
    """Rows holding every token and carrying dimension ``by``, which becomes a column."""
    found = datums.where(F.col("name") == metric)
    if namespace is not None:
        found = found.where(F.col("namespace") == namespace)
    found = pin(found, "dims")
    for name, value in tokens.items():
        found = found.where(D.has_dim(F.col("dims"), name, value))
    return found.withColumn(by, D.dim_value(F.col("dims"), by)).where(F.col(by).isNotNull())


def windowed(df: DataFrame, keys: list[str], period: str, statistics: list[str], value: str = "value",
             ts: str = "ts", stored: bool = False) -> DataFrame:
    """``keys`` and ``bucket`` with one column per statistic.

    Rank statistics read their input twice. With ``stored`` its few columns are written once
    first, for inputs that cost more to compute than to store.
    """
    group = [*keys, "bucket"]
    rows = df.select(*keys, bucket(F.col(ts), period).alias("bucket"), value)
    rows = session.stored(rows, "windowed") if stored else rows
    plain = [s for s in statistics if s in PLAIN_STATISTICS]
    ranked = [RANK_STATISTICS[s] for s in statistics if s not in PLAIN_STATISTICS]
    if not ranked:
        return rows.groupBy(*group).agg(*[PLAIN_STATISTICS[s](F.col(value)).alias(s) for s in plain])
    stats = order_stats(rows, group, value, ranked).drop("n")
    if not plain:
        return stats
    sums = rows.groupBy(*group).agg(*[PLAIN_STATISTICS[s](F.col(value)).alias(s) for s in plain])
    return sums.join(stats, group, "left")


def ratio(df: DataFrame, keys: list[str], period: str, used: Column, total: Column, statistic: str = "sum",
          ts: str = "ts") -> DataFrame:
    """``used / total * 100`` of two series aggregated in one pass."""
    agg = PLAIN_STATISTICS[statistic]
    sides = df.withColumn("bucket", bucket(F.col(ts), period)).groupBy(*keys, "bucket").agg(
        agg(used).alias("used"), agg(total).alias("total")
    )
    return sides.withColumn("percent", V.ratio_percent(F.col("used"), F.col("total")))


def rollup_by_kind(events: DataFrame, keys: list[str], period: str, order: list[str]) -> DataFrame:
    """Counts are summed, gauges keep the last value, timers give count, mean and p99.

    ``events`` carries ``metric``, ``rollup_kind``, ``value``, ``ts`` and the ``order`` columns.
    Its narrow rows are written once, since three aggregations read them.
    """
    group = ["metric", "rollup_kind", *keys, "bucket"]
    narrow = events.withColumn("bucket", bucket(F.col("ts"), period)).select(*group, "value", *order)
    rows = session.stored(narrow, "rollup")

    def only(kind, column):
        return F.when(F.col("rollup_kind") == kind, column)

    # counts and timers share a partial aggregation; max_by is partial too
    base = rows.groupBy(*group).agg(
        only("count", F.sum("value")).alias("total"),
        only("gauge", F.max_by("value", F.struct(*order))).alias("last"),
        only("timer", F.count(F.lit(1))).alias("samples"),
        only("timer", F.avg("value")).alias("mean"),
    )
    timers = order_stats(rows.where("rollup_kind = 'timer'"), group, "value", [RANK_STATISTICS["p99"]])
    return base.join(timers.drop("n"), group, "left")


def panel_series(rows: DataFrame, panels: list[PanelLine], metric: str = "metric") -> DataFrame:
    """(panel, metric, statistic, period, series, bucket, value) of all dashboard panels.

    ``rows`` have the metric, value, ts and a column for every dimension a panel names. A panel's rows
    hold all its tokens and, if it fans out, carry that dimension, whose value is the series. A row may
    serve several panels; there is one aggregation for each period and kind of statistic.
    """

    def serves(line: PanelLine) -> Column:
        hit = F.col(metric).isin(*line.metric.split("/")) if line.ratio else F.col(metric) == line.metric
        for name, value in line.tokens:
            hit &= F.col(name) == value
        return hit if line.by is None else hit & F.col(line.by).isNotNull()

    lines = list(enumerate(panels))
    shown = F.explode(F.array_compact(F.array(*[
        F.when(serves(line), F.struct(
            F.lit(i).alias("line"), (F.lit(None) if line.by is None else F.col(line.by)).cast("string").alias("series")))
        for i, line in lines])))
    served = rows.select(F.col(metric).alias("__metric"), "value", "ts", shown.alias("__s")).select(
        "__metric", "value", "ts", "__s.line", "__s.series")
    parts = []
    for kind in sorted({(p.period, p.statistic, p.ratio) for p in panels}):
        period, statistic, is_ratio = kind
        mine = [(i, p) for i, p in lines if (p.period, p.statistic, p.ratio) == kind]
        wanted = served.where(F.col("line").isin(*[i for i, _ in mine]))
        if is_ratio:
            used, total = ({i: p.metric.split("/")[side] for i, p in mine} for side in (0, 1))
            pick = lambda names: F.when(reduce(
                lambda x, y: x | y, [(F.col("line") == i) & (F.col("__metric") == m) for i, m in names.items()]), F.col("value"))
            made = ratio(wanted, ["line", "series"], period, pick(used), pick(total), statistic)
            parts.append(made.select("line", "series", "bucket", F.col("percent").alias("value")))
        else:
            made = windowed(wanted, ["line", "series"], period, [statistic])
            parts.append(made.select("line", "series", "bucket", F.col(statistic).alias("value")))
    names = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in (
        ("panel", p.panel), ("metric", p.metric), ("statistic", p.statistic), ("period", p.period))]) for p in panels])
    whole = reduce(DataFrame.unionByName, parts).withColumn("__p", F.element_at(names, F.col("line") + 1))
    return whole.select("__p.*", "series", "bucket", "value")


def long_measures(df: DataFrame, ids: list[str], families: dict[str, tuple[str, ...]]) -> DataFrame:
    """Wide host samples to one row per measurement, keeping the listed measurements only."""
    listed = [m for measures in families.values() for m in measures if m in df.columns]
    # a row's measurements stay where it was dealt to, which an unpivot wouldn't keep
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in listed])
    return df.select(*ids, F.inline(each)).where("value IS NOT NULL")


def host_samples(df: DataFrame, ids: list[str], cluster: str, core: str = "core", fstype: str = "fstype") -> DataFrame:
    """The host agent's measurements, one row each, tagged with the cluster.

    Processor measures are taken of single cores and not of their total, disk measures not of the
    ignored file systems.
    """
    long = long_measures(df, [*ids, core, fstype], HOST_MEASURES)
    of = {name: F.col("measure").isin(*measures) for name, measures in HOST_MEASURES.items()}
    left_out = (of["cpu"] & (F.col(core) == CPU_TOTAL)) | (of["disk"] & F.col(fstype).isin(*IGNORED_FILE_SYSTEMS))
    return long.where(~left_out).withColumn("cluster", F.lit(cluster))


def host_grouping_sets(df: DataFrame, sets: list[list[str]], measures: list[Column]) -> DataFrame:
    """One aggregation over several dimension subsets; ``set_id`` tells them apart."""
    names = list(dict.fromkeys(name for one in sets for name in one))
    return df.groupingSets(sets, *names).agg(
        F.grouping_id(*names).cast("bigint").alias("set_id"), *measures
    )
