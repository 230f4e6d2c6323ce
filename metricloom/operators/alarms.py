"""M-of-N threshold alarms over dense period grids, and their state changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.catalog import AlarmRule
from metricloom.functions import values as V
from metricloom.operators import metrics as M

ALARM, OK, INSUFFICIENT = "ALARM", "OK", "INSUFFICIENT_DATA"


# periods made by one row; a longer span is cut, so no array grows with it
PIECE = 1_000


def dense_grid(points: DataFrame, keys: list[str], period: str, start: str = "bucket", until=None, since=None) -> DataFrame:
    """Every period from a series' first bucket to its last, with null values where one is missing.

    With ``until`` all series go on to the last period that begins no later, so one that stopped
    reporting is missing from there on; with ``since`` none begins before it. A series' buckets are its
    aggregated periods, so the grid grows with time, not with rows.
    """
    step = F.expr(f"INTERVAL {period}")
    first, last = F.min(start), F.max(start)
    if since is not None:
        first = F.greatest(first, F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        last = F.greatest(last, F.lit(until).cast("timestamp_ntz"))
    span = points.groupBy(*keys).agg(first.alias("__first"), last.alias("__last")).where("__first <= __last")
    pieces = span.select(*keys, "__last", F.explode(F.sequence("__first", "__last", step * PIECE)).alias("__from"))
    upto = F.least(F.col("__last"), F.col("__from") + step * (PIECE - 1))
    grid = pieces.select(*keys, F.explode(F.sequence("__from", upto, step)).alias(start))
    return grid.join(points, [*keys, start], "left")


def rule_case(rules: list[AlarmRule], pick, rule: str = "alarm") -> Column:
    """The rule-specific column ``pick(rule)`` chosen by the ``alarm`` column."""
    chosen = F
    for one in rules:
        chosen = chosen.when(F.col(rule) == one.name, pick(one))
    return chosen


def rule_points(datums: DataFrame, rules, metric: str = "metric") -> DataFrame:
    """(alarm, bucket, value) of rules that share a period, from datums with metric, value, ts and the rules' dims.

    A datum may serve several rules. A rule on "a/b" compares the first metric's statistic with the
    second's, in percent.
    """
    [period] = {rule.period for rule in rules}

    def serves(rule: AlarmRule) -> Column:
        hit = F.col(metric).isin(*rule.metric.split("/")) if rule.ratio else F.col(metric) == rule.metric
        for name, value in rule.dims.items():
            hit &= F.col(name) == value
        return hit

    named = datums.select(
        metric, "value", "ts", F.explode(F.array_compact(F.array(*[F.when(serves(r), r.name) for r in rules]))).alias("alarm"))
    parts = []
    for statistic in sorted({r.statistic for r in rules if not r.ratio}):
        mine = [r.name for r in rules if r.statistic == statistic and not r.ratio]
        stats = M.windowed(named.where(F.col("alarm").isin(*mine)), ["alarm"], period, [statistic])
        parts.append(stats.select("alarm", "bucket", F.col(statistic).alias("value")))
    for rule in (r for r in rules if r.ratio):
        used, total = (F.when(F.col(metric) == m, F.col("value")) for m in rule.metric.split("/"))
        shares = M.ratio(named.where(F.col("alarm") == rule.name), ["alarm"], period, used, total, rule.statistic)
        parts.append(shares.select("alarm", "bucket", F.col("percent").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def catalogue_states(datums: DataFrame, rules, until=None) -> DataFrame:
    """States of all rules, each at its own period, up to ``until``."""
    parts = []
    for period in sorted({rule.period for rule in rules}):
        mine = [rule for rule in rules if rule.period == period]
        parts.append(evaluate(rule_points(datums, mine), [], mine, period, until))
    return reduce(DataFrame.unionByName, parts)


def evaluate(points: DataFrame, keys: list[str], rules: list[AlarmRule], period: str, until=None, since=None) -> DataFrame:
    """State of every alarm at every period; ``until`` and ``since`` as in ``dense_grid``.

    ``points`` has ``alarm`` (a rule's name), ``keys``, ``bucket`` and ``value``. Rules with
    different N share one sort: their frames run over the same window partition.
    """
    series = ["alarm", *keys]
    grid = dense_grid(points, series, period, until=until, since=since)
    breach = rule_case(rules, lambda r: V.breaches(F.col("value"), r.compare, r.threshold))
    rows = grid.withColumns({
        "breach": F.coalesce(breach, F.lit(False)).cast("int"),
        "present": F.col("value").isNotNull().cast("int"),
    })
    order = W.partitionBy(*series).orderBy("bucket")

    def last(column: str, n: int) -> Column:
        return F.sum(column).over(order.rowsBetween(-(n - 1), 0))

    rows = rows.withColumns({
        "breaches": rule_case(rules, lambda r: last("breach", r.evaluations)),
        "datapoints": rule_case(rules, lambda r: last("present", r.evaluations)),
    })
    state = rule_case(
        rules,
        lambda r: F.when(F.lit(r.missing == "missing") & (F.col("datapoints") == 0), INSUFFICIENT)
        .when(F.col("breaches") >= r.datapoints, ALARM).otherwise(OK),
    )
    return rows.select(*series, "bucket", "value", "breaches", "datapoints", state.alias("state"))


def transitions(states: DataFrame, keys: list[str]) -> DataFrame:
    """Rows where a series enters another state; the first state counts as entered from none."""
    order = W.partitionBy("alarm", *keys).orderBy("bucket")
    return (
        states.withColumn("previous", F.lag("state").over(order))
        .where(~F.col("state").eqNullSafe(F.col("previous")))
        .select("alarm", *keys, "bucket", F.coalesce("previous", F.lit("NONE")).alias("previous"), "state")
    )


def scaling_change(points: DataFrame, steps, value: str = "value") -> DataFrame:
    return points.withColumn("change", V.step_change(F.col(value), steps).cast("bigint"))
