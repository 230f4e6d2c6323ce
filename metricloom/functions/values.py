"""Value conversions on metric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the one metric reported in nanoseconds and stored in milliseconds.
NANOSECOND_METRICS = ("jvm/gc/cpu",)
# The leader flag's name and height.
LEADER_METRIC, LEADER_VALUE = "zk_leader", 3.0


def stored_value(metric: Column, value: Column) -> Column:
    """Whole milliseconds (truncated) for nanosecond metrics, the double itself otherwise."""
    whole = value.cast("double").cast("bigint")
    millis = ((whole - whole % 1_000_000) / 1_000_000).cast("double")
    return F.when(metric.isin(*NANOSECOND_METRICS), millis).otherwise(value.cast("double"))


def percent_range(value: Column, convert: Column) -> Column:
    return F.when(convert, value * 100).otherwise(value)


def ratio_percent(used: Column, total: Column) -> Column:
    return F.try_divide(used, total) * 100


COMPARISONS = {
    ">": lambda value, bound: value > bound,
    ">=": lambda value, bound: value >= bound,
    "<": lambda value, bound: value < bound,
    "<=": lambda value, bound: value <= bound,
}


def breaches(value: Column, compare: str, threshold) -> Column:
    return COMPARISONS[compare](value, F.lit(float(threshold)))


def step_change(value: Column, steps) -> Column:
    """Capacity change of the ``[lower, upper)`` step holding ``value``; 0 outside all steps."""
    change = F
    for lower, upper, amount in steps:
        inside = F.lit(True)
        if lower is not None:
            inside &= value >= F.lit(lower)
        if upper is not None:
            inside &= value < F.lit(upper)
        change = change.when(inside, F.lit(amount))
    return F.lit(0) if change is F else change.otherwise(0)
