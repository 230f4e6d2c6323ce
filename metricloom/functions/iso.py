"""ISO-8601 periods and intervals, read once from the rule into constant columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PERIOD = re.compile(
    r"P(?:(?P<years>\d+)Y)?(?:(?P<months>\d+)M)?(?:(?P<weeks>\d+)W)?(?:(?P<days>\d+)D)?"
    r"(?:T(?:(?P<hours>\d+)H)?(?:(?P<mins>\d+)M)?(?:(?P<secs>\d+)S)?)?"
)


def period_parts(text: str) -> dict[str, int]:
    match = _PERIOD.fullmatch(text)
    parts = {k: int(v) for k, v in match.groupdict().items() if v} if match else {}
    if not parts:
        raise ValueError(f"not an ISO period: {text!r}")
    return parts


def before(as_of: Column, period: str) -> Column:
    """``as_of`` minus a calendar-aware period."""
    return as_of - F.make_interval(**{k: F.lit(v) for k, v in period_parts(period).items()})


def interval_bounds(text: str) -> tuple[Column, Column]:
    start, _, end = text.partition("/")
    if not end:
        raise ValueError(f"not an ISO interval: {text!r}")
    return F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
