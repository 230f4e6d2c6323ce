"""Ordered, first-match time rules over rows, and what they keep per tier."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions import iso

ACTIONS = {"load": "load", "drop": "drop", "broadcast": "broadcast"}


@dataclass(frozen=True)
class Rule:
    type: str
    period: str | None = None
    interval: str | None = None
    include_future: bool = False
    replicants: dict = field(default_factory=dict, hash=False)

    def action(self) -> str:
        for action in ACTIONS:
            if self.type.startswith(action):
                return action
        raise ValueError(f"unknown rule type {self.type!r}")

    def matches(self, ts: Column, as_of: Column) -> Column:
        shape = self.type.removeprefix(self.action())
        if shape == "Forever":
            return F.lit(True)
        if shape == "ByInterval" and self.interval:
            start, end = iso.interval_bounds(self.interval)
            return (ts >= start) & (ts < end)
        if shape == "ByPeriod" and self.period:
            recent = ts >= iso.before(as_of, self.period)
            return recent if self.include_future else recent & (ts < as_of)
        if self.type == "dropBeforeByPeriod" and self.period:
            return ts < iso.before(as_of, self.period)
        raise ValueError(f"rule {self.type!r} needs its period or interval")


    def earliest(self, as_of: Column) -> Column | None:
        """Lower bound of the matching times, None if there is none."""
        if self.period and self.type != "dropBeforeByPeriod":
            return iso.before(as_of, self.period)
        return iso.interval_bounds(self.interval)[0] if self.interval else None


DEFAULT_CHAIN = (Rule("loadForever", replicants={"default": 2}),)


def as_of_column(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def apply_retention(df: DataFrame, ts: str, rules, as_of: str, default=DEFAULT_CHAIN) -> DataFrame:
    """Add ``rule_no`` (1-based), ``action`` and ``replicants`` of the first matching rule.

    Each column is one flat CASE over constant bounds: no join, no shuffle.
    """
    now = as_of_column(as_of)
    number, action, replicants = F, F, F
    for i, rule in enumerate([*rules, *default], start=1):
        hit = rule.matches(F.col(ts), now)
        number = number.when(hit, F.lit(i))
        action = action.when(hit, F.lit(rule.action()))
        replicants = replicants.when(hit, _replicant_map(rule))
    return df.withColumns({"rule_no": number, "action": action, "replicants": replicants})


def _replicant_map(rule: Rule) -> Column:
    if not rule.replicants:
        return F.from_json(F.lit("{}"), "map<string,int>")
    return F.create_map(*[F.lit(x) for pair in rule.replicants.items() for x in pair]).cast("map<string,int>")


def earliest_kept(rules, as_of: Column) -> Column | None:
    """A constant no kept row lies before, None if the rules keep rows of any age.

    Rows that reach a dropBefore or dropForever rule and are old enough are gone, so only the
    keep rules above it can hold older ones.
    """
    bounds = []
    for rule in rules:
        if rule.type == "dropBeforeByPeriod":
            bounds.append(iso.before(as_of, rule.period))
        if rule.type in ("dropBeforeByPeriod", "dropForever"):
            return F.least(*bounds) if len(bounds) > 1 else bounds[0] if bounds else None
        if rule.action() != "drop":
            bound = rule.earliest(as_of)
            if bound is None:
                return None
            bounds.append(bound)
    return None


def retained(df: DataFrame, ts: str, rules, as_of: str) -> DataFrame:
    """Rows no rule drops. The age bound the rules imply is a plain filter that reaches the scan."""
    bound = earliest_kept([*rules, *DEFAULT_CHAIN], as_of_column(as_of))
    young = df if bound is None else df.where(F.col(ts) >= bound)
    kept = apply_retention(young, ts, rules, as_of).where("action <> 'drop'")
    return kept.select(*df.columns)


def tier_bytes(df: DataFrame, ts: str, rules, as_of: str, size: str = "bytes") -> DataFrame:
    """Bytes and segments each tier must hold: size times the tier's replicas."""
    loaded = apply_retention(df, ts, rules, as_of).where("action = 'load'")
    fanned = loaded.select(F.col(size).alias("__size"), F.explode("replicants").alias("tier", "replicas"))
    return fanned.groupBy("tier").agg(
        F.sum(F.col("__size") * F.col("replicas")).alias("bytes"), F.sum("replicas").alias("copies")
    )


def purge(files: DataFrame, modified: str, period: str, as_of: str) -> DataFrame:
    """Files older than ``period``: the ones to delete.

    The bound is a constant, so it reaches the scan and prunes date partitions.
    """
    return files.where(F.col(modified) < iso.before(as_of_column(as_of), period))
