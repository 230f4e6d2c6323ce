"""Key-value enrichment and size-checked replication of small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.operators import retention
from metricloom.session import stored


def lookup(rows: DataFrame, key: str, table: DataFrame, value: str, default: str | None = None) -> DataFrame:
    """Add ``value`` found under ``key``; rows without a match get ``default``."""
    joined = rows.join(table.select(key, value), key, "left")
    return joined if default is None else joined.withColumn(value, F.coalesce(value, F.lit(default)))


def lookup_map(column: Column, pairs: dict[str, str], default: str | None = None) -> Column:
    """A short constant lookup as an expression, with no join at all."""
    if not pairs:
        return F.lit(default)
    entries = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, column), F.lit(default))


def replicated(rows: DataFrame, ts: str, rules, as_of: str) -> DataFrame:
    """Rows the rules mark for every node, stored: the planner broadcasts them if their bytes allow it."""
    marked = retention.apply_retention(rows, ts, rules, as_of).where("action = 'broadcast'")
    return stored(marked.select(*rows.columns), "replicated")
