"""Set operations over keyed snapshots and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stored_intersection(claimed: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return claimed.join(stored.select(key).distinct(), key, "left_semi")


def replace_changes(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """The change set of a full replace: every existing row deleted, every desired one created."""
    return existing.withColumn("change", F.lit("delete")).unionByName(
        desired.withColumn("change", F.lit("create"))
    )


def minimal_changes(existing: DataFrame, desired: DataFrame, keys: list[str]) -> DataFrame:
    """The change set that reaches the same table touching only rows that differ.

    Both sides hold a key once. One shuffle on the keys, no join: rows are reduced to their
    old and new state per key.
    """
    values = [c for c in desired.columns if c not in keys]

    def side(df, old, new):
        state = F.struct(*values)
        shape = F.lit(None)
        return df.select(
            *keys,
            (state if old else shape).alias("__old"),
            (state if new else shape).alias("__new"),
        )

    both = side(existing, True, False).unionByName(side(desired, False, True))
    states = both.groupBy(*keys).agg(
        F.max("__old").alias("__old"), F.max("__new").alias("__new"),
    )
    change = (
        F.when(F.col("__new").isNull(), "delete")
        .when(F.col("__old").isNull(), "create")
        .when(F.col("__old") != F.col("__new"), "update")
        .otherwise("keep")
    )
    return states.select(*keys, F.coalesce("__new", "__old").alias("__row"), change.alias("change")).select(
        *keys, *[F.col("__row")[v].alias(v) for v in values], "change"
    )


def ordered_distinct(first: Column, second: Column) -> Column:
    return F.array_distinct(F.concat(first, second))
