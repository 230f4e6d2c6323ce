"""Running totals over long ordered groups, split into blocks so no task holds a whole group.

A plain window sorts all rows of a key in one task. Here a key is cut into blocks along its
order, each block is scanned on its own, and the blocks' totals (one row per block) carry the
offset from block to block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def time_block(ts: Column, width: str) -> Column:
    return F.window(ts, width)["start"]


def number_block(order: Column, width: int) -> Column:
    return F.floor(order / F.lit(width))


def running(df: DataFrame, keys: list[str], order: list[str], block: Column, sums: dict[str, Column],
            inclusive: bool = True, coarser: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add one running sum per entry of ``sums`` over ``keys`` in ``order``.

    ``block`` must never decrease along ``order`` within a key. With ``inclusive=False`` a row's
    own value is left out. ``coarser`` maps a block to a wider one; give it where a key has so
    many fine blocks that even their totals should be scanned in pieces.
    """
    names = list(sums)
    # one struct column groups, sorts and joins, so the rows are shuffled once; structs also
    # compare null keys as equal
    rows = df.select(
        "*", F.struct(*keys, block.alias("__block")).alias("__at"),
        *[c.alias(f"__part_{n}") for n, c in sums.items()],
    )
    totals = rows.groupBy("__at").agg(*[F.sum(f"__part_{n}").alias(f"__total_{n}") for n in names])
    if coarser is None:
        earlier = W.partitionBy(*[F.col("__at")[k] for k in keys]).orderBy(F.col("__at")["__block"]).rowsBetween(
            W.unboundedPreceding, -1)
        carry = totals.select(
            F.col("__at").alias("__from"),
            *[F.coalesce(F.sum(f"__total_{n}").over(earlier), F.lit(0)).alias(f"__carry_{n}") for n in names],
        )
    else:
        flat = totals.select(
            F.col("__at").alias("__outer"), *[F.col("__at")[k].alias(k) for k in keys],
            F.col("__at")["__block"].alias("__fine"), *[f"__total_{n}" for n in names])
        carry = running(
            flat, keys, ["__fine"], coarser(F.col("__fine")),
            {f"__carry_{n}": F.col(f"__total_{n}") for n in names}, inclusive=False,
        ).select(F.col("__outer").alias("__from"), *[f"__carry_{n}" for n in names])

    inside = W.partitionBy("__at").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    scanned = rows.withColumns(
        {f"__in_{n}": F.coalesce(F.sum(f"__part_{n}").over(inside), F.lit(0)) for n in names}
    )
    joined = scanned.join(carry, F.col("__at") == F.col("__from"))
    return joined.select(
        *df.columns, *[(F.col(f"__in_{n}") + F.col(f"__carry_{n}")).alias(n) for n in names],
    )


def row_numbers(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str = "rn",
                coarser: Callable[[Column], Column] | None = None) -> DataFrame:
    return running(df, keys, order, block, {name: F.lit(1).cast("bigint")}, coarser=coarser)
