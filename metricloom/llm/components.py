"""Connected components of a graph given as links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.session import stored


def _large(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = links.union(links.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("to").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("to"))
    # the node itself goes with the neighbours, once
    moved = down.join(least, "a").where("b <> to").select(F.col("b").alias("a"), F.col("to").alias("b"))
    return moved.union(least.select("a", F.col("to").alias("b"))).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """The smallest node reachable from each linked node.

    ``links`` has two columns of one ordered type. Returns (node, root) for every node with a link
    to another one; a link with a null end or of a node to itself adds nothing. No neighbours are
    gathered: every step joins with minima, so a node may have any number of links. Each round is
    written to the shared folder, which also cuts the lineage.
    """
    a, b = links.columns
    now = stored(
        links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), label)
    before = None
    while True:
        now = stored(_small(_large(now)), label)
        size = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if size == before:
            break
        before = size
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
