"""Coordination-service scrapes: text lines to datums and the leader flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom import catalog
from metricloom.catalog import EmitterSettings
from metricloom.functions import dims as D
from metricloom.functions import values as V


def scrape_values(lines: DataFrame, keys: list[str], order: str, column: str = "value") -> DataFrame:
    """Last value of each listed metric per scrape; blank, version and short lines are skipped."""
    line = F.col(column)
    words = F.split(F.regexp_replace(line, r"\A\s+", ""), r"\s+")
    # one element or none, so every line is split once
    listed = F.filter(
        F.when(~F.contains(line, F.lit("zk_version")), F.array(words)),
        lambda w: (F.size(w) >= 2) & w[0].isin(*catalog.COORDINATION_UNITS) & (w[1] != ""),
    )
    pairs = lines.select(*keys, order, F.inline(F.transform(
        listed, lambda w: F.struct(w[0].alias("metric"), w[1].alias("text")))))
    return pairs.groupBy(*keys, "metric").agg(F.max_by("text", order).alias("text"))


def _unit(metric: Column) -> Column:
    units = F.create_map(*[F.lit(x) for pair in catalog.COORDINATION_UNITS.items() for x in pair])
    return F.coalesce(F.try_element_at(units, metric), F.lit("Count"))


def coordination_datums(values: DataFrame, node: str, settings: EmitterSettings = EmitterSettings()) -> DataFrame:
    """Numeric metrics with the node dimension; the leader alone emits the leader flag."""
    common = F.array(
        D.dim(settings.service_dim, F.lit("ZooKeeper")), D.dim(settings.cluster_dim, F.lit(settings.cluster))
    )
    is_state = F.col("metric") == "zk_server_state"
    leads = is_state & (F.col("text") == "leader")
    return values.where(~is_state | leads).withColumns({
        "name": F.when(leads, V.LEADER_METRIC).otherwise(F.col("metric")),
        "number": F.when(leads, F.lit(V.LEADER_VALUE)).otherwise(F.col("text").try_cast("double")),
        "unit": F.when(leads, "None").otherwise(_unit(F.col("metric"))),
        "dims": F.when(leads, common).otherwise(
            F.concat(common, F.array(D.dim("ZooKeeper.ID", F.col(node).cast("string"))))
        ),
    })
