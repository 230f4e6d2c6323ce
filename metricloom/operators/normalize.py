"""From raw service events to stored metric datums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom import catalog
from metricloom.catalog import EmitterSettings
from metricloom.functions import dims as D
from metricloom.functions import values as V

DATUM_COLUMNS = ("event_id", "queue", "name", "value", "dims", "unit", "ts", "namespace", "service")


def pin(df: DataFrame, name: str) -> DataFrame:
    """Compute a costly column once for everything that reads it later.

    Filters and projections above would each repeat its expression; the output of a one-element
    explode is a plain column. Filters on the other columns still move below it.
    """
    return df.select(*[F.col(c) for c in df.columns if c != name], F.explode(F.array(name)).alias(name))


def dispatch(events: DataFrame) -> DataFrame:
    """Add ``route``: metric, alert, invalid, or fatal when a metric cannot be handled."""
    unusable = F.col("metric").isNull() | F.col("value").isNull() | F.col("ts").isNull()
    return events.withColumn(
        "route",
        F.when(F.col("kind") == "alert", F.when(F.col("ts").isNull(), "fatal").otherwise("alert"))
        .when(F.col("kind") == "metric", F.when(unusable, "fatal").otherwise("metric"))
        .otherwise("invalid"),
    )


def implicit_dims(settings: EmitterSettings):
    return F.array(
        D.dim(settings.service_dim, F.col("service")),
        D.dim(settings.cluster_dim, F.lit(settings.cluster)),
    )


def metric_datums(events: DataFrame, settings: EmitterSettings, units: DataFrame | None = None) -> DataFrame:
    """Allow-listed metric events as datums; names outside the catalogue vanish silently."""
    units = catalog.unit_table(events.sparkSession) if units is None else units
    known = dispatch(events).where("route = 'metric'").join(units, "metric")
    return known.select(
        "event_id",
        F.lit("metric").alias("queue"),
        F.col("metric").alias("name"),
        V.stored_value(F.col("metric"), F.col("value")).alias("value"),
        F.concat(implicit_dims(settings), D.clean_dims(F.col("dims"))).alias("dims"),
        "unit",
        "ts",
        F.lit(settings.namespace).alias("namespace"),
        "service",
    )


def alert_datums(events: DataFrame, settings: EmitterSettings) -> DataFrame:
    return dispatch(events).where("route = 'alert'").select(
        "event_id",
        F.lit("alert").alias("queue"),
        F.lit(settings.alert_name).alias("name"),
        F.lit(1.0).alias("value"),
        implicit_dims(settings).alias("dims"),
        F.lit("Count").alias("unit"),
        "ts",
        F.lit(settings.namespace).alias("namespace"),
        "service",
    )


def datums(events: DataFrame, settings: EmitterSettings = EmitterSettings()) -> DataFrame:
    return metric_datums(events, settings).unionByName(alert_datums(events, settings))


def with_unit(metrics: DataFrame, units: DataFrame | None = None, default: str = "Count") -> DataFrame:
    """Unit of every metric, ``Count`` for names outside the catalogue."""
    units = catalog.unit_table(metrics.sparkSession) if units is None else units
    return metrics.join(units, "metric", "left").withColumn("unit", F.coalesce("unit", F.lit(default)))


def rollup_dims(events: DataFrame, rollup: DataFrame | None = None) -> DataFrame:
    """Mapped metrics with the dimensions their map entry lists, cleaned, and 0..1 ranges converted.

    The join comes first and the listed names are picked before cleaning, so no work goes into
    unmapped metrics or unlisted dimensions.
    """
    rollup = catalog.rollup_table(events.sparkSession) if rollup is None else rollup
    joined = events.join(rollup, "metric")
    return joined.withColumns({
        "dims": D.clean_dims(D.project_dims(F.col("dims"), F.col("keep_dims"))),
        "value": V.percent_range(F.col("value"), F.col("convert_range")),
    }).drop("keep_dims", "convert_range")


def statsd_rows(events: DataFrame, settings: EmitterSettings = EmitterSettings()) -> DataFrame:
    """Mapped dimension subset and kind, host tag, and the constant cluster tag."""
    return rollup_dims(events.where("kind = 'metric'")).withColumns({
        "tags": F.array(F.lit(f"cluster_name:{settings.cluster}")),
        "host_tag": F.col("host"),
    })
