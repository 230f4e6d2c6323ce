"""File formats, storage addresses, stream connectors and event readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.dims import RAW_DIMS

BUILT_IN = ("parquet", "orc", "json", "csv", "text")
# readers that come as separate Spark packages
PACKAGED = {"avro": "spark-avro", "kafka": "spark-sql-kafka", "kinesis": "spark-sql-kinesis"}

# text formats cut to milliseconds unless told otherwise
TEXT_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}

EVENT_SCHEMA = (
    "event_id bigint, kind string, ts timestamp_ntz, service string, host string, metric string, "
    f"value double, severity string, description string, dims {RAW_DIMS}"
)


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema=None,
               **options) -> DataFrame:
    """Any built-in or packaged format at any Hadoop file-system address (hdfs://, s3a://, file:/)."""
    reader = spark.read.format(format).options(**options)
    if schema:
        reader = reader.schema(schema)
    try:
        return reader.load(path)
    except Exception as error:
        if format in PACKAGED:
            raise RuntimeError(f"format {format!r} needs the {PACKAGED[format]} package") from error
        raise


def write_table(df: DataFrame, path: str, format: str = "parquet", partition: list[str] | None = None,
                **options) -> None:
    exact = TEXT_TIMES if format in ("json", "csv") else {}
    writer = df.write.format(format).options(**{**exact, **options})
    (writer.partitionBy(*partition) if partition else writer).save(path)


def landed_logs(spark: SparkSession, path: str, schema: str | None = None, separator: str = " ") -> DataFrame:
    """Access or flow logs under a landing prefix; their columns are the caller's to name."""
    if schema is None:
        return spark.read.text(path)
    return spark.read.schema(schema).option("sep", separator).option("mode", "PERMISSIVE").csv(path)


def metric_events(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Service events; rows without any content are ignored."""
    return read_table(spark, path, format, EVENT_SCHEMA).where("kind IS NOT NULL OR metric IS NOT NULL")


def stream_events(spark: SparkSession, path: str, schema, format: str = "parquet", glob: str | None = None,
                  files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of ``path``: one file, or a folder with files at any depth."""
    reader = spark.readStream.format(format).schema(schema).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_topic(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """A Kafka topic of JSON events (needs the connector package on the class path)."""
    try:
        raw = (
            spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).load()
        )
    except Exception as error:
        raise RuntimeError(f"stream connector needs the {PACKAGED['kafka']} package") from error
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e"), "partition", "offset").select(
        "e.*", "partition", "offset"
    )
