"""Batch and streaming inputs. All of them take or have an explicit schema."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of the daily extracts.
RIDER_COLUMNS = (
    "rider_id",
    "timestamp",
    "latitude",
    "longitude",
    "destination_lat",
    "destination_lng",
    "trip_count",
    "avg_rating",
    "cancellation_rate",
)
DRIVER_COLUMNS = (
    "driver_id",
    "timestamp",
    "latitude",
    "longitude",
    "status",
    "vehicle_type",
    "avg_rating",
    "acceptance_rate",
)


def on_day(ts: str, day: date) -> Column:
    """A half-open range, which every source can push down, unlike a cast to a date."""
    return (F.col(ts) >= F.lit(day)) & (F.col(ts) < F.lit(day + timedelta(days=1)))


def read_day(spark: SparkSession, root: str, schema: T.StructType, day: date, partition: str = "ds") -> DataFrame:
    """One day of a table partitioned by day; other days are pruned."""
    columns = [f for f in schema.fields if f.name != partition]
    table = spark.read.schema(T.StructType([*columns, T.StructField(partition, T.DateType())])).parquet(root)
    return table.where(F.col(partition) == F.lit(day)).drop(partition)


def daily_extract(table: DataFrame, columns: Sequence[str], ts: str, day: date) -> DataFrame:
    return table.where(on_day(ts, day)).select(*columns)


def rider_extract(table: DataFrame, day: date) -> DataFrame:
    return daily_extract(table, RIDER_COLUMNS, "timestamp", day)


def driver_extract(table: DataFrame, day: date) -> DataFrame:
    return daily_extract(table, DRIVER_COLUMNS, "timestamp", day)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: object,
    upper: object,
    partitions: int,
    **options: str,
) -> DataFrame:
    """A warehouse table read in parallel ranges; later filters are pushed down."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=partition_column,
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(partitions),
            **options,
        )
        .load()
    )


def read_topics(
    spark: SparkSession,
    servers: str,
    topics: Sequence[str],
    starting: str = "latest",
    max_per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """A stream of ``value`` text with its origin. Needs Spark's Kafka connector.

    Offsets are kept in the query's checkpoint, which replaces consumer groups.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", starting)
        .options(**options)
    )
    if max_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", str(max_per_trigger))
    return reader.load().select(
        F.col("value").cast("string").alias("value"), "topic", "partition", "offset"
    )


def read_text_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same stream from text files of one JSON record per line."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(path).select(
        "value",
        F.col("_metadata.file_path").alias("topic"),
        F.lit(None).cast("int").alias("partition"),
        F.col("_metadata.file_block_start").alias("offset"),
    )


def read_parquet_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet", max_files: int | None = None
) -> DataFrame:
    """A folder's parquet files as a stream, oldest first."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(folder)
