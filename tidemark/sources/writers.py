"""Batch outputs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import iso_format
from ..functions.events import route_of, topic_of
from ..functions.ids import features_hash, record_id
from ..operators.quality import Expectation, observed

LOG_TTL = timedelta(hours=24)


def write_days(
    df: DataFrame, root: str, partition: str = "ds", expectations: Sequence[Expectation] = ()
) -> Observation:
    """Replace the days that ``df`` holds and no others; rows are counted on the way.

    Running a day again gives the same table. The observation has the row count
    and the failures of the expectations, without a second pass. Rows are brought
    together by day; adaptive execution splits a day that is too large for one
    task and merges small ones.
    """
    counted, observation = observed(df, "write_days", expectations)
    (
        counted.hint("rebalance", F.col(partition))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(root)
    )
    return observation


def replace_days(spark: SparkSession, staged: str, root: str, days: Sequence[date], partition: str = "ds") -> None:
    """Publish days written aside: each named day becomes what ``staged`` has of it, which may be nothing.

    A day that is there is moved aside, below a name that readers do not see, and deleted only when the new one is in its
    place: a driver that is lost in between leaves both, and the next call puts the new one there.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(root))
    for day in days:
        source, target = path(f"{staged}/{partition}={day}"), path(f"{root}/{partition}={day}")
        aside = path(f"{root}/_{partition}={day}-{uuid.uuid4().hex}")
        moved = files.exists(target) and files.rename(target, aside)
        if files.exists(source) and not files.rename(source, target):
            if moved:
                files.rename(aside, target)
            raise RuntimeError(f"{source} could not be moved to {target}")
        if moved:
            files.delete(aside, True)


def append_days(df: DataFrame, root: str, partition: str = "ds") -> None:
    df.hint("rebalance", F.col(partition)).write.mode("append").partitionBy(partition).parquet(root)


def append_batch(df: DataFrame, root: str, batch: str, partition: str = "ds") -> None:
    """Add a named batch to a log; a batch that is written again takes its own place.

    Readers of ``root`` see a further column ``batch``.
    """
    rows = df.hint("rebalance", F.col(partition))
    rows.write.mode("overwrite").partitionBy(partition).parquet(f"{root}/batch={batch}")


def to_messages(records: DataFrame, record: str, key: Column | None = None) -> DataFrame:
    """Event records as topic, key and JSON value, ready for a ``kafka`` write.

    The key is the given one or else the event id. Records of unknown type have a
    null topic; :func:`split_messages` takes them apart.
    """
    event_type = F.col(f"{record}.event_type")
    own = F.col(f"{record}.event_id")
    return records.select(
        topic_of(event_type).alias("topic"),
        (own if key is None else F.coalesce(key.cast("string"), own)).alias("key"),
        F.to_json(record).alias("value"),
    )


def split_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages that can be published, and those of unknown type."""
    return messages.where(F.col("topic").isNotNull()), messages.where(F.col("topic").isNull())


def publish_counts(records: DataFrame, event_type: str) -> DataFrame:
    """Success and failure counts per route, the unknown one included."""
    route = F.coalesce(route_of(F.col(event_type)), F.lit("unknown"))
    known = route_of(F.col(event_type)).isNotNull()
    return records.groupBy(route.alias("route")).agg(
        F.count_if(known).alias("success"), F.count_if(~known).alias("failed")
    )


def write_messages(messages: DataFrame, servers: str, **options: str) -> None:
    """Publish in batch. Needs Spark's Kafka connector; order holds within a key."""
    (
        messages.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("kafka.compression.type", "gzip")
        .options(**options)
        .save()
    )


def prediction_records(
    predictions: DataFrame,
    model_name: str,
    ts: str,
    prediction: str,
    request: Sequence[str],
    ttl: timedelta = LOG_TTL,
) -> DataFrame:
    """Predictions in the log's schema, with a replay-stable id and a features hash."""
    at = F.col(ts).cast("timestamp")
    return predictions.select(
        record_id(F.lit(model_name), iso_format(at), F.to_json(F.struct(*request))).alias("log_id"),
        F.lit(model_name).alias("model_name"),
        at.alias("ts"),
        F.to_json(F.struct(*request)).alias("request"),
        features_hash(request).alias("features_hash"),
        F.col(prediction).cast("double").alias("prediction"),
        (at + F.lit(ttl)).alias("expires_at"),
        F.to_date(at).alias("ds"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
