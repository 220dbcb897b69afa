"""Append-only topic logs in files: messages keep the offset they got, so that a record can be found again.

A log has a number of partitions per topic. A message's partition follows from its key, and its offset counts on from the
last one of its partition. A batch of messages is one folder that is written aside and then renamed, so readers see all of
it or nothing; a batch that is there already is left alone. Readers see a stream of ``value`` with ``topic``, ``partition`` and ``offset``, the
columns that the connector of a broker gives, and keep their place in the query's checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import stable_bucket
from ..operators.timeline import HotKeys, row_numbers
from ..session import path_exists
from .readers import read_parquet_stream

SCHEMA = "topic string, partition int, offset bigint, key string, value string"


def _ends(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The next offset of each topic and partition, as of the batches before one."""
    if not path_exists(spark, root):
        return None
    rows = spark.read.schema(f"{SCHEMA}, batch bigint").parquet(root)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end"))


def append_messages(
    messages: DataFrame, root: str, batch: int, ts: str, tie: Sequence[str], partitions: int = 8, hot: HotKeys | None = None
) -> bool:
    """Add a batch of messages (topic, key, value) in the order of ``ts``, then ``tie``. Those without a topic are left out.

    False if the batch is in the log. Batches are numbered upwards, one after the other. Partitions with very many messages are numbered in several tasks.
    """
    spark = messages.sparkSession
    target = f"{root}/batch={batch}"
    if path_exists(spark, target):
        return False
    placed = messages.where(F.col("topic").isNotNull()).withColumn("partition", stable_bucket(F.coalesce("key", F.lit("")), partitions))
    numbered = row_numbers(placed, ["topic", "partition"], ts, tie, "__number", hot)
    ends = _ends(spark, root, batch)
    if ends is None:
        numbered = numbered.withColumn("end", F.lit(0))
    else:
        # One row per topic and partition.
        numbered = numbered.join(F.broadcast(ends), ["topic", "partition"], "left")
    offset = F.coalesce("end", F.lit(0)).cast("bigint") + F.col("__number") - 1
    rows = numbered.select("topic", "partition", offset.alias("offset"), "key", "value")
    # A name that begins with an underscore is not seen by readers.
    aside = f"{root}/_batch={batch}-{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.rename(path(aside), path(target)):
        raise RuntimeError(f"{aside} could not be moved to {target}")
    return True


def read_topic_log(
    spark: SparkSession, root: str, topics: Sequence[str] | None = None, starting: str = "earliest", max_files: int | None = None
) -> DataFrame:
    """A stream of messages with their origin; ``starting`` at the ``earliest``, or at what comes after the ``latest``.

    ``max_files`` bounds a micro-batch. A query that starts again from its checkpoint goes on where it was, whatever
    ``starting`` was; give ``latest`` for its first start only, as it is taken when this is called.
    """
    if starting not in ("earliest", "latest"):
        raise ValueError(f"starting must be earliest or latest, not {starting}")
    schema = spark.createDataFrame([], SCHEMA).schema
    rows = read_parquet_stream(spark, root, schema, max_files=max_files)
    if topics is not None:
        rows = rows.where(F.col("topic").isin(*topics))
    ends = _ends(spark, root) if starting == "latest" else None
    if ends is not None:
        # One row per topic and partition.
        rows = rows.join(F.broadcast(ends), ["topic", "partition"], "left").where(F.col("offset") >= F.coalesce("end", F.lit(0)))
    return rows.select("value", "topic", "partition", "offset")


def find_records(spark: SparkSession, root: str, places: DataFrame) -> DataFrame:
    """The messages at places (topic, partition, offset), with their keys: dead letters found again."""
    rows = spark.read.schema(SCHEMA).parquet(root)
    return rows.join(places.select("topic", "partition", "offset").distinct(), ["topic", "partition", "offset"], "left_semi")
