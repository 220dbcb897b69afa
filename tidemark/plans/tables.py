"""The given tables in the roles the queries use them in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_TIME = "'%Y-%m-%d %H:%M:%S.%f'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # The tables hold UTC times without a zone.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_time(ts: Column | str) -> Column:
    return F.date_format(ts, TEXT_TIME)


def text_day(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def rides(spark: SparkSession, folder: str) -> DataFrame:
    """Events as rider activity."""
    return events(spark, folder).select(
        F.col("user_id").alias("rider_id"),
        F.col("ts").alias("event_timestamp"),
        "event_id",
        "event_type",
        "value",
    )


def drives(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as driver activity."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("driver_id"),
        F.col("l_shipdate").cast("timestamp").alias("event_timestamp"),
        F.col("l_quantity").alias("distance"),
        (F.col("l_discount") * 100).alias("duration"),
        (F.col("l_returnflag") == "R").alias("cancelled"),
        (F.col("l_linestatus") == "F").alias("accepted"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a log of served predictions, one model per event type but errors."""
    return events(spark, folder).select(
        F.when(F.col("user_id") % 2 == 0, "eta").otherwise("surge").alias("model_name"),
        "ts",
        F.col("user_id").alias("request_key"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
    )


def latitude(key: str) -> Column:
    return 37 + (F.col(key) % 100) / F.lit(100.0)


def longitude(key: str) -> Column:
    return -122 - (F.col(key) % 77) / F.lit(100.0)


def sql_latitude(key: str) -> str:
    return f"(37 + ({key} % 100) / 100.0::DOUBLE)"


def sql_longitude(key: str) -> str:
    return f"(-122 - ({key} % 77) / 100.0::DOUBLE)"


def sql_haversine(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return (
        f"(2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) "
        f"+ cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2)))))"
    )


def sql_bucket(key: str, buckets: int = 100, salt: str = "") -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR || '{salt}'), 1, 15))::BIGINT % {buckets})"


PREDICTIONS_SQL = """
    SELECT CASE WHEN user_id % 2 = 0 THEN 'eta' ELSE 'surge' END AS model_name, ts, user_id AS request_key,
           value AS latency_ms, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status
    FROM events"""
