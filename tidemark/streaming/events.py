"""From text records to features per route, with broken and unknown records kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import calendar_columns, day_of_week, event_time
from ..functions.events import route_of
from ..functions.geo import haversine_km
from ..schemas import ANY_EVENT

CORRUPT = "_corrupt_record"
ROUTES = ("rider", "driver", "trip")
WATERMARK = "1 day"


def parse(stream: DataFrame, value: str = "value", schema: T.StructType = ANY_EVENT) -> DataFrame:
    """Add ``event``, ``event_ts``, ``route`` and ``problem`` to text records.

    ``problem`` is null for records that can be processed. Others say why:
    ``broken`` JSON, an ``unknown`` type, a type ``unhandled`` downstream, or a
    time or entity that is missing.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    event = F.from_json(value, with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    entity = (
        F.when(F.col("route") == "rider", F.col("event.rider_id"))
        .when(F.col("route") == "driver", F.col("event.driver_id"))
        .when(F.col("route") == "trip", F.col("event.trip_id"))
    )
    parsed = stream.withColumn("event", event)
    parsed = parsed.withColumns(
        {
            "event_ts": event_time(F.col("event.timestamp")),
            "route": route_of(F.col("event.event_type")),
        }
    ).withColumn("entity_id", entity)
    problem = (
        F.when(F.col("event").isNull() | F.col(f"event.{CORRUPT}").isNotNull(), "broken")
        .when(F.col("route").isNull(), "unknown")
        .when(~F.col("route").isin(*ROUTES), "unhandled")
        .when(F.col("event_ts").isNull(), "no_time")
        .when(F.col("entity_id").isNull(), "no_entity")
    )
    return parsed.withColumn("problem", problem)


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("problem").isNull())


def dead_letters(parsed: DataFrame, value: str = "value") -> DataFrame:
    """Records that cannot be processed: the text, the reason and where it came from."""
    origin = [c for c in ("topic", "partition", "offset") if c in parsed.columns]
    return parsed.where(F.col("problem").isNotNull()).select(F.col(value).alias("value"), "problem", *origin)


def outcome_counts(parsed: DataFrame) -> DataFrame:
    """Records per route and problem."""
    return parsed.groupBy(F.coalesce("route", F.lit("none")).alias("route"), F.coalesce("problem", F.lit("ok")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _base(parsed: DataFrame, route: str) -> DataFrame:
    return good(parsed).where(F.col("route") == route)


def rider_event_features(parsed: DataFrame, *more: Column) -> DataFrame:
    """Calendar, pickup and distance of rider events; no destination gives a null distance. ``more`` columns follow."""
    e = F.col("event")
    distance = haversine_km(e.latitude, e.longitude, e.destination_lat, e.destination_lng)
    return _base(parsed, "rider").select(
        e.event_id.alias("event_id"),
        e.rider_id.alias("rider_id"),
        "event_ts",
        *[c.alias(n) for n, c in calendar_columns(F.col("event_ts")).items()],
        e.latitude.alias("pickup_lat"),
        e.longitude.alias("pickup_lng"),
        distance.alias("trip_distance_km"),
        F.coalesce(e.rider_rating, F.lit(4.5)).alias("rider_rating"),
        *more,
    )


def driver_event_features(parsed: DataFrame, *more: Column) -> DataFrame:
    e = F.col("event")
    return _base(parsed, "driver").select(
        e.event_id.alias("event_id"),
        e.driver_id.alias("driver_id"),
        "event_ts",
        e.status.alias("driver_status"),
        e.vehicle_type.alias("vehicle_type"),
        e.latitude.alias("current_lat"),
        e.longitude.alias("current_lng"),
        F.hour("event_ts").alias("hour_of_day"),
        day_of_week(F.col("event_ts")).alias("day_of_week"),
        F.coalesce(e.driver_rating, F.lit(4.5)).alias("driver_rating"),
        *more,
    )


def trip_event_features(parsed: DataFrame) -> DataFrame:
    """Places and distance of trip events; duration and fare once the trip has ended."""
    e = F.col("event")
    ended = e.event_type == "trip.end"
    return _base(parsed, "trip").select(
        e.event_id.alias("event_id"),
        e.trip_id.alias("trip_id"),
        e.rider_id.alias("rider_id"),
        e.driver_id.alias("driver_id"),
        "event_ts",
        e.event_type.alias("event_type"),
        e.pickup_lat.alias("pickup_lat"),
        e.pickup_lng.alias("pickup_lng"),
        e.dropoff_lat.alias("dropoff_lat"),
        e.dropoff_lng.alias("dropoff_lng"),
        haversine_km(e.pickup_lat, e.pickup_lng, e.dropoff_lat, e.dropoff_lng).alias("trip_distance_km"),
        F.when(ended, e.duration_minutes).alias("actual_duration"),
        F.when(ended, e.actual_fare).alias("actual_fare"),
    )


def trip_entities(trips: DataFrame) -> DataFrame:
    """A row for the rider and one for the driver of each ended trip, to be counted."""
    both = F.array(
        F.struct(F.lit("rider").alias("entity_type"), F.col("rider_id").alias("entity_id")),
        F.struct(F.lit("driver").alias("entity_type"), F.col("driver_id").alias("entity_id")),
    )
    return (
        trips.where(F.col("event_type") == "trip.end")
        .select("event_id", "event_ts", F.explode(both).alias("__e"))
        .select("event_id", "event_ts", "__e.entity_type", "__e.entity_id")
        .where(F.col("entity_id").isNotNull())
    )


def once(
    stream: DataFrame, key: str, ts: str, delay: str = WATERMARK, spread: Column | None = None
) -> DataFrame:
    """Drop repeats of an event id that arrive within the watermark.

    If one id may be repeated very often, ``spread`` (say, a hash of the row's
    origin into a few values) first drops repeats among rows of one value, so
    that few rows of the id are left to meet in one task.
    """
    watched = stream.withWatermark(ts, delay)
    if spread is not None:
        watched = watched.withColumn("__spread", spread).dropDuplicatesWithinWatermark([key, "__spread"]).drop("__spread")
    return watched.dropDuplicatesWithinWatermark([key])


def online_rows(features: DataFrame, entity_type: str, key: str, ts: str, ttl: Column) -> DataFrame:
    """Features as keyed JSON rows with an expiry, for the online table."""
    values = [c for c in features.columns if c not in (key, ts)]
    return features.select(
        F.lit(entity_type).alias("entity_type"),
        F.col(key).cast("string").alias("entity_id"),
        F.to_json(F.struct(*values)).alias("features"),
        F.col(ts).alias("updated_at"),
        (F.col(ts) + ttl).alias("expires_at"),
    )
