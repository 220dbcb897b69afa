"""Daily rider, driver and trip features.

Each function takes activity rows and returns the rows of a feature table; the
columns that a source lacks are left out rather than filled with constants.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns, day_of_week
from ..functions.geo import haversine_km
from ..functions.pricing import surge_quote
from ..operators.asof import asof_join
from ..operators.timeline import HotKeys, find_hot_keys, next_in_time, row_numbers, running_totals, with_slots
from ..operators.trailing import Trailing, trailing

WEEK = timedelta(days=7)
MONTH = timedelta(days=30)
CITY_SPEED = 30.0


def rider_features(
    activity: DataFrame,
    key: str = "rider_id",
    ts: str = "event_timestamp",
    rating: Column | None = None,
    cancelled: Column | None = None,
    fare: Column | None = None,
    sunday_first: bool = False,
    include_current: bool = True,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Trailing trip counts and averages of each rider with calendar features.

    One row per rider and time. ``cancelled`` may be a flag or a rate.
    """
    specs = [
        Trailing("rider_trips_7d", WEEK),
        Trailing("rider_trips_30d", MONTH),
    ]
    if rating is not None:
        specs.append(Trailing("rider_avg_rating", MONTH, "avg", rating))
    if cancelled is not None:
        specs.append(Trailing("rider_cancellation_rate_7d", WEEK, "avg", cancelled))
    if fare is not None:
        specs.append(Trailing("rider_avg_fare_30d", MONTH, "avg", fare))
    rows = trailing(activity, [key], ts, specs, include_current=include_current, hot=hot)
    calendar = calendar_columns(F.col(ts))
    calendar["day_of_week"] = day_of_week(F.col(ts), sunday_first)
    return rows.withColumns(calendar)


def driver_features(
    activity: DataFrame,
    key: str = "driver_id",
    ts: str = "event_timestamp",
    cancelled: Column | None = None,
    accepted: Column | None = None,
    requested: Column | None = None,
    distance: Column | None = None,
    duration: Column | None = None,
    extra: Sequence[str] = (),
    hot: HotKeys | None = None,
) -> DataFrame:
    """Trips today and over trailing windows, and trailing rates and averages.

    ``extra`` columns (rating, vehicle type, status) are passed through.
    """
    specs = [
        Trailing("driver_trips_7d", WEEK),
        Trailing("driver_trips_30d", MONTH),
    ]
    if accepted is not None:
        specs.append(Trailing("driver_acceptance_rate_7d", WEEK, "ratio", accepted, requested))
    if cancelled is not None:
        specs.append(Trailing("driver_cancellation_rate_7d", WEEK, "avg", cancelled))
    if distance is not None:
        specs.append(Trailing("driver_avg_trip_distance_7d", WEEK, "avg", distance))
    if duration is not None:
        specs.append(Trailing("driver_avg_trip_duration_7d", WEEK, "avg", duration))
    return trailing(activity, [key], ts, specs, extra, day_count="driver_trips_today", hot=hot)


def hours_online(
    status_events: DataFrame,
    key: str = "driver_id",
    ts: str = "event_timestamp",
    status: str = "status",
    tie: Sequence[str] = (),
    offline: str = "offline",
    hot: HotKeys | None = None,
) -> DataFrame:
    """Hours online per driver and UTC day.

    A status holds until the driver's next event. A stretch that crosses midnight
    is split between its days; the status after the last event counts nothing.
    """
    events = next_in_time(status_events, [key], ts, tie, "__until", hot)
    online = events.where((F.col(status) != offline) & F.col("__until").isNotNull())
    days = F.sequence(F.to_date(ts), F.to_date("__until"))
    split = online.withColumn("day", F.explode(days))
    begin = F.greatest(F.unix_micros(ts), F.unix_micros(F.col("day").cast("timestamp")))
    end = F.least(F.unix_micros("__until"), F.unix_micros(F.date_add("day", 1).cast("timestamp")))
    return split.groupBy(key, "day").agg((F.sum(end - begin) / F.lit(3_600_000_000.0)).alias("hours_online"))


def preferred_type(
    trips: DataFrame, key: str, kind: str, ts: str | None = None, before: Column | None = None
) -> DataFrame:
    """The most frequent type of each key, optionally before a time; ties by name.

    Two aggregates, both combining before their shuffle.
    """
    seen = trips.where(F.col(kind).isNotNull())
    if before is not None:
        seen = seen.where(F.col(ts) < before)
    counts = seen.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(kind).alias("kind")))
    return counts.groupBy(key).agg(best.alias("__best")).select(
        key, F.col("__best.kind").alias("preferred_type"), (-F.col("__best.n")).alias("trips")
    )


def preferred_type_as_of(
    trips: DataFrame,
    key: str,
    kind: str,
    ts: str,
    tie: Sequence[str],
    include_current: bool = False,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add to each trip the most frequent type among its key's earlier trips, ties by name, and its number of trips.

    A type's counts go up one by one, so the running number of a trip within its
    key and type says when the type has reached a count. The type that is ahead at
    any time is the least by (count downwards, name) of all trips so far: a
    running minimum, which hot keys carry from slot to slot. Trips without a type
    count for none. ``tie`` tells trips of one time apart.
    """
    axis = F.unix_micros(F.col(ts).cast("timestamp"))
    if hot is None:
        hot = find_hot_keys(trips, [key], axis)
    numbered = row_numbers(trips, [key, kind], ts, tie, "__number")
    slotted = with_slots(numbered, [key], axis, hot)
    order = [F.col(ts).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in tie]]
    reached = F.when(F.col(kind).isNotNull(), F.struct((-F.col("__number")).alias("n"), F.col(kind).alias("kind")))
    found = running_totals(slotted, [key], order, {"__ahead": reached}, bool(hot), combine=F.min, before=not include_current)
    return found.select(
        *trips.columns, F.col("__ahead.kind").alias("preferred_type"), F.coalesce(-F.col("__ahead.n"), F.lit(0)).alias("preferred_trips")
    )


def trip_features(
    trips: DataFrame,
    riders: DataFrame,
    drivers: DataFrame,
    rider_key: str = "rider_id",
    driver_key: str = "driver_id",
    pickup: tuple[str, str] = ("pickup_lat", "pickup_lng"),
    dropoff: tuple[str, str] = ("dropoff_lat", "dropoff_lng"),
) -> DataFrame:
    """Trips with their rider's and driver's columns and the trip's distance.

    ``riders`` and ``drivers`` hold one row per key. Trips without a known rider
    or driver are kept.
    """
    distance = haversine_km(F.col(pickup[0]), F.col(pickup[1]), F.col(dropoff[0]), F.col(dropoff[1]))
    return (
        trips.join(riders, rider_key, "left")
        .join(drivers, driver_key, "left")
        .withColumn("trip_distance_km", distance)
    )


def trip_features_at_start(
    trips: DataFrame,
    riders: DataFrame,
    drivers: DataFrame,
    started: str,
    rider_ts: str,
    driver_ts: str,
    rider_key: str = "rider_id",
    driver_key: str = "driver_id",
    ttl: timedelta | None = None,
    km_per_hour: float = CITY_SPEED,
) -> DataFrame:
    """Trips with all declared trip columns, and their rider's and driver's features as of the start.

    ``riders`` and ``drivers`` are feature histories; all their columns but key and
    time are added. Distance, duration, surge and fare are estimated from the
    coordinates and the start; weather and traffic come with the trip.
    """
    rider_columns = [c for c in riders.columns if c not in (rider_key, rider_ts)]
    driver_columns = [c for c in drivers.columns if c not in (driver_key, driver_ts)]
    known = asof_join(trips, riders, [rider_key], started, rider_ts, rider_columns, ttl)
    known = asof_join(known, drivers, [driver_key], started, driver_ts, driver_columns, ttl)
    distance = haversine_km(F.col("pickup_lat"), F.col("pickup_lng"), F.col("dropoff_lat"), F.col("dropoff_lng"))
    known = known.withColumn("trip_distance_km", distance)
    quote = surge_quote(F.col(started), F.col("trip_distance_km"), F.lit(0.0))
    return known.withColumns(
        {
            "estimated_duration_minutes": F.col("trip_distance_km") / km_per_hour * 60,
            "estimated_fare": quote["estimated_fare"],
            "surge_multiplier": quote["surge_multiplier"],
        }
    )
