"""Feature store: training joins, lookups, materialization, snapshots."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..features.batch import driver_features, rider_features
from ..features.store import (
    DRIVER_VIEW,
    ETA_PREDICTION,
    FRAUD_DETECTION,
    RIDER_VIEW,
    TRIP_VIEW,
    FeatureView,
    historical_features,
    materialize,
    materialize_incremental,
    online_features,
    slice_to_load,
)
from ..functions import haversine_km
from ..operators.asof import asof_join, asof_join_by_instant, latest, lookup
from ..operators.timeline import row_numbers_in_ranges
from ..operators.timeline import HotKeys, find_hot_keys
from ..session import shared_dir
from ..sources.snapshots import SnapshotTable
from .tables import (
    SQL_TIME,
    drives,
    events,
    latitude,
    longitude,
    sql_haversine,
    sql_latitude,
    sql_longitude,
    table,
    text_time,
)

DAY = timedelta(days=1)


def pit_join_single(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases with the rider's latest view of the last day."""
    rows = events(spark, folder)
    labels = rows.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts", "value")
    views = rows.where(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value")
    )
    return asof_join(labels, views, ["user_id"], "ts", "view_ts", ["view_id", "view_value"], DAY, feature_ts_as="seen_at").select(
        "event_id",
        "user_id",
        "value",
        F.col("view_id").cast("string").alias("view_id"),
        "view_value",
        text_time("seen_at").alias("seen_at"),
    )


PIT_SINGLE_SQL = f"""
    WITH l AS (SELECT * FROM events WHERE event_type = 'purchase'),
         f AS (SELECT * FROM events WHERE event_type = 'view')
    SELECT l.event_id, l.user_id, l.value,
           CASE WHEN f.ts >= l.ts - INTERVAL 1 DAY THEN f.event_id::VARCHAR END AS view_id,
           CASE WHEN f.ts >= l.ts - INTERVAL 1 DAY THEN f.value END AS view_value,
           CASE WHEN f.ts >= l.ts - INTERVAL 1 DAY THEN strftime(f.ts, {SQL_TIME}) END AS seen_at
    FROM l ASOF LEFT JOIN f ON l.user_id = f.user_id AND l.ts >= f.ts"""


def _views(spark: SparkSession, folder: str) -> dict[str, FeatureView]:
    """The declared views over features computed from orders and line items."""
    orders = table(spark, folder, "orders").withColumn("event_timestamp", F.col("o_orderdate").cast("timestamp"))
    riders = rider_features(
        orders.select(F.col("o_custkey").alias("rider_id"), "event_timestamp", "o_totalprice", "o_orderstatus"),
        cancelled=F.col("o_orderstatus") == "F",
        fare=F.col("o_totalprice"),
    )
    activity = drives(spark, folder).withColumn(
        "vehicle_type", F.element_at(F.array(*map(F.lit, ("sedan", "suv", "luxury"))), (F.col("driver_id") % 3 + 1).cast("int"))
    )
    drivers = driver_features(
        activity,
        cancelled=F.col("cancelled"),
        accepted=F.col("accepted"),
        duration=F.col("duration"),
        extra=["vehicle_type"],
    ).withColumn("driver_avg_rating", F.lit(None).cast("float"))
    priority = F.col("o_orderpriority")
    trips = orders.select(
        F.col("o_orderkey").alias("trip_id"),
        "event_timestamp",
        haversine_km(
            latitude("o_custkey"), longitude("o_custkey"), latitude("o_orderkey"), longitude("o_orderkey")
        ).alias("trip_distance_km"),
        F.col("o_totalprice").alias("estimated_fare"),
        F.when(priority == "1-URGENT", "heavy").when(priority == "5-LOW", "light").alias("traffic_level"),
        F.when(F.col("o_orderstatus") == "F", "fog").otherwise("clear").alias("weather_condition"),
    )
    # Looked for in the tables that entities and features come from, not in what is
    # computed from them. A trip has one row.
    entities = _entities(spark, folder)
    hot_riders = _hot(entities, orders.select(F.col("o_custkey").alias("rider_id"), "event_timestamp"), "rider_id")
    hot_drivers = _hot(entities, activity, "driver_id")
    return {
        "rider_features": RIDER_VIEW.over(riders, hot_riders),
        "driver_features": DRIVER_VIEW.over(drivers, hot_drivers),
        "trip_features": TRIP_VIEW.over(trips, HotKeys()),
    }


def _hot(entities: DataFrame, activity: DataFrame, key: str) -> HotKeys:
    times = entities.select(key, "event_timestamp").unionByName(activity.select(key, "event_timestamp"))
    return find_hot_keys(times, [key], F.unix_micros("event_timestamp"))


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("trip_id"),
        F.col("o_custkey").alias("rider_id"),
        (F.col("o_custkey") % 10).alias("driver_id"),
        (F.col("o_orderdate").cast("timestamp") + F.lit(timedelta(hours=12))).alias("event_timestamp"),
    )


def pit_join_service(spark: SparkSession, folder: str) -> DataFrame:
    """Training rows of the ETA model: three as-of joins, each with its view's own keys and time to live."""
    rows = historical_features(_entities(spark, folder), ETA_PREDICTION, _views(spark, folder))
    return rows.select(
        "trip_id",
        "rider_id",
        "driver_id",
        text_time("event_timestamp").alias("event_timestamp"),
        F.round("trip_distance_km", 5).alias("trip_distance_km"),
        "traffic_level",
        "weather_condition",
        F.round("driver_avg_trip_duration_7d", 7).alias("driver_avg_trip_duration_7d"),
        "vehicle_type",
        "hour_of_day",
        "day_of_week",
        "is_peak_hour",
    )


ENTITIES_SQL = """
    e AS (SELECT o_orderkey AS trip_id, o_custkey AS rider_id, o_custkey % 10 AS driver_id,
                 o_orderdate + INTERVAL 12 HOURS AS event_timestamp FROM orders)"""
DRIVERS_SQL = """
    d AS (SELECT DISTINCT l_suppkey AS driver_id, l_shipdate AS ts,
                 avg(round(l_discount * 100, 4)) OVER w7 AS driver_avg_trip_duration_7d,
                 avg((l_linestatus = 'F')::INT) OVER w7 AS driver_acceptance_rate_7d,
                 avg((l_returnflag = 'R')::INT) OVER w7 AS driver_cancellation_rate_7d
          FROM lineitem
          WINDOW w7 AS (PARTITION BY l_suppkey ORDER BY l_shipdate
                        RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW))"""
TRIP_KM_SQL = sql_haversine(
    sql_latitude("o_custkey"), sql_longitude("o_custkey"), sql_latitude("o_orderkey"), sql_longitude("o_orderkey")
)
PIT_SERVICE_SQL = f"""
    WITH {ENTITIES_SQL}, {DRIVERS_SQL},
    t AS (SELECT o_orderkey AS trip_id, round({TRIP_KM_SQL}, 5) AS trip_distance_km,
                 CASE o_orderpriority WHEN '1-URGENT' THEN 'heavy' WHEN '5-LOW' THEN 'light' END AS traffic_level,
                 CASE WHEN o_orderstatus = 'F' THEN 'fog' ELSE 'clear' END AS weather_condition FROM orders)
    SELECT e.trip_id, e.rider_id, e.driver_id, strftime(e.event_timestamp, {SQL_TIME}) AS event_timestamp,
           trip_distance_km, traffic_level, weather_condition,
           CASE WHEN d.ts >= e.event_timestamp - INTERVAL 12 HOURS THEN round(driver_avg_trip_duration_7d, 7) END
               AS driver_avg_trip_duration_7d,
           CASE WHEN d.ts >= e.event_timestamp - INTERVAL 12 HOURS
                THEN ['sedan', 'suv', 'luxury'][e.driver_id % 3 + 1] END AS vehicle_type,
           0 AS hour_of_day, (isodow(e.event_timestamp) - 1)::INT AS day_of_week, 0 AS is_peak_hour
    FROM e JOIN t USING (trip_id) ASOF LEFT JOIN d ON e.driver_id = d.driver_id AND e.event_timestamp >= d.ts"""


def pit_join_fraud(spark: SparkSession, folder: str) -> DataFrame:
    """The fraud model's training rows with view names in the columns, and no driver key to join on."""
    entities = _entities(spark, folder).drop("driver_id")
    rows = historical_features(entities, FRAUD_DETECTION, _views(spark, folder), full_names=True)
    return rows.select(
        "trip_id",
        "rider_features__rider_trips_7d",
        F.round("rider_features__rider_cancellation_rate_7d", 8).alias("rider_features__rider_cancellation_rate_7d"),
        F.round("rider_features__rider_avg_fare_30d", 4).alias("rider_features__rider_avg_fare_30d"),
        F.col("driver_features__driver_avg_rating").cast("double").alias("driver_features__driver_avg_rating"),
        F.round("trip_features__trip_distance_km", 5).alias("trip_features__trip_distance_km"),
        F.col("trip_features__estimated_fare").alias("trip_features__estimated_fare"),
    )


PIT_FRAUD_SQL = f"""
    WITH r AS (
        SELECT DISTINCT o_custkey, o_orderdate, count(*) OVER w7 AS n7,
               avg((o_orderstatus = 'F')::INT) OVER w7 AS c7, avg(o_totalprice) OVER w30 AS f30
        FROM orders
        WINDOW w7 AS (PARTITION BY o_custkey ORDER BY o_orderdate
                      RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW),
               w30 AS (PARTITION BY o_custkey ORDER BY o_orderdate
                       RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW))
    SELECT o_orderkey AS trip_id, n7 AS rider_features__rider_trips_7d,
           round(c7, 8) AS rider_features__rider_cancellation_rate_7d,
           round(f30, 4) AS rider_features__rider_avg_fare_30d,
           NULL::DOUBLE AS driver_features__driver_avg_rating,
           round({TRIP_KM_SQL}, 5) AS trip_features__trip_distance_km, o_totalprice AS trip_features__estimated_fare
    FROM orders JOIN r USING (o_custkey, o_orderdate)"""

EVENT_VIEW = FeatureView(
    "rider_activity",
    ("user_id",),
    timedelta(hours=24),
    schema=None,
    ts_col="ts",
)


def _event_view(spark: SparkSession, folder: str) -> FeatureView:
    source = events(spark, folder).select("user_id", "ts", "event_id", "event_type", "value")
    wanted = source.select("event_id", "event_type", "value").schema
    return replace(EVENT_VIEW, schema=wanted, source=source)


def online_latest(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest(events(spark, folder), ["user_id"], "ts", ["event_id"])
    return rows.select("user_id", text_time("ts").alias("ts"), "event_id", "event_type", "value", "props")


def online_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer as a request, against the latest event that is less than a day old."""
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    online = slice_to_load(_event_view(spark, folder), None, now)
    requests = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    online = online.withColumn("event_id", F.col("event_id").cast("string"))
    return lookup(requests, online, ["user_id"], ["event_id", "event_type", "value"], now)


ONLINE_LOOKUP_SQL = """
    SELECT c_custkey AS user_id, c_mktsegment, event_id::VARCHAR AS event_id, event_type, value
    FROM customer LEFT JOIN (
        SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-30 12:00:00'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) l
      ON c_custkey = user_id AND ts + INTERVAL 24 HOURS > TIMESTAMP '2024-01-30 12:00:00'"""


def online_service(spark: SparkSession, folder: str) -> DataFrame:
    """The ETA service for every order as a request, from latest values, without a driver key."""
    views = _views(spark, folder)
    end = F.lit("2002-01-01").cast("timestamp")
    views = {
        "trip_features": replace(views["trip_features"], schema=views["trip_features"].source.select(
            "trip_distance_km", "traffic_level", "weather_condition").schema),
        "rider_features": replace(views["rider_features"], schema=views["rider_features"].source.select(
            "hour_of_day", "day_of_week", "is_peak_hour").schema),
        "driver_features": views["driver_features"],
    }
    online = {name: slice_to_load(views[name], None, end) for name in ("trip_features", "rider_features")}
    requests = _entities(spark, folder).select("trip_id", "rider_id")
    rows = online_features(requests, ETA_PREDICTION, views, online)
    return rows.withColumns(
        {
            "trip_distance_km": F.round("trip_distance_km", 5),
            "driver_avg_trip_duration_7d": F.col("driver_avg_trip_duration_7d").cast("double"),
        }
    )


ONLINE_SERVICE_SQL = f"""
    SELECT o_orderkey AS trip_id, o_custkey AS rider_id, round({TRIP_KM_SQL}, 5) AS trip_distance_km,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'heavy' WHEN '5-LOW' THEN 'light' END AS traffic_level,
           CASE WHEN o_orderstatus = 'F' THEN 'fog' ELSE 'clear' END AS weather_condition,
           NULL::DOUBLE AS driver_avg_trip_duration_7d, NULL::VARCHAR AS vehicle_type, 0 AS hour_of_day,
           (isodow(max(o_orderdate) OVER (PARTITION BY o_custkey)) - 1)::INT AS day_of_week, 0 AS is_peak_hour
    FROM orders"""


def pit_one_instant(spark: SparkSession, folder: str) -> DataFrame:
    """Labels that were all loaded at one instant, most of them of one key: numbered, and with their key's newest event."""
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    key = F.when(F.col("user_id") % 5 == 0, F.col("user_id")).otherwise(F.lit(0)).alias("key")
    labels = rows.select("event_id", key, F.lit("2024-01-16").cast("timestamp").alias("loaded"))
    numbered = row_numbers_in_ranges(labels, ["key"], "loaded", ["event_id"], slot_rows=2_000)
    found = asof_join_by_instant(numbered, rows.select(key, "ts", "value", F.col("event_id").alias("newest")), ["key"], "loaded", "ts", ["newest", "value"])
    return found.select("event_id", "key", "row_number", "newest", "value")


PIT_ONE_INSTANT_SQL = """
    WITH e AS (SELECT *, CASE WHEN user_id % 5 = 0 THEN user_id ELSE 0 END AS key FROM events),
    f AS (SELECT key, event_id AS newest, value FROM e WHERE ts <= TIMESTAMP '2024-01-16'
          QUALIFY row_number() OVER (PARTITION BY key ORDER BY e.ts DESC, event_id DESC) = 1)
    SELECT event_id, key, row_number() OVER (PARTITION BY key ORDER BY event_id) AS row_number, newest, f.value
    FROM e LEFT JOIN f USING (key)"""


def _online_table(spark: SparkSession, root: str) -> SnapshotTable:
    return SnapshotTable(spark, root, ("user_id",), ("ts", "event_id"))


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    expires = text_time("expires_at").alias("expires_at")
    return rows.select("user_id", text_time("ts").alias("ts"), "event_id", "event_type", "value", expires, *more)


def materialize_slice(spark: SparkSession, folder: str) -> DataFrame:
    online = _online_table(spark, shared_dir(spark, "online"))
    start, end = (F.lit(t).cast("timestamp") for t in ("2024-01-10", "2024-01-17"))
    materialize(_event_view(spark, folder), online, start, end, version=1)
    return _shown(online.read())


def materialize_twice(spark: SparkSession, folder: str) -> DataFrame:
    """Two incremental loads; the second takes up where the first ended."""
    root = shared_dir(spark, "incremental")
    online = _online_table(spark, f"{root}/table")
    for end in (datetime(2024, 1, 15), datetime(2024, 1, 25)):
        materialize_incremental(spark, _event_view(spark, folder), online, f"{root}/log", end)
    return _shown(online.read())


def online_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches merged by key, the second one twice; then a writer that starts anew, with one column more."""
    view = _event_view(spark, folder)
    online = _online_table(spark, shared_dir(spark, "snapshot"))
    middle, late, end = (F.lit(t).cast("timestamp") for t in ("2024-01-15", "2024-01-22", "2024-02-01"))
    online.upsert(slice_to_load(view, None, middle), 0)
    for _ in range(2):
        online.upsert(slice_to_load(view, middle, late, after=True), 1)
    last = slice_to_load(view, late, end, after=True).withColumn("note", F.lit("late"))
    online.upsert(last, 0, "restarted")
    try:
        replace(online, buckets=online.buckets * 2).read()
    except ValueError:
        refused = True
    else:
        refused = False
    return _shown(online.read(), "note").withColumn("refused", F.lit(refused))


def _latest_sql(condition: str) -> str:
    return f"""
    SELECT user_id, strftime(ts, {SQL_TIME}) AS ts, event_id, event_type, value,
           strftime(ts + INTERVAL 24 HOURS, {SQL_TIME}) AS expires_at
    FROM events WHERE {condition}
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY events.ts DESC, event_id DESC) = 1"""


QUERIES = {
    "pit_join_single": pit_join_single,
    "pit_join_service": pit_join_service,
    "pit_join_fraud": pit_join_fraud,
    "pit_one_instant": pit_one_instant,
    "online_latest": online_latest,
    "online_lookup": online_lookup,
    "online_service": online_service,
    "materialize_slice": materialize_slice,
    "materialize_incremental": materialize_twice,
    "online_snapshot": online_snapshot,
}

ORACLE = {
    "pit_one_instant": PIT_ONE_INSTANT_SQL,
    "pit_join_single": PIT_SINGLE_SQL,
    "pit_join_service": PIT_SERVICE_SQL,
    "pit_join_fraud": PIT_FRAUD_SQL,
    "online_latest": f"""
        SELECT user_id, strftime(ts, {SQL_TIME}) AS ts, event_id, event_type, value, props FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY events.ts DESC, event_id DESC) = 1""",
    "online_lookup": ONLINE_LOOKUP_SQL,
    "online_service": ONLINE_SERVICE_SQL,
    "materialize_slice": _latest_sql("ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-17'"),
    "materialize_incremental": _latest_sql("ts <= TIMESTAMP '2024-01-25'"),
    "online_snapshot": f"""
        SELECT *, CASE WHEN ts > '2024-01-22 00:00:00.000000' THEN 'late' END AS note, true AS refused
        FROM ({_latest_sql("ts <= TIMESTAMP '2024-02-01'")})""",
}
