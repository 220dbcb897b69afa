"""Batch features."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..features.batch import (
    MONTH,
    WEEK,
    driver_features,
    hours_online,
    preferred_type,
    preferred_type_as_of,
    rider_features,
    trip_features,
    trip_features_at_start,
)
from ..functions import add_days, day_of_week, event_time, haversine_km, is_peak_hour, is_weekend, iso_format
from ..functions.pricing import stable_jitter, surge_quote
from ..functions.values import (
    TRAFFIC_CODES,
    TRAFFIC_DEFAULT,
    VEHICLE_CODES,
    VEHICLE_DEFAULT,
    WEATHER_CODES,
    WEATHER_DEFAULT,
    ordinal,
)
from ..features.daily import check_day, run_day
from ..operators.asof import latest
from ..operators.distribution import value_counts
from ..operators.quality import between, not_null
from ..operators.trailing import Trailing, trailing
from ..session import shared_dir
from ..sources.readers import daily_extract, driver_extract, read_day
from ..sources.writers import append_days, write_csv, write_days
from .tables import (
    SQL_TIME,
    drives,
    events,
    latitude,
    longitude,
    rides,
    sql_bucket,
    sql_haversine,
    sql_latitude,
    sql_longitude,
    table,
    text_day,
    text_time,
)

DAY = date(1997, 5, 28)
JOB_DAYS = (date(2024, 1, 25), date(2024, 1, 26))


def rider_features_daily(spark: SparkSession, folder: str) -> DataFrame:
    rows = rider_features(rides(spark, folder), fare=F.col("value"))
    return rows.select(
        "rider_id",
        text_time("event_timestamp").alias("event_timestamp"),
        "rider_trips_7d",
        "rider_trips_30d",
        F.round("rider_avg_fare_30d", 8).alias("rider_avg_fare_30d"),
        "hour_of_day",
        "day_of_week",
        "is_peak_hour",
        "is_weekend",
    )


RIDER_FEATURES_SQL = f"""
    SELECT DISTINCT user_id AS rider_id, strftime(ts, {SQL_TIME}) AS event_timestamp,
           count(*) OVER w7 AS rider_trips_7d, count(*) OVER w30 AS rider_trips_30d,
           round(avg(value) OVER w30, 8) AS rider_avg_fare_30d,
           hour(ts)::INT AS hour_of_day, (isodow(ts) - 1)::INT AS day_of_week,
           (hour(ts) IN (7, 8, 9, 17, 18, 19))::INT AS is_peak_hour, (isodow(ts) >= 6)::INT AS is_weekend
    FROM events
    WINDOW w7 AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW),
           w30 AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)"""


def rider_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Average rating over 30 days, cancellation and acceptance rates over 7."""
    kind = F.col("event_type")
    specs = [
        Trailing("rider_avg_rating", MONTH, "avg", F.col("value")),
        Trailing("rider_cancellation_rate_7d", WEEK, "avg", kind == "error"),
        Trailing("acceptance_rate_7d", WEEK, "ratio", kind == "purchase", kind.isin("view", "purchase")),
    ]
    rows = trailing(rides(spark, folder), ["rider_id"], "event_timestamp", specs)
    return rows.select(
        "rider_id",
        text_time("event_timestamp").alias("event_timestamp"),
        *[F.round(s.name, 8).alias(s.name) for s in specs],
    )


RIDER_RATES_SQL = f"""
    SELECT DISTINCT user_id AS rider_id, strftime(ts, {SQL_TIME}) AS event_timestamp,
           round(avg(value) OVER w30, 8) AS rider_avg_rating,
           round(avg((event_type = 'error')::INT) OVER w7, 8) AS rider_cancellation_rate_7d,
           round(coalesce(count(*) FILTER (event_type = 'purchase') OVER w7
                 / nullif(count(*) FILTER (event_type IN ('view', 'purchase')) OVER w7, 0)::DOUBLE, 0), 8)
               AS acceptance_rate_7d
    FROM events
    WINDOW w7 AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW),
           w30 AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)"""


def rider_counts_before(spark: SparkSession, folder: str) -> DataFrame:
    """The trailing counts a live consumer reads before it counts the event itself."""
    rows = rider_features(rides(spark, folder), include_current=False, sunday_first=True)
    return rows.select(
        "rider_id",
        text_time("event_timestamp").alias("event_timestamp"),
        "rider_trips_7d",
        "rider_trips_30d",
        "day_of_week",
    )


RIDER_COUNTS_BEFORE_SQL = f"""
    SELECT DISTINCT user_id AS rider_id, strftime(ts, {SQL_TIME}) AS event_timestamp,
           count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING
                          AND INTERVAL 1 MICROSECOND PRECEDING) AS rider_trips_7d,
           count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAYS PRECEDING
                          AND INTERVAL 1 MICROSECOND PRECEDING) AS rider_trips_30d,
           (dayofweek(ts) + 1)::INT AS day_of_week
    FROM events"""


def rider_preferred_type(spark: SparkSession, folder: str) -> DataFrame:
    cutoff = F.lit("2024-01-21").cast("timestamp")
    return preferred_type(rides(spark, folder), "rider_id", "event_type", "event_timestamp", cutoff)


def preferred_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """The preferred type as of each event; an event of some kinds has no type."""
    trips = events(spark, folder).select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"))
    return preferred_type_as_of(trips, "user_id", "kind", "ts", ["event_id"]).select("event_id", "preferred_type", "preferred_trips")


PREFERRED_AS_OF_SQL = """
    WITH counts AS (
        SELECT a.event_id, b.event_type, count(*) AS n FROM events a JOIN events b
            ON a.user_id = b.user_id AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id)) AND b.event_type <> 'error'
        GROUP BY ALL),
    best AS (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, event_type) = 1)
    SELECT e.event_id, b.event_type AS preferred_type, coalesce(n, 0) AS preferred_trips FROM events e LEFT JOIN best b USING (event_id)"""

RIDER_PREFERRED_SQL = """
    SELECT rider_id, preferred_type, trips
    FROM (SELECT user_id AS rider_id, event_type AS preferred_type, count(*) AS trips,
                 row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS place
          FROM events WHERE ts < TIMESTAMP '2024-01-21' GROUP BY user_id, event_type)
    WHERE place = 1"""


def driver_features_daily(spark: SparkSession, folder: str) -> DataFrame:
    rows = driver_features(
        drives(spark, folder),
        cancelled=F.col("cancelled"),
        accepted=F.col("accepted"),
        distance=F.col("distance"),
        duration=F.col("duration"),
    )
    rates = [
        "driver_acceptance_rate_7d",
        "driver_cancellation_rate_7d",
        "driver_avg_trip_distance_7d",
        "driver_avg_trip_duration_7d",
    ]
    return rows.select(
        "driver_id",
        text_time("event_timestamp").alias("event_timestamp"),
        "driver_trips_today",
        "driver_trips_7d",
        "driver_trips_30d",
        *[F.round(c, 7).alias(c) for c in rates],
    )


DRIVER_FEATURES_SQL = f"""
    SELECT DISTINCT l_suppkey AS driver_id, strftime(l_shipdate, {SQL_TIME}) AS event_timestamp,
           count(*) OVER (PARTITION BY l_suppkey, l_shipdate::DATE) AS driver_trips_today,
           count(*) OVER w7 AS driver_trips_7d, count(*) OVER w30 AS driver_trips_30d,
           round(avg((l_linestatus = 'F')::INT) OVER w7, 7) AS driver_acceptance_rate_7d,
           round(avg((l_returnflag = 'R')::INT) OVER w7, 7) AS driver_cancellation_rate_7d,
           round(avg(l_quantity) OVER w7, 7) AS driver_avg_trip_distance_7d,
           round(avg(round(l_discount * 100, 4)) OVER w7, 7) AS driver_avg_trip_duration_7d
    FROM lineitem
    WINDOW w7 AS (PARTITION BY l_suppkey ORDER BY l_shipdate RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW),
           w30 AS (PARTITION BY l_suppkey ORDER BY l_shipdate RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)"""


def driver_hours_online(spark: SparkSession, folder: str) -> DataFrame:
    """Riders' event types as statuses, where a signup means offline."""
    rows = hours_online(
        rides(spark, folder), "rider_id", "event_timestamp", "event_type", ["event_id"], offline="signup"
    )
    return rows.select("rider_id", text_day("day").alias("day"), F.round("hours_online", 6).alias("hours_online"))


HOURS_ONLINE_SQL = """
    WITH spans AS (
        SELECT user_id, event_type, ts,
               lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until_ts FROM events),
    days AS (
        SELECT user_id, ts, until_ts,
               unnest(generate_series(ts::DATE::TIMESTAMP, until_ts::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS day
        FROM spans WHERE event_type <> 'signup' AND until_ts IS NOT NULL)
    SELECT user_id AS rider_id, strftime(day, '%Y-%m-%d') AS day,
           round(sum(epoch_us(least(until_ts, day + INTERVAL 1 DAY)) - epoch_us(greatest(ts, day)))::BIGINT
                 / 3600000000.0::DOUBLE, 6) AS hours_online
    FROM days GROUP BY ALL"""


def trip_features_query(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("rider_id"), "o_orderdate"
    )
    legs = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("trip_id"), "l_linenumber", F.col("l_suppkey").alias("driver_id")
    )
    trips = legs.join(orders, "trip_id", "left").withColumns(
        {
            "pickup_lat": latitude("rider_id"),
            "pickup_lng": longitude("rider_id"),
            "dropoff_lat": latitude("driver_id"),
            "dropoff_lng": longitude("driver_id"),
        }
    )
    riders = table(spark, folder, "customer").select(F.col("c_custkey").alias("rider_id"), "c_mktsegment")
    drivers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("driver_id"), "s_nationkey")
    return trip_features(trips, riders, drivers).select(
        "trip_id",
        "l_linenumber",
        "rider_id",
        "driver_id",
        text_time("o_orderdate").alias("started_at"),
        "c_mktsegment",
        "s_nationkey",
        F.round("trip_distance_km", 5).alias("trip_distance_km"),
    )


TRIP_FEATURES_SQL = f"""
    SELECT l_orderkey AS trip_id, l_linenumber, o_custkey AS rider_id, l_suppkey AS driver_id,
           strftime(o_orderdate, {SQL_TIME}) AS started_at, c_mktsegment, s_nationkey,
           round({sql_haversine(sql_latitude("o_custkey"), sql_longitude("o_custkey"),
                                sql_latitude("l_suppkey"), sql_longitude("l_suppkey"))}, 5) AS trip_distance_km
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
         LEFT JOIN supplier ON l_suppkey = s_suppkey"""


def trip_features_at_start_query(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as trips at the order's time, with the customer's and the supplier's history as features."""
    orders = table(spark, folder, "orders")
    lines = table(spark, folder, "lineitem")
    starts = orders.select(F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("rider_id"), F.col("o_orderdate").cast("timestamp").alias("started"))
    trips = lines.select(F.col("l_orderkey").alias("trip_id"), "l_linenumber", F.col("l_suppkey").alias("driver_id"), "l_returnflag", "l_linestatus")
    trips = trips.join(starts, "trip_id").select(
        "trip_id", "l_linenumber", "rider_id", "driver_id", "started",
        latitude("rider_id").alias("pickup_lat"), longitude("rider_id").alias("pickup_lng"),
        latitude("driver_id").alias("dropoff_lat"), longitude("driver_id").alias("dropoff_lng"),
        F.when(F.col("l_returnflag") == "R", "rain").otherwise("clear").alias("weather_condition"),
        F.when(F.col("l_linestatus") == "F", "heavy").otherwise("light").alias("traffic_level"),
    )
    riders = orders.select(F.col("o_custkey").alias("rider_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_totalprice").alias("rider_last_fare"))
    drivers = lines.select(F.col("l_suppkey").alias("driver_id"), F.col("l_shipdate").cast("timestamp").alias("at"), F.col("l_quantity").alias("driver_last_distance"))
    rows = trip_features_at_start(trips, riders, drivers, "started", "at", "at", ttl=MONTH)
    rounded = ["pickup_lat", "pickup_lng", "dropoff_lat", "dropoff_lng", "trip_distance_km", "estimated_duration_minutes"]
    return rows.select(
        "trip_id", "l_linenumber", "rider_last_fare", "driver_last_distance", "estimated_fare", "surge_multiplier",
        "weather_condition", "traffic_level", *[F.round(c, 4).alias(c) for c in rounded],
    )


_START_KM = sql_haversine(sql_latitude("o_custkey"), sql_longitude("o_custkey"), sql_latitude("l_suppkey"), sql_longitude("l_suppkey"))
TRIP_AT_START_SQL = f"""
    WITH r AS (SELECT o_custkey AS k, o_orderdate AS at, max(o_totalprice) AS rider_last_fare FROM orders GROUP BY ALL),
    d AS (SELECT l_suppkey AS k, l_shipdate AS at, max(l_quantity) AS driver_last_distance FROM lineitem GROUP BY ALL),
    t AS (SELECT *, {_START_KM} AS km FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_orderkey AS trip_id, l_linenumber, rider_last_fare,
           CASE WHEN d.at >= t.o_orderdate - INTERVAL 30 DAYS THEN driver_last_distance END AS driver_last_distance,
           round(8.0::DOUBLE + km * 2.5::DOUBLE, 2) AS estimated_fare, 1.0::DOUBLE AS surge_multiplier,
           CASE WHEN l_returnflag = 'R' THEN 'rain' ELSE 'clear' END AS weather_condition,
           CASE WHEN l_linestatus = 'F' THEN 'heavy' ELSE 'light' END AS traffic_level,
           round({sql_latitude("o_custkey")}, 4) AS pickup_lat, round({sql_longitude("o_custkey")}, 4) AS pickup_lng,
           round({sql_latitude("l_suppkey")}, 4) AS dropoff_lat, round({sql_longitude("l_suppkey")}, 4) AS dropoff_lng,
           round(km, 4) AS trip_distance_km, round(km / 30.0::DOUBLE * 60, 4) AS estimated_duration_minutes
    FROM t JOIN r ON r.k = t.o_custkey AND r.at = t.o_orderdate
    ASOF LEFT JOIN d ON d.k = t.l_suppkey AND d.at <= t.o_orderdate"""


def _places(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a pickup and, unless pending, a destination."""
    known = F.col("o_orderstatus") != "P"
    return table(spark, folder, "orders").withColumns(
        {
            "lat": latitude("o_custkey"),
            "lng": longitude("o_custkey"),
            "dest_lat": F.when(known, latitude("o_orderkey")),
            "dest_lng": F.when(known, longitude("o_orderkey")),
        }
    )


KM_SQL = (
    "CASE WHEN o_orderstatus <> 'P' THEN "
    + sql_haversine(
        sql_latitude("o_custkey"), sql_longitude("o_custkey"), sql_latitude("o_orderkey"), sql_longitude("o_orderkey")
    )
    + " END"
)


def haversine_distances(spark: SparkSession, folder: str) -> DataFrame:
    km = haversine_km(F.col("lat"), F.col("lng"), F.col("dest_lat"), F.col("dest_lng"))
    return _places(spark, folder).select("o_orderkey", F.round(km, 5).alias("distance_km"))


def surge_quotes(spark: SparkSession, folder: str) -> DataFrame:
    km = haversine_km(F.col("lat"), F.col("lng"), F.col("dest_lat"), F.col("dest_lng"))
    asked_at = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    quote = surge_quote(asked_at, km, stable_jitter(F.col("o_orderkey")))
    return _places(spark, folder).select("o_orderkey", *[c.alias(name) for name, c in quote.items()])


SURGE_SQL = f"""
    WITH q AS (
        SELECT o_orderkey, {KM_SQL} AS km,
               greatest(1.0::DOUBLE, least(3.0::DOUBLE,
                   CASE WHEN o_orderkey % 24 IN (7, 8, 9, 17, 18, 19) THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END
                   + ({sql_bucket("o_orderkey", 1000)} / 1000.0::DOUBLE * (0.3::DOUBLE - -0.1::DOUBLE) + -0.1::DOUBLE)
               )) AS surge
        FROM orders)
    SELECT o_orderkey, round(surge, 2) AS surge_multiplier, 8.0::DOUBLE AS base_fare,
           round(8.0::DOUBLE * surge + coalesce(km, 5.0::DOUBLE) * 2.5::DOUBLE, 2) AS estimated_fare,
           CASE WHEN surge > 1.5::DOUBLE THEN 'high' WHEN surge > 1.2::DOUBLE THEN 'moderate' ELSE 'normal' END
               AS demand_level
    FROM q"""


def calendar_features(spark: SparkSession, folder: str) -> DataFrame:
    ts = F.col("ts")
    return events(spark, folder).select(
        "event_id",
        iso_format(ts).alias("iso"),
        text_time(event_time(iso_format(ts))).alias("parsed"),
        F.hour(ts).alias("hour_of_day"),
        day_of_week(ts).alias("day_of_week"),
        day_of_week(ts, sunday_first=True).alias("day_of_week_sunday_first"),
        is_weekend(ts).alias("is_weekend"),
        is_peak_hour(ts).alias("is_peak_hour"),
        text_day(F.to_date(ts)).alias("day"),
        text_time(add_days(ts, 30)).alias("in_30_days"),
        text_time(add_days(ts, -7)).alias("a_week_before"),
    )


CALENDAR_SQL = f"""
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, strftime(ts, {SQL_TIME}) AS parsed,
           hour(ts)::INT AS hour_of_day, (isodow(ts) - 1)::INT AS day_of_week,
           (dayofweek(ts) + 1)::INT AS day_of_week_sunday_first, (isodow(ts) >= 6)::INT AS is_weekend,
           (hour(ts) IN (7, 8, 9, 17, 18, 19))::INT AS is_peak_hour, strftime(ts, '%Y-%m-%d') AS day,
           strftime(ts + INTERVAL 30 DAYS, {SQL_TIME}) AS in_30_days,
           strftime(ts - INTERVAL 7 DAYS, {SQL_TIME}) AS a_week_before
    FROM events"""


def categorical_encode(spark: SparkSession, folder: str) -> DataFrame:
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    traffic = F.when(priority == "1-URGENT", "heavy").when(priority == "2-HIGH", "moderate").when(
        priority == "5-LOW", "light"
    )
    weather = F.when(status == "F", "fog").when(status == "O", "rain").otherwise("hail")
    vehicle = F.when(priority == "1-URGENT", "luxury").when(priority == "2-HIGH", "suv").otherwise("sedan")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        ordinal(traffic, TRAFFIC_CODES, TRAFFIC_DEFAULT).alias("traffic_level"),
        ordinal(weather, WEATHER_CODES, WEATHER_DEFAULT).alias("weather_condition"),
        ordinal(vehicle, VEHICLE_CODES, VEHICLE_DEFAULT).alias("vehicle_type"),
        F.coalesce(F.when(status != "P", F.col("o_totalprice")), F.lit(0.0)).alias("price"),
    )


CATEGORICAL_SQL = """
    SELECT o_orderkey,
           CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 0 ELSE 1 END AS traffic_level,
           CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 1 ELSE 0 END AS weather_condition,
           CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 ELSE 0 END AS vehicle_type,
           CASE WHEN o_orderstatus <> 'P' THEN o_totalprice ELSE 0.0::DOUBLE END AS price
    FROM orders"""


def daily_extract_query(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    return daily_extract(table(spark, folder, "orders"), columns, "o_orderdate", DAY)


def driver_extract_day(spark: SparkSession, folder: str) -> DataFrame:
    """A day's driver rows with the declared columns, from line items as driver activity."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("driver_id"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        latitude("l_suppkey").alias("latitude"),
        longitude("l_suppkey").alias("longitude"),
        F.col("l_linestatus").alias("status"),
        F.lit("sedan").alias("vehicle_type"),
        F.col("l_quantity").alias("avg_rating"),
        F.col("l_discount").alias("acceptance_rate"),
        F.col("l_orderkey").alias("not_extracted"),
    )
    found = driver_extract(rows, DAY)
    return found.withColumns({"timestamp": text_time("timestamp"), "latitude": F.round("latitude", 8), "longitude": F.round("longitude", 8)})


DRIVER_EXTRACT_SQL = f"""
    SELECT l_suppkey AS driver_id, strftime(l_shipdate::TIMESTAMP, {SQL_TIME}) AS timestamp, round({sql_latitude("l_suppkey")}, 8) AS latitude,
           round({sql_longitude("l_suppkey")}, 8) AS longitude, l_linestatus AS status, 'sedan' AS vehicle_type, l_quantity AS avg_rating,
           l_discount AS acceptance_rate
    FROM lineitem WHERE l_shipdate >= TIMESTAMP '{DAY}' AND l_shipdate < TIMESTAMP '{DAY}' + INTERVAL 1 DAY"""


def type_counts_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of event types, written as text with a header and read back."""
    path = shared_dir(spark, "csv")
    write_csv(events(spark, folder).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.option("header", True).schema("event_type string, n bigint").csv(path)


def features_daily_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    """Order features written by month, one month written again, and read back."""
    root = shared_dir(spark, "daily")
    orders = table(spark, folder, "orders")
    features = orders.select(
        "o_custkey",
        text_day("o_orderdate").alias("day"),
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("ds"),
    ).distinct()
    written = write_days(features, root)
    assert written.get["rows"] > 0
    month = date(1998, 10, 1)
    write_days(features.where(F.col("ds") == F.lit(month)), root)
    one_month = read_day(spark, root, features.schema, month)
    rest = spark.read.schema(features.schema).parquet(root).where(F.col("ds") != F.lit(month)).drop("ds")
    return one_month.unionByName(rest)


def daily_job(spark: SparkSession, folder: str) -> DataFrame:
    """Two days of rider features, each from its own month of partitions, then materialized."""
    root = shared_dir(spark, "job")
    activity = rides(spark, folder).withColumn("ds", F.to_date("event_timestamp"))
    append_days(activity, f"{root}/activity")

    def compute(rows: DataFrame) -> DataFrame:
        features = rider_features(rows, fare=F.col("value"))
        return features.withColumn("rider_avg_fare_30d", F.round("rider_avg_fare_30d", 8))

    rules = [not_null("rider_id"), between("is_peak_hour", 0, 1)]
    for day in JOB_DAYS:
        check_day(run_day(spark, f"{root}/activity", f"{root}/features", activity.schema, day, compute, expectations=rules))
    written = spark.read.parquet(f"{root}/features")
    newest = latest(written, ["rider_id"], "event_timestamp")
    return newest.select(
        "rider_id",
        text_time("event_timestamp").alias("event_timestamp"),
        "rider_trips_7d",
        "rider_trips_30d",
        "rider_avg_fare_30d",
        "day_of_week",
    )


DAILY_JOB_SQL = f"""
    WITH f AS (
        SELECT user_id, ts, count(*) OVER w7 AS n7, count(*) OVER w30 AS n30, avg(value) OVER w30 AS fare FROM events
        WINDOW w7 AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW),
               w30 AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW))
    SELECT user_id AS rider_id, strftime(ts, {SQL_TIME}) AS event_timestamp, n7 AS rider_trips_7d, n30 AS rider_trips_30d,
           round(fare, 8) AS rider_avg_fare_30d, (isodow(ts) - 1)::INT AS day_of_week
    FROM f WHERE ts::DATE IN ({", ".join(f"DATE '{d}'" for d in JOB_DAYS)})
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1"""


def trailing_small_values(spark: SparkSession, folder: str) -> DataFrame:
    """Sums and averages over a week of values far below one, far above, and of exact decimals."""
    value = F.col("value")
    specs = [
        Trailing("small", WEEK, "avg", value * 1e-12),
        Trailing("small_sum", WEEK, "sum", value * 1e-12),
        Trailing("large", WEEK, "avg", value * 1e15),
        Trailing("cents", WEEK, "sum", F.round(value, 2).cast("decimal(18,2)")),
    ]
    rows = trailing(rides(spark, folder), ["rider_id"], "event_timestamp", specs)
    shown = {"small": 1e12, "small_sum": 1e12, "large": 1e-15, "cents": 1.0}
    return rows.select(
        "rider_id",
        text_time("event_timestamp").alias("event_timestamp"),
        *[F.round(F.col(name).cast("double") * factor, 6).alias(name) for name, factor in shown.items()],
    )


SMALL_VALUES_SQL = f"""
    SELECT DISTINCT user_id AS rider_id, strftime(ts, {SQL_TIME}) AS event_timestamp,
           round(avg(value) OVER w7, 6) AS small, round(sum(value) OVER w7, 6) AS small_sum, round(avg(value) OVER w7, 6) AS large,
           round(sum(round(value, 2)::DECIMAL(18, 2)) OVER w7::DOUBLE, 6) AS cents
    FROM events WINDOW w7 AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)"""


QUERIES = {
    "trip_features_at_start": trip_features_at_start_query,
    "trailing_small_values": trailing_small_values,
    "rider_features_daily": rider_features_daily,
    "rider_rates": rider_rates,
    "rider_counts_before": rider_counts_before,
    "rider_preferred_type": rider_preferred_type,
    "preferred_type_as_of": preferred_as_of,
    "driver_features_daily": driver_features_daily,
    "driver_hours_online": driver_hours_online,
    "trip_features": trip_features_query,
    "haversine_distances": haversine_distances,
    "surge_quote": surge_quotes,
    "calendar_features": calendar_features,
    "categorical_encode": categorical_encode,
    "driver_extract_day": driver_extract_day,
    "type_counts_csv": type_counts_csv,
    "daily_extract": daily_extract_query,
    "features_daily_overwrite": features_daily_overwrite,
    "daily_job": daily_job,
    "value_counts": lambda spark, folder: value_counts(table(spark, folder, "orders"), "o_orderpriority").select(
        "value", "n", F.round("share", 8).alias("share")
    ),
}

ORACLE = {
    "trip_features_at_start": TRIP_AT_START_SQL,
    "trailing_small_values": SMALL_VALUES_SQL,
    "rider_features_daily": RIDER_FEATURES_SQL,
    "rider_rates": RIDER_RATES_SQL,
    "rider_counts_before": RIDER_COUNTS_BEFORE_SQL,
    "rider_preferred_type": RIDER_PREFERRED_SQL,
    "preferred_type_as_of": PREFERRED_AS_OF_SQL,
    "driver_features_daily": DRIVER_FEATURES_SQL,
    "driver_hours_online": HOURS_ONLINE_SQL,
    "trip_features": TRIP_FEATURES_SQL,
    "haversine_distances": f"SELECT o_orderkey, round({KM_SQL}, 5) AS distance_km FROM orders",
    "surge_quote": SURGE_SQL,
    "calendar_features": CALENDAR_SQL,
    "categorical_encode": CATEGORICAL_SQL,
    "driver_extract_day": DRIVER_EXTRACT_SQL,
    "type_counts_csv": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "daily_extract": f"""
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
        WHERE o_orderdate::DATE = DATE '{DAY}'""",
    "daily_job": DAILY_JOB_SQL,
    "features_daily_overwrite": """
        SELECT DISTINCT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""",
    "value_counts": """
        SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 8) AS share
        FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL""",
}
