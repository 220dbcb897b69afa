"""Streams over the given tables, run until all is processed, and what their sinks hold.

A table is written to a working folder in parts, in the order of time, and read a
part per micro-batch, so that state, watermarks and the merging of batches are
part of every query.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.events import topic_of
from ..operators.asof import latest
from ..operators.monitoring import health_windows
from ..session import shared_dir
from ..sources.readers import read_parquet_stream
from ..sources.snapshots import SnapshotTable
from ..sources.topics import append_messages, find_records, read_topic_log
from ..streaming import counters, sinks
from ..streaming import events as E
from ..streaming.profiles import driver_features, keyed_state, rider_features
from .serving import KINDS_SQL, event_records
from .tables import (
    PREDICTIONS_SQL,
    SQL_TIME,
    sql_bucket,
    sql_haversine,
    sql_latitude,
    sql_longitude,
    table,
    text_time,
)


# Micro-batches per query, and the least files of a micro-batch and state partitions; larger tables have more of both.
BATCHES = 3
FILES = 2
STATE = 8
# Rows of a file and of a state partition in a micro-batch, and the most state partitions, each a store of its own.
FILE_ROWS = 250_000
STATE_ROWS = 100_000
MOST_STATE = 256
# Rows of a group of keys in a micro-batch, and the least groups.
GROUP_ROWS = 20_000
GROUPS = 64


def _files(rows: int) -> int:
    """Files of each micro-batch of a table, all read at once, so that no task's share grows with the table."""
    return max(FILES, math.ceil(rows / BATCHES / FILE_ROWS))


def _state(*tables: DataFrame) -> int:
    """State partitions for queries over these tables."""
    return min(MOST_STATE, max(STATE, math.ceil(sum(rows.count() for rows in tables) / BATCHES / STATE_ROWS)))


def _groups(rows: DataFrame) -> int:
    """Groups of keys whose state is read and written at once, for queries over this table."""
    return max(GROUPS, math.ceil(rows.count() / BATCHES / GROUP_ROWS))


def _parts(spark: SparkSession, folder: str, name: str, ts: str, again: bool = False) -> DataFrame:
    """A table as a stream of ``BATCHES`` parts in the order of ``ts``; the first part arrives ``again`` at the end.

    Rows without a time are in the first part.
    """
    rows = table(spark, folder, name)
    axis = F.unix_micros(F.col(ts).cast("timestamp"))
    found = rows.agg(F.approx_percentile(axis, [i / BATCHES for i in range(1, BATCHES)]), F.count(F.lit(1))).first()
    cuts, files = found[0] or [0] * (BATCHES - 1), _files(found[1])
    part = F.coalesce(sum(((axis > cut).cast("int") for cut in cuts), F.lit(0)), F.lit(0))
    root = shared_dir(spark, name)
    for number in [*range(BATCHES), *([0] if again else [])]:
        rows.where(part == number).repartition(files).write.mode("append").parquet(root)
    return read_parquet_stream(spark, root, rows.schema, max_files=files)


def _events(spark: SparkSession, folder: str, again: bool = False) -> DataFrame:
    return _parts(spark, folder, "events", "ts", again).withColumn("ts", F.col("ts").cast("timestamp"))


def _as_text(rows: DataFrame) -> DataFrame:
    """Events as JSON text; those with a large value are cut short."""
    value = F.to_json("record")
    broken = F.col("value") > 100
    cut = value.substr(F.lit(1), F.length(value) - 5)
    return event_records(rows).select(F.when(broken, cut).otherwise(value).alias("value"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return _as_text(_events(spark, folder))


def _with_restart(spark: SparkSession, folder: str, root: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``make`` gives for a stream of event texts; the query ends before the last part arrives and starts again."""
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    axis = F.unix_micros("ts")
    found = rows.agg(F.approx_percentile(axis, [i / (BATCHES + 1) for i in range(1, BATCHES + 1)]), F.count(F.lit(1))).first()
    cuts, files = found[0] or [0] * BATCHES, _files(found[1])
    state = _state(rows)
    part = F.coalesce(sum(((axis > cut).cast("int") for cut in cuts), F.lit(0)), F.lit(0))
    source = f"{root}/source"
    with keyed_state(spark):
        for arrived in (range(BATCHES), [BATCHES]):
            for number in arrived:
                rows.where(part == number).repartition(files).write.mode("append").parquet(source)
            stream = read_parquet_stream(spark, source, rows.schema, max_files=files)
            sinks.run_to_files(make(E.parse(_as_text(stream))), root, partitions=state)
    return spark.read.parquet(f"{root}/data")


DAYS = (1, 7, 30)


def stream_rider_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per user over 1, 7 and 30 days, every day: daily counts are merged into a table and added up when read."""
    root = shared_dir(spark, "sliding")
    counts = counters.daily_counts(_events(spark, folder), ["user_id"], "ts")
    target = SnapshotTable(spark, f"{root}/table", ("user_id", "day"), ("batch",))
    sinks.run_versioned_upserts(counts, target, root, partitions=_state(table(spark, folder, "events")))
    daily = target.read().select("user_id", "day", "n")
    rows = [
        counters.windows_of_days(daily, ["user_id"], days).withColumn("days", F.lit(days)) for days in DAYS
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select(
        "user_id", "days", text_time("window_start").alias("window_start"), text_time("window_end").alias("window_end"), "n"
    )


RIDER_COUNTS_SQL = " UNION ALL ".join(
    f"""
    SELECT user_id, {days} AS days, strftime(w - INTERVAL {days} DAYS, {SQL_TIME}) AS window_start, strftime(w, {SQL_TIME}) AS window_end,
           count(*) AS n
    FROM (SELECT user_id, unnest(generate_series(ts::DATE + INTERVAL 1 DAY, ts::DATE + INTERVAL {days} DAYS, INTERVAL 1 DAY)) AS w
          FROM events)
    GROUP BY user_id, w"""
    for days in DAYS
)


def stream_gap_counter(spark: SparkSession, folder: str) -> DataFrame:
    """Counts that start again after a day of silence, those still open included: the newest state of each session."""
    root = shared_dir(spark, "gaps")
    target = SnapshotTable(spark, f"{root}/table", ("user_id", "session_start"), ("batch",))
    rows = _events(spark, folder).select("user_id", "ts")
    sinks.run_sessions(rows, target, root, ["user_id"], "ts", "1 day", partitions=_state(table(spark, folder, "events")))
    return target.read().where("n > 0").select(
        "user_id", text_time("session_start").alias("session_start"), text_time("session_end").alias("session_end"), "n"
    )


GAP_COUNTER_SQL = f"""
    WITH m AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY AS goes_on FROM events),
    s AS (SELECT *, count(*) FILTER (goes_on IS NOT true) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM m)
    SELECT user_id, strftime(min(ts), {SQL_TIME}) AS session_start,
           strftime(max(ts) + INTERVAL 1 DAY, {SQL_TIME}) AS session_end, count(*) AS n
    FROM s GROUP BY user_id, session"""


def stream_dedup_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Every event arrives twice, and the first part once more, late; the latest of each user is kept, with an expiry."""
    root = shared_dir(spark, "dedup")
    twice = _events(spark, folder, again=True).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    single = E.once(twice, "event_id", "ts")
    newest = SnapshotTable(spark, f"{root}/newest", ("user_id",), ("ts", "event_id"))
    counted = SnapshotTable(spark, f"{root}/counted", ("user_id",), ("seen",))

    def handle(batch: DataFrame, number: int) -> None:
        writer = sinks.writer_name(batch)
        batch = batch.persist()
        try:
            newest.upsert(latest(batch, ["user_id"], "ts", ["event_id"]), number, writer)
            seen = batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("seen"))
            before = counted.read(number, writer)
            if before is not None:
                seen = seen.unionByName(before).groupBy("user_id").agg(F.sum("seen").alias("seen"))
            counted.upsert(seen, number, writer)
        finally:
            batch.unpersist()

    sinks.run_batches(single, root, handle, partitions=_state(table(spark, folder, "events")))
    return newest.read().join(counted.read(), "user_id").select(
        "user_id", text_time("ts").alias("ts"), "event_id", "event_type", "seen",
        text_time(F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"),
    )


DEDUP_SQL = f"""
    SELECT user_id, strftime(ts, {SQL_TIME}) AS ts, event_id, event_type, count(*) OVER (PARTITION BY user_id) AS seen,
           strftime(ts + INTERVAL 24 HOURS, {SQL_TIME}) AS expires_at
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY events.ts DESC, event_id DESC) = 1"""


def stream_trip_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as trip starts joined with line items shipped within 120 days as their ends."""
    root = shared_dir(spark, "pairs")
    starts = _parts(spark, folder, "orders", "o_orderdate").select(
        F.col("o_orderkey").alias("trip_id"), F.col("o_orderdate").cast("timestamp").alias("started_at"), "o_totalprice"
    )
    ends = _parts(spark, folder, "lineitem", "l_shipdate").select(
        F.col("l_orderkey").alias("trip_id"), F.col("l_shipdate").cast("timestamp").alias("ended_at"), "l_linenumber"
    )
    state = _state(table(spark, folder, "orders"), table(spark, folder, "lineitem"))
    pairs = sinks.run_trip_pairs(starts, ends, root, "trip_id", "started_at", "ended_at", "120 DAYS", partitions=state)
    days = F.datediff("ended_at", "started_at").cast("bigint")
    return spark.read.parquet(pairs).select("trip_id", "l_linenumber", "o_totalprice", days.alias("days"))


TRIP_PAIRS_SQL = """
    SELECT o_orderkey AS trip_id, l_linenumber, o_totalprice, date_diff('day', o_orderdate, l_shipdate) AS days
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey
     AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 120 DAYS"""


def stream_dead_letter(spark: SparkSession, folder: str) -> DataFrame:
    """Records that cannot be processed, with the reason."""
    root = shared_dir(spark, "dead")
    parsed = sinks.observe_outcomes(E.parse(_texts(spark, folder)))
    sinks.run_to_files(E.dead_letters(parsed), root, partitions=_state(table(spark, folder, "events")))
    letters = spark.read.parquet(f"{root}/data")
    return letters.select("problem", F.regexp_extract("value", '"event_id":"([0-9]+)"', 1).alias("event_id"))


DEAD_LETTER_SQL = """
    SELECT CASE WHEN value > 100 THEN 'broken' WHEN event_type = 'error' THEN 'unknown' ELSE 'unhandled' END
               AS problem, event_id::VARCHAR AS event_id
    FROM events WHERE value > 100 OR event_type IN ('error', 'signup')"""


def stream_dead_letter_origin(spark: SparkSession, folder: str) -> DataFrame:
    """Broken and unhandled records with their topic, partition and offset, found again in the log by these.

    Events arrive in batches of ten days; the last one arrives, and the one before arrives again, when the query has
    ended once.
    """
    root = shared_dir(spark, "origin")
    records = event_records(table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    value = F.to_json("record")
    cut = value.substr(F.lit(1), F.length(value) - 5)
    messages = records.select(
        topic_of(F.col("record.event_type")).alias("topic"), F.col("user_id").cast("string").alias("key"),
        F.when(F.col("value") > 100, cut).otherwise(value).alias("value"), "ts", "event_id", F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)).alias("part"),
    )
    for arrived in ([0, 1], [1, 2]):
        for part in arrived:
            append_messages(messages.where(F.col("part") == part), f"{root}/log", part, "ts", ["event_id"], partitions=4)
        parsed = E.parse(read_topic_log(spark, f"{root}/log", max_files=FILES))
        sinks.run_to_files(E.dead_letters(parsed), root, partitions=STATE)
    letters = spark.read.parquet(f"{root}/data")
    found = find_records(spark, f"{root}/log", letters)
    return letters.drop("value").join(found, ["topic", "partition", "offset"]).select(
        "problem", "topic", "partition", "offset", F.col("key").alias("user_id"), F.regexp_extract("value", '"event_id":"([0-9]+)"', 1).alias("event_id")
    )


DEAD_LETTER_ORIGIN_SQL = f"""
    WITH e AS (SELECT *, split_part({KINDS_SQL}, '.', 1) || '.events' AS topic, {sql_bucket("user_id", 4)}::INT AS "partition"
               FROM events WHERE event_type <> 'error'),
    n AS (SELECT *, row_number() OVER (PARTITION BY topic, "partition" ORDER BY least((day(ts) - 1) // 10, 2), ts, event_id) - 1 AS "offset" FROM e)
    SELECT CASE WHEN value > 100 THEN 'broken' ELSE 'unhandled' END AS problem, topic, "partition", "offset", user_id::VARCHAR AS user_id,
           event_id::VARCHAR AS event_id
    FROM n WHERE value > 100 OR event_type = 'signup'"""


def stream_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Records and failures of a running query, added up over its micro-batches, beside what its sink holds."""
    root = shared_dir(spark, "progress")
    log = sinks.ProgressLog()
    spark.streams.addListener(log)
    try:
        parsed = sinks.observe_outcomes(E.parse(_texts(spark, folder)))
        query = sinks.run_to_files(E.dead_letters(parsed), root, partitions=_state(table(spark, folder, "events")))
        totals = log.totals(str(query.id), "events", timeout=60)
    finally:
        spark.streams.removeListener(log)
    rows = spark.createDataFrame([(totals["total"], totals["errors"])], "total bigint, errors bigint")
    letters = spark.read.parquet(f"{root}/data").agg(F.count(F.lit(1)).alias("dead_letters"))
    # One row each.
    return rows.join(F.broadcast(letters))


PROGRESS_SQL = """
    SELECT count(*) AS total, count(*) FILTER (bad) AS errors, count(*) FILTER (bad) AS dead_letters
    FROM (SELECT value > 100 OR event_type IN ('error', 'signup') AS bad FROM events)"""


def stream_event_features(spark: SparkSession, folder: str) -> DataFrame:
    """One parsed stream, a table of features per route."""
    root = shared_dir(spark, "routes")
    parsed = E.parse(_texts(spark, folder))
    views = {
        "rider": E.rider_event_features,
        "driver": E.driver_event_features,
        "trip": E.trip_event_features,
    }

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for route, view in views.items():
                view(batch).write.mode("overwrite").parquet(f"{root}/{route}/batch={number}")
        finally:
            batch.unpersist()

    sinks.run_batches(parsed, root, handle, partitions=_state(table(spark, folder, "events")))
    riders, drivers, trips = (spark.read.parquet(f"{root}/{route}") for route in views)
    riders = riders.select(
        F.lit("rider").alias("route"), "event_id", "hour_of_day", "is_peak_hour", "trip_distance_km", "rider_rating"
    )
    drivers = drivers.select(F.lit("driver").alias("route"), "event_id", "hour_of_day", "driver_status")
    trips = trips.select(F.lit("trip").alias("route"), "event_id", "trip_distance_km", "actual_fare", "actual_duration")
    rows = riders.unionByName(drivers, allowMissingColumns=True).unionByName(trips, allowMissingColumns=True)
    return rows.withColumns(
        {
            "trip_distance_km": F.round("trip_distance_km", 5),
            "hour_of_day": F.col("hour_of_day").cast("string"),
            "is_peak_hour": F.col("is_peak_hour").cast("string"),
        }
    )


EVENT_KM_SQL = sql_haversine(
    sql_latitude("user_id"), sql_longitude("user_id"), sql_latitude("event_id"), sql_longitude("event_id")
)
EVENT_FEATURES_SQL = f"""
    SELECT split_part({KINDS_SQL}, '.', 1) AS route, event_id::VARCHAR AS event_id,
           CASE WHEN event_type <> 'purchase' THEN hour(ts)::VARCHAR END AS hour_of_day,
           CASE WHEN event_type = 'click' THEN (hour(ts) IN (7, 8, 9, 17, 18, 19))::INT::VARCHAR END AS is_peak_hour,
           CASE WHEN event_type = 'purchase' OR (event_type = 'click' AND user_id % 3 > 0) THEN round({EVENT_KM_SQL}, 5) END
               AS trip_distance_km,
           CASE WHEN event_type = 'click' THEN 4.5::DOUBLE END AS rider_rating,
           CASE WHEN event_type = 'view' THEN 'available' END AS driver_status,
           CASE WHEN event_type = 'purchase' THEN value END AS actual_fare,
           CASE WHEN event_type = 'purchase' THEN value / 2 END AS actual_duration
    FROM events WHERE value <= 100 AND event_type IN ('click', 'view', 'purchase')"""


# Ratings and answers to requests are not in the given events: some get one from their number.
def _number() -> Column:
    return F.col("event.event_id").cast("bigint")


def _rating() -> Column:
    return F.when(_number() % 4 == 0, 3 + (_number() % 8) * 0.25)


RATING_SQL = "CASE WHEN event_id % 4 = 0 THEN 3 + (event_id % 8) * 0.25 END"


def stream_rider_features(spark: SparkSession, folder: str) -> DataFrame:
    """Every rider event with its rider's trips and rating until then, from state kept over micro-batches and a restart."""
    root = shared_dir(spark, "riders")
    groups = _groups(table(spark, folder, "events"))
    found = _with_restart(spark, folder, root, lambda parsed: rider_features(parsed, rating=_rating(), groups=groups))
    return found.select(
        "event_id", "rider_id", "hour_of_day", "day_of_week", "is_peak_hour", "is_weekend", F.round("pickup_lat", 8).alias("pickup_lat"),
        F.round("trip_distance_km", 5).alias("trip_distance_km"), "rider_trips_7d", "rider_trips_30d",
        F.round("rider_avg_rating", 8).alias("rider_avg_rating"), text_time("previous_ts").alias("previous_ts"),
    )


def _before_sql(key: str, counted: str, days: int) -> str:
    """Earlier rows of a key for which ``counted`` is 1, of the last ``days`` days, the row's own day included."""
    return f"""(sum({counted}) OVER ({key} ORDER BY ts, event_id::VARCHAR ROWS UNBOUNDED PRECEDING) - {counted}
                - coalesce(sum({counted}) OVER ({key} ORDER BY ts::DATE RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {days} DAYS PRECEDING), 0))"""


RIDER_FEATURES_SQL = f"""
    WITH c AS (SELECT *, 1 AS trip, CASE WHEN event_type = 'click' THEN {RATING_SQL} END AS rating, event_type = 'click' AS wanted
               FROM events WHERE value <= 100 AND event_type IN ('click', 'purchase')),
    k AS (SELECT *, {_before_sql("PARTITION BY user_id", "trip", 7)}::BIGINT AS rider_trips_7d,
                 {_before_sql("PARTITION BY user_id", "trip", 30)}::BIGINT AS rider_trips_30d,
                 coalesce(avg(rating) OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4.5) AS rated
          FROM c)
    SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS rider_id, hour(ts)::INT AS hour_of_day, (isodow(ts) - 1)::INT AS day_of_week,
           (hour(ts) IN (7, 8, 9, 17, 18, 19))::INT AS is_peak_hour, (isodow(ts) >= 6)::INT AS is_weekend,
           round({sql_latitude("user_id")}, 8) AS pickup_lat,
           CASE WHEN user_id % 3 > 0 THEN round({EVENT_KM_SQL}, 5) END AS trip_distance_km, rider_trips_7d, rider_trips_30d,
           round(rated, 8) AS rider_avg_rating,
           strftime(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR), {SQL_TIME}) AS previous_ts
    FROM k WHERE wanted"""


def stream_driver_features(spark: SparkSession, folder: str) -> DataFrame:
    """Every driver event with its driver's trips, acceptance rate and rating until then; every third is a request refused."""
    root = shared_dir(spark, "drivers")
    groups = _groups(table(spark, folder, "events"))
    found = _with_restart(
        spark, folder, root, lambda parsed: driver_features(parsed, _number() % 5 > 0, _number() % 3 > 0, rating=_rating(), groups=groups)
    )
    return found.select(
        "event_id", "driver_id", "driver_status", "vehicle_type", "hour_of_day", "day_of_week", F.round("current_lat", 8).alias("current_lat"),
        "driver_trips_today", "driver_trips_7d", F.round("driver_acceptance_rate_7d", 8).alias("driver_acceptance_rate_7d"),
        F.round("driver_avg_rating", 8).alias("driver_avg_rating"),
    )


DRIVER_FEATURES_SQL = f"""
    WITH c AS (SELECT *, user_id % 20 AS driver, event_type = 'view' AS wanted, (event_type = 'purchase')::INT AS trip,
                      (event_type = 'view' AND event_id % 5 > 0)::INT AS asked, (event_type = 'view' AND event_id % 5 > 0 AND event_id % 3 > 0)::INT AS taken,
                      CASE WHEN event_type = 'view' THEN {RATING_SQL} END AS rating
               FROM events WHERE value <= 100 AND event_type IN ('view', 'purchase')),
    k AS (SELECT *, {_before_sql("PARTITION BY driver", "trip", 1)}::BIGINT AS driver_trips_today,
                 {_before_sql("PARTITION BY driver", "trip", 7)}::BIGINT AS driver_trips_7d,
                 {_before_sql("PARTITION BY driver", "asked", 7)} AS asked_7d, {_before_sql("PARTITION BY driver", "taken", 7)} AS taken_7d,
                 coalesce(avg(rating) OVER (PARTITION BY driver ORDER BY ts, event_id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4.5) AS rated
          FROM c)
    SELECT event_id::VARCHAR AS event_id, driver::VARCHAR AS driver_id, 'available' AS driver_status, 'sedan' AS vehicle_type,
           hour(ts)::INT AS hour_of_day, (isodow(ts) - 1)::INT AS day_of_week, round({sql_latitude("user_id")}, 8) AS current_lat,
           driver_trips_today, driver_trips_7d,
           CASE WHEN asked_7d > 0 THEN round(taken_7d / asked_7d::DOUBLE, 8) ELSE 0 END AS driver_acceptance_rate_7d, round(rated, 8) AS driver_avg_rating
    FROM k WHERE wanted"""


def stream_trip_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Daily trips of the rider and the driver of every ended trip."""
    root = shared_dir(spark, "trips")
    ended = E.trip_entities(E.trip_event_features(E.parse(_texts(spark, folder))))
    keys = ["entity_type", "entity_id"]
    counts = counters.daily_counts(ended, keys, "event_ts")
    target = SnapshotTable(spark, f"{root}/table", (*keys, "day"), ("batch",))
    sinks.run_versioned_upserts(counts, target, root, partitions=_state(table(spark, folder, "events")))
    return target.read().select(*keys, text_time("day").alias("window_start"), "n")


TRIP_COUNTERS_SQL = f"""
    WITH t AS (SELECT * FROM events WHERE event_type = 'purchase' AND value <= 100),
    e AS (SELECT 'rider' AS entity_type, user_id::VARCHAR AS entity_id, ts FROM t
          UNION ALL SELECT 'driver', (user_id % 20)::VARCHAR, ts FROM t)
    SELECT entity_type, entity_id, strftime(date_trunc('day', ts), {SQL_TIME}) AS window_start, count(*) AS n
    FROM e GROUP BY ALL"""


def stream_online_store(spark: SparkSession, folder: str) -> DataFrame:
    """The latest features of each rider as JSON with an expiry."""
    root = shared_dir(spark, "store")
    features = E.rider_event_features(E.parse(_texts(spark, folder)))
    rows = E.online_rows(features, "rider", "rider_id", "event_ts", F.lit(timedelta(hours=24)))
    target = SnapshotTable(spark, f"{root}/table", ("entity_type", "entity_id"), ("updated_at", "features"))
    sinks.run_upserts(rows, target, root, partitions=_state(table(spark, folder, "events")))
    return target.read().select(
        "entity_type",
        "entity_id",
        text_time("updated_at").alias("updated_at"),
        text_time("expires_at").alias("expires_at"),
        F.get_json_object("features", "$.event_id").alias("event_id"),
        F.get_json_object("features", "$.day_of_week").alias("day_of_week"),
    )


ONLINE_STORE_SQL = f"""
    SELECT 'rider' AS entity_type, user_id::VARCHAR AS entity_id, strftime(ts, {SQL_TIME}) AS updated_at,
           strftime(ts + INTERVAL 24 HOURS, {SQL_TIME}) AS expires_at, event_id::VARCHAR AS event_id,
           (isodow(ts) - 1)::VARCHAR AS day_of_week
    FROM events WHERE event_type = 'click' AND value <= 100
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1"""


def stream_running_count(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with its user's count so far."""
    root = shared_dir(spark, "running")
    state = SnapshotTable(spark, f"{root}/state", ("user_id",), ("n",))
    rows = _events(spark, folder).select("event_id", "user_id", "ts")
    out = sinks.run_running_counts(rows, state, root, ["user_id"], "ts", ["event_id"], partitions=_state(table(spark, folder, "events")))
    totals = state.read().select("user_id", F.col("n").alias("total"))
    return spark.read.parquet(out).join(totals, "user_id").select("event_id", "user_id", "running_count", "total")


def stream_health(spark: SparkSession, folder: str) -> DataFrame:
    """Health of predictions per five minutes and model, as windows change."""
    root = shared_dir(spark, "health")
    log = _parts(spark, folder, "events", "ts").select(
        F.when(F.col("user_id") % 2 == 0, "eta").otherwise("surge").alias("model_name"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
    )
    measured = health_windows(log.withWatermark("ts", E.WATERMARK), max_latency_ms=150.0)
    target = SnapshotTable(spark, f"{root}/table", ("window_start", "model_name"), ("batch",))
    sinks.run_versioned_upserts(measured, target, root, partitions=_state(table(spark, folder, "events")))
    return target.read().select(
        text_time("window_start").alias("window_start"),
        "model_name",
        "requests",
        F.round("error_rate", 8).alias("error_rate"),
        "healthy",
    )


HEALTH_SQL = f"""
    WITH log AS ({PREDICTIONS_SQL})
    SELECT strftime(time_bucket(INTERVAL 5 MINUTES, ts, TIMESTAMP '2024-01-01'), {SQL_TIME}) AS window_start, model_name,
           count(*) AS requests, round(count(*) FILTER (status = 'error') / count(*)::DOUBLE, 8) AS error_rate,
           count(*) FILTER (status = 'error') / count(*)::DOUBLE <= 0.05 AND avg(latency_ms) <= 150 AS healthy
    FROM log GROUP BY ALL"""


def stream_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Records per route and outcome, as a live count."""
    root = shared_dir(spark, "outcomes")
    counts = E.outcome_counts(E.parse(_texts(spark, folder)))
    target = SnapshotTable(spark, f"{root}/table", ("route", "outcome"), ("batch",))
    sinks.run_versioned_upserts(counts, target, root, partitions=_state(table(spark, folder, "events")))
    return target.read().select("outcome", "n").groupBy("outcome").agg(F.sum("n").alias("n"))


QUERIES = {
    "stream_rider_counts": stream_rider_counts,
    "stream_gap_counter": stream_gap_counter,
    "stream_dedup_latest": stream_dedup_latest,
    "stream_trip_pairs": stream_trip_pairs,
    "stream_dead_letter": stream_dead_letter,
    "stream_dead_letter_origin": stream_dead_letter_origin,
    "stream_progress": stream_progress,
    "stream_event_features": stream_event_features,
    "stream_rider_features": stream_rider_features,
    "stream_driver_features": stream_driver_features,
    "stream_trip_counters": stream_trip_counters,
    "stream_online_store": stream_online_store,
    "stream_running_count": stream_running_count,
    "stream_health": stream_health,
    "stream_outcomes": stream_outcomes,
}

ORACLE = {
    "stream_rider_counts": RIDER_COUNTS_SQL,
    "stream_gap_counter": GAP_COUNTER_SQL,
    "stream_dedup_latest": DEDUP_SQL,
    "stream_trip_pairs": TRIP_PAIRS_SQL,
    "stream_dead_letter": DEAD_LETTER_SQL,
    "stream_dead_letter_origin": DEAD_LETTER_ORIGIN_SQL,
    "stream_progress": PROGRESS_SQL,
    "stream_event_features": EVENT_FEATURES_SQL,
    "stream_rider_features": RIDER_FEATURES_SQL,
    "stream_driver_features": DRIVER_FEATURES_SQL,
    "stream_trip_counters": TRIP_COUNTERS_SQL,
    "stream_online_store": ONLINE_STORE_SQL,
    "stream_running_count": """
        SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS running_count,
               count(*) OVER (PARTITION BY user_id) AS total
        FROM events""",
    "stream_health": HEALTH_SQL,
    "stream_outcomes": """
        SELECT CASE WHEN value > 100 THEN 'broken' WHEN event_type = 'error' THEN 'unknown'
                    WHEN event_type = 'signup' THEN 'unhandled' ELSE 'ok' END AS outcome, count(*) AS n
        FROM events GROUP BY ALL""",
}
