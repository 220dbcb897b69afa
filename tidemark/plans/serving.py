"""Events on the wire, served predictions, canaries, prediction logs."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import event_struct
from ..operators.evaluation import passes_gate, regression_metrics
from ..operators.governance import promotion_events, unexpired
from ..operators.monitoring import (
    canary_arm,
    canary_health,
    event_counts,
    health_windows,
    latency_histogram,
    prediction_counts,
    rollout_decision,
)
from ..operators.timeline import row_numbers
from ..schemas import ANY_EVENT
from ..session import shared_dir
from ..sources.writers import append_batch, prediction_records, publish_counts, split_messages, to_messages
from .tables import (
    PREDICTIONS_SQL,
    SQL_TIME,
    events,
    latitude,
    longitude,
    predictions,
    sql_bucket,
    sql_latitude,
    table,
    text_day,
    text_time,
)

# Which kind of event each given type stands for.
KINDS = {
    "click": "rider.request",
    "view": "driver.location",
    "purchase": "trip.end",
    "signup": "courier.pickup",
    "error": "payment.failed",
}
KINDS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"


def kind() -> Column:
    result = F.lit(None).cast("string")
    for name, event_type in KINDS.items():
        result = F.when(F.col("event_type") == name, event_type).otherwise(result)
    return result


def event_records(rows: DataFrame) -> DataFrame:
    """Given events as event records: the table's columns as the record's own fields."""
    trip = F.col("event_type") == "purchase"
    fields = {
        "rider_id": F.when(F.col("event_type").isin("click", "purchase"), F.col("user_id")).cast("string"),
        "driver_id": F.when(F.col("event_type").isin("view", "purchase"), F.col("user_id") % 20).cast("string"),
        "trip_id": F.when(trip, F.col("event_id")).cast("string"),
        "latitude": latitude("user_id"),
        "longitude": longitude("user_id"),
        "destination_lat": F.when(F.col("user_id") % 3 > 0, latitude("event_id")),
        "destination_lng": F.when(F.col("user_id") % 3 > 0, longitude("event_id")),
        "status": F.when(F.col("event_type") == "view", "available"),
        "vehicle_type": F.when(F.col("event_type") == "view", "sedan"),
        "pickup_lat": F.when(trip, latitude("user_id")),
        "pickup_lng": F.when(trip, longitude("user_id")),
        "dropoff_lat": F.when(trip, latitude("event_id")),
        "dropoff_lng": F.when(trip, longitude("event_id")),
        "actual_fare": F.when(trip, F.col("value")),
        "duration_minutes": F.when(trip, F.col("value") / 2),
    }
    record = event_struct(kind(), F.col("ts"), fields, F.col("event_id"))
    return rows.withColumn("record", record)


def event_routing(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder).withColumn("kind", kind())
    return publish_counts(rows, "kind")


EVENT_ROUTING_SQL = f"""
    WITH r AS (SELECT split_part({KINDS_SQL}, '.', 1) AS prefix FROM events)
    SELECT CASE WHEN prefix = 'payment' THEN 'unknown' ELSE prefix END AS route,
           count(*) FILTER (prefix <> 'payment') AS success, count(*) FILTER (prefix = 'payment') AS failed
    FROM r GROUP BY ALL"""


def event_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with topic and key; riders' requests are keyed by rider, others by event."""
    records = event_records(events(spark, folder))
    key = F.when(F.col("record.event_type") == "rider.request", F.col("record.rider_id"))
    publish, failed = split_messages(to_messages(records, "record", key))
    value = F.from_json("value", ANY_EVENT)
    return publish.unionByName(failed).select(
        "topic",
        "key",
        value.event_id.alias("event_id"),
        value.event_type.alias("event_type"),
        value.timestamp.alias("timestamp"),
        value.version.alias("version"),
        value.latitude.alias("latitude"),
        value.actual_fare.alias("actual_fare"),
    )


EVENT_MESSAGES_SQL = f"""
    SELECT CASE event_type WHEN 'click' THEN 'rider.events' WHEN 'view' THEN 'driver.events'
                WHEN 'purchase' THEN 'trip.events' WHEN 'signup' THEN 'courier.events' END AS topic,
           CASE WHEN event_type = 'click' THEN user_id ELSE event_id END::VARCHAR AS key, event_id::VARCHAR AS event_id,
           {KINDS_SQL} AS event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, '1.0' AS version,
           {sql_latitude("user_id")} AS latitude, CASE WHEN event_type = 'purchase' THEN value END AS actual_fare
    FROM events"""


def event_json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Rows to JSON and back, and the JSON the table holds."""
    rows = events(spark, folder)
    columns = ["event_id", "user_id", "event_type", "value"]
    shape = rows.select(*columns).schema
    back = F.from_json(F.to_json(F.struct(*columns)), shape)
    return rows.select(back.alias("r"), "props").select(
        "r.*", F.from_json("props", "k BIGINT").k.alias("k")
    )


def union_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Events split by route and put together again, numbered per user by event time."""
    rows = events(spark, folder).withColumn("kind", kind())
    riders = rows.where(F.col("kind").startswith("rider")).select("event_id", "user_id", "ts", "kind")
    drivers = rows.where(F.col("kind").startswith("driver")).select("event_id", "user_id", "ts", "kind", "props")
    trips = rows.where(F.col("kind").startswith("trip")).select("event_id", "user_id", "ts", "kind", "value")
    together = riders.unionByName(drivers, allowMissingColumns=True).unionByName(trips, allowMissingColumns=True)
    return row_numbers(together, ["user_id"], "ts", ["event_id"], "place").select(
        "event_id", "user_id", "kind", "props", "value", "place"
    )


UNION_ROUTES_SQL = f"""
    SELECT event_id, user_id, {KINDS_SQL} AS kind, CASE WHEN event_type = 'view' THEN props END AS props,
           CASE WHEN event_type = 'purchase' THEN value END AS value,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place
    FROM events WHERE event_type IN ('click', 'view', 'purchase')"""


def latency(spark: SparkSession, folder: str) -> DataFrame:
    rows = latency_histogram(predictions(spark, folder), [10, 50, 100, 250], percents=(50, 95, 99))
    return rows.select(
        "model_name",
        F.coalesce(F.col("le").cast("int").cast("string"), F.lit("+Inf")).alias("le"),
        "n",
        F.round("latency_sum", 4).alias("latency_sum"),
        "latency_count",
        *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")],
    )


LATENCY_SQL = f"""
    WITH log AS ({PREDICTIONS_SQL}), b AS (SELECT unnest([10, 50, 100, 250, NULL]) AS le)
    SELECT model_name, coalesce(le::VARCHAR, '+Inf') AS le, count(*) FILTER (le IS NULL OR latency_ms <= le) AS n,
           round(sum(latency_ms), 4) AS latency_sum, count(*) AS latency_count,
           round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99
    FROM log, b GROUP BY model_name, le"""


def windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = health_windows(predictions(spark, folder), window="5 minutes", max_latency_ms=150.0)
    return rows.select(
        text_time("window_start").alias("window_start"),
        "model_name",
        "requests",
        "errors",
        F.round("mean_latency_ms", 6).alias("mean_latency_ms"),
        F.round("error_rate", 8).alias("error_rate"),
        "healthy",
    )


WINDOWS_SQL = f"""
    WITH log AS ({PREDICTIONS_SQL})
    SELECT strftime(time_bucket(INTERVAL 5 MINUTES, ts, TIMESTAMP '2024-01-01'), {SQL_TIME}) AS window_start, model_name,
           count(*) AS requests, count(*) FILTER (status = 'error') AS errors,
           round(avg(latency_ms), 6) AS mean_latency_ms,
           round(count(*) FILTER (status = 'error') / count(*)::DOUBLE, 8) AS error_rate,
           count(*) FILTER (status = 'error') / count(*)::DOUBLE <= 0.05 AND avg(latency_ms) <= 150 AS healthy
    FROM log GROUP BY ALL"""


def canary_assign(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select("event_id", canary_arm(F.col("user_id"), 25).alias("arm"))


def canary_steps(spark: SparkSession, folder: str) -> DataFrame:
    rows = canary_health(predictions(spark, folder), "request_key")
    return rows.select(
        "percent",
        "arm",
        "requests",
        "errors",
        F.round("mean_latency_ms", 6).alias("mean_latency_ms"),
        F.round("error_rate", 8).alias("error_rate"),
        "healthy",
    )


CANARY_SQL = f"""
    WITH log AS ({PREDICTIONS_SQL}), steps AS (SELECT unnest([10, 25, 50, 100]) AS percent)
    SELECT percent, CASE WHEN {sql_bucket("request_key")} < percent THEN 'canary' ELSE 'stable' END AS arm,
           count(*) AS requests, count(*) FILTER (status = 'error') AS errors, round(avg(latency_ms), 6) AS mean_latency_ms,
           round(count(*) FILTER (status = 'error') / count(*)::DOUBLE, 8) AS error_rate,
           count(*) FILTER (status = 'error') / count(*)::DOUBLE <= 0.05 AND avg(latency_ms) <= 1000 AS healthy
    FROM log, steps GROUP BY ALL"""


def canary_decision(spark: SparkSession, folder: str) -> DataFrame:
    """Ten models, each rolled out in steps of five days; what has become of each after eighteen."""
    log = predictions(spark, folder).withColumn("model_name", F.concat(F.lit("m"), F.col("request_key") % 10))
    found = rollout_decision(
        log, "request_key", F.lit("2024-01-02").cast("timestamp"), timedelta(days=5), F.lit("2024-01-20").cast("timestamp"),
        min_requests=5, max_error_rate=0.25, max_latency_ms=60.0,
    )
    return found.select("model_name", "decision", "step", "traffic", "reason")


CANARY_DECISION_SQL = f"""
    WITH log AS (SELECT 'm' || (request_key % 10) AS model_name, request_key, latency_ms, status,
                        floor(epoch(ts - TIMESTAMP '2024-01-02') / 432000)::INT AS step
                 FROM ({PREDICTIONS_SQL}) WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20'),
    steps AS (SELECT * FROM (VALUES (0, 10, 0), (1, 25, 10), (2, 50, 25), (3, 100, 50)) v(step, percent, before)),
    grid AS (SELECT * FROM (SELECT DISTINCT model_name FROM log), steps),
    measured AS (SELECT model_name, step, count(*) AS requests, count(*) FILTER (status = 'error') AS errors, avg(latency_ms) AS latency
                 FROM log JOIN steps USING (step) WHERE {sql_bucket("request_key")} < percent GROUP BY ALL),
    judged AS (
        SELECT g.model_name, g.step, g.percent, g.before,
               CASE WHEN g.step = 3 THEN 'waiting' WHEN coalesce(requests, 0) < 5 THEN 'too few requests' WHEN errors / requests::DOUBLE > 0.25 THEN 'errors'
                    WHEN latency > 60 THEN 'latency' ELSE 'healthy' END AS reason
        FROM grid g LEFT JOIN measured m USING (model_name, step)),
    first_bad AS (SELECT * FROM judged WHERE reason <> 'healthy' QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY step) = 1)
    SELECT model_name, CASE reason WHEN 'waiting' THEN 'advance' WHEN 'too few requests' THEN 'hold' ELSE 'roll_back' END AS decision, percent AS step,
           CASE reason WHEN 'waiting' THEN percent WHEN 'too few requests' THEN before ELSE 0 END AS traffic,
           CASE WHEN reason = 'waiting' AND step > 0 THEN 'healthy' ELSE reason END AS reason
    FROM first_bad"""


def prediction_log_append(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of two models appended to the log, each batch twice; what has not expired is read."""
    root = shared_dir(spark, "predictions")
    rows = events(spark, folder)
    for model in ("eta", "surge"):
        own = rows.where((F.col("user_id") % 2 == 0) == (model == "eta"))
        for _ in range(2):
            append_batch(prediction_records(own, model, "ts", "value", ["event_id", "event_type"]), root, model)
    log = unexpired(spark.read.parquet(root), "expires_at", F.lit("2024-01-25").cast("timestamp"))
    return log.select(
        "model_name", text_time("ts").alias("ts"), "prediction", "features_hash", text_day("ds").alias("ds")
    )


PREDICTION_LOG_SQL = f"""
    SELECT CASE WHEN user_id % 2 = 0 THEN 'eta' ELSE 'surge' END AS model_name, strftime(ts, {SQL_TIME}) AS ts,
           value AS prediction,
           sha256(concat_ws(chr(31), 'event_id', event_id::VARCHAR, 'event_type', event_type)) AS features_hash,
           strftime(ts, '%Y-%m-%d') AS ds
    FROM events WHERE ts + INTERVAL 24 HOURS > TIMESTAMP '2024-01-25'"""


def _guesses(spark: SparkSession, folder: str) -> DataFrame:
    """Line item prices with a guess that is linear in the quantity."""
    return table(spark, folder, "lineitem").select(
        "l_returnflag", F.col("l_extendedprice").alias("price"), (F.col("l_quantity") * 1000).alias("guess")
    )


def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    metrics = regression_metrics(_guesses(spark, folder), "price", "guess", ["l_returnflag"])
    return metrics.select("l_returnflag", "rows", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2", "mape")])


def _metrics_sql(by: str) -> str:
    group = f"GROUP BY {by}" if by else ""
    return f"""
    SELECT {by + ',' if by else ''} count(*) AS "rows", avg(abs(p - g)) AS mae, sqrt(avg((p - g) ** 2)) AS rmse,
           1 - sum((p - g) ** 2) / (var_pop(p) * count(*)) AS r2, avg(abs(p - g) / p) * 100 AS mape
    FROM (SELECT *, l_extendedprice AS p, l_quantity * 1000 AS g FROM lineitem) {group}"""


ROUNDED_SQL = "round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 4) AS r2, round(mape, 4) AS mape"


def model_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Two candidates by their metrics; the one that is good enough gets a stage event."""
    guesses = _guesses(spark, folder)
    candidates = guesses.withColumn("candidate", F.lit("linear")).unionByName(
        guesses.withColumn("guess", F.col("price") + F.col("guess") / 10000).withColumn("candidate", F.lit("near"))
    )
    passed = passes_gate(regression_metrics(candidates, "price", "guess", ["candidate"]))
    numbered = passed.select(F.col("candidate").alias("model_name"), F.col("rows").cast("string").alias("version"))
    events = promotion_events(numbered, F.lit("2024-02-01").cast("timestamp"))
    return events.select("model_name", "version", "stage", text_time("ts").alias("ts"), "archive_existing")


MODEL_GATE_SQL = """
    WITH c AS (
        SELECT 'linear' AS model_name, avg(abs(l_extendedprice - l_quantity * 1000)) AS mae, count(*) AS n FROM lineitem
        UNION ALL
        SELECT 'near', avg(l_quantity / 10), count(*) FROM lineitem)
    SELECT model_name, n::VARCHAR AS version, 'Production' AS stage, '2024-02-01 00:00:00.000000' AS ts,
           true AS archive_existing
    FROM c WHERE mae < 5"""

QUERIES = {
    "event_routing": event_routing,
    "event_messages": event_messages,
    "event_json_roundtrip": event_json_roundtrip,
    "event_counts": lambda spark, folder: event_counts(events(spark, folder)),
    "union_routes": union_routes,
    "prediction_counts": lambda spark, folder: prediction_counts(predictions(spark, folder)),
    "latency_histogram": latency,
    "health_windows": windows,
    "canary_assign": canary_assign,
    "canary_health": canary_steps,
    "canary_decision": canary_decision,
    "prediction_log_append": prediction_log_append,
    "eval_metrics": eval_metrics,
    "model_gate": model_gate,
}

ORACLE = {
    "event_routing": EVENT_ROUTING_SQL,
    "event_messages": EVENT_MESSAGES_SQL,
    "event_json_roundtrip": """
        SELECT event_id, user_id, event_type, value, (props->>'$.k')::BIGINT AS k FROM events""",
    "event_counts": """
        SELECT event_type, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total FROM events GROUP BY event_type""",
    "union_routes": UNION_ROUTES_SQL,
    "prediction_counts": f"""
        WITH log AS ({PREDICTIONS_SQL}) SELECT model_name, status, count(*) AS n FROM log GROUP BY ALL""",
    "latency_histogram": LATENCY_SQL,
    "health_windows": WINDOWS_SQL,
    "canary_assign": f"""
        SELECT event_id, CASE WHEN {sql_bucket("user_id")} < 25 THEN 'canary' ELSE 'stable' END AS arm FROM events""",
    "canary_health": CANARY_SQL,
    "canary_decision": CANARY_DECISION_SQL,
    "prediction_log_append": PREDICTION_LOG_SQL,
    "eval_metrics": f"""
        SELECT l_returnflag, "rows", {ROUNDED_SQL} FROM ({_metrics_sql("l_returnflag")})""",
    "model_gate": MODEL_GATE_SQL,
}
