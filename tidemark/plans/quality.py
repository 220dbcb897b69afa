"""Data quality and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.distribution import profile
from ..operators.quality import (
    LATITUDE,
    LONGITUDE,
    RATING,
    allowed,
    between,
    evaluate,
    not_null,
    orphans,
    row_count,
    rule,
    schema_differences,
    valid_coordinates,
)
from .tables import latitude, longitude, table

PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def dq_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rules on orders and on events, some of which fail."""
    orders = table(spark, folder, "orders").withColumns(
        {"latitude": latitude("o_orderkey") * 2.1, "longitude": longitude("o_orderkey")}
    )
    events = table(spark, folder, "events")
    on_orders = evaluate(
        orders,
        [
            row_count(),
            not_null("o_custkey"),
            between("latitude", *LATITUDE),
            between("longitude", *LONGITUDE),
            allowed("o_orderstatus", ["F", "O"]),
            rule("valid_coordinates", valid_coordinates(F.col("latitude"), F.col("longitude"))),
        ],
    )
    on_events = evaluate(
        events,
        [
            row_count(1, 500),
            not_null("event_type"),
            between("value", *RATING),
            allowed("event_type", ["click", "view", "purchase", "signup"]),
        ],
    )
    return on_orders.withColumn("dataset", F.lit("orders")).unionByName(on_events.withColumn("dataset", F.lit("events")))


DQ_REPORT_SQL = """
    WITH o AS (SELECT *, 2.1::DOUBLE * (37 + (o_orderkey % 100) / 100.0::DOUBLE) AS lat FROM orders),
    r AS (
        SELECT 'orders' AS dataset, 'row_count' AS expectation, NULL AS "column", count(*) AS "rows",
               greatest(count(*) - 10000000, 0) AS failed FROM o
        UNION ALL SELECT 'orders', 'not_null', 'o_custkey', count(*), count(*) FILTER (o_custkey IS NULL) FROM o
        UNION ALL SELECT 'orders', 'between', 'latitude', count(*), count(*) FILTER (abs(lat) > 90) FROM o
        UNION ALL SELECT 'orders', 'between', 'longitude', count(*), 0 FROM o
        UNION ALL SELECT 'orders', 'allowed', 'o_orderstatus', count(*),
                         count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM o
        UNION ALL SELECT 'orders', 'valid_coordinates', NULL, count(*), count(*) FILTER (abs(lat) > 90) FROM o
        UNION ALL SELECT 'events', 'row_count', NULL, count(*), greatest(count(*) - 500, 0) FROM events
        UNION ALL SELECT 'events', 'not_null', 'event_type', count(*), count(*) FILTER (event_type IS NULL) FROM events
        UNION ALL SELECT 'events', 'between', 'value', count(*),
                         count(*) FILTER (value NOT BETWEEN 1 AND 5) FROM events
        UNION ALL SELECT 'events', 'allowed', 'event_type', count(*),
                         count(*) FILTER (event_type = 'error') FROM events)
    SELECT dataset, expectation, "column", "rows", failed, failed = 0 AS success FROM r"""


def dq_referential(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without a parent, for one relation that holds and two that do not."""
    customers = table(spark, folder, "customer")
    checks = [
        ("orders", orphans(table(spark, folder, "orders"), "o_custkey", customers, "c_custkey")),
        ("lineitem", orphans(table(spark, folder, "lineitem"), "l_partkey", table(spark, folder, "supplier"), "s_suppkey")),
        ("events", orphans(table(spark, folder, "events"), "event_id", customers, "c_custkey")),
    ]
    counted = [
        rows.agg(F.lit(name).alias("child"), F.count(F.lit(1)).alias("orphans")) for name, rows in checks
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


DQ_REFERENTIAL_SQL = """
    SELECT 'orders' AS child, count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL
    SELECT 'lineitem', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL
    SELECT 'events', count(*) FROM events WHERE event_id NOT IN (SELECT c_custkey FROM customer)"""


def _profile_sql(columns: list[str], text: list[str]) -> str:
    parts = []
    for c in columns:
        number = c not in text
        stats = (
            f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max"
            if number
            else "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max"
        )
        parts.append(
            f"SELECT '{c}' AS feature, {stats}, round(avg(({c} IS NULL)::INT) * 100, 6) AS missing_pct, "
            f"count(DISTINCT {c}) AS unique_count FROM lineitem"
        )
    return " UNION ALL ".join(parts)


def profile_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = profile(table(spark, folder, "lineitem"), PROFILED)
    return stats.select(
        "feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max",
        F.round("missing_pct", 6).alias("missing_pct"), "unique_count",
    )


# What the events are held against: some columns are as expected, others of another type, missing or more.
EXPECTED = {"event_id": "bigint", "ts": "string", "user_id": "int", "event_type": "string", "value": "double", "device": "string"}


def schema_compliance(spark: SparkSession, folder: str) -> DataFrame:
    """Differences between the events' columns and those expected, beside the rows they concern."""
    events = table(spark, folder, "events")
    expected = T.StructType([T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in EXPECTED.items()])
    rows = events.agg(F.count(F.lit(1)).alias("rows"))
    # One row on the right.
    return schema_differences(events, expected).join(F.broadcast(rows))


SCHEMA_SQL = f"""
    WITH have AS (SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
                         WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS type FROM (DESCRIBE events)),
    want AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{t}')" for n, t in EXPECTED.items())}) v(name, type))
    SELECT coalesce(w.name, h.name) AS "column", CASE WHEN h.name IS NULL THEN 'missing' WHEN w.name IS NULL THEN 'extra' ELSE 'type' END AS problem,
           w.type AS expected, h.type AS actual, (SELECT count(*) FROM events) AS "rows"
    FROM want w FULL JOIN have h USING (name) WHERE w.type IS DISTINCT FROM h.type"""

QUERIES = {
    "schema_compliance": schema_compliance,
    "dq_report": dq_report,
    "dq_referential": dq_referential,
    "profile_stats": profile_stats,
}

ORACLE = {
    "schema_compliance": SCHEMA_SQL,
    "dq_report": DQ_REPORT_SQL,
    "dq_referential": DQ_REFERENTIAL_SQL,
    "profile_stats": _profile_sql(PROFILED, ["l_returnflag", "l_linestatus"]),
}
