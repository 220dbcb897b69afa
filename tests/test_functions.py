from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import functions as X
from tidemark import schemas
from tidemark.functions.pricing import random_jitter, stable_jitter, surge_quote
from tidemark.functions.values import TRAFFIC_CODES


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize(
    "day, dow, sunday_first, weekend",
    [(datetime(2024, 1, 6), 5, 7, 1), (datetime(2024, 1, 7), 6, 1, 1), (datetime(2024, 1, 8), 0, 2, 0)],
)
def test_days(spark, day, dow, sunday_first, weekend):
    ts = F.lit(day)
    assert value(spark, X.day_of_week(ts)) == dow
    assert value(spark, X.day_of_week(ts, sunday_first=True)) == sunday_first
    assert value(spark, X.is_weekend(ts)) == weekend


def test_peak_hours(spark):
    hours = spark.range(24).select(F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.col("id"), F.lit(0), F.lit(0)).alias("t"))
    peak = [r["h"] for r in hours.where(X.is_peak_hour(F.col("t")) == 1).select(F.hour("t").alias("h")).collect()]
    assert sorted(peak) == [7, 8, 9, 17, 18, 19]


def test_time_text(spark):
    text = "2024-01-02T03:04:05.000006"
    assert value(spark, X.iso_format(X.event_time(F.lit(text)))) == text
    assert value(spark, X.event_time(F.lit("2024-01-02T03:04:05Z"))) == datetime(2024, 1, 2, 3, 4, 5)
    assert value(spark, X.event_time(F.lit("soon"))) is None
    assert value(spark, X.add_days(F.lit(datetime(2024, 2, 28)), 2)) == datetime(2024, 3, 1)


@pytest.mark.parametrize(
    "points, km",
    [
        ((10.0, 20.0, 10.0, 20.0), 0.0),
        ((0.0, 0.0, 0.0, 180.0), 20015.0868),
        ((37.7749, -122.4194, 37.8044, -122.2712), 13.4296),
        ((0.0, 0.0, 0.0, 1.0), 111.1949),
        ((None, 0.0, 0.0, 1.0), None),
        ((0.0, 0.0, 0.0, None), None),
    ],
)
def test_haversine(spark, points, km):
    got = value(spark, X.haversine_km(*[F.lit(p).cast("double") for p in points]))
    assert got == (None if km is None else pytest.approx(km, abs=1e-3))


def test_values(spark):
    code = lambda v: value(spark, X.ordinal(F.lit(v).cast("string"), TRAFFIC_CODES, 1))
    assert [code(v) for v in ("light", "moderate", "heavy", "jam", None)] == [0, 1, 2, 1, 1]
    assert value(spark, X.safe_ratio(F.lit(1), F.lit(4))) == 0.25
    assert value(spark, X.safe_ratio(F.lit(1), F.lit(0))) == 0.0
    assert [value(spark, X.clamp(F.lit(v), 1.0, 3.0)) for v in (0.5, 2.0, 9.0)] == [1.0, 2.0, 3.0]
    steps = [(0.1, "moderate"), (0.2, "significant")]
    assert [value(spark, X.band(F.lit(v), steps, "none")) for v in (0.05, 0.1, 0.2)] == ["none", "moderate", "significant"]
    assert value(spark, X.band(F.lit(0.1), steps, "none", strict=True)) == "none"
    assert value(spark, X.or_default(F.lit(None).cast("double"), 4.5)) == 4.5


def test_stable_bucket_and_hashes(spark):
    assert value(spark, X.stable_bucket(F.lit(42))) == int("a1d0c6e83f02732", 16) % 100
    df = spark.createDataFrame([(1, "x", None)], "a int, b string, c double")
    one, other = (df.select(X.features_hash(names).alias("h")).first()["h"] for names in (["a", "b", "c"], ["c", "b", "a"]))
    assert one == other
    assert value(spark, X.record_id(F.lit("a"), F.lit(None))) != value(spark, X.record_id(F.lit("a"), F.lit("")))
    assert len(value(spark, X.random_id())) == 36


def test_split_does_not_depend_on_partitioning(spark):
    rows = spark.range(1000)
    pick = lambda df: {r.id for r in df.where(X.stable_bucket(F.col("id")) < 20).collect()}
    assert pick(rows.repartition(1)) == pick(rows.repartition(7))
    assert 150 < len(pick(rows)) < 250


def test_surge(spark):
    quote = surge_quote(F.lit(datetime(2024, 1, 1, 8)), F.lit(10.0), F.lit(0.2))
    row = spark.range(1).select(*[c.alias(n) for n, c in quote.items()]).first()
    assert (row.surge_multiplier, row.estimated_fare, row.demand_level) == (1.4, 36.2, "moderate")
    low = surge_quote(F.lit(datetime(2024, 1, 1, 12)), F.lit(None).cast("double"), F.lit(-0.1))
    row = spark.range(1).select(*[c.alias(n) for n, c in low.items()]).first()
    assert (row.surge_multiplier, row.estimated_fare, row.demand_level) == (1.0, 20.5, "normal")
    for jitter in (stable_jitter(F.col("id")), random_jitter(1)):
        bounds = spark.range(500).select(jitter.alias("j")).agg(F.min("j").alias("a"), F.max("j").alias("b")).first()
        assert -0.1 <= bounds.a < bounds.b < 0.3


def test_event_records(spark):
    assert len(schemas.EVENT_TYPES) == 8
    types = spark.createDataFrame([(t,) for t in (*schemas.EVENT_TYPES, "payment.x")], "t string")
    rows = {r.t: (r.route, r.topic) for r in types.select("t", X.route_of(F.col("t")).alias("route"), X.topic_of(F.col("t")).alias("topic")).collect()}
    assert rows["driver.status"] == ("driver", "driver.events") and rows["payment.x"] == (None, None)
    record = X.event_struct(F.lit("rider.request"), F.lit(datetime(2024, 1, 1)), {"rider_id": F.lit("r1"), "latitude": F.lit(1.5)})
    row = spark.range(1).select(record.alias("e")).first()["e"]
    assert (row.event_type, row.rider_id, row.latitude, row.version) == ("rider.request", "r1", 1.5, "1.0")
    assert row.timestamp == "2024-01-01T00:00:00.000000" and len(row.event_id) == 36
