from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.features import batch, store
from tidemark.operators.quality import not_null
from tidemark.session import path_exists, shared_dir
from tidemark.sources import readers, writers
from tidemark.sources.snapshots import SnapshotTable

T0 = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def rider_view(spark, rows):
    schema = schemas.RIDER_FEATURES
    source = spark.createDataFrame(rows, "rider_id string, event_timestamp timestamp, hour_of_day bigint")
    for f in schema.fields:
        if f.name not in source.columns:
            source = source.withColumn(f.name, F.lit(None).cast(f.dataType))
    return store.RIDER_VIEW.over(source)


def test_declared_views_and_services():
    views = {v.name: v for v in (store.RIDER_VIEW, store.DRIVER_VIEW, store.TRIP_VIEW)}
    assert (store.RIDER_VIEW.ttl, store.DRIVER_VIEW.ttl) == (timedelta(days=1), timedelta(hours=12))
    for service in (store.ETA_PREDICTION, store.SURGE_PRICING, store.FRAUD_DETECTION):
        for view, columns in service.parts:
            assert set(columns) <= set(views[view].columns)
        assert sum(len(c) for _, c in service.parts) == 8


def test_historical_and_online_features(spark):
    view = rider_view(spark, [("r1", T0, 7), ("r1", T0 + 2 * HOUR, 9), ("r2", T0 - timedelta(days=3), 1)])
    service = store.FeatureService("s", (("rider_features", ("hour_of_day",)), ("driver_features", ("vehicle_type",))))
    views = {"rider_features": view, "driver_features": store.DRIVER_VIEW}
    entities = spark.createDataFrame(
        [("r1", T0 + HOUR), ("r1", T0 + 3 * HOUR), ("r2", T0), (None, T0)], "rider_id string, event_timestamp timestamp"
    )
    got = store.historical_features(entities, service, views).collect()
    assert {(r.rider_id, r.event_timestamp): (r.hour_of_day, r.vehicle_type) for r in got} == {
        ("r1", T0 + HOUR): (7, None), ("r1", T0 + 3 * HOUR): (9, None), ("r2", T0): (None, None), (None, T0): (None, None)
    }
    online = {"rider_features": store.slice_to_load(view, None, F.lit(T0 + 5 * HOUR))}
    requests = spark.createDataFrame([("r1",), ("r2",), ("r9",)], "rider_id string")
    got = store.online_features(requests, service, views, online, F.lit(T0 + 5 * HOUR), full_names=True)
    assert got.columns == ["rider_id", "rider_features__hour_of_day", "driver_features__vehicle_type"]
    assert {r.rider_id: r.rider_features__hour_of_day for r in got.collect()} == {"r1": 9, "r2": None, "r9": None}


def test_a_name_in_two_places_needs_full_names(spark):
    view = rider_view(spark, [("r1", T0, 7)])
    entities = spark.createDataFrame([("r1", T0, 1)], "rider_id string, event_timestamp timestamp, hour_of_day int")
    service = store.FeatureService("s", (("rider_features", ("hour_of_day",)),))
    with pytest.raises(ValueError):
        store.historical_features(entities, service, {"rider_features": view})
    full = store.historical_features(entities, service, {"rider_features": view}, full_names=True)
    assert full.collect()[0].rider_features__hour_of_day == 7


def test_view_schema_problems(spark):
    source = spark.createDataFrame([("r", T0, "x")], "rider_id string, event_timestamp timestamp, hour_of_day string")
    rows = {r.column: (r.problem, r.actual) for r in store.RIDER_VIEW.over(source).problems().collect()}
    assert rows["hour_of_day"] == ("type", "string") and rows["rider_trips_7d"][0] == "missing"
    assert rider_view(spark, [("r", T0, 1)]).problems().count() == 0


def table(spark, **options):
    return SnapshotTable(spark, shared_dir(spark, "t"), ("k",), ("ts",), **options)


def rows_of(t):
    return {r.k: (r.ts, r.v) for r in t.read().collect()}


def test_snapshot_upserts(spark):
    t = table(spark, buckets=4)
    assert t.read() is None
    frame = lambda rows: spark.createDataFrame(rows, "k string, ts int, v string")
    t.upsert(frame([("a", 1, "a1"), ("b", 5, "b5"), ("a", 2, "a2")]), 0)
    assert rows_of(t) == {"a": (2, "a2"), "b": (5, "b5")}
    second = frame([("b", 4, "late"), ("c", 1, "c1"), ("a", 3, "a3")])
    for _ in range(2):
        t.upsert(second, 1)
        assert rows_of(t) == {"a": (3, "a3"), "b": (5, "b5"), "c": (1, "c1")}
    t.upsert(frame([]), 2)
    t.upsert(frame([("d", 9, "d9")]), 3)
    assert set(rows_of(t)) == set("abcd")
    assert {r.k for r in t.read(before=1).collect()} == {"a", "b"}


def test_snapshot_writers_buckets_columns_and_retention(spark):
    t = table(spark, buckets=2, keep=2)
    frame = lambda rows, more="": spark.createDataFrame(rows, f"k string, ts int, v string{more}")
    assert t.upsert(frame([("a", 1, "a1")]), 5, "old") and not t.upsert(frame([("a", 9, "again")]), 5, "old")
    with pytest.raises(ValueError, match="after 5"):
        t.upsert(frame([("a", 9, "again")]), 4, "old")
    # A writer that starts anew goes on from what is there.
    assert t.upsert(frame([("b", 1, "b1")]), 0, "new")
    assert rows_of(t) == {"a": (1, "a1"), "b": (1, "b1")}
    t.upsert(frame([("c", 1, "c1", 7)], ", w int"), 1, "new")
    assert {r.k: r.w for r in t.read().collect()} == {"a": None, "b": None, "c": 7}
    other = SnapshotTable(spark, t.root, ("k",), ("ts",), buckets=3)
    for use in (other.read, lambda: other.upsert(frame([("d", 1, "d1")]))):
        with pytest.raises(ValueError, match="2 buckets"):
            use()
    for n in range(6):
        t.upsert(frame([("a", 10 + n, f"n{n}")]))
    assert len(t._names("commits")) == 2 and rows_of(t)["a"] == (15, "n5")
    assert len(t._names("data")) <= 4
    assert {r.k for r in t.read(0, "unknown").collect()} == {"a", "b", "c"}


def test_materialize_incremental(spark):
    rows = [("r1", T0, 1), ("r1", T0 + HOUR, 2), ("r2", T0 + 3 * HOUR, 3)]
    view = rider_view(spark, rows)
    root = shared_dir(spark, "m")
    online = SnapshotTable(spark, f"{root}/online", ("rider_id",), ("event_timestamp",), 4)
    load = lambda end: store.materialize_incremental(spark, view, online, f"{root}/log", end)
    state = lambda: {r.rider_id: (r.hour_of_day, r.expires_at) for r in online.read().collect()}
    day = timedelta(days=1)
    assert load(T0 + HOUR) == 1 and state() == {"r1": (2, T0 + HOUR + day)}
    assert load(T0 + 5 * HOUR) == 2 and state() == {"r1": (2, T0 + HOUR + day), "r2": (3, T0 + 3 * HOUR + day)}


def test_daily_write_replaces_only_its_days(spark):
    root = shared_dir(spark, "days")
    frame = lambda rows: spark.createDataFrame(rows, "k string, n bigint, ds date")
    one, two = date(2024, 1, 1), date(2024, 1, 2)
    seen = writers.write_days(frame([("a", 1, one), ("b", 2, two), (None, 3, two)]), root, expectations=[not_null("k")]).get
    assert seen["rows"] == 3 and seen["not_null:k"] == 1
    writers.write_days(frame([("c", 4, two)]), root)
    schema = frame([]).schema
    assert {r.k for r in readers.read_day(spark, root, schema, one).collect()} == {"a"}
    day_two = readers.read_day(spark, root, schema, two)
    assert {r.k for r in day_two.collect()} == {"c"}
    assert "PartitionFilters: [isnotnull(ds" in day_two._jdf.queryExecution().executedPlan().toString()
    assert schema.fieldNames() == ["k", "n", "ds"]


def test_extracts(spark):
    rows = [("r1", T0, 1.0, 2.0, None, None, 3, 4.5, 0.1), ("r1", T0 + timedelta(days=1), 1.0, 2.0, None, None, 3, 4.5, 0.1)]
    riders = spark.createDataFrame(rows, schemas.RIDER_EXTRACT)
    assert readers.rider_extract(riders.withColumn("more", F.lit(1)), T0.date()).collect() == riders.limit(1).collect()
    drivers = spark.createDataFrame([("d1", T0, 1.0, 2.0, "available", "suv", 4.0, 0.9)], schemas.DRIVER_EXTRACT)
    assert readers.driver_extract(drivers, T0.date()).count() == 1


def test_messages(spark):
    from tidemark.functions import event_struct

    rows = spark.createDataFrame([("rider.request", "r1"), ("courier.pickup", None), ("x", None)], "t string, r string")
    record = event_struct(F.col("t"), F.lit(T0), {"rider_id": F.col("r")})
    good, bad = writers.split_messages(writers.to_messages(rows.withColumn("e", record), "e", F.col("e.rider_id")))
    got = {r.topic: r.key for r in good.collect()}
    assert got["rider.events"] == "r1" and len(got["courier.events"]) == 36
    assert bad.count() == 1
    counts = {r.route: (r.success, r.failed) for r in writers.publish_counts(rows, "t").collect()}
    assert counts == {"rider": (1, 0), "courier": (1, 0), "unknown": (0, 1)}


def test_csv(spark):
    path = shared_dir(spark, "csv")
    writers.write_csv(spark.createDataFrame([("f", 0.5)], "feature string, importance double"), path)
    assert spark.read.option("header", True).csv(path).collect()[0].asDict() == {"feature": "f", "importance": "0.5"}


def test_hours_online(spark):
    rows = [("d", T0 + 22 * HOUR, "available", 1), ("d", T0 + 26 * HOUR, "offline", 2), ("d", T0 + 30 * HOUR, "on_trip", 3),
            ("d", T0 + 31 * HOUR, "available", 4)]
    events = spark.createDataFrame(rows, "driver_id string, event_timestamp timestamp, status string, id int")
    got = {r.day: r.hours_online for r in batch.hours_online(events, tie=["id"]).collect()}
    assert got == {date(2024, 1, 1): 2.0, date(2024, 1, 2): 3.0}


def test_preferred_type_ties_and_nulls(spark):
    rows = [("r", "suv", 1), ("r", "sedan", 2), ("s", None, 1), ("t", "suv", 1), ("t", "suv", 2), ("t", "sedan", 3)]
    trips = spark.createDataFrame(rows, "rider_id string, kind string, ts int")
    assert {r.rider_id: r.preferred_type for r in batch.preferred_type(trips, "rider_id", "kind").collect()} == {"r": "sedan", "t": "suv"}
    early = batch.preferred_type(trips, "rider_id", "kind", "ts", F.lit(2))
    assert {r.rider_id: r.preferred_type for r in early.collect()} == {"r": "suv", "t": "suv"}


def test_daily_job_reads_its_history_and_stops_on_bad_data(spark):
    from tidemark.features.daily import HISTORY, check_day, read_history, run_day
    from tidemark.operators.quality import QualityError, between

    root = shared_dir(spark, "daily")
    days = [T0 + timedelta(days=d, hours=1) for d in range(0, 40, 2)]
    rows = spark.createDataFrame([("r", t) for t in days], "rider_id string, event_timestamp timestamp")
    rows = rows.withColumn("ds", F.to_date("event_timestamp"))
    writers.append_days(rows, f"{root}/in")
    day = days[-1].date()
    compute = lambda df: batch.rider_features(df)
    seen = run_day(spark, f"{root}/in", f"{root}/out", rows.schema, day, compute)
    assert check_day(seen) == 1
    row = spark.read.parquet(f"{root}/out").first()
    assert (row.rider_trips_7d, row.rider_trips_30d, row.ds) == (4, 16, day)
    history = read_history(spark, f"{root}/in", rows.schema, day, HISTORY)
    assert history.count() == 16
    bad = run_day(spark, f"{root}/in", f"{root}/out", rows.schema, day, compute, expectations=[between("rider_trips_30d", 0, 3)])
    with pytest.raises(QualityError):
        check_day(bad)
    # The day that failed is not published, and a day that becomes empty loses its rows.
    assert [r.rider_trips_7d for r in spark.read.parquet(f"{root}/out").collect()] == [4]
    none = run_day(spark, f"{root}/in", f"{root}/out", rows.schema, day, lambda df: compute(df).where("false"), allow_empty=True)
    assert check_day(none, allow_empty=True) == 0
    with pytest.raises(QualityError):
        check_day(none)
    assert path_exists(spark, f"{root}/out") and not path_exists(spark, f"{root}/out/ds={day}")


