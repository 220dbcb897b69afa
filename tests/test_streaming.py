"""Streams over small files, replayed and against the batch form of the same work."""

from __future__ import annotations

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.plans import streams
from tidemark.session import path_exists, shared_dir
from tidemark.sources.readers import read_parquet_stream, read_text_events
from tidemark.sources.snapshots import SnapshotTable
from tidemark.streaming import counters, sinks
from tidemark.streaming import events as E

T0 = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def rider(i, at, **more):
    return {"event_id": str(i), "event_type": "rider.request", "timestamp": at.isoformat(), "version": "1.0",
            "rider_id": "r1", "latitude": 0.0, "longitude": 0.0, **more}


def trip(i, kind, at, **more):
    return {"event_id": str(i), "event_type": kind, "timestamp": at.isoformat(), "trip_id": "t1", "rider_id": "r1",
            "driver_id": "d1", "pickup_lat": 0.0, "pickup_lng": 0.0, "dropoff_lat": 0.0, "dropoff_lng": 1.0, **more}


RECORDS = [
    rider(1, T0 + 8 * HOUR, destination_lat=0.0, destination_lng=1.0),
    rider(2, T0 + 9 * HOUR),
    {"event_id": "3", "event_type": "driver.status", "timestamp": T0.isoformat(), "driver_id": "d1", "latitude": 1.0,
     "longitude": 2.0, "status": "available", "vehicle_type": "suv", "driver_rating": 4.9},
    trip(4, "trip.start", T0, duration_minutes=1.0),
    trip(5, "trip.end", T0 + HOUR, duration_minutes=60.0, actual_fare=9.5),
    {"event_id": "6", "event_type": "courier.pickup", "timestamp": T0.isoformat()},
    {"event_id": "7", "event_type": "scooter.start", "timestamp": T0.isoformat()},
    {**rider(8, T0), "timestamp": "yesterday"},
    {**rider(9, T0), "rider_id": None},
]


@pytest.fixture
def texts(spark):
    lines = [json.dumps(r) for r in RECORDS] + ['{"event_id": "10", "event_type": "rid', "not json"]
    return spark.createDataFrame([(line,) for line in lines], "value string")


def test_parse_and_dead_letters(spark, texts):
    parsed = E.parse(texts)
    problems = sorted(r.problem for r in E.dead_letters(parsed).collect())
    assert problems == ["broken", "broken", "no_entity", "no_time", "unhandled", "unknown"]
    assert E.good(parsed).count() == 5
    counts = {(r.route, r.outcome): r.n for r in E.outcome_counts(parsed).collect()}
    assert counts[("rider", "ok")] == 2 and counts[("courier", "unhandled")] == 1


def test_features_per_route(spark, texts):
    parsed = E.parse(texts)
    one, two = sorted(E.rider_event_features(parsed).collect(), key=lambda r: r.event_id)
    assert one.trip_distance_km == pytest.approx(111.1949, abs=1e-3) and two.trip_distance_km is None
    assert (one.hour_of_day, one.day_of_week, one.is_peak_hour, one.is_weekend, one.rider_rating) == (8, 0, 1, 0, 4.5)
    driver = E.driver_event_features(parsed).first()
    assert (driver.driver_status, driver.vehicle_type, driver.driver_rating) == ("available", "suv", 4.9)
    start, end = sorted(E.trip_event_features(parsed).collect(), key=lambda r: r.event_id)
    assert (start.actual_duration, end.actual_duration, end.actual_fare) == (None, 60.0, 9.5)
    entities = E.trip_entities(E.trip_event_features(parsed)).collect()
    assert {(r.entity_type, r.entity_id) for r in entities} == {("rider", "r1"), ("driver", "d1")}


def test_text_stream_with_dead_letters_and_progress(spark, texts):
    root = shared_dir(spark, "text")
    texts.coalesce(1).write.text(f"{root}/in")
    log = sinks.ProgressLog()
    spark.streams.addListener(log)
    try:
        parsed = sinks.observe_outcomes(E.parse(read_text_events(spark, f"{root}/in")))
        sinks.run_to_files(E.dead_letters(parsed), root)
        assert spark.read.parquet(f"{root}/data").where("topic LIKE '%/in/part-%'").count() == 6
        deadline = time.time() + 20
        while time.time() < deadline and not any(p.get("observed") for p in log.latest.values()):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    (progress,) = log.latest.values()
    assert progress["observed"]["events"] == {"total": 11, "errors": 6}


def stream_of(spark, name, batches, schema):
    """One file per batch, read one at a time and in order."""
    root = shared_dir(spark, name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    shape = spark.read.parquet(f"{root}/in").schema
    return root, read_parquet_stream(spark, f"{root}/in", shape, max_files=1)


KEYED = "k string, ts timestamp, id long"


def batches():
    rows = [("ab"[i % 5 == 0], T0 + i * HOUR, i) for i in range(90)]
    return [rows[:40], rows[40:70], rows[70:]]


def test_running_counts_over_batches_and_replay(spark):
    root, stream = stream_of(spark, "run", batches(), KEYED)
    state = SnapshotTable(spark, f"{root}/state", ("k",), ("n",), 4)
    out = sinks.run_running_counts(stream, state, root, ["k"], "ts", ["id"])
    expected = {}
    for k, _, i in sum(batches(), []):
        expected[i] = sum(1 for other, _, j in sum(batches(), []) if other == k and j <= i)
    assert {r.id: r.running_count for r in spark.read.parquet(out).collect()} == expected
    last = spark.createDataFrame(batches()[2], KEYED)
    (writer,) = state.last_commit().writers
    numbered, counts = counters.running_counts(last, state.read(2, writer), ["k"], "ts", ["id"])
    assert {r.id: r.running_count for r in numbered.collect()} == {i: n for i, n in expected.items() if i >= 70}
    assert not state.upsert(counts, 2, writer)
    assert {r.k: r.n for r in state.read().collect()} == {"a": 72, "b": 18}


def test_sliding_counts_match_batch(spark):
    root, stream = stream_of(spark, "slide", batches(), KEYED)
    target = SnapshotTable(spark, f"{root}/table", ("k", "window_start"), ("batch",), 4)
    sinks.run_versioned_upserts(counters.sliding_counts(stream, ["k"], "ts", 2), target, root)
    table = spark.createDataFrame(sum(batches(), []), KEYED)
    whole = counters.sliding_counts(table, ["k"], "ts", 2)
    columns = ["k", "window_start", "n"]
    assert sorted(target.read().select(columns).collect()) == sorted(whole.select(columns).collect())


def test_late_events_are_dropped(spark):
    late = [("a", T0 - timedelta(days=30), 100)]
    root, stream = stream_of(spark, "late", [*batches(), late, [("a", T0 + 91 * HOUR, 101)]], KEYED)
    sinks.run_to_files(counters.sliding_counts(stream, ["k"], "ts", 1, delay="1 hour"), root)
    starts = [r.window_start for r in spark.read.parquet(f"{root}/data").collect()]
    assert starts and min(starts) == T0


def test_duplicates_within_and_across_batches(spark):
    first, second, third = batches()
    rows = [first + first[:10], second + first[30:], third]
    for spread in (None, F.pmod(F.xxhash64("ts"), F.lit(4))):
        root, stream = stream_of(spark, "dup", rows, KEYED)
        sinks.run_to_files(E.once(stream, "id", "ts", "3 days", spread), root)
        assert sorted(r.id for r in spark.read.parquet(f"{root}/data").collect()) == list(range(90))


def test_trips_are_matched_once(spark):
    starts = [("t1", T0), ("t1", T0), ("t2", T0), ("t3", T0)]
    ends = [("t1", T0 + HOUR, 1), ("t2", T0 + 5 * HOUR, 2), ("t3", T0 - HOUR, 3), ("t1", T0 + 2 * HOUR, 4)]
    s = spark.createDataFrame(starts, "trip_id string, s timestamp")
    e = spark.createDataFrame(ends, "trip_id string, e timestamp, n int")
    want = [("t1", 1), ("t1", 4)]
    batch = counters.match_trips(s, e, "trip_id", "s", "e", "3 HOURS")
    assert sorted((r.trip_id, r.n) for r in batch.collect()) == want
    root, left = stream_of(spark, "starts", [starts], "trip_id string, s timestamp")
    _, right = stream_of(spark, "ends", [ends], "trip_id string, e timestamp, n int")
    sinks.run_to_files(counters.match_trips(left, right, "trip_id", "s", "e", "3 HOURS"), root)
    assert sorted((r.trip_id, r.n) for r in spark.read.parquet(f"{root}/data").collect()) == want


def test_gap_counts(spark):
    rows = [("a", T0, 1), ("a", T0 + 2 * HOUR, 2), ("a", T0 + 30 * HOUR, 3)]
    table = spark.createDataFrame(rows, KEYED)
    got = {r.session_start: r.n for r in counters.gap_counts(table, ["k"], "ts", "1 day").collect()}
    assert got == {T0: 2, T0 + 30 * HOUR: 1}


def test_online_rows(spark, texts):
    features = E.rider_event_features(E.parse(texts))
    rows = E.online_rows(features, "rider", "rider_id", "event_ts", F.lit(timedelta(hours=24))).collect()
    assert rows[0].expires_at - rows[0].updated_at == timedelta(days=1)
    assert json.loads(rows[0].features)["hour_of_day"] in (8, 9)


def test_rows_without_a_time_enter_a_batch(spark, tmp_path):
    at = [None, *(T0 + i * HOUR for i in range(9)), None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "event_id long, ts timestamp")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    stream = streams._parts(spark, str(tmp_path), "events", "ts")
    query = stream.writeStream.format("memory").queryName("untimed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.event_id for r in spark.table("untimed").collect()) == list(range(11))


def run_pairs(spark, name, starts, ends, in_files):
    """Pairs of micro-batches of starts and ends, one of each at a time, and the progress of the query."""
    root, left = stream_of(spark, f"{name}-starts", starts, "trip_id string, s timestamp, fare long")
    _, right = stream_of(spark, f"{name}-ends", ends, "trip_id string, e timestamp, n long")
    log = []
    handle = sinks.run_batches

    def kept(*args, **kwargs):
        log.append(handle(*args, **kwargs))
        return log[-1]

    if in_files:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(sinks, "run_batches", kept)
            sinks.run_trip_pairs(left, right, root, "trip_id", "s", "e", "5 DAYS", partitions=3)
    else:
        log.append(sinks.run_to_files(counters.match_trips(left, right, "trip_id", "s", "e", "5 DAYS"), root, partitions=3))
    rows = spark.read.parquet(f"{root}/data")
    return root, sorted((r.trip_id, r.s, r.fare, r.e, r.n) for r in rows.collect()), log[0].recentProgress


def test_trip_pairs_in_files_are_those_of_the_streams(spark):
    """Ends before their start, late rows of both kinds, repeats that are held and that are forgotten, no key or time."""
    rng = random.Random(7)
    day, starts, ends = timedelta(days=1), [], []
    for number in range(5):
        base = T0 + 4 * number * day
        ids = rng.sample(range(40), 30)
        starts.append([(f"t{i}", base + rng.randrange(-200, 96) * HOUR, 100 * number + i) for i in ids] + [(None, base, 0), (f"x{number}", None, 0)])
        ends.append([(f"t{rng.randrange(40)}", base + rng.randrange(-200, 200) * HOUR, 1000 * number + i) for i in range(60)] + [(None, base, 0), ("t1", None, 0)])
    _, want, _ = run_pairs(spark, "joined", starts, ends, False)
    root, found, progress = run_pairs(spark, "kept", starts, ends, True)
    assert found == want and len(found) > 40
    # No row goes through a state store, each is read once, and what no later row can match is let go.
    assert [p.stateOperators for p in progress if p.numInputRows] == [[]] * 5
    assert [p.numInputRows for p in progress if p.numInputRows] == [len(s) + len(e) for s, e in zip(starts, ends, strict=True)]
    marks = spark.read.parquet(f"{root}/state/batch=4/marks").first()
    assert marks.late_rows > 0 and spark.read.parquet(f"{root}/state/batch=4/open_ends").count() < 180
    assert not path_exists(spark, f"{root}/state/batch=2")


def test_trip_pairs_query_keeps_no_row_in_a_state_store(spark, tmp_path):
    spark.createDataFrame([(i, T0 + i * HOUR, 1.0) for i in range(9)], "o_orderkey long, o_orderdate timestamp, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i % 9, T0 + i * 9 * HOUR, i) for i in range(18)], "l_orderkey long, l_shipdate timestamp, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    log = sinks.ProgressLog()
    stored = []
    log.onQueryProgress = lambda event: stored.append(len(event.progress.stateOperators))
    spark.streams.addListener(log)
    try:
        assert streams.stream_trip_pairs(spark, str(tmp_path)).count() == 18
        deadline = time.time() + 20
        while time.time() < deadline and len(stored) < 3:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    assert stored and not any(stored)
