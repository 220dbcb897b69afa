from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.streaming.profiles import COUNTS, Profile, Ring, _Processor, keyed_state, with_profile
from tidemark.streaming.sinks import run_to_files


def naive(events, profile):
    """Events (batch, day, counts, rating) in the order they are seen; one result for each."""
    out, past = [], []
    for batch, day, counts, rating in events:
        earlier = [d for b, d, _, _ in past if b < batch]
        late = bool(earlier) and day < max(earlier) - profile.late_days
        if profile.include_current and not late:
            past.append((batch, day, counts, rating))
        row = []
        for days in profile.days:
            inside = [c for _, d, c, _ in past if day - days < d <= day]
            trips, accepted, requests = (sum(c[i] for c in inside) for i in range(3))
            row += [None, None] if late else [trips, accepted / requests if requests else 0.0]
        ratings = [r for _, _, _, r in past if r is not None]
        out.append((*row, sum(ratings) / len(ratings) if ratings else profile.default_rating))
        if not profile.include_current and not late:
            past.append((batch, day, counts, rating))
    return out


@pytest.mark.parametrize("include_current", [False, True])
@pytest.mark.parametrize("late_days", [0, 3, 100])
def test_ring_matches_all_events(include_current, late_days):
    rng = random.Random(late_days)
    profile = Profile(days=(1, 7, 30), late_days=late_days, include_current=include_current)
    for _ in range(30):
        events, got, ring, day = [], [], Ring.of(None), 100
        for batch in range(rng.randrange(1, 7)):
            day += rng.choice([0, 1, 2, 9, 40, -4])
            days = sorted(max(0, day + rng.randrange(4)) for _ in range(rng.randrange(1, 9)))
            rows = [(batch, d, [rng.randrange(2) for _ in COUNTS], rng.choice([None, 3.0, 4.25])) for d in days]
            events += rows
            made = ring.apply(
                np.array(days), np.array([r[2] for r in rows]).T, np.array([np.nan if r[3] is None else r[3] for r in rows]), profile
            )
            ring = Ring.of(ring.value())
            for i in range(len(rows)):
                cells = [made[f"{name}_{d}d"][i] for d in profile.days for name in ("trips", "acceptance_rate")]
                got.append((*[None if np.isnan(c) else c for c in cells], made["avg_rating"][i]))
        assert got == [pytest.approx(w) for w in naive(events, profile)]
        assert len(ring.days) <= max(profile.days) + late_days


SCHEMA = "k string, id string, ts timestamp, trips int, accepted int, requests int, rating double, wanted boolean"


def run(spark, root, batches, profile=None):
    """Each batch arrives after the query has ended, which starts again from its checkpoint."""
    for i, batch in enumerate(batches):
        rows = spark.createDataFrame(batch, "k string, id string, ts string, trips int, accepted int, requests int, rating double, wanted boolean")
        rows.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{root}/in")
        with keyed_state(spark):
            stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
            run_to_files(with_profile(stream, ["k"], "ts", "id", profile), root, partitions=2)
    return spark.read.parquet(f"{root}/data")


def test_state_goes_on_after_restarts(spark, tmp_path):
    batches = [
        [("a", "2", "2024-01-01 10:00:00", 1, 1, 1, 4.0, True), ("a", "1", "2024-01-01 10:00:00", 1, 0, 1, None, True), ("b", "9", "2024-01-01 00:00:00", 1, 0, 0, None, False)],
        [("a", "3", "2024-01-02 00:00:00", None, None, None, 5.0, True), (None, "0", "2024-01-02 00:00:00", 1, 1, 1, 1.0, True), ("a", "0", None, 1, 1, 1, 1.0, True)],
        [("b", "4", "2024-01-07 23:59:59", 0, 0, 0, None, True), ("b", "5", "2024-01-08 00:00:00", 0, 0, 0, None, True), ("c", "6", "2024-01-08 00:00:00", 1, 0, 0, None, None)],
    ]
    found = run(spark, str(tmp_path), batches)
    assert found.columns[:3] == ["k", "id", "ts"] and "wanted" not in found.columns
    got = {r.id: (r.trips_1d, r.trips_7d, r.trips_30d, r.acceptance_rate_7d, r.avg_rating, str(r.previous_ts)) for r in found.collect()}
    assert got == {
        "1": (0, 0, 0, 0.0, 4.5, "None"),
        "2": (1, 1, 1, 0.0, 4.5, "2024-01-01 10:00:00"),
        "3": (0, 2, 2, 0.5, 4.0, "2024-01-01 10:00:00"),
        "4": (0, 1, 1, 0.0, 4.5, "None"),
        "5": (0, 0, 1, 0.0, 4.5, "2024-01-07 23:59:59"),
    }


def test_late_events_and_expired_state(spark, tmp_path):
    batches = [
        [("a", "1", "2024-02-20 10:00:00", 1, 0, 0, None, True)],
        [("a", "2", "2024-02-19 10:00:00", 1, 0, 0, None, True), ("a", "3", "2024-02-01 10:00:00", 1, 0, 0, 1.0, True)],
        [("a", "4", "2024-02-20 12:00:00", 1, 0, 0, None, True)],
    ]
    found = run(spark, str(tmp_path), batches, Profile(newest_ttl_ms=1)).collect()
    got = {r.id: (r.trips_1d, r.trips_7d, r.avg_rating) for r in found}
    assert got == {"1": (0, 0, 4.5), "2": (0, 0, 4.5), "3": (None, None, 4.5), "4": (1, 2, 4.5)}
    # What is older than its time to live is forgotten; within a batch it is known.
    assert {r.id: str(r.previous_ts) for r in found} == {"1": "None", "3": "None", "2": "2024-02-01 10:00:00", "4": "None"}


@pytest.mark.parametrize("include_current", [False, True])
def test_ring_of_many_keys_is_that_of_each(include_current):
    rng = random.Random(3)
    profile = Profile(late_days=4, include_current=include_current)
    together, alone = Ring.of(None), {}
    for batch in range(6):
        rows = sorted((rng.randrange(3 + batch), 100 + 9 * batch + rng.randrange(-9, 9)) for _ in range(rng.randrange(1, 40)))
        rows += [(2 + batch, 100 + 9 * batch)]  # the newest key has a row in every batch
        key, day = (np.array(column) for column in zip(*rows, strict=True))
        counts = np.array([[rng.randrange(2) for _ in rows] for _ in COUNTS])
        rating = np.array([rng.choice([np.nan, 0.1, 4.3, 1e300]) for _ in rows])
        made = together.apply(day, counts, rating, profile, key)
        together = Ring.of(together.value())
        for k in set(key):
            here = key == k
            one = alone.setdefault(k, Ring.of(None)).apply(day[here], counts[:, here], rating[here], profile)
            for name, values in one.items():
                np.testing.assert_array_equal(made[name][here], values)
    for k, ring in alone.items():
        here = together.keys == k
        np.testing.assert_array_equal(together.days[here], ring.days)
        np.testing.assert_array_equal(together.counts[:, here], ring.counts)
        assert (together.rating_sum[k], together.rating_n[k]) == (ring.rating_sum[0], ring.rating_n[0])


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


class Held:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_keys_of_a_group_are_forgotten_one_by_one():
    profile = Profile(days=(30,), ring_ttl_ms=100, newest_ttl_ms=40)
    processor = _Processor(profile, ["k", "id"], ["k"], "id")
    processor.state = Held()

    def feed(now, *rows):
        frame = pd.DataFrame(rows, columns=["k", "id", "at__", "day__", "trips__", "wanted__", "rating__"]).assign(accepted__=0, requests__=0)
        # A group comes in pieces.
        (out,) = processor.handleInputRows((0,), iter([frame[:1], frame[1:]]), Clock(now))
        return {r.id: (r.trips_30d, r.avg_rating, None if r.previous_at is pd.NA else r.previous_at) for r in out.itertuples()}

    assert feed(0, ("a", "1", 5, 10, 1, True, 2.0), ("b", "2", 6, 10, 1, True, 3.0)) == {"1": (0, 4.5, None), "2": (0, 4.5, None)}
    assert feed(50, ("b", "3", 9, 10, 1, False, np.nan), ("c", "4", 7, 11, 1, True, np.nan), ("b", "5", 8, 10, 1, True, 5.0)) == {"5": (1, 3.0, None), "4": (0, 4.5, None)}
    # At 100 the ring of a is gone, those of b and c are not; at 90 their newest events were.
    assert feed(89, ("c", "6", 9, 11, 1, True, np.nan)) == {"6": (1, 4.5, 7)}
    assert feed(100, ("a", "7", 9, 10, 1, True, np.nan), ("b", "8", 9, 10, 1, True, np.nan), ("c", "9", 9, 41, 1, True, np.nan)) == {
        "7": (0, 4.5, None), "8": (3, 4.0, None), "9": (0, 4.5, 9)
    }
    # A key of which nothing is known any more leaves the group.
    feed(1000, ("d", "10", 9, 10, 1, True, np.nan))
    assert processor._held(1000)[0] == [("d",)]


def test_keys_share_reads_and_writes_of_state(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(60)}", str(1000 + i), f"2024-01-{1 + i // 20:02d} {rng.randrange(24):02d}:00:00", 1, 0, 0, rng.choice([None, 3.0, 4.5]), True) for i in range(600)]
    spark.createDataFrame(rows, "k string, id string, ts string, trips int, accepted int, requests int, rating double, wanted boolean").withColumn(
        "ts", F.col("ts").cast("timestamp")
    ).coalesce(1).write.parquet(f"{tmp_path}/in")
    with keyed_state(spark):
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        query = run_to_files(with_profile(stream, ["k"], "ts", "id", groups=3), str(tmp_path), partitions=2)
    (progress,) = [p for p in query.recentProgress if p.numInputRows]
    assert progress.stateOperators[0].numRowsUpdated == 3
    found = {r.id: (r.trips_7d, r.avg_rating, r.previous_ts) for r in spark.read.parquet(f"{tmp_path}/data").collect()}
    past: dict[str, list] = {}
    for k, i, ts, *_, rating, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        day, before = int(ts[8:10]), past.setdefault(k, [])
        rated = [r for _, r, _ in before if r is not None]
        want = (sum(day - 7 < d for d, _, _ in before), pytest.approx(sum(rated) / len(rated) if rated else 4.5), before[-1][2] if before else None)
        trips, average, previous = found.pop(i)
        assert (trips, average, previous and str(previous)) == want
        before.append((day, rating, ts))
    assert not found
