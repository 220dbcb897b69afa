"""Ordered operators against brute force, with hot keys forced and not."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.features.batch import preferred_type_as_of
from tidemark.operators.asof import asof_join, asof_join_by_instant, latest, lookup
from tidemark.operators.timeline import SLOT, find_hot_keys, next_in_time, row_numbers, row_numbers_in_ranges, with_slots
from tidemark.operators.trailing import Trailing, trailing

START = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def make_events(seed: int, rows: int = 400):
    """Rows in which key "a" holds well over a third."""
    rng = random.Random(seed)
    return [
        (
            rng.choice("aaaabcd"),
            START + timedelta(minutes=30 * rng.randrange(800)),
            round(rng.uniform(0, 100), 2) if rng.random() > 0.1 else None,
            rng.random() < 0.3,
            i,
        )
        for i in range(rows)
    ]


@pytest.fixture(params=["cold", "hot"])
def heat(request):
    """Run with the real threshold, and with one that makes the large keys hot."""
    return dict(share=0.05, floor=20) if request.param == "hot" else dict()


def hot_for(df, heat, shifts=(0,)):
    found = find_hot_keys(df, ["k"], F.unix_micros("ts"), shifts, **heat)
    assert bool(found) == bool(heat)
    return found


def test_trailing_matches_brute_force(spark, heat):
    data = make_events(1)
    df = spark.createDataFrame(data, "k string, ts timestamp, v double, ok boolean, id long")
    specs = [
        Trailing("n2", timedelta(days=2)),
        Trailing("n5", timedelta(days=5)),
        Trailing("s2", timedelta(days=2), "sum", F.col("v")),
        Trailing("a5", timedelta(days=5), "avg", F.col("v")),
        Trailing("r5", timedelta(days=5), "ratio", F.col("ok")),
    ]
    hot = hot_for(df, heat, [0, *(days * 86_400_000_000 for days in (2, 5))])
    got = trailing(df, ["k"], "ts", specs, day_count="today", hot=hot).collect()
    assert len(got) == len({(k, ts) for k, ts, *_ in data})
    for row in got:
        def frame(days):
            return [r for r in data if r[0] == row.k and row.ts - timedelta(days=days) <= r[1] <= row.ts]

        two, five = frame(2), frame(5)
        assert row.n2 == len(two) and row.n5 == len(five)
        values = [r[2] for r in two if r[2] is not None]
        assert row.s2 == (pytest.approx(sum(values)) if values else None)
        values = [r[2] for r in five if r[2] is not None]
        assert row.a5 == (pytest.approx(sum(values) / len(values)) if values else None)
        assert row.r5 == pytest.approx(sum(r[3] for r in five) / len(five))
        assert row.today == sum(r[0] == row.k and r[1].date() == row.ts.date() for r in data)


def test_trailing_without_current_and_with_extra(spark, heat):
    data = make_events(2)
    df = spark.createDataFrame(data, "k string, ts timestamp, v double, ok boolean, id long")
    specs = [Trailing("n2", timedelta(days=2))]
    got = trailing(df, ["k"], "ts", specs, extra=["ok"], include_current=False, hot=hot_for(df, heat)).collect()
    assert len(got) == len({(r[0], r[1], r[3]) for r in data})
    for row in got:
        assert row.n2 == sum(r[0] == row.k and row.ts - timedelta(days=2) <= r[1] < row.ts for r in data)


def test_trailing_edges(spark):
    week = timedelta(days=7)
    times = [START, START + week, START + week, START + week + timedelta(microseconds=1)]
    df = spark.createDataFrame([("a", t, float(i)) for i, t in enumerate(times)], "k string, ts timestamp, v double")
    got = {r.ts: r.n for r in trailing(df, ["k"], "ts", [Trailing("n", week)]).collect()}
    assert got == {times[0]: 1, times[1]: 3, times[3]: 3}


def test_trailing_large_value_leaves_no_residue(spark):
    rows = [("a", START, 1e15), ("a", START + timedelta(days=9), 0.1)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    got = trailing(df, ["k"], "ts", [Trailing("s", timedelta(days=7), "avg", F.col("v"))])
    assert {r.ts: r.s for r in got.collect()}[rows[1][1]] == 0.1


def test_row_numbers_and_next(spark, heat):
    data = make_events(3)
    df = spark.createDataFrame(data, "k string, ts timestamp, v double, ok boolean, id long")
    hot = hot_for(df, heat)
    ordered = {k: sorted((r[1], r[4]) for r in data if r[0] == k) for k in "abcd"}
    for row in row_numbers(df, ["k"], "ts", ["id"], hot=hot).collect():
        assert ordered[row.k][row.row_number - 1] == (row.ts, row.id)
    for row in next_in_time(df, ["k"], "ts", ["id"], hot=hot).collect():
        place = ordered[row.k].index((row.ts, row.id)) + 1
        expected = ordered[row.k][place][0] if place < len(ordered[row.k]) else None
        assert row.next_ts == expected


def test_asof_matches_brute_force(spark, heat):
    labels = make_events(4, 300)
    features = make_events(5, 300)
    left = spark.createDataFrame(labels, "k string, ts timestamp, v double, ok boolean, id long").select("k", "ts", "id")
    right = spark.createDataFrame(features, "k string, fts timestamp, f double, ok boolean, created long")
    ttl = timedelta(hours=12)
    hot = hot_for(left, heat)
    got = asof_join(left, right, ["k"], "ts", "fts", ["f", "created"], ttl, "created", "seen_at", hot).collect()
    assert len(got) == len(labels)
    for row in got:
        seen = [(r[1], r[4], r[2]) for r in features if r[0] == row.k and row.ts - ttl <= r[1] <= row.ts]
        expected = max(seen, key=lambda s: s[:2], default=(None, None, None))
        assert (row.seen_at, row.created, row.f) == expected


def test_asof_edges(spark):
    day = timedelta(days=1)
    tick = timedelta(microseconds=1)
    labels = [(1, "at", START), (2, "edge", START), (3, "old", START), (4, "later", START), (5, "null", START),
              (6, "at", START), (7, "none", START), (8, None, START), (9, "at", None)]
    features = [("at", START, 1), ("edge", START - day, 2), ("old", START - day - tick, 3), ("later", START + tick, 4),
                ("null", START - HOUR, 5), ("null", START, None), (None, START, 9)]
    left = spark.createDataFrame(labels, "id int, k string, ts timestamp")
    right = spark.createDataFrame(features, "k string, fts timestamp, f int")
    got = {r.id: r.f for r in asof_join(left, right, ["k"], "ts", "fts", ["f"], day).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: None, 5: None, 6: 1, 7: None, 8: None, 9: None}


def test_asof_reads_only_what_labels_can_see(spark, tmp_path):
    features = spark.createDataFrame([("a", START + i * HOUR, i) for i in range(100)], "k string, fts timestamp, f int")
    features.write.parquet(str(tmp_path / "f"))
    stored = spark.read.parquet(str(tmp_path / "f"))
    labels = spark.createDataFrame([("a", START + 50 * HOUR)], "k string, ts timestamp")
    joined = asof_join(labels, stored, ["k"], "ts", "fts", ["f"], timedelta(hours=3))
    assert joined.collect()[0].f == 50
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(fts" in plan.replace("...l(fts", "GreaterThanOrEqual(fts") and "fts,2024-01-02 23:00:00" in plan
    none = asof_join(labels.limit(0), stored, ["k"], "ts", "fts", ["f"], timedelta(hours=3))
    assert none.collect() == []


def test_latest_and_lookup(spark):
    rows = [("a", START, 1), ("a", START + HOUR, 2), ("a", START + HOUR, 3), ("b", START, None)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, f int")
    last = latest(df, ["k"], "ts", ["f"])
    assert {(r.k, r.f) for r in last.collect()} == {("a", 3), ("b", None)}
    table = last.withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    asked = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    got = lookup(asked, table, ["k"], ["f"], F.lit(START + timedelta(days=1)))
    assert {(r.k, r.f) for r in got.collect()} == {("a", 3), ("b", None), ("c", None), (None, None)}


def test_slots_of_a_burst_are_even(spark):
    """Nine tenths of a hot key's rows fall into an hour of a month."""
    rows = [("a", START + timedelta(seconds=4 * i)) for i in range(900)]
    rows += [("a", START + timedelta(hours=7 * i)) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    axis = F.unix_micros("ts")
    week = 7 * 86_400_000_000
    hot = find_hot_keys(df, ["k"], axis, [0, week], share=0.05, floor=50)
    moves = df.withColumn("at", F.explode(F.array(axis, axis + week))).where(F.col("at") <= axis + week)
    moves = with_slots(moves, ["k"], F.col("at"), hot, unseen=F.col("at") > axis)
    sizes = [r["count"] for r in moves.groupBy(SLOT).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3 * sum(sizes) / len(sizes)


def test_hot_keys_are_few_and_optional(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"), F.col("id").alias("at"))
    assert not find_hot_keys(df, ["k"], F.col("at"))
    assert not find_hot_keys(df, ["k"], F.col("at"), share=0.2, floor=10)
    assert find_hot_keys(df, ["k"], F.col("at"), share=0.05, floor=10).rows == 10


def test_preferred_type_as_of_each_trip(spark, heat):
    """Against counting all earlier trips; ties by name, trips without a type count for none."""
    rng = random.Random(9)
    data = [(k, t, rng.choice(["suv", "sedan", "van", None]), i) for k, t, _, _, i in make_events(6)]
    df = spark.createDataFrame(data, "k string, ts timestamp, kind string, id long")
    for include_current in (False, True):
        got = preferred_type_as_of(df, "k", "kind", "ts", ["id"], include_current, hot_for(df, heat)).collect()
        assert len(got) == len(data)
        for row in got:
            seen = [r[2] for r in data if r[0] == row.k and r[2] and ((r[1], r[3]) < (row.ts, row.id) or include_current and r[3] == row.id)]
            best = min(((-seen.count(x), x) for x in set(seen)), default=(0, None))
            assert (row.preferred_type, row.preferred_trips) == (best[1], -best[0])


def test_one_instant_of_one_key_is_cut(spark):
    """A bulk load: all rows of a key at one time, in slots that its ties are cut into."""
    rng = random.Random(3)
    data = [("a" if i % 4 else rng.choice("bc"), START, i) for i in range(500)] + [("a", None, 1000 + i) for i in range(20)]
    data += [(None, START, 2000 + i) for i in range(9)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, ts timestamp, id long").repartition(5)
    got = row_numbers_in_ranges(df, ["k"], "ts", ["id"], slot_rows=30).collect()
    assert len(got) == len(data)
    for key in ("a", "b", "c", None):
        own = sorted(((t is not None, t or START, i) for k, t, i in data if k == key))
        assert [r.id for r in sorted((r for r in got if r.k == key), key=lambda r: r.row_number)] == [i for _, _, i in own]
        assert sorted(r.row_number for r in got if r.k == key) == list(range(1, len(own) + 1))


def test_asof_by_instant_is_the_same_join(spark):
    labels = [(k, START + timedelta(hours=h % 3), i) for i, (k, h) in enumerate((k, h) for k in ("a", "a", "a", "b", None) for h in range(40))]
    labels += [("a", None, 999)]
    features = make_events(7, 80)
    left = spark.createDataFrame(labels, "k string, ts timestamp, id long")
    right = spark.createDataFrame(features, "k string, fts timestamp, f double, ok boolean, created long")
    how = dict(ttl=timedelta(days=9), created="created", feature_ts_as="seen_at")
    args = (left, right, ["k"], "ts", "fts", ["f", "created"])
    want, got = asof_join(*args, **how), asof_join_by_instant(*args, **how)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
