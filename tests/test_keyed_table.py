from __future__ import annotations

import random
from pathlib import Path

import pytest

from tidemark.session import shared_dir
from tidemark.sources.snapshots import SnapshotTable

SCHEMA = "k string, ts long, v string"


def table(spark, **options):
    return SnapshotTable(spark, shared_dir(spark, "keyed"), ("k",), ("ts",), **options)


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA).coalesce(1)


def held(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def size(t):
    return sum(f.stat().st_size for f in Path(t.root, "data").rglob("*.parquet"))


def test_a_small_upsert_writes_little(spark):
    """One key into 100,000 costs bytes for one key, until its bucket has many deltas, which become one."""
    t = table(spark, buckets=4, keep=1000, most_deltas=3)
    t.upsert(spark.range(100_000).selectExpr("CAST(id AS STRING) AS k", "1L AS ts", "repeat(CAST(id AS STRING), 20) AS v"))
    first = size(t)
    written = []
    for i in range(9):
        before = size(t)
        t.upsert(rows(spark, ("77", 2 + i, f"new {i}")))
        written.append(size(t) - before)
    assert max(written) < first / 200
    pieces = [p for p in t.last_commit().layout.values() if len(p) > 1]
    assert len(pieces) == 1 and len(pieces[0]) <= 4 and pieces[0][-1].rows == 1
    assert held(t.get([("77",)])) == [("77", 10, "new 8")] and t.read().count() == 100_000
    assert t.compact() and not t.compact()
    assert all(len(p) == 1 for p in t.last_commit().layout.values())
    assert held(t.get([("77",), ("nobody",), ("5",)])) == [("5", 1, "5" * 20), ("77", 10, "new 8")] and t.read().count() == 100_000


def test_buckets_are_written_anew_when_deltas_grow(spark):
    t = table(spark, buckets=1, delta_share=0.5)
    t.upsert(rows(spark, *[(str(i), 1, "a") for i in range(10)]))
    t.upsert(rows(spark, *[(str(i), 2, "b") for i in range(5)]))
    assert [p.rows for p in t.last_commit().layout[0]] == [10, 5]
    t.upsert(rows(spark, ("x", 3, "c")))
    assert [p.rows for p in t.last_commit().layout[0]] == [11]
    assert held(t.read()) == sorted([(str(i), 2, "b") if i < 5 else (str(i), 1, "a") for i in range(10)] + [("x", 3, "c")])


@pytest.mark.parametrize("most_deltas", [1, 4])
def test_any_series_of_upserts_reads_as_the_latest_rows(spark, most_deltas):
    """Older rows that come later lose, null keys are a key, columns come up later; before and after compaction."""
    rng = random.Random(most_deltas)
    t = table(spark, buckets=3, most_deltas=most_deltas, delta_share=0.4, keep=3)
    known, time = {}, list(range(1, 400))
    rng.shuffle(time)
    for step in range(12):
        batch = [(rng.choice([None, *"abcdefghijklmnopqrstuvwxyz"]), time.pop(), f"{step}-{i}") for i in range(rng.choice([1, 2, 12]))]
        df = rows(spark, *batch)
        t.upsert(df.selectExpr("*", "ts * 2 AS more") if step > 6 else df)
        for k, ts, v in batch:
            if k not in known or ts > known[k][1]:
                known[k] = (k, ts, v, ts * 2 if step > 6 else None)
        if step in (5, 9):
            t.compact()
        got = t.read()
        assert held(got if step > 6 else got.selectExpr("*", "CAST(NULL AS BIGINT) AS more")) == sorted(known.values(), key=repr)
    assert held(t.get([("a",), (None,)])) == sorted([known[k] for k in ("a", None) if k in known], key=repr)


def test_a_point_read_opens_few_pieces(spark):
    t = table(spark, buckets=2, delta_share=10.0)
    t.upsert(rows(spark, *[(str(i), 1, "a") for i in range(50)]))
    for i in range(6):
        t.upsert(rows(spark, (str(i), 2, "b")))
    pieces = {p.folder for held_ in t.last_commit().layout.values() for p in held_}
    opened = {f.split("/data/")[1].split("/")[0] for f in t.get([("3",)]).inputFiles()}
    assert len(pieces) == 7 and len(opened) == 2
    assert t.get([("none",)]).count() == 0 and table(spark).get([("a",)]) is None
