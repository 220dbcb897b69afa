from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.plans import streams
from tidemark.streaming import sinks


@pytest.mark.parametrize(("file_rows", "files"), [(streams.FILE_ROWS, streams.FILES), (50, 6)])
def test_micro_batches_of_larger_tables_have_more_files(spark, tmp_path, monkeypatch, file_rows, files):
    """Three micro-batches in the order of time, whole, in files of so many rows."""
    monkeypatch.setattr(streams, "FILE_ROWS", file_rows)
    rows = spark.range(900).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600).alias("ts"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    seen = []

    def handle(batch, number):
        ids = [r.event_id for r in batch.select("event_id").collect()]
        seen.append((min(ids), max(ids), len(ids), batch.select(F.input_file_name()).distinct().count()))

    sinks.run_batches(streams._parts(spark, str(tmp_path), "events", "ts"), f"{tmp_path}/run", handle)
    assert len(seen) == 3 and sum(n for _, _, n, _ in seen) == 900 and all(found == files for *_, found in seen)
    assert all(before[1] < after[0] for before, after in zip(seen, seen[1:])) and (seen[0][0], seen[-1][1]) == (0, 899)


def test_state_partitions_go_with_the_tables(spark, monkeypatch):
    monkeypatch.setattr(streams, "STATE_ROWS", 10)
    assert streams._state(spark.range(100)) == streams.STATE
    assert streams._state(spark.range(600), spark.range(300)) == 30
    assert streams._state(spark.range(100_000)) == streams.MOST_STATE
