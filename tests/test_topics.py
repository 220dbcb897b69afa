from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.timeline import find_hot_keys
from tidemark.session import shared_dir
from tidemark.sources import topics as L
from tidemark.streaming.sinks import run_to_files

T0 = datetime(2024, 1, 1)


def messages(spark, numbers, topic="a"):
    rows = [(topic if i % 7 else None, f"k{i % 3}", f"v{i}", T0 + timedelta(seconds=i), i) for i in numbers]
    return spark.createDataFrame(rows, "topic string, key string, value string, ts timestamp, id long")


def held(spark, root):
    return {(r.topic, r.partition, r.offset): r.value for r in spark.read.schema(L.SCHEMA).parquet(root).collect()}


@pytest.mark.parametrize("hot", [False, True])
def test_offsets_are_dense_and_kept(spark, hot):
    root = shared_dir(spark, "log")
    for batch, numbers in enumerate((range(30), range(30, 50), [], range(50, 61))):
        df = messages(spark, numbers)
        places = df.where("topic IS NOT NULL").withColumn("partition", L.stable_bucket(F.col("key"), 2))
        found = find_hot_keys(places, ["topic", "partition"], F.unix_micros("ts"), floor=4) if hot and numbers else None
        L.append_messages(df, root, batch, "ts", ["id"], 2, found)
    rows = held(spark, root)
    assert sorted(rows.values()) == sorted(f"v{i}" for i in range(61) if i % 7)
    for p in (0, 1):
        own = [rows[k] for k in sorted(k for k in rows if k[1] == p)]
        assert [k[2] for k in sorted(rows) if k[1] == p] == list(range(len(own))) and own == sorted(own, key=lambda v: int(v[1:]))
    assert not L.append_messages(messages(spark, range(30, 50)), root, 1, "ts", ["id"], 2)
    assert held(spark, root) == rows


def test_readers_start_at_either_end_and_go_on(spark):
    root = shared_dir(spark, "log")
    L.append_messages(messages(spark, range(10)), f"{root}/log", 0, "ts", ["id"])
    L.append_messages(messages(spark, range(10, 20), "b"), f"{root}/log", 1, "ts", ["id"])

    def run(name, **options):
        run_to_files(L.read_topic_log(spark, f"{root}/log", **options), f"{root}/{name}")
        return sorted(int(r.value[1:]) for r in spark.read.schema("value string").parquet(f"{root}/{name}/data").collect())

    assert run("all", max_files=1) == [i for i in range(20) if i % 7]
    assert run("b", topics=["b"]) == [i for i in range(10, 20) if i % 7]
    assert run("late", starting="latest") == []
    L.append_messages(messages(spark, range(20, 30)), f"{root}/log", 2, "ts", ["id"])
    assert run("all") == [i for i in range(30) if i % 7] and run("b", topics=["b"]) == [i for i in range(10, 20) if i % 7]
    assert run("late") == [i for i in range(20, 30) if i % 7]
    with pytest.raises(ValueError, match="earliest or latest"):
        L.read_topic_log(spark, f"{root}/log", starting="now")


def test_records_are_found_by_their_place(spark):
    root = shared_dir(spark, "log")
    L.append_messages(messages(spark, range(20)), root, 0, "ts", ["id"], 2)
    places = spark.createDataFrame([("a", 1, 3), ("a", 0, 0), ("a", 0, 0), ("b", 0, 0), ("a", 0, 99)], "topic string, partition int, offset long")
    found = {(r.topic, r.partition, r.offset): r.value for r in L.find_records(spark, root, places).collect()}
    assert found == {k: v for k, v in held(spark, root).items() if k in (("a", 1, 3), ("a", 0, 0))}
