"""Running streams into tables. Every sink gives the same table if a batch is repeated."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from ..sources.snapshots import SnapshotTable
from .counters import first_starts, gap_counts, match_trips, merge_sessions, running_counts
from .events import WATERMARK

_STARTS = threading.Lock()


@contextmanager
def _state_partitions(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """Start a query with so many state partitions; its checkpoint keeps the number.

    Starts are taken one at a time, so that none sees the other's number.
    """
    if partitions is None:
        yield
        return
    name = "spark.sql.shuffle.partitions"
    with _STARTS:
        before = spark.conf.get(name)
        spark.conf.set(name, str(partitions))
        try:
            yield
        finally:
            spark.conf.set(name, before)


def _run(writer: DataStreamWriter, spark: SparkSession, every: str | None, partitions: int | None) -> StreamingQuery:
    """Start a query: until what is available is processed, or every so often until it is stopped."""
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    with _state_partitions(spark, partitions):
        query = writer.start()
    if every is None:
        query.awaitTermination()
    return query


def run_to_files(
    stream: DataFrame, root: str, mode: str = "append", partitions: int | None = None, every: str | None = None
) -> StreamingQuery:
    """Write a stream to parquet files.

    The file sink keeps a log of the files of each batch, so readers see every
    row once. ``partitions`` is the number of state partitions, to be sized for
    the state: the checkpoint keeps it for ever. Without ``every`` the query ends
    when what is available is processed; with it, it goes on and is returned.
    """
    writer = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", f"{root}/checkpoint")
        .option("path", f"{root}/data")
    )
    return _run(writer, stream.sparkSession, every, partitions)


def run_batches(
    stream: DataFrame,
    root: str,
    handle: Callable[[DataFrame, int], None],
    mode: str = "append",
    partitions: int | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Hand each micro-batch and its number to ``handle``; see :func:`run_to_files`."""
    writer = (
        stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint")
    )
    return _run(writer, stream.sparkSession, every, partitions)


def writer_name(batch: DataFrame) -> str:
    """The streaming query that a micro-batch is from: the same after a restart from its checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def run_upserts(
    stream: DataFrame,
    table: SnapshotTable,
    root: str,
    mode: str = "append",
    partitions: int | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Merge each micro-batch into a keyed table; one that is repeated changes nothing."""

    def handle(batch: DataFrame, number: int) -> None:
        table.upsert(batch, number, writer_name(batch))

    return run_batches(stream, root, handle, mode, partitions, every)


def run_versioned_upserts(
    stream: DataFrame, table: SnapshotTable, root: str, partitions: int | None = None, every: str | None = None
) -> StreamingQuery:
    """Merge changed aggregates into a table ordered by a ``batch`` column, the newest kept.

    ``batch`` counts on from the table's commits, so that aggregates of a query
    with a new checkpoint replace those of the one before.
    """

    def handle(batch: DataFrame, number: int) -> None:
        last = table.last_commit()
        following = 1 if last is None else last.number + 1
        table.upsert(batch.withColumn("batch", F.lit(following).cast("bigint")), number, writer_name(batch))

    return run_batches(stream, root, handle, "update", partitions, every)


def run_sessions(
    stream: DataFrame,
    table: SnapshotTable,
    root: str,
    keys: Sequence[str],
    ts: str,
    gap: str,
    partitions: int | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Keep the counts of every key's sessions, open ones included, in a table by key and ``session_start``.

    A micro-batch is counted by itself and merged with the sessions it touches.
    Rows with ``n`` 0 are sessions that have become part of another.
    """

    def handle(batch: DataFrame, number: int) -> None:
        writer = writer_name(batch)
        new = gap_counts(batch, keys, ts, gap)
        merged = merge_sessions(new, table.read(number, writer), keys)
        table.upsert(merged.withColumn("batch", F.lit(number).cast("bigint")), number, writer)

    return run_batches(stream, root, handle, partitions=partitions, every=every)


def run_running_counts(
    stream: DataFrame,
    state: SnapshotTable,
    root: str,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str],
    partitions: int | None = None,
    every: str | None = None,
) -> str:
    """Write every event with its key's running count; returns the folder.

    A key's count is read as it was before the batch, so a repeated batch gives
    its events the same numbers again.
    """

    def handle(batch: DataFrame, number: int) -> None:
        writer = writer_name(batch)
        batch = batch.persist()
        try:
            numbered, counts = running_counts(batch, state.read(number, writer), keys, ts, tie)
            numbered.write.mode("overwrite").parquet(f"{root}/events/batch={number}")
            state.upsert(counts, number, writer)
        finally:
            batch.unpersist()

    run_batches(stream, root, handle, partitions=partitions, every=every)
    return f"{root}/events"


def run_trip_pairs(
    starts: DataFrame,
    ends: DataFrame,
    root: str,
    key: str,
    start_ts: str,
    end_ts: str,
    within: str,
    delay: str = WATERMARK,
    salts: int = 1,
    partitions: int | None = None,
    every: str | None = None,
) -> str:
    """Write the pairs of :func:`match_trips`, a folder per micro-batch, and return the folder of these.

    What a join of streams keeps row by row in a state store is kept in files here: starts and ends that may still be
    matched are read, joined with those of a micro-batch, and written again, in as many tasks as ``partitions`` says. That
    suits micro-batches that are not small beside what is kept; for others write ``match_trips`` of the streams.

    Rows count, are late and are forgotten as they are there. The watermark of a micro-batch is ``delay`` before the newest
    start or newest end of earlier ones, whichever is older. Rows not after the watermark of the micro-batch before are
    late: they are dropped, and counted in ``state/batch=N/marks``. A start blocks repeats until the watermark has passed
    it by ``delay``. A micro-batch that is repeated reads what the one before kept, and replaces its own.
    """
    sides, times = (starts, ends), (start_ts, end_ts)
    length = starts.sparkSession.sql(f"SELECT TIMESTAMP_NTZ'1970-01-01' + INTERVAL {delay}").first()[0] - datetime(1970, 1, 1)
    micros = length // timedelta(microseconds=1)
    own = [F.struct(*rows.columns) for rows in sides]
    none = [F.lit(None).cast(rows.select(one.alias("r")).schema["r"].dataType) for rows, one in zip(sides, own, strict=True)]
    both = starts.select(own[0].alias("start"), none[1].alias("end"), F.lit(False).alias("ended")).unionByName(
        ends.select(none[0].alias("start"), own[1].alias("end"), F.lit(True).alias("ended"))
    )

    def after(ts: Column | str, mark: int | None) -> Column:
        return F.lit(True) if mark is None else F.unix_micros(ts) > mark

    def handle(batch: DataFrame, number: int) -> None:
        session, here, before = batch.sparkSession, f"{root}/state/batch={number}", f"{root}/state/batch={number - 1}"

        def keep(rows: DataFrame, name: str) -> DataFrame:
            rows.write.mode("overwrite").parquet(f"{here}/{name}")
            return session.read.schema(rows.schema).parquet(f"{here}/{name}")

        held = session.read.parquet(f"{before}/marks").first() if number else None
        passed, earlier = (held.mark, (held.last_start, held.last_end)) if held else (None, (None, None))
        batch.write.mode("overwrite").partitionBy("ended").parquet(f"{here}/arrived")
        read = session.read.schema(batch.schema).parquet(f"{here}/arrived")
        arrived = read.where(~F.col("ended")).select("start.*"), read.where("ended").select("end.*")
        late = [~after(ts, passed) for ts in times]

        # The newest times so far, and the watermark that follows from those of earlier micro-batches.
        seen = [rows.agg(F.max(F.unix_micros(ts)), F.count_if(gone)).first() for rows, ts, gone in zip(arrived, times, late, strict=True)]
        newest = [max((t for t in (now[0], then) if t is not None), default=None) for now, then in zip(seen, earlier, strict=True)]
        mark = None if None in earlier else max([min(earlier) // 1000 * 1000 - micros, *([] if passed is None else [passed])])

        # A row without a time is not late, and as old as can be when it is kept.
        timed = [rows.where(F.col(key).isNotNull() & ~F.coalesce(gone, F.lit(False))) for rows, gone in zip(arrived, late, strict=True)]
        blocks = F.lit(True) if passed is None else F.coalesce(F.unix_micros(start_ts), F.lit(0)) + micros > passed
        open_start = blocks | after(F.col(start_ts) + F.expr(f"INTERVAL {within}"), passed)
        kept = [rows.limit(0) for rows in timed]
        if number:
            old = session.read.schema(batch.schema).parquet(f"{before}/arrived").where("ended").select("end.*")
            first = session.read.schema(starts.schema).parquet(f"{before}/first", f"{before}/open_starts")
            old = old.unionByName(session.read.schema(ends.schema).parquet(f"{before}/open_ends"))
            kept = [first.where(open_start), old.where(after(end_ts, passed))]
        known = keep(kept[0], "open_starts"), keep(kept[1], "open_ends")
        # Written first: which of several repeats is kept must not change between its uses.
        first = keep(first_starts(timed[0], key, start_ts, delay, known[0].where(blocks)), "first")
        pairs = match_trips(first, timed[1], key, start_ts, end_ts, within, delay, salts, known)
        pairs.write.mode("overwrite").parquet(f"{root}/data/batch={number}")
        marks = [(*newest, mark, sum(now[1] for now in seen))]
        session.createDataFrame(marks, "last_start bigint, last_end bigint, mark bigint, late_rows bigint").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{here}/marks")
        if number > 1:
            gone = session._jvm.org.apache.hadoop.fs.Path(f"{root}/state/batch={number - 2}")
            gone.getFileSystem(session._jsc.hadoopConfiguration()).delete(gone, True)

    run_batches(both, root, handle, partitions=partitions, every=every)
    return f"{root}/data"


class ProgressLog(StreamingQueryListener):
    """Keeps the latest progress of each query: rows, rates, late rows, observed metrics, and these added up."""

    def __init__(self) -> None:
        self.latest: dict[str, dict] = {}
        self.observed: dict[tuple[str, str], dict[int, dict[str, int]]] = {}
        self.ended: set[str] = set()

    def totals(self, query: str, name: str, timeout: float = 30) -> dict[str, int]:
        """Observed counts over all micro-batches of a query that has ended; progress comes in some time after."""
        deadline = time.monotonic() + timeout
        while query not in self.ended and time.monotonic() < deadline:
            time.sleep(0.05)
        if query not in self.ended:
            raise TimeoutError(f"the end of {query} has not been seen")
        out: dict[str, int] = {}
        for counts in self.observed.get((query, name), {}).values():
            for metric, n in counts.items():
                out[metric] = out.get(metric, 0) + n
        return out

    def onQueryStarted(self, event) -> None:
        self.latest.setdefault(str(event.id), {})

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        self.latest[str(event.progress.id)] = {
            "batch": progress["batchId"],
            "rows": progress.get("numInputRows", 0),
            "rows_per_second": progress.get("processedRowsPerSecond"),
            "late_rows": sum(op.get("numRowsDroppedByWatermark", 0) for op in progress.get("stateOperators", [])),
            "observed": progress.get("observedMetrics", {}),
        }
        # A micro-batch may be reported again, without rows, when nothing is left.
        if progress.get("numInputRows", 0):
            for name, counts in progress.get("observedMetrics", {}).items():
                self.observed.setdefault((str(event.progress.id), name), {})[progress["batchId"]] = counts

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))


def observe_outcomes(parsed: DataFrame, name: str = "events") -> DataFrame:
    """Count processed and failed records on the way, for :class:`ProgressLog`."""
    return parsed.observe(
        name,
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("problem").isNotNull()).alias("errors"),
    )


def merge_sessions_early(spark: SparkSession) -> None:
    """Merge sessions within each task before the shuffle, which busy keys need."""
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
