"""Event-time counters over streams. The same functions work on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.timeline import row_numbers
from .events import WATERMARK


def daily_counts(stream: DataFrame, keys: Sequence[str], ts: str, delay: str = WATERMARK) -> DataFrame:
    """Events per key and UTC day: the only state that counts over several days need.

    Counting is combined before the shuffle, so a busy key costs its state one
    row per day and task.
    """
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day").alias("__w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("__w.start").alias("day"), "n")
    )


def windows_of_days(daily: DataFrame, keys: Sequence[str], days: int) -> DataFrame:
    """Counts in windows of ``days``, one ending after every day that has events in it, from daily counts.

    A day's count is added to the windows it lies in; events are not touched again.
    """
    day = F.expr("INTERVAL 1 DAY")
    spread = F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    return (
        daily.withColumn("__back", spread)
        .withColumn("window_start", F.col("day") - F.col("__back") * day)
        .groupBy(*keys, "window_start")
        .agg(F.sum("n").alias("n"))
        .select(*keys, "window_start", (F.col("window_start") + days * day).alias("window_end"), "n")
    )


def sliding_counts(
    stream: DataFrame,
    keys: Sequence[str],
    ts: str,
    days: int,
    slide: str = "1 day",
    delay: str = WATERMARK,
) -> DataFrame:
    """Events per key in windows of ``days``, one ending every ``slide``.

    Each event enters as many windows as overlap. For several days prefer
    :func:`daily_counts`, added up by :func:`windows_of_days` when read.
    """
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, f"{days} days", slide).alias("__w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), "n")
    )


def gap_counts(
    stream: DataFrame, keys: Sequence[str], ts: str, gap: str, delay: str = WATERMARK
) -> DataFrame:
    """Events per key since the last silence of at least ``gap``, when it is closed.

    For the value of counters that are still open see ``sinks.run_sessions``.
    Let the session merge sessions before the shuffle for busy keys:
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``.
    """
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap).alias("__w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("__w.start").alias("session_start"), F.col("__w.end").alias("session_end"), "n")
    )


def merge_sessions(new: DataFrame, known: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Sessions of a batch merged with those known before that they touch.

    Both have ``session_start``, ``session_end`` (excluded) and ``n``. A known
    session that becomes part of one that starts earlier comes back with ``n`` 0.
    """
    if known is None:
        return new
    reach = new.groupBy(*keys).agg(F.min("session_start").alias("__from"), F.max("session_end").alias("__to"))
    touched = (
        known.join(reach, list(keys))
        .where((F.col("session_start") < F.col("__to")) & (F.col("session_end") > F.col("__from")))
        .drop("__from", "__to")
    )
    along = Window.partitionBy(*keys).orderBy("session_start", "session_end")
    before = F.max("session_end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = new.unionByName(touched.select(new.columns))
    # A key's sessions near the batch's events, not its events.
    numbered = rows.withColumn("__fresh", (before.isNull() | (F.col("session_start") >= before)).cast("int")).withColumn(
        "__number", F.sum("__fresh").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    merged = (
        numbered.groupBy(*keys, "__number")
        .agg(F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("n").alias("n"))
        .drop("__number")
    )
    gone = touched.join(merged, [*keys, "session_start"], "left_anti").withColumn("n", F.lit(0).cast("bigint"))
    return merged.unionByName(gone.select(merged.columns))


def first_starts(starts: DataFrame, key: str, start_ts: str, delay: str = WATERMARK, held: DataFrame | None = None) -> DataFrame:
    """Starts without repeats of a trip, among themselves and of the trips in ``held``."""
    first = starts.withWatermark(start_ts, delay)
    first = first.dropDuplicatesWithinWatermark([key]) if starts.isStreaming else first.dropDuplicates([key])
    return first if held is None else first.join(held.select(key), key, "left_anti")


def match_trips(
    starts: DataFrame,
    ends: DataFrame,
    key: str,
    start_ts: str,
    end_ts: str,
    within: str,
    delay: str = WATERMARK,
    salts: int = 1,
    known: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Ends joined with the start of the same trip at most ``within`` before.

    A trip has one start, of which repeats are dropped, so there is at most one
    row per end. The time bound lets a stream forget starts that can no longer be
    matched. Where one trip may have very many ends, they can be spread over
    ``salts`` groups, each with a copy of the start.

    ``known`` are the starts and ends kept of earlier micro-batches: those of this
    one, whose starts :func:`first_starts` has been through, are matched with them
    and with each other. See ``sinks.run_trip_pairs``.
    """
    if known is None:
        left, right = first_starts(starts, key, start_ts, delay), ends.withWatermark(end_ts, delay)
    else:
        left, right = (
            new.withColumn("__new", F.lit(True)).unionByName(old.select(new.columns).withColumn("__new", F.lit(False)))
            for new, old in zip((starts, ends), known, strict=True)
        )
    left = left.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("s")
    spread = F.pmod(F.xxhash64(*ends.columns), F.lit(salts)).cast("int")
    right = right.withColumn("__salt", spread).alias("e")
    same = (F.col(f"s.{key}") == F.col(f"e.{key}")) & (F.col("s.__salt") == F.col("e.__salt"))
    bound = (F.col(f"e.{end_ts}") >= F.col(f"s.{start_ts}")) & (
        F.col(f"e.{end_ts}") <= F.col(f"s.{start_ts}") + F.expr(f"INTERVAL {within}")
    )
    if known is not None:
        bound = bound & (F.col("s.__new") | F.col("e.__new"))
    joined = left.join(right, same & bound)
    return joined.select(
        *[F.col(f"s.{c}") for c in starts.columns], *[F.col(f"e.{c}") for c in ends.columns if c != key]
    )


def running_counts(
    batch: DataFrame, state: DataFrame | None, keys: Sequence[str], ts: str, tie: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Number a batch's events per key, going on from the counts in ``state``.

    Returns the numbered events and the new counts of the keys in the batch.
    """
    name = "running_count"
    numbered = row_numbers(batch, keys, ts, tie, name)
    counts = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_ts"))
    if state is None:
        return numbered, counts
    known = state.select(*keys, F.col("n").alias("__n"), F.col("last_ts").alias("__last"))
    numbered = numbered.join(known, list(keys), "left").withColumn(name, F.col(name) + F.coalesce("__n", F.lit(0)))
    counts = counts.join(known, list(keys), "left").select(
        *keys,
        (F.col("n") + F.coalesce("__n", F.lit(0))).alias("n"),
        F.greatest("last_ts", "__last").alias("last_ts"),
    )
    return numbered.drop("__n", "__last"), counts
