"""Counts, rates and ratings of an entity as of each of its events, from arbitrary state kept per group of keys.

The state of a key is a ring of counts per UTC day, as long as the longest window plus ``late_days``, the sum and number of
its ratings, and the time of its newest event, forgotten after ``newest_ttl``. Keys are dealt by hash into ``groups``, and
the state of a group is one value: a micro-batch costs a group one read and one write of it, whatever its number of keys and
events, and the events of all its keys are numbered by sums over arrays. Few keys of a group cost as much as all, so small
micro-batches want more groups. State lives in RocksDB, so the number of keys is not bound by memory; a group's state is held
in memory by a task, so choose ``groups`` for thousands of keys in each, not millions: the checkpoint keeps it.

The events that one group has in one micro-batch meet in one task; bound them by the source's limit per trigger
(``max_files``, ``maxOffsetsPerTrigger``): a million events of a group take some hundred megabytes there.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import events as E

# The processor travels to the executors by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTS = ("trips", "accepted", "requests")
DEFAULT_RATING = 4.5
DAY_MS = 86_400_000
NAMES = ("names", "keys", "days", "counts", "rating_sum", "rating_n", "ring_at", "newest", "newest_at")
STATE = ", ".join(f"{name} binary" for name in NAMES)
GROUPS = 256
NEVER = np.iinfo(np.int64).min  # in place of a time: there is none


@dataclass(frozen=True)
class Profile:
    """What is kept: windows in days, how late an event may be, and whether an event counts itself."""

    days: tuple[int, ...] = (1, 7, 30)
    late_days: int = 7
    include_current: bool = False
    default_rating: float = DEFAULT_RATING
    ring_ttl_ms: int | None = 62 * DAY_MS
    newest_ttl_ms: int | None = DAY_MS


def _longer(values: np.ndarray, n: int, fill: float = 0) -> np.ndarray:
    return np.concatenate([values, np.full(max(0, n - len(values)), fill, values.dtype)])


@dataclass
class Ring:
    """Counts per key and day, in the order of both, and the ratings of each key. Keys are numbers from 0."""

    keys: np.ndarray
    days: np.ndarray
    counts: np.ndarray  # a row per name in COUNTS
    rating_sum: np.ndarray  # a number per key
    rating_n: np.ndarray

    @classmethod
    def of(cls, held: tuple | None) -> Ring:
        if held is None:
            return cls(*[np.zeros(0, np.int64) for _ in range(2)], np.zeros((len(COUNTS), 0), np.int64), np.zeros(0), np.zeros(0, np.int64))
        keys, days, counts, rating_sum, rating_n = (
            np.frombuffer(value, kind) for value, kind in zip(held, ("<i4", "<i4", "<i8", "<f8", "<i8"), strict=True)
        )
        return cls(keys.astype(np.int64), days.astype(np.int64), counts.reshape(len(COUNTS), -1), rating_sum, rating_n)

    def value(self) -> tuple:
        held = (self.keys, "<i4"), (self.days, "<i4"), (self.counts, "<i8"), (self.rating_sum, "<f8"), (self.rating_n, "<i8")
        return tuple(values.astype(kind).tobytes() for values, kind in held)

    def without(self, gone: np.ndarray) -> Ring:
        """Without what is known of the keys that ``gone`` marks; the others keep their numbers."""
        kept = ~gone[self.keys]
        return Ring(self.keys[kept], self.days[kept], self.counts[:, kept], np.where(gone, 0.0, self.rating_sum), np.where(gone, 0, self.rating_n))

    def apply(
        self, day: np.ndarray, counts: np.ndarray, rating: np.ndarray, profile: Profile, key: np.ndarray | None = None
    ) -> dict[str, np.ndarray]:
        """Columns for events in the order of their ``key`` (all of one without) and time; the ring goes on after them.

        An event sees what came before it: earlier batches, and earlier events of its own.
        """
        key = np.zeros(len(day), np.int64) if key is None else key
        n_keys = max(len(self.rating_sum), int(key[-1]) + 1 if len(key) else 0)
        held_sum, held_n = _longer(self.rating_sum, n_keys), _longer(self.rating_n, n_keys)
        # A key's days as one range of numbers, with room for the longest window before the first day.
        all_days = np.concatenate([self.days, day])
        first = (int(all_days.min()) if len(all_days) else 0) - max(profile.days)
        span = (int(all_days.max()) if len(all_days) else 0) - first + 1
        known_at, at = self.keys * span + self.days - first, key * span + day - first

        newest = np.full(n_keys, np.iinfo(np.int64).min // 2)
        newest[self.keys] = self.days  # the last of a key's days
        late = day < newest[key] - profile.late_days
        counted = np.where(late, 0, counts)
        before = np.concatenate([np.zeros((len(COUNTS), 1), np.int64), np.cumsum(self.counts, axis=1)], axis=1)
        sums = np.concatenate([np.zeros((len(COUNTS), 1), np.int64), np.cumsum(counted, axis=1)], axis=1)
        seen = np.arange(len(day)) + int(profile.include_current)
        out: dict[str, np.ndarray] = {}
        for days in profile.days:
            known = before[:, np.searchsorted(known_at, at, "right")] - before[:, np.searchsorted(known_at, at - days, "right")]
            own = sums[:, seen] - sums[:, np.searchsorted(at, at - days, "right")]
            trips, accepted, requests = known + own
            out[f"trips_{days}d"] = np.where(late, np.nan, trips)
            rate = np.divide(accepted, requests, out=np.zeros(len(day)), where=requests > 0)
            out[f"acceptance_rate_{days}d"] = np.where(late, np.nan, rate)
        given = ~np.isnan(rating) & ~late
        rated = np.where(given, rating, 0.0)
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        total, n = np.zeros(len(day)), np.zeros(len(day), np.int64)
        rating_sum, rating_n = held_sum.copy(), held_n.copy()
        # Key by key, so that no key's ratings round those of another.
        for start, end in zip(starts, [*starts[1:], len(day)], strict=True):
            of, here = key[start], slice(start, end)
            until, number = np.cumsum(rated[here]), np.cumsum(given[here])
            if profile.include_current:
                total[here], n[here] = until, number
            else:
                total[start + 1 : end], n[start + 1 : end] = until[:-1], number[:-1]
            rating_sum[of] += until[-1]
            rating_n[of] += number[-1]
        ratings = held_n[key] + n
        average = np.full(len(day), profile.default_rating)
        np.divide(held_sum[key] + total, ratings, out=average, where=ratings > 0)
        out["avg_rating"] = average

        places, place = np.unique(np.concatenate([known_at, at[~late]]), return_inverse=True)
        merged = np.zeros((len(COUNTS), len(places)), np.int64)
        for row, (old, new) in enumerate(zip(self.counts, counted[:, ~late], strict=True)):
            np.add.at(merged[row], place, np.concatenate([old, new]))
        keys, days = places // span, places % span + first
        newest[keys] = days
        kept = days > newest[keys] - max(profile.days) - profile.late_days
        self.keys, self.days, self.counts = keys[kept], days[kept], merged[:, kept]
        self.rating_sum, self.rating_n = rating_sum, rating_n
        return out


class _Processor(StatefulProcessor):
    def __init__(self, profile: Profile, columns: list[str], keys: list[str], tie: str) -> None:
        self.profile, self.columns, self.keys, self.tie = profile, columns, keys, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttls = (self.profile.ring_ttl_ms, self.profile.newest_ttl_ms)
        self.state = handle.getValueState("group", STATE, None if None in ttls else max(ttls))

    def _held(self, now: int) -> tuple[list[tuple], Ring, np.ndarray, np.ndarray, np.ndarray]:
        """The keys of the group, their ring and when it was written, their newest event and when that was written."""
        held = self.state.get()
        if held is None:
            return [], Ring.of(None), *[np.zeros(0, np.int64) for _ in range(3)]
        names, ring = pickle.loads(held[0]), Ring.of(tuple(held[1:6]))
        ring_at, newest, newest_at = (np.frombuffer(value, "<i8") for value in held[6:])
        lost, old = (
            np.zeros(len(names), bool) if ttl is None else (at == NEVER) | (at + ttl <= now)
            for at, ttl in ((ring_at, self.profile.ring_ttl_ms), (newest_at, self.profile.newest_ttl_ms))
        )
        return names, ring.without(lost), np.where(lost, NEVER, ring_at), np.where(old, NEVER, newest), np.where(old, NEVER, newest_at)

    def _keep(self, names: list[tuple], ring: Ring, ring_at: np.ndarray, newest: np.ndarray, newest_at: np.ndarray) -> None:
        there = (ring_at != NEVER) | (newest_at != NEVER)
        number = np.cumsum(there) - 1
        ring = Ring(number[ring.keys], ring.days, ring.counts, ring.rating_sum[there], ring.rating_n[there])
        times = [values[there].astype("<i8").tobytes() for values in (ring_at, newest, newest_at)]
        kept = [name for name, here in zip(names, there, strict=True) if here]
        self.state.update((pickle.dumps(kept), *ring.value(), *times))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        names, ring, ring_at, newest, newest_at = self._held(now)
        found = pd.concat(rows, ignore_index=True)
        # Each key by its number: the known ones first, as numbered before.
        own = found[self.keys].drop_duplicates()
        numbers = {name: number for number, name in enumerate(names)}
        mine = [numbers.setdefault(tuple(None if v != v else v for v in name), len(numbers)) for name in zip(*[own[k].tolist() for k in self.keys], strict=True)]
        codes = found.groupby(self.keys, sort=False, dropna=False).ngroup().to_numpy()
        found["key__"] = np.array(mine, np.int64)[codes]
        found = found.sort_values(["key__", "at__", self.tie], kind="stable", ignore_index=True)
        names, n_keys, code = list(numbers), len(numbers), found["key__"].to_numpy(np.int64)
        ring_at, newest, newest_at = (_longer(values, n_keys, NEVER) for values in (ring_at, newest, newest_at))

        counts = np.stack([found[f"{c}__"].to_numpy(np.int64) for c in COUNTS])
        made = ring.apply(found["day__"].to_numpy(np.int64), counts, found["rating__"].to_numpy(float), self.profile, code)
        ring_at[code] = now

        wanted = found["wanted__"].to_numpy(bool)
        at, code = found["at__"].to_numpy(np.int64)[wanted], code[wanted]
        first = np.diff(code, prepend=-1) != 0
        previous = np.where(first, newest[code], np.roll(at, 1))
        newest[code] = np.maximum(newest[code], at)  # the last of a key is its newest
        newest_at[code] = now
        self._keep(names, ring, ring_at, newest, newest_at)

        out = found.loc[wanted, self.columns].reset_index(drop=True)
        for name, values in made.items():
            column = pd.Series(values[wanted])
            out[name] = column.astype("Int64") if name.startswith("trips") else column.where(column.notna(), None)
        out["previous_at"] = pd.Series(previous).astype("Int64").where(previous != NEVER, pd.NA)
        yield out

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here keep their state in RocksDB and run no micro-batch without data.

    Arbitrary state needs the one; without the other, state that can expire keeps a query going that should end when all
    that is available is processed. What has expired is not seen again, whether or not it has been removed yet.
    """
    wanted = {PROVIDER: ROCKSDB, EMPTY_BATCHES: "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def with_profile(
    rows: DataFrame, keys: Sequence[str], ts: str, tie: str, profile: Profile | None = None, groups: int = GROUPS
) -> DataFrame:
    """Add to each wanted row of a stream what its key had done before.

    ``rows`` has, besides its own columns, what a row counts for: ``trips``, ``accepted`` and ``requests`` (null: 0), a
    ``rating`` or null, and ``wanted``, whether it is returned or only counted. Returned are its own columns and, for each
    window of ``profile.days`` UTC days, the row's own day included, ``trips_Nd`` and ``acceptance_rate_Nd`` (0 without
    requests), then ``avg_rating`` of all ratings so far (the default without any) and ``previous_ts``, the key's wanted
    event before, unless the state has forgotten it.

    Events of a micro-batch count in the order of ``ts``, then ``tie``; an event that comes in a later micro-batch than
    younger ones counts for those that come after it. One whose day lies more than ``late_days`` before its key's newest
    is not counted and gets nulls. Rows without a key or a time are dropped. Start the query within :func:`keyed_state`.
    Keys share state in ``groups``, a number that the checkpoint keeps.
    """
    profile = profile or Profile()
    extra = {*COUNTS, "rating", "wanted"}
    own = [f for f in rows.schema.fields if f.name not in extra]
    at = F.unix_micros(F.col(ts))
    prepared = rows.where(F.col(ts).isNotNull()).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(
        *[f.name for f in own],
        at.alias("at__"),
        F.floor(at / F.lit(86_400_000_000)).cast("bigint").alias("day__"),
        *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(f"{c}__") for c in COUNTS],
        F.col("rating").cast("double").alias("rating__"),
        F.coalesce(F.col("wanted"), F.lit(False)).alias("wanted__"),
        F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int").alias("group__"),
    )
    schema = T.StructType(list(own))
    for days in profile.days:
        schema = schema.add(f"trips_{days}d", "long").add(f"acceptance_rate_{days}d", "double")
    schema = schema.add("avg_rating", "double").add("previous_at", "long")
    processor = _Processor(profile, [f.name for f in own], list(keys), tie)
    found = prepared.groupBy("group__").transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")
    return found.withColumn("previous_ts", F.timestamp_micros("previous_at")).drop("previous_at")


def _trip_ends(parsed: DataFrame, entity: str) -> DataFrame:
    """Ended trips as counts of their rider or driver."""
    ended = E.good(parsed).where(F.col("event.event_type") == "trip.end")
    return ended.select(
        F.col("event.event_id").alias("event_id"), F.col(f"event.{entity}").alias(entity), "event_ts", F.lit(1).alias("trips"), F.lit(False).alias("wanted")
    )


def rider_features(
    parsed: DataFrame, rating: Column | None = None, profile: Profile | None = None, groups: int = GROUPS
) -> DataFrame:
    """Rider events with calendar, pickup, distance, and their rider's trips of 7 and 30 days and rating until then.

    A rider's request and the end of a trip each count as a trip, a request only for later events.
    """
    rating = F.col("event.rider_rating") if rating is None else rating
    own = E.rider_event_features(parsed, rating.cast("double").alias("rating"))
    rows = own.withColumns({"trips": F.lit(1), "wanted": F.lit(True)}).unionByName(_trip_ends(parsed, "rider_id"), allowMissingColumns=True)
    rows = rows.withColumns({"accepted": F.lit(0), "requests": F.lit(0)}).drop("rider_rating")
    found = with_profile(rows, ["rider_id"], "event_ts", "event_id", profile, groups)
    renamed = {"trips_7d": "rider_trips_7d", "trips_30d": "rider_trips_30d", "avg_rating": "rider_avg_rating"}
    return found.withColumnsRenamed(renamed).drop(*[c for c in found.columns if c.startswith(("trips_", "acceptance_")) and c not in renamed])


def driver_features(
    parsed: DataFrame,
    requested: Column | None = None,
    accepted: Column | None = None,
    rating: Column | None = None,
    profile: Profile | None = None,
    groups: int = GROUPS,
) -> DataFrame:
    """Driver events with status, place and calendar, and their driver's trips, acceptance rate and rating until then.

    The end of a trip counts as a trip. ``requested`` says which driver events answer a request, and ``accepted`` which
    of them take it; by default those that report a status, and those that report ``on_trip``.
    """
    e = F.col("event")
    requested = e.event_type == "driver.status" if requested is None else requested
    accepted = e.status == "on_trip" if accepted is None else accepted
    rating = e.driver_rating if rating is None else rating
    asked = F.coalesce(requested, F.lit(False))
    own = E.driver_event_features(
        parsed,
        asked.cast("int").alias("requests"),
        (asked & F.coalesce(accepted, F.lit(False))).cast("int").alias("accepted"),
        rating.cast("double").alias("rating"),
    )
    rows = own.withColumns({"trips": F.lit(0), "wanted": F.lit(True)}).unionByName(_trip_ends(parsed, "driver_id"), allowMissingColumns=True)
    found = with_profile(rows.drop("driver_rating"), ["driver_id"], "event_ts", "event_id", profile, groups)
    renamed = {
        "trips_1d": "driver_trips_today",
        "trips_7d": "driver_trips_7d",
        "acceptance_rate_7d": "driver_acceptance_rate_7d",
        "avg_rating": "driver_avg_rating",
    }
    return found.withColumnsRenamed(renamed).drop(*[c for c in found.columns if c.startswith(("trips_", "acceptance_")) and c not in renamed])
