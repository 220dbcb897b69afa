"""Feature views and services: training joins, online lookup, materialization."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.asof import asof_join, latest, lookup, time_range
from ..operators.quality import schema_differences
from ..operators.timeline import HotKeys, find_hot_keys
from ..session import path_exists
from ..sources.snapshots import SnapshotTable


@dataclass(frozen=True)
class FeatureView:
    """Features of one entity: keys, columns, time to live, and the table they are in.

    ``hot`` are the source's hot keys if they are known; otherwise a training
    join looks for them, which reads the keys and times of the source once more.
    """

    name: str
    keys: tuple[str, ...]
    ttl: timedelta
    schema: T.StructType
    source: DataFrame | None = None
    ts_col: str = "event_timestamp"
    created_col: str | None = None
    tags: Mapping[str, str] = field(default_factory=dict)
    hot: HotKeys | None = None

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    def over(self, source: DataFrame, hot: HotKeys | None = None) -> FeatureView:
        return replace(self, source=source, hot=hot)

    def problems(self) -> DataFrame:
        """How the source's schema differs from the declared one."""
        return schema_differences(self.source.select(*[c for c in self.source.columns if c in self.columns]), self.schema)


@dataclass(frozen=True)
class FeatureService:
    """An ordered choice of columns from several views."""

    name: str
    parts: tuple[tuple[str, tuple[str, ...]], ...]
    tags: Mapping[str, str] = field(default_factory=dict)


RIDER_VIEW = FeatureView("rider_features", ("rider_id",), timedelta(days=1), schemas.RIDER_FEATURES)
DRIVER_VIEW = FeatureView("driver_features", ("driver_id",), timedelta(hours=12), schemas.DRIVER_FEATURES)
TRIP_VIEW = FeatureView("trip_features", ("trip_id",), timedelta(hours=24), schemas.TRIP_FEATURES)

# The columns each model reads.
ETA_PREDICTION = FeatureService(
    "eta_prediction",
    (
        ("trip_features", ("trip_distance_km", "traffic_level", "weather_condition")),
        ("driver_features", ("driver_avg_trip_duration_7d", "vehicle_type")),
        ("rider_features", ("hour_of_day", "day_of_week", "is_peak_hour")),
    ),
)
SURGE_PRICING = FeatureService(
    "surge_pricing",
    (
        ("rider_features", ("rider_trips_7d", "hour_of_day", "is_peak_hour")),
        ("driver_features", ("driver_trips_today", "driver_status")),
        ("trip_features", ("pickup_lat", "pickup_lng", "traffic_level")),
    ),
)
FRAUD_DETECTION = FeatureService(
    "fraud_detection",
    (
        ("rider_features", ("rider_trips_7d", "rider_cancellation_rate_7d", "rider_avg_fare_30d")),
        ("driver_features", ("driver_acceptance_rate_7d", "driver_cancellation_rate_7d", "driver_avg_rating")),
        ("trip_features", ("trip_distance_km", "estimated_fare")),
    ),
)


def _wanted(service: FeatureService, columns: Sequence[str], full_names: bool) -> list[tuple[str, str, str]]:
    """(view, column, output name) in the service's order; a repeated name needs full names."""
    out = [(view, c, f"{view}__{c}" if full_names else c) for view, cs in service.parts for c in cs]
    names = [name for _, _, name in out] + list(columns)
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"columns in more than one place, use full names: {repeated}")
    return out


def historical_features(
    entities: DataFrame,
    service: FeatureService,
    views: Mapping[str, FeatureView],
    ts: str = "event_timestamp",
    full_names: bool = False,
) -> DataFrame:
    """Every entity row with each view's features as of the row's time.

    A view is joined on its own keys; a view whose keys the entities lack gives
    null columns.
    """
    wanted = _wanted(service, entities.columns, full_names)
    asked_between = time_range(entities, ts)
    result = entities
    for view_name, _ in service.parts:
        view = views[view_name]
        pairs = [(c, name) for v, c, name in wanted if v == view_name]
        if set(view.keys) <= set(entities.columns):
            source = view.source.select(
                *view.keys,
                F.col(view.ts_col).alias("__feature_ts"),
                *([F.col(view.created_col).alias("__created")] if view.created_col else []),
                *[F.col(c).alias(name) for c, name in pairs],
            )
            result = asof_join(
                result,
                source,
                list(view.keys),
                ts,
                "__feature_ts",
                [name for _, name in pairs],
                view.ttl,
                "__created" if view.created_col else None,
                hot=_hot_keys(entities, ts, view) if view.hot is None else view.hot,
                asked_between=asked_between,
            )
        else:
            result = result.withColumns(_nulls(view, pairs))
    return result.select(*entities.columns, *[name for _, _, name in wanted])


def _hot_keys(entities: DataFrame, ts: str, view: FeatureView) -> HotKeys:
    """Hot keys of the entities as given and the view; earlier joins do not add rows."""
    times = entities.select(*view.keys, F.col(ts).cast("timestamp").alias("__at")).unionByName(
        view.source.select(*view.keys, F.col(view.ts_col).cast("timestamp").alias("__at"))
    )
    return find_hot_keys(times, view.keys, F.unix_micros("__at"))


def _nulls(view: FeatureView, pairs: Sequence[tuple[str, str]]) -> dict[str, Column]:
    return {name: F.lit(None).cast(view.schema[c].dataType) for c, name in pairs}


def online_features(
    requests: DataFrame,
    service: FeatureService,
    views: Mapping[str, FeatureView],
    online: Mapping[str, DataFrame],
    now: Column | None = None,
    full_names: bool = False,
) -> DataFrame:
    """Request rows with the online table's values; unknown or expired keys give nulls.

    ``online`` maps a view to a table with one row per key and ``expires_at``.
    """
    wanted = _wanted(service, requests.columns, full_names)
    result = requests
    for view_name, _ in service.parts:
        view = views[view_name]
        pairs = [(c, name) for v, c, name in wanted if v == view_name]
        if set(view.keys) <= set(requests.columns):
            table = online[view_name].select(
                *view.keys, "expires_at", *[F.col(c).alias(name) for c, name in pairs]
            )
            result = lookup(result, table, view.keys, [name for _, name in pairs], now)
        else:
            result = result.withColumns(_nulls(view, pairs))
    return result.select(*requests.columns, *[name for _, _, name in wanted])


def slice_to_load(
    view: FeatureView, start: Column | None, end: Column, after: bool = False, by: str | None = None
) -> DataFrame:
    """The latest row of each key with a time in [start, end], with its expiry.

    ``after`` leaves the start itself out, for loads that continue an earlier one.
    ``by`` names the column that decides, if it is not the time of the event. The
    filter reaches the scan.
    """
    at = F.col(by or view.ts_col)
    rows = view.source.where(at <= end)
    if start is not None:
        rows = rows.where(at > start if after else at >= start)
    columns = [*view.keys, view.ts_col, *view.columns]
    if view.created_col:
        columns.append(view.created_col)
    tie = [view.created_col] if view.created_col else []
    newest = latest(rows.select(*columns), list(view.keys), view.ts_col, tie or view.columns)
    return newest.withColumn("expires_at", F.col(view.ts_col).cast("timestamp") + F.lit(view.ttl))


def materialize(view: FeatureView, table: SnapshotTable, start: Column, end: Column, version: int) -> None:
    """Load the time slice [start, end] of a view into its online table."""
    table.upsert(slice_to_load(view, start, end), version, f"slice:{view.name}")


def materialize_incremental(
    spark: SparkSession, view: FeatureView, table: SnapshotTable, log: str, end: datetime
) -> int:
    """Load what is new since the last load of the view, and note the new mark in ``log``.

    What is new is decided by the view's time of creation if it has one, so that
    rows which arrive late are loaded too, and by event time otherwise. The mark is
    written after the load. A run that is lost in between is repeated by the next
    one under the same number, which changes nothing.
    """
    last = None
    if path_exists(spark, log):
        marks = spark.read.schema("view string, loaded_to timestamp, version bigint").parquet(log)
        newest = F.max(F.struct("version", "loaded_to")).alias("mark")
        last = marks.where(F.col("view") == view.name).agg(newest).first()["mark"]
    version = 1 if last is None else last["version"] + 1
    start = None if last is None else F.lit(last["loaded_to"])
    rows = slice_to_load(view, start, F.lit(end), after=True, by=view.created_col)
    table.upsert(rows, version, f"incremental:{view.name}")
    mark = spark.createDataFrame([(view.name, end, version)], "view string, loaded_to timestamp, version bigint")
    mark.coalesce(1).write.mode("append").parquet(log)
    return version
