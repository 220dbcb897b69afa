"""Point-in-time joins and latest-value lookups."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .timeline import SLOT, HotKeys, find_hot_keys, with_slots


def time_range(df: DataFrame, ts: str) -> tuple[int, int] | None:
    """The least and the greatest time in microseconds, or None if there is none."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    found = df.agg(F.min(at).alias("first"), F.max(at).alias("last")).first()
    return None if found["first"] is None else (found["first"], found["last"])


def asof_join(
    labels: DataFrame,
    features: DataFrame,
    keys: Sequence[str],
    label_ts: str,
    feature_ts: str,
    columns: Sequence[str],
    ttl: timedelta | None = None,
    created: str | None = None,
    feature_ts_as: str | None = None,
    hot: HotKeys | None = None,
    asked_between: tuple[int, int] | None = None,
) -> DataFrame:
    """All label rows, each with the latest feature row of its key at or before its time.

    A feature row exactly ``ttl`` old is still visible, an older one is not. Of
    several feature rows of one key and time the one created last wins
    (``created``), or else the greatest by ``columns``. The chosen row's nulls
    stay null. ``feature_ts_as`` also returns the time of the chosen row.

    Both sides go through one shuffle on the key, as one union, and one ordered
    pass that remembers the last feature row. With a ``ttl`` only feature rows
    that some label can see are read: ``asked_between`` is the range of label
    times (see :func:`time_range`), which is looked up if not given.
    """
    if ttl is not None and asked_between is None:
        asked_between = time_range(labels, label_ts)
    if ttl is not None and asked_between is not None:
        first, last = (F.timestamp_micros(F.lit(t)) for t in asked_between)
        features = features.where(F.col(feature_ts).between(first - F.lit(ttl), last))
    chosen = F.struct(*[F.col(c) for c in columns])
    newest = F.max_by(chosen, F.struct(F.col(created), chosen)) if created else F.max(chosen)
    known = (
        features.where(F.col(feature_ts).isNotNull())
        .dropna(subset=list(keys), how="any")
        .groupBy(*keys, feature_ts)
        .agg(newest.alias("__f"))
        .select(
            *keys,
            F.col(feature_ts).cast("timestamp").alias("__at"),
            F.lit(0).alias("__side"),
            F.struct(F.col(feature_ts).cast("timestamp").alias("at"), F.col("__f").alias("row")).alias("__f"),
        )
    )
    asked = labels.select(
        *keys,
        F.col(label_ts).cast("timestamp").alias("__at"),
        F.lit(1).alias("__side"),
        F.struct(*labels.columns).alias("__label"),
    )
    rows = asked.unionByName(known, allowMissingColumns=True)

    axis = F.unix_micros("__at")
    if hot is None:
        narrow = labels.select(*keys, F.col(label_ts).cast("timestamp").alias("__at")).unionByName(
            features.select(*keys, F.col(feature_ts).cast("timestamp").alias("__at"))
        )
        hot = find_hot_keys(narrow, keys, axis)
    rows = with_slots(rows, keys, axis, hot)
    if hot:
        last = F.max_by("__f", F.when(F.col("__side") == 0, F.col("__at")))
        per_slot = rows.where(F.col(SLOT).isNotNull()).groupBy(*keys, SLOT).agg(last.alias("__f"))
        before = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
        carry = per_slot.select(
            *keys,
            SLOT,
            F.last("__f", ignorenulls=True).over(before).alias("__f"),
            F.lit(-1).alias("__side"),
        )
        rows = rows.unionByName(carry, allowMissingColumns=True)

    along = (
        Window.partitionBy(*keys, SLOT)
        .orderBy(F.col("__at").asc_nulls_first(), "__side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = rows.withColumn("__seen", F.last("__f", ignorenulls=True).over(along)).where(F.col("__side") == 1)
    fresh = F.col("__at").isNotNull()
    if ttl is not None:
        micros = ttl // timedelta(microseconds=1)
        fresh = fresh & (F.unix_micros("__at") - F.unix_micros("__seen.at") <= F.lit(micros))
    visible = F.when(fresh, F.col("__seen"))
    extra = [] if feature_ts_as is None else [F.col("__v.at").alias(feature_ts_as)]
    return seen.withColumn("__v", visible).select(
        *[F.col("__label").getField(c).alias(c) for c in labels.columns],
        *[F.col("__v.row").getField(c).alias(c) for c in columns],
        *extra,
    )


def asof_join_by_instant(
    labels: DataFrame,
    features: DataFrame,
    keys: Sequence[str],
    label_ts: str,
    feature_ts: str,
    columns: Sequence[str],
    **how,
) -> DataFrame:
    """:func:`asof_join` where many labels share a key and an instant, as after a bulk load.

    All labels of a key and instant see the same feature row, which is looked up once for each; labels that share one
    are then joined with it. That join has one row per key and instant on its other side, so adaptive execution can cut
    a hot instant into as many tasks as it takes.
    """
    instants = labels.select(*keys, label_ts).distinct()
    found = asof_join(instants, features, keys, label_ts, feature_ts, columns, **how)
    extra = [c for c in found.columns if c not in (*keys, label_ts)]
    renamed = found.select(*[F.col(c).alias(f"__i_{c}") for c in (*keys, label_ts)], *extra)
    # Written first, so that the join is one of plain tables, which is what can be cut.
    path = shared_dir(labels.sparkSession, "instants")
    renamed.write.parquet(path)
    known = labels.sparkSession.read.schema(renamed.schema).parquet(path)
    same = [F.col(c).eqNullSafe(F.col(f"__i_{c}")) for c in (*keys, label_ts)]
    return labels.join(known, same, "left").select(*labels.columns, *extra)


def latest(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str] = (),
) -> DataFrame:
    """The last row of each key by time, ties by the ``tie`` columns.

    An aggregate rather than a window: each task keeps one row per key before
    the shuffle, whatever the size of a key.
    """
    others = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(ts), *[F.col(c) for c in tie])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*others), order).alias("__last"))
        .select(*keys, *[F.col("__last").getField(c).alias(c) for c in others])
        .select(*df.columns)
    )


def lookup(
    requests: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    now: Column | None = None,
    expires: str = "expires_at",
) -> DataFrame:
    """Request rows with the columns of a table that holds one row per key.

    Unknown keys and rows expired at ``now`` give nulls. The expiry filter runs
    before the join. Join strategy and skew are left to adaptive execution.
    """
    live = table if now is None else table.where(F.col(expires).isNull() | (F.col(expires) > now))
    return requests.join(live.select(*keys, *columns), list(keys), "left")
