"""Ordered per-key computations that stay balanced when one key holds much of the data.

A window over ``partitionBy(key).orderBy(time)`` puts a whole key into one task.
Here a *hot* key's time line is cut into slots, each slot is a group of its own,
and what earlier slots contribute is handed to a slot as one extra *carry* row
that sorts before its rows. Other keys have a single slot. The results do not
depend on which keys are hot or on how their time lines are cut.

A key is hot when it has more rows than one task should put in order, ``HOT_ROWS``,
whatever the size of the table. Slots are cut at approximate quantiles of a hot
key's own times, as many as its rows need, so they hold similar numbers of rows
however its activity is spread. The table of hot keys is broadcast while it has
no more than ``SMALL_KEYS`` rows; beyond that it is joined like any other table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import edges_below
from ..session import shared_dir

HOT_ROWS = 1_000_000
SMALL_KEYS = 10_000

SLOT = "__slot"
CARRY_ORDER = -1


@dataclass(frozen=True)
class HotKeys:
    """Hot keys with the last position on their time line and the edges of their slots.

    ``table`` is None when no key is hot.
    """

    table: DataFrame | None = None
    rows: int = 0
    cuts: int = 0

    def __bool__(self) -> bool:
        return self.table is not None


def _same_key(keys: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys]


def _written(df: DataFrame) -> DataFrame:
    """The table written below the shared folder and read again, which cuts its lineage."""
    path = shared_dir(df.sparkSession, "keys")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def find_hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    axis: Column,
    shifts: Sequence[int] = (0,),
    floor: int = HOT_ROWS,
    share: float | None = None,
) -> HotKeys:
    """Keys with more than ``floor`` rows, and slots of about that many for each.

    ``axis`` is the integer position of a row on its key's time line. ``shifts``
    are the distances from it at which the row is going to be placed. ``share``
    raises the limit to that share of all rows. A table without hot keys costs a
    count per key, and only the rows of hot keys are read a second time.
    """
    rows = df.select(*keys, axis.alias("__axis"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), F.max("__axis").alias("__to"))
    limit = floor if share is None else max(floor, int(share * (counts.agg(F.sum("__rows")).first()[0] or 0)))
    hot = counts.where(F.col("__rows") > limit)
    # A key's slots are rounded up to a power of two, so that keys of all sizes need few kinds of quantiles.
    bits = F.ceil(F.log2(F.ceil(F.col("__rows") * len(shifts) / limit))).cast("int")
    hot = hot.withColumn("__bits", F.greatest(bits, F.lit(1)))
    spark = df.sparkSession
    found = hot.limit(SMALL_KEYS + 1).collect()
    if not found:
        return HotKeys()
    small = len(found) <= SMALL_KEYS
    if small:
        held, number, kinds = spark.createDataFrame(found, hot.schema), len(found), sorted({r["__bits"] for r in found})
    else:
        held = _written(hot)
        number, kinds = held.count(), sorted(r[0] for r in held.select("__bits").distinct().collect())
    renamed = held.select(*[F.col(k).alias(f"__h_{k}") for k in keys], "__to", "__bits")
    places = F.array(*[(F.col("__axis") + F.lit(s)).cast("bigint") for s in shifts])
    # One kind for each power of two of slots: a few tens at most.
    cuts = [
        F.approx_percentile(F.when(F.col("__bits") == b, F.col("__at")), [i / (1 << b) for i in range(1, 1 << b)], 10 << b)
        for b in kinds
    ]
    edges = (
        rows.join(F.broadcast(renamed) if small else renamed, _same_key(keys, "__h_"))
        .select(*keys, "__to", "__bits", F.explode(places).alias("__at"))
        .where(F.col("__at") <= F.col("__to"))
        .groupBy(*keys, "__to")
        .agg(F.coalesce(*cuts).alias("__edges"))
        .withColumn("__edges", F.array_sort(F.array_distinct("__edges")))
    )
    table = spark.createDataFrame(edges.collect(), edges.schema) if small else _written(edges)
    return HotKeys(table, number, 1 << max(kinds))


def with_slots(
    df: DataFrame, keys: Sequence[str], axis: Column, hot: HotKeys, unseen: Column | None = None
) -> DataFrame:
    """Add the slot of each row; the one slot of a key that is not hot is null.

    Rows marked ``unseen`` matter only to rows after them: those placed behind
    the end of a hot key's time line are dropped.
    """
    if not hot:
        return df.withColumn(SLOT, F.lit(None).cast("bigint"))
    small = hot.table.select(*[F.col(k).alias(f"__h_{k}") for k in keys], "__to", "__edges")
    slot = F.when(F.col("__edges").isNotNull(), edges_below(F.col("__edges"), axis, hot.cuts).cast("bigint"))
    joined = df.join(F.broadcast(small) if hot.rows <= SMALL_KEYS else small, _same_key(keys, "__h_"), "left")
    if unseen is not None:
        joined = joined.where(~F.coalesce(unseen & (axis > F.col("__to")), F.lit(False)))
    return joined.withColumn(SLOT, slot).drop(*small.columns)


def running_totals(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    hot: bool,
    slot: str = SLOT,
    combine: Callable[[str], Column] = F.sum,
    before: bool = False,
) -> DataFrame:
    """Add running sums along each key's order; rows of equal order share a sum.

    ``rows`` carry their slot. Null terms count as nothing and an empty sum is
    null. Slots must increase along the order. ``combine`` may be another
    aggregate that combines its own results, such as ``F.min``. With ``before``
    a row's own term and those after it are left out; then the order must be total.
    """
    terms = {f"__term_{name}": term for name, term in totals.items()}
    rows = rows.withColumns(terms)
    if not hot:
        along = Window.partitionBy(*keys).orderBy(*order)
        along = along.rowsBetween(Window.unboundedPreceding, -1) if before else along
        return rows.withColumns({name: combine(f"__term_{name}").over(along) for name in totals}).drop(*terms)

    per_slot = (
        rows.where(F.col(slot).isNotNull()).groupBy(*keys, slot).agg(*[combine(name).alias(name) for name in terms])
    )
    # One row per slot of a hot key: small whatever the size of the key.
    earlier = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_slot.select(
        *keys,
        slot,
        *[combine(name).over(earlier).cast(rows.schema[name].dataType).alias(name) for name in terms],
        F.lit(CARRY_ORDER).alias("__carry"),
    )
    rows = rows.withColumn("__carry", F.lit(0)).unionByName(carry, allowMissingColumns=True)
    along = Window.partitionBy(*keys, slot).orderBy("__carry", *order)
    along = along.rowsBetween(Window.unboundedPreceding, -1) if before else along
    return (
        rows.withColumns({name: combine(f"__term_{name}").over(along) for name in totals})
        .where(F.col("__carry") == 0)
        .drop("__carry", *terms)
    )


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str],
    name: str = "row_number",
    hot: HotKeys | None = None,
) -> DataFrame:
    """Number the rows of each key from 1 in time order, ties by the ``tie`` columns."""
    axis = F.unix_micros(F.col(ts).cast("timestamp"))
    if hot is None:
        hot = find_hot_keys(df, keys, axis)
    slotted = with_slots(df, keys, axis, hot)
    order = [F.col(ts).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in tie]]
    return running_totals(slotted, keys, order, {name: F.lit(1).cast("bigint")}, bool(hot)).drop(SLOT)


def row_numbers_in_ranges(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str],
    name: str = "row_number",
    slot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Like :func:`row_numbers`, where one key may have more rows at one instant than a task should order.

    All rows are put in ranges of key, time and ``tie`` together, about ``slot_rows`` to a range, so that the rows of an
    instant, say of a bulk load, are cut between ties. The ranges are written, as they would else be drawn anew by each
    use; each is a slot, and hands its count on.
    """
    spark = df.sparkSession
    order = [F.col(c).asc_nulls_first() for c in (*keys, ts, *tie)]
    slots = max(1, -(-df.count() // slot_rows))
    ranged = df.repartitionByRange(slots, *order).withColumn(SLOT, F.spark_partition_id().cast("bigint"))
    path = shared_dir(spark, "ranges")
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    along = [F.col(ts).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in tie]]
    return running_totals(rows, keys, along, {name: F.lit(1).cast("bigint")}, True).drop(SLOT)


def next_in_time(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str],
    name: str = "next_ts",
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add the time of the same key's following row; null on the last one."""
    axis = F.unix_micros(F.col(ts).cast("timestamp"))
    if hot is None:
        hot = find_hot_keys(df, keys, axis)
    rows = with_slots(df, keys, axis, hot).withColumns({"__at": F.col(ts), "__carry": F.lit(0)})
    if hot:
        firsts = rows.where(F.col(SLOT).isNotNull()).groupBy(*keys, SLOT).agg(F.min("__at").alias("__at"))
        following = F.lead("__at").over(Window.partitionBy(*keys).orderBy(SLOT))
        carry = firsts.select(*keys, SLOT, following.alias("__at"), F.lit(1).alias("__carry"))
        rows = rows.unionByName(carry, allowMissingColumns=True)
    along = Window.partitionBy(*keys, SLOT).orderBy("__carry", "__at", *tie)
    result = rows.withColumn(name, F.lead("__at").over(along))
    return result.where(F.col("__carry") == 0).drop("__at", "__carry", SLOT)
