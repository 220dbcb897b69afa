"""Trailing time-range aggregates per key: counts, sums, averages and ratios.

``count(*) OVER (... RANGE BETWEEN 7 DAYS PRECEDING AND CURRENT ROW)`` makes
Spark add up the whole frame again for every row, so its cost grows with the
square of a key's density. Here each row *enters* its windows at its own time
and *leaves* each of them one window length later, and one running sum over
entries and departures yields every window in a single ordered pass. Windows are
closed at both ends, and rows at one time count each other.

Values are summed exactly, so that what leaves a window cancels what entered it
and results do not depend on the order in which rows arrive: whole numbers as
such, decimals as such, and fractional values as two decimals, the whole part and
the fraction with ``FRACTION_DIGITS`` digits. A sum beyond 38 digits is an error,
not a wrong result. Infinite values count as missing, like NaN.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import safe_ratio
from .timeline import SLOT, HotKeys, find_hot_keys, running_totals, with_slots

FRACTION_DIGITS = 28


@dataclass(frozen=True)
class Trailing:
    """One output column: an aggregate of the rows in the window ending at a row.

    ``kind`` is ``count`` (of rows, or of rows where ``value`` is true), ``sum``
    or ``avg`` of ``value``, or ``ratio``: rows where ``value`` is true over rows
    where ``base`` is true, 0.0 if there are none.
    """

    name: str
    length: timedelta
    kind: str = "count"
    value: Column | None = None
    base: Column | None = None


def _micros(length: timedelta) -> int:
    return (length.days * 86400 + length.seconds) * 1_000_000 + length.microseconds


def _whole_parts(value: Column, data_type: T.DataType) -> list[Column]:
    """A value as exact numbers, and in the last place whether there is one."""
    if isinstance(data_type, (T.BooleanType, T.IntegralType)):
        return [value.cast("bigint"), _flag(value.isNotNull())]
    if isinstance(data_type, T.DecimalType):
        return [value, _flag(value.isNotNull())]
    number = value.cast("double")
    number = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    fraction = number % F.lit(1.0)
    return [
        (number - fraction).cast("decimal(38,0)"),
        fraction.cast(f"decimal({FRACTION_DIGITS},{FRACTION_DIGITS})"),
        _flag(number.isNotNull()),
    ]


def _flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("bigint"), F.lit(0).cast("bigint"))


def _parts(spec: Trailing, df: DataFrame) -> list[Column]:
    """The exact numbers that a row adds to the window."""
    one = F.lit(1).cast("bigint")
    if spec.kind == "count":
        return [one if spec.value is None else _flag(spec.value)]
    if spec.kind in ("sum", "avg"):
        return _whole_parts(spec.value, df.select(spec.value.alias("v")).schema["v"].dataType)
    if spec.kind == "ratio":
        return [_flag(spec.value), one if spec.base is None else _flag(spec.base)]
    raise ValueError(f"unknown kind of trailing aggregate: {spec.kind}")


def _result(spec: Trailing, totals: list[Column]) -> Column:
    if spec.kind == "count":
        return F.coalesce(totals[0], F.lit(0).cast("bigint"))
    if spec.kind == "ratio":
        return safe_ratio(*totals)
    whole, *fraction, present = totals
    total = whole.cast("double")
    if fraction:
        total = total + fraction[0].cast("double")
    if spec.kind == "avg":
        total = total / present
    return F.when(present > 0, total)


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    specs: Sequence[Trailing],
    extra: Sequence[str] = (),
    include_current: bool = True,
    day_count: str | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """One row per distinct (keys, ts, extra) with the trailing aggregates of ``specs``.

    ``include_current=False`` leaves the rows at the row's own time out.
    ``day_count`` names a further column: the rows of the same key and UTC day.
    """
    axis = F.unix_micros(F.col(ts).cast("timestamp"))
    lengths = sorted({_micros(s.length) for s in specs})
    if hot is None:
        hot = find_hot_keys(df, keys, axis, [0, *lengths])

    # Equal rows are folded before the shuffle, so repeats of one instant cost nothing.
    parts: dict[str, Column] = {}
    columns: dict[str, list[str]] = {}
    for spec in specs:
        names = []
        for number, term in enumerate(_parts(spec, df)):
            text = f"{number}:{term}"
            names.append(parts.setdefault(text, (f"__p{len(parts)}", term))[0])
        columns[spec.name] = names
    folded = (
        df.withColumns(dict(parts.values()))
        .groupBy(*keys, ts, *extra)
        .agg(
            F.count(F.lit(1)).alias("__rows"),
            *[F.sum(name).alias(name) for name, _ in parts.values()],
        )
    )

    enter, probe, leave = 0, 1, 2
    if include_current:
        # An entering row also reads the sums: it sees its peers.
        steps = [F.struct(F.lit(0).cast("bigint").alias("shift"), F.lit(enter).alias("step"))]
        reads = enter
    else:
        enter, probe = 1, 0
        steps = [F.struct(F.lit(0).cast("bigint").alias("shift"), F.lit(s).alias("step")) for s in (probe, enter)]
        reads = probe
    steps += [F.struct(F.lit(n).cast("bigint").alias("shift"), F.lit(leave).alias("step")) for n in lengths]
    moves = (
        folded.withColumn("__axis", axis)
        .withColumn("__move", F.explode(F.array(*steps)))
        .withColumns({"__at": F.col("__axis") + F.col("__move.shift"), "__step": F.col("__move.step"), "__shift": F.col("__move.shift")})
        .drop("__axis", "__move")
    )
    moves = with_slots(moves, keys, F.col("__at"), hot, unseen=F.col("__step") == leave)

    totals: dict[str, Column] = {}
    for spec in specs:
        length = _micros(spec.length)
        for name in columns[spec.name]:
            totals[f"__t{length}{name}"] = F.when(F.col("__step") == enter, F.col(name)).when(
                (F.col("__step") == leave) & (F.col("__shift") == length), -F.col(name)
            )
    summed = running_totals(moves, keys, [F.col("__at"), F.col("__step")], totals, bool(hot))
    rows = summed.where(F.col("__step") == reads)
    if day_count:
        rows = _with_day_count(rows, folded, keys, ts, day_count, hot)

    outputs = [
        _result(spec, [F.col(f"__t{_micros(spec.length)}{name}") for name in columns[spec.name]]).alias(spec.name)
        for spec in specs
    ]
    day = [F.col(day_count)] if day_count else []
    return rows.select(*keys, ts, *extra, *day, *outputs)


def _with_day_count(
    rows: DataFrame, folded: DataFrame, keys: Sequence[str], ts: str, name: str, hot: HotKeys
) -> DataFrame:
    """Add the number of rows of the same key and day.

    The window is finer than the running sums' partitioning and needs no further
    shuffle. A hot key's days span several slots, so those are counted apart, by
    an aggregate.
    """
    day = F.to_date(F.col(ts).cast("timestamp"))
    rows = rows.withColumn("__day", day)
    slot = [SLOT] if hot else []
    rows = rows.withColumn(name, F.sum("__rows").over(Window.partitionBy(*keys, *slot, "__day")))
    if not hot:
        return rows
    days = (
        with_slots(folded.withColumn("__day", day), keys, F.unix_micros(F.col(ts).cast("timestamp")), hot)
        .where(F.col(SLOT).isNotNull())
        .groupBy(*[F.col(k).alias(f"__d_{k}") for k in keys], F.col("__day").alias("__d_day"))
        .agg(F.sum("__rows").alias("__d_rows"))
    )
    same = [F.col(k).eqNullSafe(F.col(f"__d_{k}")) for k in keys]
    same.append(F.col("__day").eqNullSafe(F.col("__d_day")))
    return rows.join(days, same, "left").withColumn(name, F.coalesce("__d_rows", name))
