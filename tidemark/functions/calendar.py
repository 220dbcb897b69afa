"""Event time and calendar features. Times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The hours counted as peak, morning and evening.
PEAK_HOURS = (7, 8, 9, 17, 18, 19)


def event_time(text: Column) -> Column:
    """ISO-8601 text (with or without a zone) to a timestamp; unreadable text is null."""
    return F.try_to_timestamp(text)


def iso_format(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def day_of_week(ts: Column, sunday_first: bool = False) -> Column:
    """Monday = 0 .. Sunday = 6, or the other convention Sunday = 1 .. Saturday = 7."""
    return F.dayofweek(ts) if sunday_first else F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def is_peak_hour(ts: Column) -> Column:
    return F.hour(ts).isin(*PEAK_HOURS).cast("int")


def add_days(ts: Column, days: int | Column) -> Column:
    days = F.lit(days) if isinstance(days, int) else days
    return ts + F.make_dt_interval(days=days)


def calendar_columns(ts: Column) -> dict[str, Column]:
    """The calendar features shared by the batch and the streaming side."""
    return {
        "hour_of_day": F.hour(ts),
        "day_of_week": day_of_week(ts),
        "is_peak_hour": is_peak_hour(ts),
        "is_weekend": is_weekend(ts),
    }
