"""Column expressions; all of them stay in the JVM."""

from .calendar import (
    add_days,
    calendar_columns,
    day_of_week,
    event_time,
    is_peak_hour,
    is_weekend,
    iso_format,
    micros,
)
from .events import event_struct, route_of, to_event_json, topic_of
from .geo import haversine_km
from .ids import features_hash, random_id, record_id, stable_bucket
from .values import band, clamp, ordinal, or_default, safe_ratio

__all__ = [
    "add_days",
    "band",
    "calendar_columns",
    "clamp",
    "day_of_week",
    "event_struct",
    "event_time",
    "features_hash",
    "haversine_km",
    "is_peak_hour",
    "is_weekend",
    "iso_format",
    "micros",
    "or_default",
    "ordinal",
    "random_id",
    "record_id",
    "route_of",
    "safe_ratio",
    "stable_bucket",
    "to_event_json",
    "topic_of",
]
