"""Event records: construction, routing and JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EVENT_VERSION, TOPICS
from .calendar import iso_format
from .ids import random_id


def route_of(event_type: Column) -> Column:
    """The family of an event, from the prefix of its type; null when unknown."""
    route = F.lit(None).cast("string")
    for name in TOPICS:
        route = F.when(event_type.startswith(name), F.lit(name)).otherwise(route)
    return route


def topic_of(event_type: Column) -> Column:
    topic = F.lit(None).cast("string")
    for name, target in TOPICS.items():
        topic = F.when(event_type.startswith(name), F.lit(target)).otherwise(topic)
    return topic


def event_struct(
    event_type: Column,
    ts: Column,
    fields: Mapping[str, Column],
    event_id: Column | None = None,
) -> Column:
    """An event record: the common fields followed by the event's own."""
    base = [
        (random_id() if event_id is None else event_id.cast("string")).alias("event_id"),
        event_type.alias("event_type"),
        iso_format(ts).alias("timestamp"),
        F.lit(EVENT_VERSION).alias("version"),
    ]
    return F.struct(*base, *[value.alias(name) for name, value in fields.items()])


def to_event_json(record: Column) -> Column:
    return F.to_json(record)
