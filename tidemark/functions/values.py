"""Encoding, defaults, ratios and bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinal codes of the categorical model inputs, with the code of unknown values.
TRAFFIC_CODES = {"light": 0, "moderate": 1, "heavy": 2}
TRAFFIC_DEFAULT = 1
WEATHER_CODES = {"clear": 0, "rain": 1, "snow": 2, "fog": 3}
WEATHER_DEFAULT = 0
VEHICLE_CODES = {"sedan": 0, "suv": 1, "luxury": 2}
VEHICLE_DEFAULT = 0


def ordinal(value: Column, codes: Mapping[str, int], default: int) -> Column:
    """The code of a category; null and unknown categories get the default."""
    table = F.create_map(*[F.lit(item) for item in chain.from_iterable(codes.items())])
    return F.coalesce(F.try_element_at(table, value), F.lit(default))


def safe_ratio(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator).cast("double"), F.lit(default))


def or_default(value: Column, default: object) -> Column:
    return F.coalesce(value, F.lit(default))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def band(value: Column, steps: Sequence[tuple[float, str]], below: str, strict: bool = False) -> Column:
    """The label of the highest step reached, or ``below``; null stays null.

    ``strict`` asks for a value above the step rather than at or above it.
    """
    result = F.when(value.isNotNull(), F.lit(below))
    for limit, label in sorted(steps):
        reached = value > limit if strict else value >= limit
        result = F.when(reached, F.lit(label)).otherwise(result)
    return result


def edges_below(edges: Column, value: Column, longest: int) -> Column:
    """How many of the sorted ``edges``, ``longest`` at most, are below a value.

    A binary search: an array of hundreds of edges costs a few comparisons a row.
    """
    steps = [1 << bit for bit in reversed(range(longest.bit_length()))]

    def step(found: Column, width: Column) -> Column:
        below = F.coalesce(F.get(edges, found + width - 1) < value, F.lit(False))
        return F.when(below, found + width).otherwise(found)

    return F.aggregate(F.array(*[F.lit(w) for w in steps]), F.lit(0), step)
