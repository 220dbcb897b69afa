"""The rule for surge quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import is_peak_hour
from .ids import stable_bucket
from .values import band, clamp

# Fixed values of the rule.
BASE_FARE = 8.0
FARE_PER_KM = 2.5
PEAK_SURGE = 1.2
NORMAL_SURGE = 1.0
SURGE_RANGE = (1.0, 3.0)
JITTER_RANGE = (-0.1, 0.3)
DEFAULT_KM = 5.0
DEMAND_STEPS = [(1.2, "moderate"), (1.5, "high")]


def stable_jitter(key: Column, steps: int = 1000) -> Column:
    """A value in the jitter range that depends on the key alone."""
    low, high = JITTER_RANGE
    return stable_bucket(key, steps) / F.lit(float(steps)) * (high - low) + low


def random_jitter(seed: int) -> Column:
    low, high = JITTER_RANGE
    return F.rand(seed) * (high - low) + low


def surge_quote(ts: Column, distance_km: Column, jitter: Column) -> dict[str, Column]:
    """Multiplier, fare and demand band; multiplier and fare are rounded to cents."""
    base = F.when(is_peak_hour(ts) == 1, PEAK_SURGE).otherwise(NORMAL_SURGE)
    surge = clamp(base + jitter, *SURGE_RANGE)
    fare = BASE_FARE * surge + F.coalesce(distance_km, F.lit(DEFAULT_KM)) * FARE_PER_KM
    return {
        "surge_multiplier": F.round(surge, 2),
        "base_fare": F.lit(BASE_FARE),
        "estimated_fare": F.round(fare, 2),
        "demand_level": band(surge, DEMAND_STEPS, "normal", strict=True),
    }
