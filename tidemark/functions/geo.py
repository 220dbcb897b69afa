"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Kilometres between two points in degrees; null if a coordinate is null.

    The chord term is held at 1 so that rounding cannot push antipodes out of
    the domain of the square root.
    """
    half_lat = F.radians(lat2 - lat1) / 2
    half_lng = F.radians(lng2 - lng1) / 2
    chord = F.pow(F.sin(half_lat), 2) + (
        F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lng), 2)
    )
    # least() skips nulls, so the null of a missing coordinate is kept by hand.
    chord = F.when(chord.isNotNull(), F.least(chord, F.lit(1.0)))
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))
