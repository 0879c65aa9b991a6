"""Great-circle distance, point in polygon and grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius in metres; distance at which closeness reaches zero.
EARTH_RADIUS_M = 6_371_000.0
NEAR_M = 2_000.0

METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180.0


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / F.lit(2.0))
    half_lng = F.sin(F.radians(lng2 - lng1) / F.lit(2.0))
    chord = half_lat * half_lat + half_lng * half_lng * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    half_angle = F.sqrt(chord)
    # a comparison, not ``least``: that would turn a missing coordinate into a distance
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.when(half_angle > 1, F.lit(1.0)).otherwise(half_angle))


def closeness(distance_m: Column, reach_m: float = NEAR_M) -> Column:
    near = F.lit(1.0) - distance_m / F.lit(reach_m)
    return F.when(near < 0, F.lit(0.0)).otherwise(near)


def in_polygon(lng: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring of ``struct(lng, lat)``.

    Each vertex is paired with its predecessor (the last one closes the ring);
    the point is inside when an odd number of edges lies to its right.
    """
    previous = F.concat(F.slice(ring, F.size(ring), 1), F.slice(ring, 1, F.size(ring) - 1))

    def crosses(tail: Column, head: Column) -> Column:
        slope_x = (tail["lng"] - head["lng"]) * (lat - head["lat"])
        rise = tail["lat"] - head["lat"] + F.lit(2.220446049250313e-16)
        return ((head["lat"] > lat) != (tail["lat"] > lat)) & (lng < slope_x / rise + head["lng"])

    crossings = F.size(
        F.filter(
            F.zip_with(previous, ring, lambda tail, head: crosses(tail, head)),
            lambda hit: F.coalesce(hit, F.lit(False)),
        )
    )
    return F.when(F.size(ring) < 3, F.lit(False)).otherwise(crossings % 2 == 1)


def cell(degrees: Column, size_deg: float) -> Column:
    return F.floor(degrees / F.lit(size_deg))
