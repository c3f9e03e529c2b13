"""Distances on the sphere, and feed times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the earth in metres, walking speed in metres a second.
EARTH_RADIUS_M, WALKING_SPEED_MPS = 6_371_000.0, 1.3


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres of points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    half = lambda x: F.pow(F.sin(x / 2), 2)
    h = half(b - a) + F.cos(a) * F.cos(b) * half(F.radians(lon2) - F.radians(lon1))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def seconds_of_day(text: Column) -> Column:
    """``H+:MM:SS`` in seconds; hours may pass 24. Null where it isn't of this form."""
    fine = text.rlike(r"^\s*\d+:\d{1,2}:\d{1,2}\s*$")
    part = lambda k: F.split_part(F.trim(text), F.lit(":"), F.lit(k)).cast("double")
    return F.when(fine, part(1) * 3600 + part(2) * 60 + part(3))


def hourly_frequency(headway: Column) -> Column:
    """Vehicles an hour; null where the headway is zero or null."""
    return F.try_divide(F.lit(3600.0), headway)
