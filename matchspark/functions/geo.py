"""Distances and coordinate formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchspark import vocab

EARTH_RADIUS_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres between points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((b - a) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    chord = half_lat * half_lat + F.cos(a) * F.cos(b) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def well_formed(c: Column) -> Column:
    """A plain decimal coordinate; false for null, nan and anything else."""
    return F.coalesce(c.cast("string").rlike(vocab.COORD_PATTERN), F.lit(False))


def valid_latitude(c: Column) -> Column:
    return F.when(c.cast("string").rlike(vocab.LATITUDE_PATTERN), c.cast("string").try_cast("double"))


def valid_longitude(c: Column) -> Column:
    return F.when(c.cast("string").rlike(vocab.LONGITUDE_PATTERN), c.cast("string").try_cast("double"))


def is_number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)
