"""Distances on the globe as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lodestar.common import col

EARTH_KM = 6371.0


def haversine(lat1: str | Column, lng1: str | Column, lat2: str | Column, lng2: str | Column) -> Column:
    """Kilometres between two points; null if a coordinate is."""
    a1, a2 = F.radians(col(lat1)), F.radians(col(lat2))
    d_lat, d_lng = a2 - a1, F.radians(col(lng2)) - F.radians(col(lng1))
    h = F.sin(d_lat / 2) * F.sin(d_lat / 2) + F.cos(a1) * F.cos(a2) * F.sin(d_lng / 2) * F.sin(d_lng / 2)
    h = F.when(h.isNotNull(), F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0)))
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def format_distance(km: str | Column) -> Column:
    """"850 m" below one kilometre, "3.4 km" below ten, else whole kilometres."""
    c = col(km)
    metres = F.concat(F.floor(c * 1000 + 0.5).cast("string"), F.lit(" m"))
    tenths = F.format_string("%.1f km", c)
    whole = F.concat(F.floor(c + 0.5).cast("string"), F.lit(" km"))
    return F.when(c < 1, metres).when(c < 10, tenths).when(c.isNotNull(), whole)


def coarsen(c: str | Column, digits: int = 3) -> Column:
    return F.round(col(c), digits)
