"""Distances on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lat: Column, lon: Column, to_lat: float, to_lon: float) -> Column:
    """Kilometres to a point, by the haversine formula."""
    d_lat, d_lon = F.radians(F.lit(to_lat) - lat), F.radians(F.lit(to_lon) - lon)
    a = F.sin(d_lat / 2) * F.sin(d_lat / 2) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(to_lat))) * F.sin(d_lon / 2) * F.sin(d_lon / 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def within(point: Column, lat: float, lon: float, km: float) -> Column:
    """Whether a struct of latitude and longitude is at most ``km`` away.

    A box of plain bounds comes first: the scan can test it, and most points fail it.
    """
    y, x = point["latitude"], point["longitude"]
    if km < 0:
        return F.lit(False)
    reach = math.degrees(km / EARTH_KM) * (1 + 1e-9) + 1e-9
    box = (y >= lat - reach) & (y <= lat + reach)
    if reach < 90 and abs(lat) + reach < 90:  # no pole inside
        side = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(lat))))) + 1e-9
        if lon - side >= -180 and lon + side <= 180:
            box = box & (x >= lon - side) & (x <= lon + side)
    return box & (haversine(y, x, lat, lon) <= km)
