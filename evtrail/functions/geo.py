"""Great-circle distance as a built-in expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    def c(x):
        return F.col(x) if isinstance(x, str) else x
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    dphi = F.radians(c(lat2) - c(lat1))
    dlmb = F.radians(c(lon2) - c(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))
