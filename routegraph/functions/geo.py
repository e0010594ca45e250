"""Great-circle distance as a native Column expression (stays inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in kilometres used by the haversine distance.
EARTH_RADIUS_KM = 6371.0


def _c(x: Column | str | float | None) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(None if x is None else float(x)).cast("double")


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Haversine distance in km between two (latitude, longitude) points in degrees.

    NULL in any input gives NULL. The inner term is clamped to 1.0 because rounding
    can push it a hair above 1, where ``asin`` returns NaN.
    """
    phi1, lam1, phi2, lam2 = (F.radians(_c(v)) for v in (lat1, lon1, lat2, lon2))
    half_dphi = F.sin((phi2 - phi1) / 2)
    half_dlam = F.sin((lam2 - lam1) / 2)
    h = F.pow(half_dphi, 2) + F.cos(phi1) * F.cos(phi2) * F.pow(half_dlam, 2)
    clamped = F.when(h > 1.0, F.lit(1.0)).otherwise(h)  # NULL stays NULL (least() would skip it)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(clamped))

