"""Scalar Column functions."""

from routegraph.functions.geo import EARTH_RADIUS_KM, haversine_km

__all__ = ["EARTH_RADIUS_KM", "haversine_km"]
