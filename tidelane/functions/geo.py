"""Distances and travel-time estimates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of the earth's radius; walking detour and speed; flexible-service detour, speed and boarding time.
EARTH_M = 6_371_000.0
WALK_DETOUR, WALK_M_PER_S = 1.3, 4800.0 / 3600.0
FLEX_DETOUR, FLEX_M_PER_S, FLEX_BOARD_S = 1.4, 22000.0 / 3600.0, 300.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; null where a coordinate is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def walk_seconds(metres: Column) -> Column:
    return metres * WALK_DETOUR / F.lit(WALK_M_PER_S)


def flex_seconds(metres: Column) -> Column:
    return metres * FLEX_DETOUR / F.lit(FLEX_M_PER_S) + FLEX_BOARD_S
