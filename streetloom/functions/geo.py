"""Distances, bounds and grid cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EARTH_RADIUS_M, EAST, GRID_STEP, METRES_PER_DEGREE, NORTH, SOUTH, WEST


def in_bounds(lat: Column, lng: Column) -> Column:
    """Inside the service area, edges included."""
    return lat.between(SOUTH, NORTH) & lng.between(WEST, EAST)


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a, b = F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.sin((F.radians(lng2) - F.radians(lng1)) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (b * b)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # null stays null


def haversine_rounded(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Whole metres; comparisons of the search operators use these."""
    return F.rint(haversine_m(lat1, lng1, lat2, lng2)).cast("long")


def search_box(lat: float, lng: float, radius_m: float) -> tuple[float, float, float, float]:
    """West, south, east, north around a place, clamped to the service area."""
    from math import cos, radians

    dy = radius_m / METRES_PER_DEGREE
    dx = radius_m / (METRES_PER_DEGREE * cos(radians(lat)))
    return max(WEST, lng - dx), max(SOUTH, lat - dy), min(EAST, lng + dx), min(NORTH, lat + dy)


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def steps(low: float, high: float, step: float = GRID_STEP) -> int:
    """How many steps start below ``high`` when ``step`` is added up in floating point."""
    n, at = 0, low
    while at < high:
        n, at = n + 1, at + step
    return n


def edge(low: float, i: Column, step: float = GRID_STEP) -> Column:
    """The i-th edge, added up step by step as a running sum would be."""
    return F.when(i <= 0, F.lit(low)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), F.lit(low), lambda acc, _: acc + F.lit(step))
    )


def grid_cell(lat: Column, lng: Column, base: int = 1) -> Column:
    """Name of the cell by floor arithmetic; null outside the service area."""
    columns = int((EAST - WEST) / GRID_STEP) + 1
    row, col = F.floor((lat - SOUTH) / GRID_STEP), F.floor((lng - WEST) / GRID_STEP)
    return F.when(in_bounds(lat, lng), F.concat(F.lit("grid-"), (row * columns + col + base).cast("string")))
