"""Map projection and grid-cell expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6378137.0


def mercator_x(longitude: Column) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.radians(longitude)


def mercator_y(latitude: Column) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(latitude) / 2))


def cell_centre(degrees: Column, size: float = 0.5) -> Column:
    """Centre of the grid cell that holds a coordinate."""
    return F.floor(degrees / F.lit(size)) * F.lit(size) + F.lit(size / 2)
