"""Climate zones of sites, site pairs that disagree, and zone prediction grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import harmonics
from ..functions.text import first_match, split_part
from ..operators.joins import contains_any, expand_days, grid_lookup, natural_join
from ..operators.windows import filter_group_size

# Climate class pattern -> zone, first match wins.
ZONE_RULES = [
    ("A.", "Tropical-Subtropical"),
    ("B.h", "Tropical-Subtropical"),
    ("B.k", "Temperate"),
    ("C[fw]a", "Tropical-Subtropical"),
    ("C..", "Temperate"),
    ("[DE]..?", "Polar-Continental"),
]


def climate_zones(samples: DataFrame, grid: DataFrame) -> DataFrame:
    """Zone of every sampled site from a grid of climate classes; null where the grid is silent."""
    sites = samples.select(
        F.col("SITE").alias("Site"), F.col("SITE_LONGITUDE").alias("Longitude"), F.col("SITE_LATITUDE").alias("Latitude")
    ).distinct()
    looked_up = grid_lookup(sites, grid, "Latitude", "Longitude", "climate_class")
    return looked_up.select(
        "Site", "Longitude", "Latitude", first_match(F.col("climate_class"), ZONE_RULES).alias("CZ")
    )


def mismatched_pairs(zones: DataFrame) -> DataFrame:
    """Names of site pairs with more than one zone (a null zone counts as one)."""
    pairs = zones.select(split_part(F.col("Site"), 1).alias("sitepair"), "CZ").distinct()
    return filter_group_size(pairs, ["sitepair"], low=2).select("sitepair").distinct()


def zone_mismatch(zones: DataFrame) -> DataFrame:
    """Sites whose name contains the name of a mismatched pair."""
    return contains_any(zones, "Site", mismatched_pairs(zones), "sitepair")


def zone_latitudes(samples: DataFrame, zones: DataFrame) -> DataFrame:
    """Mean absolute latitude per zone, weighted by samples."""
    named = zones.withColumnRenamed("Site", "SITE")
    return (
        natural_join(samples, named, "left", ["SITE"], [])
        .groupBy("CZ")
        .agg(F.avg(F.abs("SITE_LATITUDE") / 100).alias("lat"))
    )


def zone_grid(latitudes: DataFrame) -> DataFrame:
    """365 days per zone with its latitude and the harmonics."""
    days = expand_days(latitudes.select("CZ", "lat"))
    return days.withColumns(harmonics(F.col("jdate")))
