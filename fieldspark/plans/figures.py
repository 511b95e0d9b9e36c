"""The data behind the figures (no drawing)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import seasonal_day
from ..functions.text import level_index
from ..operators.aggregates import mean_by
from ..operators.joins import natural_join, equi_join
from ..operators.projection import filter_multiple_of
from ..operators.reshape import to_long
from ..operators.sampling import sample_rows
from ..sources.schemas import ENV_VARIABLES, SITE_KEYS
from ..stats.linear import FittedModels, predict

CURVE_VARIABLES = [v for v in ENV_VARIABLES if v != "GDD5"]
COLD_BELOW = 5.0


def climate_curves(climate: DataFrame) -> DataFrame:
    """Climatologies on the shifted clock, long, with the variable's position among the ordered levels."""
    shifted = climate.withColumn("jdate", seasonal_day(F.col("jdate"), F.col("SITE_LATITUDE")))
    long = to_long(shifted, [*SITE_KEYS, "jdate", "site_sde"], CURVE_VARIABLES)
    return long.withColumn("var_level", level_index(F.col("var"), ENV_VARIABLES))


def snow_scatter(sample_days: DataFrame, biomass: DataFrame, predictors: DataFrame) -> DataFrame:
    """Mean weather per sample with its biomass and a flag for cold samples."""
    weighed = natural_join(sample_days, biomass, "left", ["SAMPLE_CODE"], [])
    weather = natural_join(weighed, predictors, "left", [*SITE_KEYS, "date"], [])
    means = mean_by(weather, ["SAMPLE_CODE", "SAMPLE_WEIGHT", "BIOMASS_PostMean"], ENV_VARIABLES)
    return means.withColumn("cold", F.col("avg_t2m") < COLD_BELOW)


def modelled_curves(zone_days: DataFrame, models: FittedModels) -> DataFrame:
    """Seasonal fits at every zone's latitude, long."""
    wide = predict(zone_days, models, "{}")
    return to_long(wide, ["CZ", "jdate", "lat"], CURVE_VARIABLES, "var", "val")


def observed_points(seasonal: DataFrame, zones: DataFrame, n: int = 20000, seed: int = 1) -> DataFrame:
    """A random part of the seasonal table with zones, long."""
    drawn = sample_rows(seasonal, ["SITE", "jdate"], n, seed)
    named = natural_join(drawn, zones.withColumnRenamed("Site", "SITE"), "left", ["SITE"])
    return to_long(named, ["SITE", "CZ", "jdate"], CURVE_VARIABLES, "var", "val")


def model_against_climate(zone_days: DataFrame, models: FittedModels, seasonal: DataFrame, zone: str, site: str) -> DataFrame:
    """One zone's modelled temperature next to every 25th day of one site's climatology."""
    fitted = predict(zone_days.filter(F.col("CZ") == zone), models, "{}")
    fitted = fitted.select(F.col("jdate").cast("int").alias("jdate"), F.col("avg_t2m").alias("predtemp"))
    measured = filter_multiple_of(seasonal.filter(F.col("SITE") == site), "jdate", 25)
    return equi_join(fitted, measured.select(F.col("jdate").cast("int").alias("jdate"), F.col("avg_t2m").alias("mestemp")), ["jdate"], "left")


def climate_against_year(seasonal: DataFrame, env: DataFrame, site: str, year: int) -> DataFrame:
    """Every 5th day of one site's climatology next to every 25th day of one year's weather."""
    measured = filter_multiple_of(seasonal.filter(F.col("SITE") == site), "jdate", 5)
    measured = measured.select(F.col("jdate").cast("int").alias("jdate"), F.col("avg_t2m").alias("mestemp"))
    daily = env.filter((F.col("SITE") == site) & (F.year("date") == year)).select(F.dayofyear("date").alias("jdate"), "avg_t2m")
    return equi_join(measured, filter_multiple_of(daily, "jdate", 25), ["jdate"], "left")
