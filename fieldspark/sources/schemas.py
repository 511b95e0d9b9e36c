"""Fixed schemas of the analysis tables, as DDL strings."""

from __future__ import annotations

ENV_VARIABLES = ["avg_t2m", "GDD5", "tot_tp", "tot_evavt", "avg_sde", "avg_swvl1"]
SITE_KEYS = ["SITE", "SITE_LATITUDE", "SITE_LONGITUDE"]


ENV_DAILY = (
    "SITE string, SITE_LATITUDE double, SITE_LONGITUDE double, date date, "
    "avg_t2m double, GDD5 double, tot_tp double, tot_evavt double, avg_sde double, avg_swvl1 double"
)
SAMPLES = (
    "SAMPLE_CODE string, SITE string, SITE_TYPE string, SITE_LATITUDE double, SITE_LONGITUDE double, "
    "START_DATE date, COLL_DATE date, Weight double"
)
BIOMASS = ("SAMPLE_CODE string, BIOMASS_PostMean double")
ELEVATION = ("SITE string, altitude double")
COVARIATES = (
    "NAME string, TYPE string, TEAM string, TEAM_ID int, SITE_ID int, annual_mean_temperature double, "
    "diurnal_temperature_range double, temperature_seasonality double, annual_precipitation double, "
    "precipitation_seasonality double, KG_climate_classification int, human_footprint_index double, "
    "human_influence_index double, population_density double, night_light double, "
    "esa_worldcover_50 int, esa_worldcover_500 int, elevation int"
)
ZONE_GRID = ("lat double, lon double, climate_class string")
COEFFICIENTS = ("response string, term string, estimate double, se double")
