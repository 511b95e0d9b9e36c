"""Field samples: cleaning, zero imputation, weather anomalies, enrichment, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.calendar import date_span, year_text
from ..functions.nulls import ratio, strict_mean, strict_median
from ..functions.text import paste
from ..operators.aggregates import standardise
from ..operators.joins import drop_matching_rows, enrich, keep_matching, natural_join, equi_join, never_sent, suffix_join
from ..operators.projection import across, shared_names, truncate_linked
from ..operators.reshape import stack_rows
from ..operators.windows import day_chunks, linked_cells
from ..sources.io import materialise
from ..sources.schemas import ENV_VARIABLES, SITE_KEYS

from .climate import clean_predictors

# Fixed values of the analysis.
EXCLUDED_SITE = "NEGreenland"
MIN_SAMPLES = 4
CHUNK_DAYS, MIN_CHUNK_DAYS = 7, 6
SNOW_LIMIT, TEMPERATURE_LIMIT = 0.1, 5.0
TEMPERATURE_CUTOFF = -7.0

PERIOD_KEYS = [
    "SAMPLE_CODE", "SAMPLE_WEIGHT", *SITE_KEYS, "SITE_TYPE", "DB_sample", "n_days", "START_DATE", "COLL_DATE", "site_sde",
]
# Order of the weather columns in the sample table.
WEATHER_ORDER = ["avg_t2m", "GDD5", "avg_sde", "avg_swvl1", "tot_evavt", "tot_tp"]
PERIOD_MEANS = [f"{v}_{kind}" for v in WEATHER_ORDER for kind in ("anom", "clim")]
SCALED = [*PERIOD_MEANS, "HFI", "HII", "elevation", "site_sde"]


def keep_usable(samples: DataFrame) -> DataFrame:
    """Drop the excluded site, samples alone in both their start and end year, and sparse sites."""
    dated = samples.filter(F.col("SITE") != EXCLUDED_SITE).withColumns(
        {"year_start": year_text(F.col("START_DATE")), "year_end": year_text(F.col("COLL_DATE"))}
    )
    cells = linked_cells(dated, ["SITE", "year_start"], ["SITE", "year_end"])
    # still a handful of cells per site: one per pair of start and end year
    per_site = cells.withColumn("__site", F.sum("n").over(W.partitionBy("SITE"))).filter(F.col("__site") >= MIN_SAMPLES)
    usable = per_site.select("SITE", "year_start", "year_end")
    return keep_matching(dated, usable, ["SITE", "year_start", "year_end"], []).drop("year_start", "year_end")


def sample_rates(samples: DataFrame) -> DataFrame:
    """Usable samples with their daily rate."""
    days = F.datediff("COLL_DATE", "START_DATE")
    return (
        keep_usable(samples)
        .withColumn("n_days", days)
        .withColumn("DB_sample", ratio(F.col("Weight"), F.col("n_days")))
        .withColumnRenamed("Weight", "SAMPLE_WEIGHT")
    )


def each_day(periods: DataFrame) -> DataFrame:
    """One row per exposed day [start, end - 1]."""
    return periods.withColumn("date", F.explode(date_span(F.col("START_DATE"), F.col("COLL_DATE"), "left")))


def clean_samples(samples: DataFrame) -> DataFrame:
    """Usable samples with their daily rate, one row per exposed day."""
    return each_day(sample_rates(samples))


def unsampled_chunks(predictors: DataFrame, sample_days: DataFrame) -> DataFrame:
    """Runs of unsampled days within the active years of a site, cut into weeks.

    The weather table has one row per site and day, so the ordered windows see
    no more rows per site than the calendar has days.
    """
    years = sample_days.select("SITE", year_text(F.col("COLL_DATE")).alias("year")).distinct()
    active = years.groupBy("SITE").agg(F.collect_list("year").alias("years"))
    types = sample_days.select("SITE", "SITE_TYPE").distinct()
    # both joins are by site alone, as the weather lies; only days of active years go on to the last one
    dated = natural_join(predictors.withColumn("year", year_text(F.col("date"))), active, "inner", ["SITE"], [])
    dated = dated.filter(F.array_contains("years", F.col("year"))).drop("years")
    typed = natural_join(dated, types, "left", ["SITE"], [])
    free = drop_matching_rows(typed, never_sent(sample_days), [*SITE_KEYS, "date", "SITE_TYPE"], ["SITE_TYPE"])
    return day_chunks(free, ["SITE"], "date", CHUNK_DAYS).withColumn(
        "SAMPLE_CODE", paste(F.col("SITE"), F.col("island"), F.col("chunk"))
    )


def zero_weeks(predictors: DataFrame, sample_days: DataFrame) -> DataFrame:
    """Cold, snowy, unsampled weeks as samples with a zero rate."""
    weeks = (
        unsampled_chunks(predictors, sample_days)
        .groupBy("SAMPLE_CODE", *SITE_KEYS, "SITE_TYPE")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("date").alias("START_DATE"),
            F.max("date").alias("COLL_DATE"),
            *across(["avg_t2m", "avg_sde"], strict_mean),
        )
    )
    cold = (
        (F.col("rows") >= MIN_CHUNK_DAYS)
        & (F.col("avg_sde") > SNOW_LIMIT)
        & (F.col("avg_t2m") < TEMPERATURE_LIMIT)
    )
    return (
        weeks.filter(cold)
        .drop("rows")
        .withColumns({"DB_sample": F.lit(0.0), "n_days": F.datediff("COLL_DATE", "START_DATE")})
    )


def impute_zero_weeks(predictors: DataFrame, sample_days: DataFrame) -> DataFrame:
    """The zero weeks, one row per day.

    A week ends on its last day, which is therefore not expanded (n_days 5 or 6).
    """
    return each_day(zero_weeks(predictors, sample_days))


def with_imputed(samples: DataFrame, imputed: DataFrame) -> DataFrame:
    """Samples and imputed ones, either as periods or as days."""
    return stack_rows(samples, imputed.select(*shared_names(samples, imputed)))


def weather_anomalies(sample_days: DataFrame, env: DataFrame, climate: DataFrame) -> DataFrame:
    """Mean anomaly and climatology over every sample period.

    Anomalies subtract the climatology (cleaned rows) from the *raw* daily weather.
    A period with days that the climatology lacks splits by ``site_sde``; means
    and the median day are those of each part.
    """
    dated = sample_days.withColumn("jdate", F.dayofyear("date"))
    # keys are null only in SAMPLE_WEIGHT and site_sde, which group but never join
    weather = equi_join(dated, never_sent(env.select(*SITE_KEYS, "date", *ENV_VARIABLES)), [*SITE_KEYS, "date"], "left", [])
    both = suffix_join(weather, never_sent(climate), [*SITE_KEYS, "jdate"], "_clim", nullable=[])
    both = both.withColumns({f"{v}_anom": F.col(v) - F.col(f"{v}_clim") for v in ENV_VARIABLES})
    return both.groupBy(*PERIOD_KEYS).agg(
        *across(PERIOD_MEANS, strict_mean), strict_median(F.col("jdate")).alias("jdate")
    )


def footprint(covariates: DataFrame) -> DataFrame:
    return covariates.select(
        F.col("NAME").alias("SITE"),
        F.col("human_footprint_index").alias("HFI"),
        F.col("human_influence_index").alias("HII"),
    )


def enrich_sites(periods: DataFrame, covariates: DataFrame, elevations: DataFrame) -> DataFrame:
    """Add footprint indices and elevation from the two site tables."""
    return enrich(periods, footprint(covariates), elevations.withColumnRenamed("altitude", "elevation"), nullable=[])


def truncate_temperature(samples: DataFrame) -> DataFrame:
    return truncate_linked(samples, "avg_t2m_clim", "avg_t2m_anom", TEMPERATURE_CUTOFF)


def describe_samples(truncated: DataFrame) -> DataFrame:
    """The sample table without the columns that only its sinks and the weather models read."""
    return truncated.drop(*PERIOD_MEANS, "site_sde", "SAMPLE_WEIGHT")


def scale_samples(truncated: DataFrame) -> DataFrame:
    """Z-scores of the numeric columns that the table has."""
    return standardise(truncated, shared_names(SCALED, truncated))


def compile_samples(
    samples: DataFrame, env: DataFrame, covariates: DataFrame, elevations: DataFrame, climate: DataFrame
) -> DataFrame:
    """Raw samples to the unscaled sample table (truncated temperatures).

    ``env`` and ``climate`` should be stored tables, as they are read several
    times; the sample days, needed four times, are stored here.
    """
    days = materialise(clean_samples(samples))
    stacked = with_imputed(days, impute_zero_weeks(clean_predictors(env), days))
    return truncate_temperature(enrich_sites(weather_anomalies(stacked, env, climate), covariates, elevations))
