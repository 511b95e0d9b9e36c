"""Daily weather to climatologies, seasonal tables and seasonal residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.calendar import HARMONICS, date_span, harmonics, seasonal_day
from ..functions.nulls import clamp, strict, strict_mean
from ..operators.aggregates import mean_by
from ..operators.joins import keep_matching, natural_join
from ..operators.projection import shared_names
from ..sources.schemas import ENV_VARIABLES, SITE_KEYS
from ..stats.linear import FittedModels, fit_linear, predict, terms_product

# Seasonal responses: column -> short name of its residual.
RESPONSES = {
    "avg_t2m": "temp",
    "GDD5": "gdd5",
    "tot_tp": "prec",
    "tot_evavt": "et",
    "avg_sde": "snow",
    "avg_swvl1": "soil",
}
# Responses that cannot be negative, so that predictions below zero count as zero.
NON_NEGATIVE = ("tot_tp", "tot_evavt", "avg_sde", "avg_swvl1")
# Fixed values of the analysis: lowest temperature and highest snow residual kept.
MIN_TEMP_RESIDUAL, MAX_SNOW_RESIDUAL = -13.5, 0.95
SEASON_TERMS = terms_product("lat", HARMONICS)


def clean_predictors(env: DataFrame) -> DataFrame:
    """Days with snow data, growing degree days not below 0, day of year."""
    return env.filter(F.col("avg_sde").isNotNull()).withColumns(
        {"GDD5": clamp(F.col("GDD5"), low=0.0), "jdate": F.dayofyear("date")}
    )


def climatology(predictors: DataFrame, variables: Sequence[str] = ENV_VARIABLES) -> DataFrame:
    """Strict means per site and day of year, and the mean snow depth of the site's year.

    The window runs over aggregated rows: 366 per site position at most.
    """
    daily = mean_by(predictors, [*SITE_KEYS, "jdate"], shared_names(list(variables), predictors.columns))
    return daily.withColumn("site_sde", strict_mean(F.col("avg_sde"), W.partitionBy("SITE")))


def seasonal_means(env: DataFrame, samples: DataFrame) -> DataFrame:
    """Mean climate of the sampled sites on the shifted 365-day clock."""
    sampled = keep_matching(env, samples.select("SITE").distinct(), ["SITE"], [])
    daily = mean_by(
        sampled.withColumn("jdate", F.dayofyear("date")).filter(F.col("jdate") != 366),
        [*SITE_KEYS, "jdate"],
        list(RESPONSES),
        strict=False,
    )
    return daily.withColumn("jdate", seasonal_day(F.col("jdate"), F.col("SITE_LATITUDE")))


def with_season(means: DataFrame) -> DataFrame:
    """Latitude and harmonics, which follow from the site and the day."""
    return means.withColumns({"lat": F.abs(F.col("SITE_LATITUDE") / 100), **harmonics(F.col("jdate"))})


def seasonal_climate(env: DataFrame, samples: DataFrame) -> DataFrame:
    """Mean climate of the sampled sites on the shifted 365-day clock, with harmonics."""
    return with_season(seasonal_means(env, samples))


def fit_seasonal(seasonal: DataFrame) -> FittedModels:
    """Six least-squares fits on latitude x season from one pass over the rows."""
    return fit_linear(seasonal, list(RESPONSES), SEASON_TERMS)


def seasonal_residuals(seasonal: DataFrame, models: FittedModels) -> DataFrame:
    """Residuals of the seasonal fits; predictions below zero count as zero where values cannot be negative."""
    predicted = predict(seasonal, models, "{}_pred")
    out = []
    for column, short in RESPONSES.items():
        fit = F.col(f"{column}_pred")
        residual = F.col(column) - fit
        if column in NON_NEGATIVE:
            residual = capped_residual(residual, fit)
        out.append(residual.alias(f"{short}_res"))
    return predicted.select(*SITE_KEYS, "jdate", *out)


def capped_residual(residual, prediction):
    """Residual against a prediction that is cut at zero."""
    return F.when(prediction < 0, residual + prediction).otherwise(residual)


def sampled_days(samples: DataFrame) -> DataFrame:
    """Site and shifted day of every day of a sample that caught something."""
    days = samples.filter(F.col("DB_sample") != 0).select(
        "SITE",
        "SITE_LATITUDE",
        F.explode(date_span(F.col("START_DATE"), F.col("COLL_DATE"), "both")).alias("sampleday"),
    )
    shifted = seasonal_day(F.dayofyear("sampleday"), F.col("SITE_LATITUDE"))
    return days.select("SITE", shifted.alias("jdate")).distinct()


def residual_cutoffs(residuals: DataFrame, samples: DataFrame) -> DataFrame:
    """Extreme residuals on sampled days: the values behind the fixed cut-offs; null when any residual is null."""
    return natural_join(residuals, sampled_days(samples), "inner", ["SITE", "jdate"], []).agg(
        strict(F.min, F.col("temp_res")).alias("min_temp"), strict(F.max, F.col("snow_res")).alias("max_snow")
    )


def limit_residuals(
    residuals: DataFrame, min_temp: float = MIN_TEMP_RESIDUAL, max_snow: float = MAX_SNOW_RESIDUAL
) -> DataFrame:
    return residuals.withColumns(
        {"temp_res": clamp(F.col("temp_res"), low=min_temp), "snow_res": clamp(F.col("snow_res"), high=max_snow)}
    )


def climate_residuals(env: DataFrame, samples: DataFrame) -> DataFrame:
    """Seasonal table, fit, residuals and cut-offs in one call."""
    seasonal = seasonal_climate(env, samples)
    return limit_residuals(seasonal_residuals(seasonal, fit_seasonal(seasonal)))
