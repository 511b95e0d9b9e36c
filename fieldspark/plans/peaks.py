"""Predicted and observed three-week peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import cap_day, day_number_span, harmonics, wrap_day
from ..functions.nulls import ratio
from ..operators.aggregates import mean_of_log
from ..operators.joins import expand_days, keep_matching, natural_join
from ..operators.windows import rolling_mean_ahead, top_rows, window_sum_ahead
from ..stats.mixed import MixedFit, predict_with_groups

# Fixed values of the analysis.
PEAK_DAYS, MIN_ROWS, MARGIN_DAYS = 21, 19, 14
# Windows equal to this many digits are ties: the earlier one wins, whatever the order of summation.
TIE_DIGITS = 9


def prediction_grid(sites: DataFrame) -> DataFrame:
    """Every site on every day 1..365 with its latitude and the harmonics."""
    grid = expand_days(sites.select("SITE", "lat").distinct())
    return grid.withColumns(harmonics(F.col("jdate")))


def predicted_curves(sites: DataFrame, fit: MixedFit, effects: DataFrame, missing: str = "error") -> DataFrame:
    return predict_with_groups(prediction_grid(sites), fit, effects, missing).select("SITE", "jdate", "pred")


def peak_windows(curves: DataFrame) -> DataFrame:
    """Start and end of the 21 days with the highest mean prediction of each site (365 rows per site)."""
    rolled = rolling_mean_ahead(curves, ["SITE"], "jdate", "pred", PEAK_DAYS, "roll_mean")
    best = top_rows(rolled, ["SITE"], [F.desc_nulls_last(F.round("roll_mean", TIE_DIGITS)), F.asc("jdate")])
    return best.select(
        "SITE",
        F.col("jdate").cast("int").alias("start_day"),
        cap_day(F.col("jdate") + PEAK_DAYS - 1).cast("int").alias("end_day"),
        "roll_mean",
    )


def peak_days(peaks: DataFrame) -> DataFrame:
    """Site and day for the peak and two weeks around it, folded onto the 365-day circle."""
    days = F.sequence(F.col("start_day") - MARGIN_DAYS, F.col("end_day") + MARGIN_DAYS)
    return peaks.select("SITE", F.explode(days).alias("day")).select(
        "SITE", wrap_day(F.col("day")).cast("double").alias("jdate")
    )


def peak_sampled_years(samples: DataFrame, peaks: DataFrame) -> DataFrame:
    """Site-years with at least one sample near the predicted peak."""
    near = keep_matching(samples.select("SITE", "year", "jdate"), peak_days(peaks), ["SITE", "jdate"], [])
    return near.select("SITE", "year").distinct()


def sampled_day_rows(samples: DataFrame, site_years: DataFrame, wrap: bool = False) -> DataFrame:
    """One row per sample and exposed day of year, for the given site-years."""
    kept = keep_matching(samples, site_years, ["SITE", "year"], [])
    days = day_number_span(F.col("START_DATE"), F.col("COLL_DATE"), wrap)
    return kept.select("SITE", "year", "DB_post_sample", F.explode(days).alias("sampled_days"))


def observed_peaks(day_rows: DataFrame) -> DataFrame:
    """Best three-week window per site-year; a site-year without a full window keeps a null total."""
    totals = window_sum_ahead(day_rows, ["SITE", "year"], "sampled_days", "DB_post_sample", PEAK_DAYS, MIN_ROWS, "total_3wk")
    best = top_rows(totals, ["SITE", "year"], [F.desc_nulls_last(F.round("total_3wk", TIE_DIGITS)), F.asc("sampled_days")])
    return best.select(
        "SITE",
        "year",
        F.col("sampled_days").alias("start_day"),
        (F.col("sampled_days") + PEAK_DAYS - 1).alias("end_day"),
        "total_3wk",
    )


def site_peaks(sites: DataFrame, peaks: DataFrame) -> DataFrame:
    """Site table joined with the mean log daily biomass of its observed peaks."""
    logs = peaks.groupBy("SITE").agg(mean_of_log(ratio(F.col("total_3wk"), F.lit(PEAK_DAYS))).alias("log_DB_peak"))
    return natural_join(sites, logs, "inner", ["SITE"], [])
