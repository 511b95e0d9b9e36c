"""Modelling tables at sample and site level, hierarchical-site subsets, the seasonal analysis."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import HARMONICS, harmonics, seasonal_day, whole_day, year_text
from ..functions.draws import draw_key, unit_draw
from ..functions.nulls import ratio, safe_log
from ..functions.text import first_match, remove_first
from ..operators.aggregates import log_ratio_of_sums, mean_by, standardise
from ..operators.joins import equi_join, natural_join, never_sent
from ..operators.reshape import stack_rows
from ..operators.sampling import sample_per_stratum
from ..operators.windows import filter_group_size
from ..sources.io import materialise
from ..sources.schemas import ENV_VARIABLES, SITE_KEYS
from ..stats.design import Term, times
from ..stats.mixed import MixedFit, SelectionLog, StatsSource, forward_selection

# Fixed values of the analysis.
MIN_DAYS, DRAW_LOW = 3, 0.01
HIERARCHICAL = ["madagascar_hierarchical", "Nordic Hierarchical"]
MIN_HIERARCHICAL_SAMPLES = 100
RESIDUALS = ["temp_res", "gdd5_res", "prec_res", "et_res", "snow_res", "soil_res"]
COUNTRY_RULES = [("madagascar", "MAD"), ("Nordic", "NORD")]
CLUSTER_NAMES = {"madagascar_hierarchical": "MAD_hier", "Nordic Hierarchical": "NORD_hier"}
PAIR_SUFFIX = "_[A-Za-z]+$"

RESPONSE, GROUP, YEAR = "logDB_post_sample", "SITE", "year"
NULL_TERMS: list[Term] = [()]
M1_TERMS: list[Term] = [(), ("cos1",), ("sin1",), ("lat", "cos1"), ("lat", "sin1")]
M2_TERMS: list[Term] = [(), *[(h,) for h in HARMONICS], *times("lat", HARMONICS)]


def _seasonal(base: Term) -> list[Term]:
    return times(base, HARMONICS)


def climate_candidates() -> dict[str, list[Term]]:
    """Candidate terms in their fixed order: main effect, season, square, square x season, latitude x season."""
    out: dict[str, list[Term]] = {}
    for short, square in (("temp", True), ("prec", True), ("et", False), ("snow", False), ("soil", True)):
        x = f"{short}_res"
        out[short], out[f"{short}_season"] = [(x,)], _seasonal((x,))
        if square:
            out[f"{short}_nl"], out[f"{short}_nl_season"] = [(x, x)], _seasonal((x, x))
        out[f"{short}_latseason"] = _seasonal((x, "lat"))
    out["elevation"], out["elevation_season"] = [("elevation",)], _seasonal(("elevation",))
    out["elevation_latseason"] = _seasonal(("elevation", "lat"))
    return out


def weather_candidates() -> dict[str, list[Term]]:
    out: dict[str, list[Term]] = {}
    for v in ("avg_t2m", "tot_tp", "tot_evavt", "avg_sde", "avg_swvl1"):
        out[f"{v}_anom"], out[f"{v}_season"] = [(f"{v}_anom",)], _seasonal((f"{v}_anom",))
    return out


def human_candidates() -> dict[str, list[Term]]:
    return {"hfi": [("HFI",)], "hfi_season": _seasonal(("HFI",)), "hfi_latseason": _seasonal(("HFI", "lat"))}


def biomass_rates(scaled: DataFrame, biomass: DataFrame, seed: int = 1) -> DataFrame:
    """Samples of three days and more with predicted biomass; zeros become small uniform draws.

    A draw lies between 0.01 and the smallest predicted biomass and depends
    only on the seed and the sample code.
    """
    least = biomass.agg(F.min("BIOMASS_PostMean")).scalar()
    drawn = F.lit(DRAW_LOW) + (F.col("__least") - DRAW_LOW) * unit_draw(draw_key(seed, F.col("SAMPLE_CODE")))
    return (
        natural_join(scaled, biomass, "left", ["SAMPLE_CODE"], [])
        .filter(F.col("n_days") >= MIN_DAYS)
        .withColumn("__least", least)
        .withColumn("BIOMASS_low_included", F.when(F.col("DB_sample") == 0, drawn).otherwise(F.col("BIOMASS_PostMean")))
        .drop("__least")
        .withColumn("DB_post_sample", ratio(F.col("BIOMASS_low_included"), F.col("n_days")))
    )


def model_samples(rates: DataFrame, residuals: DataFrame) -> DataFrame:
    """Sample-level modelling table: log rate, year, shifted day, standardised residuals, harmonics.

    Rates dealt by site meet residuals that are made where their site lies, and no day moves.
    """
    day = whole_day(seasonal_day(F.col("jdate").cast("double"), F.col("SITE_LATITUDE")))
    base = rates.withColumns(
        {
            RESPONSE: safe_log(F.col("DB_post_sample")),
            YEAR: year_text(F.col("COLL_DATE")),
            "lat": F.abs(F.col("SITE_LATITUDE") / 100),
            "jdate": day,
        }
    )
    days = residuals.withColumn("jdate", F.col("jdate").cast("double"))
    joined = equi_join(base, never_sent(days), [*SITE_KEYS, "jdate"], "left", [])
    return standardise(joined.withColumns(harmonics(F.col("jdate"))), RESIDUALS)


def site_climate(climate: DataFrame) -> DataFrame:
    """Standardised annual mean climate per site."""
    means = materialise(mean_by(climate, SITE_KEYS, ENV_VARIABLES))  # read for the scale, then for the rows
    return standardise(means, ENV_VARIABLES).withColumnsRenamed({v: f"{v}_siteclim" for v in ENV_VARIABLES})


def cluster_label() -> Column:
    site_type = F.col("SITE_TYPE")
    other = first_match(site_type, COUNTRY_RULES, remove_first(F.col("SITE"), PAIR_SUFFIX))
    first, second = CLUSTER_NAMES.items()
    return F.when(site_type == first[0], first[1]).when(site_type == second[0], second[1]).otherwise(other)


def site_table(rates: DataFrame, siteclim: DataFrame) -> DataFrame:
    """Site-level modelling table: log mean daily biomass, climate, country and cluster."""
    sums = rates.withColumn("lat", F.abs(F.col("SITE_LATITUDE") / 100)).groupBy(
        "SITE", "SITE_TYPE", "HFI", "HII", "elevation", "lat"
    )
    logs = sums.agg(log_ratio_of_sums(F.col("BIOMASS_low_included"), F.col("n_days")).alias("logDB_site"))
    country = first_match(F.col("SITE_TYPE"), COUNTRY_RULES, remove_first(F.col("SITE"), PAIR_SUFFIX))
    return equi_join(logs, siteclim, ["SITE"], "left", []).withColumns({"country": country, "cluster": cluster_label()})


def kept_hierarchical(samples: DataFrame, min_samples: int = MIN_HIERARCHICAL_SAMPLES, seed: int = 1) -> DataFrame:
    """One random well-sampled site per hierarchical type: at most two rows."""
    nested = samples.filter(F.col("SITE_TYPE").isin(HIERARCHICAL)).select("SITE", "SITE_TYPE")
    busy = filter_group_size(nested, ["SITE"], low=min_samples + 1).distinct()
    return sample_per_stratum(busy, ["SITE_TYPE"], ["SITE"], seed)


def drop_hierarchical(df: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ordinary sites and of the kept hierarchical sites."""
    marks = kept.select("SITE", F.lit(True).alias("__kept"))
    ordinary = ~F.col("SITE_TYPE").isin(HIERARCHICAL)
    return equi_join(df, marks, ["SITE"], "left", []).filter(ordinary | F.col("__kept")).drop("__kept")


@dataclass
class SeasonalAnalysis:
    """Models and selection logs of one data set."""

    null: MixedFit
    m1: MixedFit
    m2: MixedFit
    climate: SelectionLog
    weather: SelectionLog
    human: SelectionLog
    reml: MixedFit

    def log(self, spark, name: str) -> DataFrame:
        parts = {"climate": self.climate, "weather": self.weather, "human": self.human}
        frames = [log.frame(spark, dataset=name, round=label) for label, log in parts.items()]
        base = [
            (name, "season", i, label, True, float(fit.aic), float(fit.r2_marginal), float(fit.r2_conditional))
            for i, (label, fit) in enumerate((("null", self.null), ("m1", self.m1), ("m2", self.m2)))
        ]
        out = spark.createDataFrame(base, frames[0].schema)
        for frame in frames:
            out = out.unionByName(frame)
        return out


def final_models(spark: SparkSession, analyses: dict[str, SeasonalAnalysis]) -> DataFrame:
    """Coefficients of the REML refits: (dataset, response, term, estimate, se)."""
    frames = [a.reml.coefficients(spark).select(F.lit(name).alias("dataset"), "*") for name, a in analyses.items()]
    return stack_rows(*frames)


def unselected(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Candidates of a selection log that were not kept, per group of ``by``."""
    names = [*by, "cand"]
    return log.select(*names).subtract(log.filter("kept").select(*names))


def compare_selections(log: DataFrame, left: str, right: str) -> DataFrame:
    """Whether two data sets kept the same terms in the same order, per round: (round, n_left, n_right, same).

    Rounds in which neither kept a term are the same.
    """
    order = F.row_number().over(Window.partitionBy("dataset", "round").orderBy("step"))
    kept = log.filter("kept").withColumn("place", order)
    side = lambda name, alias: kept.filter(F.col("dataset") == name).select("round", "place", F.col("cand").alias(alias))
    both = side(left, "a").join(side(right, "b"), ["round", "place"], "full")
    rounds = log.filter(F.col("dataset").isin(left, right)).select("round").distinct()
    same = both.groupBy("round").agg(F.count("a").alias("n_left"), F.count("b").alias("n_right"), F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("same"))
    return rounds.join(same, "round", "left").na.fill({"n_left": 0, "n_right": 0}).withColumn("same", F.coalesce("same", F.lit(True)))


def seasonal_analysis(samples: DataFrame, na_policy: str = "per_model") -> SeasonalAnalysis:
    """Base models, then climate, weather and human-footprint selection, then the REML refit."""
    climate, weather, human = climate_candidates(), weather_candidates(), human_candidates()
    every = [*M2_TERMS, *[t for group in (climate, weather, human) for terms in group.values() for t in terms]]
    table = materialise(samples.select(RESPONSE, GROUP, YEAR, *sorted({c for t in every for c in t})))
    source = StatsSource(table, RESPONSE, every, GROUP, YEAR, na_policy)
    null, m1, m2 = source.fit(NULL_TERMS), source.fit(M1_TERMS), source.fit(M2_TERMS)
    by_climate = forward_selection(source, m2, climate)
    by_weather = forward_selection(source, by_climate.model, weather)
    by_human = forward_selection(source, by_weather.model, human)
    final = source.fit(by_human.model.terms, reml=True, start=by_human.model.theta)
    return SeasonalAnalysis(null, m1, m2, by_climate, by_weather, by_human, final)

