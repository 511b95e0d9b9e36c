"""Planar site tables, natural/urban pairs, and the spatial analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import mercator_x, mercator_y
from ..operators.joins import equi_join
from ..operators.reshape import split_column, stack_rows, to_wide
from ..operators.windows import filter_group_size
from ..sources.io import materialise
from ..stats.design import Term, term_name
from ..stats.linear import regression_test
from ..stats.mixed import SelectionLog
from ..stats.moran import morans_i_test
from ..stats.pairs import paired_test
from ..stats.smooth import Smooth, SmoothFit, SmoothSource, forward_selection_smooth

# Fixed values of the analysis.
NEIGHBOUR_RADIUS_M, PERMUTATIONS = 10000.0, 999
SMOOTHS = [Smooth("X", "Y", "in_nord", 15, "matern"), Smooth("X", "Y", "in_mad", 28, "thinplate")]
MORAN_GROUPS = [("country", "NORD"), ("country", "MAD"), ("cluster", "NORD_hier"), ("cluster", "MAD_hier")]
PAIR_LEVELS = ["Natural", "Urban"]
CLIMATE_TERMS: dict[str, list[Term]] = {
    "avg_t2m": [("avg_t2m_siteclim",)],
    "nl_avg_t2m": [("avg_t2m_siteclim", "avg_t2m_siteclim")],
    "tot_tp": [("tot_tp_siteclim",)],
    "nl_tot_tp": [("tot_tp_siteclim", "tot_tp_siteclim")],
    "tot_evavt": [("tot_evavt_siteclim",)],
    "avg_sde": [("avg_sde_siteclim",)],
    "avg_swvl1": [("avg_swvl1_siteclim",)],
    "nl_avg_swvl1": [("avg_swvl1_siteclim", "avg_swvl1_siteclim")],
    "elevation": [("elevation",)],
    "latitude": [("lat",)],
}
HUMAN_TERMS: dict[str, list[Term]] = {"hfi": [("HFI",)], "hfilat": [("lat",), ("HFI",), ("lat", "HFI")]}


def planar_sites(sites: DataFrame) -> DataFrame:
    """Mercator coordinates and 0/1 columns for the two nested clusters."""
    return sites.withColumns(
        {
            "X": mercator_x(F.col("SITE_LONGITUDE")),
            "Y": mercator_y(F.col("SITE_LATITUDE")),
            "in_nord": (F.col("cluster") == "NORD_hier").cast("double"),
            "in_mad": (F.col("cluster") == "MAD_hier").cast("double"),
        }
    )


def pair_table(sites: DataFrame, peaks: DataFrame) -> DataFrame:
    """Natural and urban values side by side for complete site pairs."""
    both = equi_join(
        sites.select("SITE", F.col("logDB_site").alias("log_DB_site")), peaks.select("SITE", "log_DB_peak"), ["SITE"], "left", []
    )
    named = split_column(both, "SITE", ["SITEPAIR", "NATURB"]).filter(F.col("NATURB").isNotNull())
    pairs = filter_group_size(named, ["SITEPAIR"], low=2, high=2)
    return to_wide(pairs, ["SITEPAIR"], "NATURB", PAIR_LEVELS, {"site": "log_DB_site", "peak": "log_DB_peak"})


def latitude_regressions(subsets: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Mean and peak biomass on latitude, for the site table and peak table of every data set."""
    fits = [
        regression_test(table.select(response, "lat"), response, "lat").select(F.lit(name).alias("dataset"), F.lit(response).alias("response"), "*")
        for name, tables in subsets.items()
        for table, response in zip(tables, ("logDB_site", "log_DB_peak"), strict=True)
    ]
    return stack_rows(*fits)


def pair_tests(pairs: DataFrame) -> DataFrame:
    """Paired tests of natural against urban sites, for mean and peak biomass."""
    return stack_rows(*[paired_test(pairs, f"{v}_Natural", f"{v}_Urban").select(F.lit(v).alias("value"), "*") for v in ("site", "peak")])


@dataclass
class SpatialAnalysis:
    """``reml``: refit of the climate model; ``human_reml``: refit with the footprint terms kept."""

    latitude: DataFrame
    climate: SelectionLog
    human: SelectionLog
    reml: SmoothFit
    human_reml: SmoothFit
    moran: DataFrame

    def refits(self, spark, name: str) -> DataFrame:
        """Linear terms and summary of both refits: (response, model, term, estimate, aic, edf, adjusted_r2, n)."""
        rows = [
            (name, model, term_name(t), float(b), float(fit.aic), float(fit.edf), float(fit.adjusted_r2), int(fit.n))
            for model, fit in (("climate", self.reml), ("human", self.human_reml))
            for t, b in zip(fit.terms, fit.beta, strict=False)
        ]
        return spark.createDataFrame(rows, "response string, model string, term string, estimate double, aic double, edf double, adjusted_r2 double, n long")

    def log(self, spark, name: str) -> DataFrame:
        frames = [log.frame(spark, response=name, round=label) for label, log in (("climate", self.climate), ("human", self.human))]
        return frames[0].unionByName(frames[1].filter(F.col("step") > 0))


def moran_by_group(residuals: DataFrame, value: str, nsim: int = PERMUTATIONS, seed: int = 1) -> DataFrame:
    """Permutation tests for the two countries and the two clusters in one job.

    A site counts once for its country and once for its cluster.
    """
    labels = {(c, v): f"{c}:{v}" for c, v in MORAN_GROUPS}
    marks = F.array(*[F.when(F.col(c) == v, F.lit(label)) for (c, v), label in labels.items()])
    grouped = residuals.select("SITE", "X", "Y", value, F.explode(F.array_compact(marks)).alias("site_group"))
    return morans_i_test(grouped, "SITE", value, "X", "Y", NEIGHBOUR_RADIUS_M, ["site_group"], nsim, seed)


def spatial_analysis(sites: DataFrame, response: str, nsim: int = PERMUTATIONS, seed: int = 1) -> SpatialAnalysis:
    """Latitude regression, climate and footprint selection on a spatial basis, residual autocorrelation."""
    terms: list[Term] = [(), *[t for group in (CLIMATE_TERMS, HUMAN_TERMS) for ts in group.values() for t in ts]]
    used = sorted({c for t in terms for c in t} | {"X", "Y", "in_nord", "in_mad", "country", "cluster", response, "SITE"})
    table = materialise(sites.select(*used).filter(F.col(response).isNotNull()))
    source = SmoothSource(table, response, terms, SMOOTHS)
    by_climate = forward_selection_smooth(source, source.fit([()]), CLIMATE_TERMS)
    reml = source.fit(by_climate.model.terms, "REML")
    by_human = forward_selection_smooth(source, by_climate.model, HUMAN_TERMS)
    human_reml = source.fit(by_human.model.terms, "REML")
    moran = moran_by_group(reml.residuals(table).filter(F.col("residual").isNotNull()), "residual", nsim, seed)
    return SpatialAnalysis(regression_test(table, response, "lat"), by_climate, by_human, reml, human_reml, moran)
