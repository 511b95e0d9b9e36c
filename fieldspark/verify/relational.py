"""Checked queries for sources, projections, joins, aggregates, windows, reshaping and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import draws, geo, nulls, text
from ..operators import aggregates as agg
from ..operators import joins as jn
from ..operators import projection as pr
from ..operators import reshape as rs
from ..operators import sampling, windows
from ..plans import models, samples, zones
from ..sources import io
from ..sources.schemas import ENV_VARIABLES, SITE_KEYS
from .oracle import ENV, PERIOD, SITE3, harmonics, means, seasonal, span, strict, unit
from .registry import query
from .stages import Stages

ENV_D = " ".join(f"{v}:d" for v in ENV)
SITE_SPEC = "SITE SITE_LATITUDE:d SITE_LONGITUDE:d"
COV_SPEC = "NAME human_footprint_index:d human_influence_index:d"

# --- sources and sinks -------------------------------------------------------


@query(
    "scan_filter_not_null",
    f"{SITE_SPEC} date:t avg_sde:d",
    f"SELECT {SITE3}, date, avg_sde FROM env_t WHERE avg_sde IS NOT NULL",
)
def _(s: Stages) -> DataFrame:
    return s.env.filter(F.col("avg_sde").isNotNull())


@query("csv_roundtrip", COV_SPEC, "SELECT SITE AS NAME, HFI AS human_footprint_index, HII AS human_influence_index FROM sites_t")
def _(s: Stages) -> DataFrame:
    path = io.shared_folder(s.spark)
    io.write_csv(s.covariates, path)
    return io.read_csv(s.spark, path, "NAME string, human_footprint_index double, human_influence_index double")


@query("parquet_roundtrip", f"{SITE_SPEC} date:t {ENV_D}", f"SELECT {SITE3}, date, {', '.join(ENV)} FROM env_t")
def _(s: Stages) -> DataFrame:
    path = io.shared_folder(s.spark)
    io.write_table(s.env, path)
    return io.read_table(s.spark, path)


# --- projection and filters --------------------------------------------------


@query("select_rename", "Site Longitude:d Latitude:d", "SELECT SITE AS Site, SITE_LONGITUDE AS Longitude, SITE_LATITUDE AS Latitude FROM samples_t")
def _(s: Stages) -> DataFrame:
    return pr.select_renamed(s.samples, Site="SITE", Longitude="SITE_LONGITUDE", Latitude="SITE_LATITUDE")


@query("select_by_pattern", f"{SITE_SPEC} SITE_TYPE START_DATE:t COLL_DATE:t", f"SELECT {SITE3}, SITE_TYPE, START_DATE, COLL_DATE FROM samples_t")
def _(s: Stages) -> DataFrame:
    return s.samples.select(*pr.names_matching(s.samples, prefix="SITE"), *pr.names_matching(s.samples, suffix="_DATE"))


@query("drop_by_prefix", "SAMPLE_CODE START_DATE:t COLL_DATE:t Weight:d", "SELECT SAMPLE_CODE, START_DATE, COLL_DATE, Weight FROM samples_t")
def _(s: Stages) -> DataFrame:
    return pr.drop_matching(s.samples, "SITE")


@query("select_intersection", SITE_SPEC, f"SELECT {SITE3} FROM samples_t")
def _(s: Stages) -> DataFrame:
    return s.samples.select(*[c for c in SITE_KEYS if c in pr.shared_names(s.samples, s.env)])


@query(
    "derived_columns",
    "SAMPLE_CODE n_days:i DB_sample:d lat:d",
    "SELECT SAMPLE_CODE, COLL_DATE - START_DATE AS n_days, Weight / (COLL_DATE - START_DATE) AS DB_sample, abs(SITE_LATITUDE / 100) AS lat FROM samples_t",
)
def _(s: Stages) -> DataFrame:
    dated = s.samples.withColumn("n_days", F.datediff("COLL_DATE", "START_DATE"))
    return dated.withColumns(
        {"DB_sample": nulls.ratio(F.col("Weight"), F.col("n_days")), "lat": F.abs(F.col("SITE_LATITUDE") / 100)}
    )


@query("across_mean", f"SITE {ENV_D}", f"SELECT SITE, {means(ENV, False)} FROM env_t GROUP BY SITE")
def _(s: Stages) -> DataFrame:
    return s.env.groupBy("SITE").agg(*pr.across(ENV_VARIABLES, F.avg))


@query("constant_columns", "SITE DB_sample:d year:i", "SELECT SITE, 0e0 AS DB_sample, 2023 AS year FROM sites_t")
def _(s: Stages) -> DataFrame:
    return s.sites.withColumns({"DB_sample": F.lit(0.0), "year": F.lit(2023)})


@query(
    "filter_compare",
    "SAMPLE_CODE SITE n_days:i",
    "SELECT SAMPLE_CODE, SITE, COLL_DATE - START_DATE AS n_days FROM samples_t WHERE SITE <> 'S0' AND COLL_DATE - START_DATE >= 3 AND Weight > 1",
)
def _(s: Stages) -> DataFrame:
    dated = s.samples.withColumn("n_days", F.datediff("COLL_DATE", "START_DATE"))
    return dated.filter((F.col("SITE") != "S0") & (F.col("n_days") >= 3) & (F.col("Weight") > 1))


@query(
    "filter_compound",
    "SAMPLE_CODE SITE SITE_TYPE",
    f"SELECT SAMPLE_CODE, SITE, SITE_TYPE FROM samples_t WHERE (SITE_TYPE <> 'madagascar_hierarchical' AND SITE_TYPE <> 'Nordic Hierarchical') OR SITE IN ('S0', 'S1')",
)
def _(s: Stages) -> DataFrame:
    plain = (F.col("SITE_TYPE") != models.HIERARCHICAL[0]) & (F.col("SITE_TYPE") != models.HIERARCHICAL[1])
    return s.samples.filter(plain | F.col("SITE").isin("S0", "S1"))


@query(
    "filter_membership",
    "SITE days:i",
    "SELECT SITE, count(*) AS days FROM env_t WHERE SITE IN (SELECT SITE FROM samples_t WHERE SITE_TYPE = 'Natural') GROUP BY SITE",
)
def _(s: Stages) -> DataFrame:
    natural = s.samples.filter(F.col("SITE_TYPE") == "Natural").select("SITE")
    return jn.keep_matching(s.env, natural, ["SITE"]).groupBy("SITE").agg(F.count(F.lit(1)).alias("days"))


@query("filter_modulo", "SITE jdate:i avg_t2m:d", "SELECT SITE, jdate, avg_t2m FROM clim_t WHERE jdate % 25 = 0")
def _(s: Stages) -> DataFrame:
    return pr.filter_multiple_of(s.climatology, "jdate", 25)


@query(
    "filter_regex_alternatives",
    "SITE SITE_TYPE",
    "SELECT s.SITE, s.SITE_TYPE FROM sites_t s WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT split_part(SITE, '_', 1) AS w FROM sites_t WHERE HFI IS NULL) v WHERE contains(s.SITE, v.w))",
)
def _(s: Stages) -> DataFrame:
    words = s.sites.filter(F.col("HFI").isNull()).select(text.split_part(F.col("SITE"), 1).alias("word")).distinct()
    return jn.contains_any(s.sites, "SITE", words, "word")


@query("distinct_values", "SITE_TYPE", "SELECT DISTINCT SITE_TYPE FROM samples_t")
def _(s: Stages) -> DataFrame:
    return agg.distinct_values(s.samples, "SITE_TYPE")


@query(
    "clamp",
    "SITE date:t GDD5:d avg_sde:d",
    "SELECT SITE, date, CASE WHEN GDD5 < 0 THEN 0 ELSE GDD5 END AS GDD5, CASE WHEN avg_sde > 0.1e0 THEN 0.1e0 ELSE avg_sde END AS avg_sde FROM env_t",
)
def _(s: Stages) -> DataFrame:
    return s.env.withColumns({"GDD5": nulls.clamp(F.col("GDD5"), low=0.0), "avg_sde": nulls.clamp(F.col("avg_sde"), high=0.1)})


@query(
    "linked_truncation",
    "SITE jdate:i avg_t2m:d anom:d",
    "SELECT SITE, jdate, CASE WHEN avg_t2m < -7 THEN -7 ELSE avg_t2m END AS avg_t2m, CASE WHEN avg_t2m < -7 THEN 0e0 ELSE GDD5 - avg_t2m END AS anom FROM clim_t",
)
def _(s: Stages) -> DataFrame:
    return pr.truncate_linked(s.climatology.withColumn("anom", F.col("GDD5") - F.col("avg_t2m")), "avg_t2m", "anom", -7.0)


@query(
    "case_label",
    "lat:d lon:d climate_class zone",
    "SELECT lat, lon, climate_class, CASE WHEN climate_class IN ('Af', 'BWh', 'Cfa') THEN 'Tropical-Subtropical' WHEN climate_class IN ('BSk', 'Csb') THEN 'Temperate' WHEN climate_class IN ('Dfb', 'ET') THEN 'Polar-Continental' END AS zone FROM zgrid",
)
def _(s: Stages) -> DataFrame:
    return s.zone_grid.withColumn("zone", text.first_match(F.col("climate_class"), zones.ZONE_RULES))


# --- joins -------------------------------------------------------------------


def _site_twins(s: Stages) -> tuple[DataFrame, DataFrame]:
    """Mean biomass per nullable footprint value, and the sites: the shared key is null for some."""
    left = s.sites.select("SITE", "HFI")
    right = s.sites.groupBy("HFI").agg(F.avg("elevation").alias("mean_elevation"), F.count(F.lit(1)).alias("n"))
    return left, right


TWIN = "(SELECT HFI, avg(elevation) AS mean_elevation, count(*) AS n FROM sites_t {} GROUP BY HFI)"


@query(
    "natural_left_join",
    "SITE HFI:d mean_elevation:d",
    f"SELECT l.SITE, l.HFI, r.mean_elevation FROM sites_t l LEFT JOIN {TWIN.format('')} r ON l.HFI IS NOT DISTINCT FROM r.HFI AND (r.n > 1)",
)
def _(s: Stages) -> DataFrame:
    left, right = _site_twins(s)
    return jn.natural_join(left, right.filter(F.col("n") > 1), "left", ["HFI"])


@query(
    "natural_inner_join",
    "SITE HFI:d mean_elevation:d",
    f"SELECT l.SITE, l.HFI, r.mean_elevation FROM sites_t l JOIN {TWIN.format('')} r ON l.HFI IS NOT DISTINCT FROM r.HFI AND (r.n > 1)",
)
def _(s: Stages) -> DataFrame:
    left, right = _site_twins(s)
    return jn.natural_join(left, right.filter(F.col("n") > 1), "inner", ["HFI"])


@query(
    "left_join_keys",
    "SAMPLE_CODE SITE avg_t2m:d",
    f"SELECT SAMPLE_CODE, SITE, avg_t2m FROM samples_t LEFT JOIN (SELECT {SITE3}, date AS START_DATE, avg_t2m FROM env_t) e USING ({SITE3}, START_DATE)",
)
def _(s: Stages) -> DataFrame:
    weather = s.env.select(*SITE_KEYS, F.col("date").alias("START_DATE"), "avg_t2m")
    return jn.equi_join(s.samples, weather, [*SITE_KEYS, "START_DATE"], "left")


@query(
    "left_join_suffix",
    "SITE date:t avg_t2m:d avg_t2m_clim:d avg_swvl1_clim:d",
    f"SELECT e.SITE, date, e.avg_t2m, c.avg_t2m AS avg_t2m_clim, c.avg_swvl1 AS avg_swvl1_clim FROM env_t e LEFT JOIN clim_t c ON e.SITE = c.SITE AND dayofyear(e.date) = c.jdate AND e.SITE_LATITUDE = c.SITE_LATITUDE AND e.SITE_LONGITUDE = c.SITE_LONGITUDE",
)
def _(s: Stages) -> DataFrame:
    dated = s.env.withColumn("jdate", F.dayofyear("date"))
    return jn.suffix_join(dated, jn.never_sent(s.climatology), [*SITE_KEYS, "jdate"], "_clim", nullable=SITE_KEYS, apart=True)


@query(
    "semi_join",
    "SITE year n:i",
    "SELECT SITE, year(date)::VARCHAR AS year, count(*) AS n FROM env_t WHERE (SITE, year(date)) IN (SELECT SITE, year(COLL_DATE) FROM samples_t) GROUP BY ALL",
)
def _(s: Stages) -> DataFrame:
    active = s.samples.select("SITE", cal.year_text(F.col("COLL_DATE")).alias("year")).distinct()
    dated = s.env.select("SITE", cal.year_text(F.col("date")).alias("year"))
    # counted first: the join then meets a few rows per site
    counted = dated.groupBy("SITE", "year").agg(F.count(F.lit(1)).alias("n"))
    return jn.keep_matching(counted, active, ["SITE", "year"])


@query(
    "anti_join",
    "SITE date:t",
    f"SELECT SITE, date FROM predictors_t p WHERE NOT EXISTS (SELECT 1 FROM dat_t d WHERE d.SITE = p.SITE AND d.SITE_LATITUDE = p.SITE_LATITUDE AND d.SITE_LONGITUDE = p.SITE_LONGITUDE AND d.date = p.date)",
)
def _(s: Stages) -> DataFrame:
    return jn.drop_matching_rows(s.predictors, s.sample_days, [*SITE_KEYS, "date"])


@query(
    "flag_join",
    "SITE year",
    "SELECT DISTINCT SITE, year(START_DATE)::VARCHAR AS year FROM samples_t WHERE dayofyear(START_DATE) BETWEEN 150 AND 170",
)
def _(s: Stages) -> DataFrame:
    flagged = s.sites.select("SITE", F.explode(F.sequence(F.lit(150), F.lit(170))).alias("jdate"))
    dated = s.samples.select("SITE", cal.year_text(F.col("START_DATE")).alias("year"), F.dayofyear("START_DATE").alias("jdate"))
    return jn.keep_matching(dated, flagged, ["SITE", "jdate"]).select("SITE", "year").distinct()


@query("cross_grid", "SITE jdate:i", "SELECT SITE, jdate FROM sites_t, range(1, 366) r(jdate)")
def _(s: Stages) -> DataFrame:
    return jn.expand_days(s.sites.select("SITE"))


@query(
    "day_join",
    "SITE jdate:i n:i tp:d",
    "SELECT d.SITE, dayofyear(d.date) AS jdate, count(*) AS n, avg(e.tot_tp) AS tp FROM dat_t d JOIN env_t e ON d.SITE = e.SITE AND d.date = e.date GROUP BY ALL",
)
def _(s: Stages) -> DataFrame:
    # sample days have a site and a date; both sides become days where their site is dealt
    joined = jn.equi_join(s.placed_days, jn.never_sent(s.env.select("SITE", "date", "tot_tp")), ["SITE", "date"], "inner", [])
    return joined.groupBy("SITE", F.dayofyear("date").alias("jdate")).agg(F.count(F.lit(1)).alias("n"), F.avg("tot_tp").alias("tp"))


@query(
    "distance_self_join",
    "i j",
    "SELECT a.SITE AS i, b.SITE AS j FROM (SELECT SITE, 6378137e0 * radians(SITE_LONGITUDE) AS X, 6378137e0 * ln(tan(pi() / 4 + radians(SITE_LATITUDE) / 2)) AS Y FROM sites_t) a JOIN (SELECT SITE, 6378137e0 * radians(SITE_LONGITUDE) AS X, 6378137e0 * ln(tan(pi() / 4 + radians(SITE_LATITUDE) / 2)) AS Y FROM sites_t) b ON a.SITE <> b.SITE AND (a.X - b.X) * (a.X - b.X) + (a.Y - b.Y) * (a.Y - b.Y) <= 1e8",
)
def _(s: Stages) -> DataFrame:
    plane = s.sites.select(
        "SITE", geo.mercator_x(F.col("SITE_LONGITUDE")).alias("X"), geo.mercator_y(F.col("SITE_LATITUDE")).alias("Y")
    )
    return jn.distance_band_pairs(plane, "SITE", "X", "Y", 10000.0)


@query(
    "grid_lookup",
    "SITE climate_class",
    "SELECT SITE, climate_class FROM sites_t LEFT JOIN zgrid g ON floor(SITE_LATITUDE / 0.5e0) * 0.5e0 + 0.25e0 = g.lat AND floor(SITE_LONGITUDE / 0.5e0) * 0.5e0 + 0.25e0 = g.lon",
)
def _(s: Stages) -> DataFrame:
    return jn.grid_lookup(s.sites, s.zone_grid, "SITE_LATITUDE", "SITE_LONGITUDE", "climate_class")


@query(
    "group_effect_lookup",
    "SAMPLE_CODE SITE effect:d",
    "SELECT SAMPLE_CODE, SITE, coalesce(effect, 0) AS effect FROM samples_t LEFT JOIN (SELECT SITE, max(Weight) AS effect FROM samples_t WHERE SITE_TYPE <> 'Urban' GROUP BY SITE) e USING (SITE)",
)
def _(s: Stages) -> DataFrame:
    effects = s.samples.filter(F.col("SITE_TYPE") != "Urban").groupBy("SITE").agg(F.max("Weight").alias("effect"))
    return jn.group_effect(s.samples, effects, "SITE", "effect", "zero")


@query(
    "dimension_enrich",
    "SAMPLE_CODE SITE HFI:d HII:d elevation:d",
    "SELECT SAMPLE_CODE, SITE, HFI, HII, elevation FROM samples_t LEFT JOIN (SELECT SITE, HFI, HII, elevation FROM sites_t) h USING (SITE)",
)
def _(s: Stages) -> DataFrame:
    return samples.enrich_sites(s.samples, s.covariates, s.elevations)


# --- aggregates --------------------------------------------------------------


@query("mean_strict", f"{SITE_SPEC} jdate:i {ENV_D}", f"SELECT {SITE3}, dayofyear(date) AS jdate, {means(ENV)} FROM env_t GROUP BY ALL")
def _(s: Stages) -> DataFrame:
    return agg.mean_by(s.env.withColumn("jdate", F.dayofyear("date")), [*SITE_KEYS, "jdate"], ENV_VARIABLES)


@query("mean_narm", f"{SITE_SPEC} jdate:i {ENV_D}", f"SELECT {SITE3}, dayofyear(date) AS jdate, {means(ENV, False)} FROM env_t GROUP BY ALL")
def _(s: Stages) -> DataFrame:
    return agg.mean_by(s.env.withColumn("jdate", F.dayofyear("date")), [*SITE_KEYS, "jdate"], ENV_VARIABLES, strict=False)


@query("mean_expr", "SITE_TYPE lat:d", "SELECT SITE_TYPE, avg(abs(SITE_LATITUDE) / 100) AS lat FROM samples_t GROUP BY SITE_TYPE")
def _(s: Stages) -> DataFrame:
    return s.samples.groupBy("SITE_TYPE").agg(F.avg(F.abs("SITE_LATITUDE") / 100).alias("lat"))


@query(
    "median_group",
    "SAMPLE_CODE jdate:d",
    f"SELECT SAMPLE_CODE, {strict('median', 'jdate')} AS jdate FROM (SELECT SAMPLE_CODE, dayofyear(date) AS jdate FROM dat_t) GROUP BY SAMPLE_CODE",
)
def _(s: Stages) -> DataFrame:
    days = s.sample_days.select("SAMPLE_CODE", F.dayofyear("date").alias("jdate"))
    return days.groupBy("SAMPLE_CODE").agg(nulls.strict_median(F.col("jdate")).alias("jdate"))


@query(
    "sample_period_means",
    "SAMPLE_CODE SAMPLE_WEIGHT:d SITE n_days:i site_sde:d jdate:d " + " ".join(f"{c}:d" for c in PERIOD),
    "SELECT * FROM periods_t",
)
def _(s: Stages) -> DataFrame:
    return s.periods


@query(
    "log_ratio_of_sums",
    "SITE HFI:d rate:d",
    "SELECT SITE, HFI, ln(sum(BIOMASS_PostMean) / sum(COLL_DATE - START_DATE)) AS rate FROM samples_t JOIN biomass_t USING (SAMPLE_CODE) JOIN (SELECT SITE, HFI FROM sites_t) h USING (SITE) GROUP BY SITE, HFI",
)
def _(s: Stages) -> DataFrame:
    rows = jn.enrich(s.samples, s.biomass, s.sites.select("SITE", "HFI"))
    return rows.groupBy("SITE", "HFI").agg(
        agg.log_ratio_of_sums(F.col("BIOMASS_PostMean"), F.datediff("COLL_DATE", "START_DATE")).alias("rate")
    )


@query("mean_log", "SITE mean_log:d", "SELECT SITE, avg(ln(Weight)) AS mean_log FROM samples_t GROUP BY SITE")
def _(s: Stages) -> DataFrame:
    return s.samples.groupBy("SITE").agg(agg.mean_of_log(F.col("Weight")).alias("mean_log"))


@query("global_extrema", "low:d high:d", "SELECT min(BIOMASS_PostMean) AS low, max(BIOMASS_PostMean) AS high FROM biomass_t")
def _(s: Stages) -> DataFrame:
    return agg.extrema(s.biomass, "BIOMASS_PostMean")


@query("distinct_pairs", "SITE year", "SELECT DISTINCT SITE, year(COLL_DATE)::VARCHAR AS year FROM samples_t")
def _(s: Stages) -> DataFrame:
    return s.samples.select("SITE", cal.year_text(F.col("COLL_DATE")).alias("year")).distinct()


@query(
    "column_stats",
    "variable mean:d sd:d n:i",
    " UNION ALL ".join(f"SELECT '{v}' AS variable, avg({v}) AS mean, stddev_samp({v}) AS sd, count({v}) AS n FROM env_t" for v in ENV),
)
def _(s: Stages) -> DataFrame:
    return agg.column_stats(s.env, ENV_VARIABLES)


@query(
    "correlation_matrix",
    "a b r:d",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM predictors_t" for i, a in enumerate(ENV) for b in ENV[i + 1 :]),
)
def _(s: Stages) -> DataFrame:
    return agg.correlations(s.predictors, ENV_VARIABLES)


@query(
    "histogram",
    "variable bin:i n:i",
    "SELECT variable, bin, count(*) AS n FROM ("
    + " UNION ALL ".join(
        f"SELECT '{v}' AS variable, least(floor(({v} - lo) * 30 / (hi - lo)), 29) AS bin FROM env_t, (SELECT min({v}) AS lo, max({v}) AS hi FROM env_t) WHERE {v} IS NOT NULL"
        for v in ENV
    )
    + ") GROUP BY variable, bin",
)
def _(s: Stages) -> DataFrame:
    return agg.histogram(s.env, ENV_VARIABLES, 30)


# --- windows -----------------------------------------------------------------


@query(
    "group_size_filter",
    "SAMPLE_CODE SITE",
    "SELECT SAMPLE_CODE, SITE FROM samples_t QUALIFY count(*) OVER (PARTITION BY SITE) > 3",
)
def _(s: Stages) -> DataFrame:
    return windows.filter_group_size(s.samples, ["SITE"], low=4)


@query("isolated_rows", "SAMPLE_CODE SITE", "SELECT SAMPLE_CODE, SITE FROM usable_t")
def _(s: Stages) -> DataFrame:
    dated = s.samples.withColumns({"a": cal.year_text(F.col("START_DATE")), "b": cal.year_text(F.col("COLL_DATE"))})
    return windows.drop_isolated(dated, ["SITE", "a"], ["SITE", "b"])


@query(
    "partition_mean",
    "SAMPLE_CODE SITE site_weight:d",
    "SELECT SAMPLE_CODE, SITE, avg(Weight) OVER (PARTITION BY SITE) AS site_weight FROM samples_t",
)
def _(s: Stages) -> DataFrame:
    return windows.with_group_mean(s.samples, ["SITE"], "Weight", "site_weight")


GAPS = "SELECT SITE, date, coalesce(date - lag(date) OVER (PARTITION BY SITE ORDER BY date), 0) AS gap FROM predictors_t"


@query("gap_days", "SITE date:t gap:i", GAPS)
def _(s: Stages) -> DataFrame:
    return windows.day_gaps(s.predictors, ["SITE"])


@query(
    "islands",
    "SITE date:t island:i",
    f"SELECT SITE, date, sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY SITE ORDER BY date) AS island FROM ({GAPS})",
)
def _(s: Stages) -> DataFrame:
    return windows.day_islands(s.predictors, ["SITE"])


@query("week_chunks", "SITE date:t island:i chunk:i SAMPLE_CODE", "SELECT SITE, date, island, chunk, SAMPLE_CODE FROM chunks_t")
def _(s: Stages) -> DataFrame:
    return samples.unsampled_chunks(s.predictors, s.stored_days)


@query("first_last", "SAMPLE_CODE SITE n:i first:t last:t", "SELECT SAMPLE_CODE, SITE, n, START_DATE AS first, COLL_DATE AS last FROM weeks_t")
def _(s: Stages) -> DataFrame:
    chunks = samples.unsampled_chunks(s.predictors, s.stored_days)
    return chunks.groupBy("SAMPLE_CODE", "SITE").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")
    )


@query("rolling_mean_21", "SITE jdate:i roll_mean:d", "SELECT SITE, jdate, roll_mean FROM rolled_t")
def _(s: Stages) -> DataFrame:
    return windows.rolling_mean_ahead(s.curves, ["SITE"], "jdate", "pred", 21, "roll_mean")


DAY_SUMS = (
    "SELECT SITE, year, day, CASE WHEN count(*) OVER w >= 19 THEN sum(DB_sample) OVER w END AS total FROM "
    "(SELECT SITE, year(date)::VARCHAR AS year, dayofyear(date) AS day, DB_sample FROM dat_t) "
    "WINDOW w AS (PARTITION BY SITE, year ORDER BY day RANGE BETWEEN CURRENT ROW AND 20 FOLLOWING)"
)


@query("range_sum_21", "SITE year day:i total:d", f"SELECT SITE, year, day, any_value(total) AS total FROM ({DAY_SUMS}) GROUP BY SITE, year, day")
def _(s: Stages) -> DataFrame:
    rows = s.sample_days.select("SITE", cal.year_text(F.col("date")).alias("year"), F.dayofyear("date").alias("day"), "DB_sample")
    return windows.window_sum_ahead(rows, ["SITE", "year"], "day", "DB_sample", 21, 19, "total")


@query(
    "top1_per_group",
    "SITE SAMPLE_CODE Weight:d",
    "SELECT SITE, SAMPLE_CODE, Weight FROM samples_t QUALIFY row_number() OVER (PARTITION BY SITE ORDER BY Weight DESC NULLS LAST, SAMPLE_CODE) = 1",
)
def _(s: Stages) -> DataFrame:
    return windows.top_rows(s.samples, ["SITE"], [F.desc_nulls_last("Weight"), F.asc("SAMPLE_CODE")])


@query(
    "zscore",
    "SAMPLE_CODE Weight:d",
    "SELECT SAMPLE_CODE, (Weight - avg(Weight) OVER ()) / stddev_samp(Weight) OVER () AS Weight FROM samples_t",
)
def _(s: Stages) -> DataFrame:
    return agg.standardise(s.samples, ["Weight"])


# --- sort, limit, sampling ---------------------------------------------------


@query("sorted_output", "SITE date:t DB_sample:d", "SELECT SITE, date, DB_sample FROM dat_t ORDER BY SITE, date, DB_sample")
def _(s: Stages) -> DataFrame:
    return s.sample_days.orderBy("SITE", "date", "DB_sample")


@query(
    "topk_per_group",
    "SITE SAMPLE_CODE Weight:d",
    "SELECT SITE, SAMPLE_CODE, Weight FROM samples_t QUALIFY row_number() OVER (PARTITION BY SITE ORDER BY Weight DESC NULLS LAST, SAMPLE_CODE) <= 5",
)
def _(s: Stages) -> DataFrame:
    return windows.top_rows(s.samples, ["SITE"], [F.desc_nulls_last("Weight"), F.asc("SAMPLE_CODE")], 5)


@query(
    "sample_n",
    "SITE jdate:i avg_t2m:d",
    "SELECT SITE, jdate, avg_t2m FROM clim_t ORDER BY md5('7:' || SITE || ':' || jdate), SITE, jdate LIMIT 20000",
)
def _(s: Stages) -> DataFrame:
    return sampling.sample_rows(s.climatology, ["SITE", "jdate"], 20000, 7)


@query(
    "sample_one_per_stratum",
    "SITE_TYPE SITE",
    "SELECT SITE_TYPE, SITE FROM sites_t QUALIFY row_number() OVER (PARTITION BY SITE_TYPE ORDER BY md5('1:' || SITE), SITE) = 1",
)
def _(s: Stages) -> DataFrame:
    return sampling.sample_per_stratum(s.sites, ["SITE_TYPE"], ["SITE"], 1)


# --- set operations ----------------------------------------------------------


@query(
    "union_by_name",
    "SAMPLE_CODE SITE SITE_TYPE SAMPLE_WEIGHT:d DB_sample:d n_days:i date:t",
    "SELECT SAMPLE_CODE, SITE, SITE_TYPE, SAMPLE_WEIGHT, DB_sample, n_days, date FROM stacked_t",
)
def _(s: Stages) -> DataFrame:
    return s.stacked


@query(
    "except_rows",
    "SITE year",
    "SELECT SITE, year(date)::VARCHAR AS year FROM env_t EXCEPT SELECT SITE, year(COLL_DATE)::VARCHAR FROM samples_t WHERE Weight > 40",
)
def _(s: Stages) -> DataFrame:
    every = s.env.select("SITE", cal.year_text(F.col("date")).alias("year"))
    heavy = s.samples.filter(F.col("Weight") > 40).select("SITE", cal.year_text(F.col("COLL_DATE")).alias("year"))
    return rs.difference(every, heavy)


@query(
    "intersect_rows",
    "SITE year",
    "SELECT SITE, year(date)::VARCHAR AS year FROM env_t INTERSECT SELECT SITE, year(COLL_DATE)::VARCHAR FROM samples_t WHERE Weight > 40",
)
def _(s: Stages) -> DataFrame:
    every = s.env.select("SITE", cal.year_text(F.col("date")).alias("year"))
    heavy = s.samples.filter(F.col("Weight") > 40).select("SITE", cal.year_text(F.col("COLL_DATE")).alias("year"))
    return rs.intersection(every, heavy)


def _ranked_variables(df: DataFrame) -> DataFrame:
    """Weather variables in order of their coefficient of variation: a list of six."""
    stats = agg.column_stats(df, ENV_VARIABLES).withColumn("cv", F.abs(nulls.ratio(F.col("sd"), F.col("mean"))))
    ordered = stats.agg(F.sort_array(F.collect_list(F.struct("cv", "variable"))).alias("list"))
    return ordered.select(F.posexplode("list").alias("position", "item")).select("position", "item.variable")


def _ranked_sql(where: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{v}' AS variable, abs(stddev_samp({v}) / avg({v})) AS cv FROM env_t {where}" for v in ENV)
    return f"SELECT row_number() OVER (ORDER BY cv, variable) AS position, variable FROM ({rows})"


@query(
    "ordered_equality",
    "same:b",
    f"SELECT coalesce(bool_and(a.variable IS NOT DISTINCT FROM b.variable), true) AS same FROM ({_ranked_sql('')}) a FULL JOIN ({_ranked_sql('WHERE SITE_LATITUDE > 0')}) b USING (position)",
)
def _(s: Stages) -> DataFrame:
    return rs.same_sequence(
        _ranked_variables(s.env), _ranked_variables(s.env.filter(F.col("SITE_LATITUDE") > 0)), "position", "variable"
    )


# --- reshape -----------------------------------------------------------------


@query(
    "unpivot_long",
    "SITE jdate:i var value:d",
    " UNION ALL ".join(f"SELECT SITE, jdate, '{v}' AS var, {v} AS value FROM clim_t" for v in ENV),
)
def _(s: Stages) -> DataFrame:
    return rs.to_long(s.climatology, ["SITE", "jdate"], ENV_VARIABLES)


@query(
    "pivot_wide",
    "pair weight_Natural:d weight_Urban:d n_Natural:i n_Urban:i",
    "SELECT pair, max(CASE WHEN side = 'Natural' THEN w END) AS weight_Natural, max(CASE WHEN side = 'Urban' THEN w END) AS weight_Urban, max(CASE WHEN side = 'Natural' THEN n END) AS n_Natural, max(CASE WHEN side = 'Urban' THEN n END) AS n_Urban FROM (SELECT split_part(SITE, '_', 1) AS pair, split_part(SITE, '_', 2) AS side, avg(Weight) AS w, count(*) AS n FROM samples_t WHERE SITE LIKE 'P%' GROUP BY ALL) GROUP BY pair HAVING count(*) = 2",
)
def _(s: Stages) -> DataFrame:
    parts = rs.split_column(s.samples.select("SITE", "Weight"), "SITE", ["pair", "side"]).filter(F.col("side").isNotNull())
    sides = parts.groupBy("pair", "side").agg(F.avg("Weight").alias("w"), F.count(F.lit(1)).alias("n"))
    complete = windows.filter_group_size(sides, ["pair"], low=2)
    return rs.to_wide(complete, ["pair"], "side", ["Natural", "Urban"], {"weight": "w", "n": "n"})


@query(
    "split_columns",
    "SITEPAIR NATURB SITE_TYPE",
    "SELECT split_part(SITE, '_', 1) AS SITEPAIR, nullif(split_part(SITE, '_', 2), '') AS NATURB, SITE_TYPE FROM sites_t",
)
def _(s: Stages) -> DataFrame:
    return rs.split_column(s.sites.select("SITE", "SITE_TYPE"), "SITE", ["SITEPAIR", "NATURB"])


@query("explode_dates", "SAMPLE_CODE date:t", f"SELECT SAMPLE_CODE, ({span('START_DATE', 'COLL_DATE')})::DATE AS date FROM samples_t")
def _(s: Stages) -> DataFrame:
    return rs.unnest(s.samples, "date", cal.date_span(F.col("START_DATE"), F.col("COLL_DATE"), "both"))


# --- scalar functions --------------------------------------------------------


@query("day_of_year", "SITE date:t jdate:i", "SELECT SITE, date, dayofyear(date) AS jdate FROM env_t")
def _(s: Stages) -> DataFrame:
    return s.env.withColumn("jdate", cal.day_of_year(F.col("date")))


@query("year_of", "year n:i", "SELECT year(COLL_DATE)::VARCHAR AS year, count(*) AS n FROM samples_t GROUP BY 1")
def _(s: Stages) -> DataFrame:
    return s.samples.groupBy(cal.year_text(F.col("COLL_DATE")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("days_between", "SAMPLE_CODE n_days:i", "SELECT SAMPLE_CODE, COLL_DATE - START_DATE AS n_days FROM samples_t")
def _(s: Stages) -> DataFrame:
    return s.samples.withColumn("n_days", F.datediff("COLL_DATE", "START_DATE"))


@query("date_sequence", "SAMPLE_CODE date:t", f"SELECT SAMPLE_CODE, ({span('START_DATE', 'COLL_DATE - 1')})::DATE AS date FROM samples_t")
def _(s: Stages) -> DataFrame:
    return rs.unnest(s.samples, "date", cal.date_span(F.col("START_DATE"), F.col("COLL_DATE"), "left"))


@query(
    "int_sequence",
    "SAMPLE_CODE day:i",
    "SELECT SAMPLE_CODE, unnest(CASE WHEN b >= a THEN generate_series(a, b) ELSE generate_series(a, b, -1) END) AS day FROM (SELECT SAMPLE_CODE, dayofyear(START_DATE) + 1 AS a, dayofyear(COLL_DATE) AS b FROM samples_t)",
)
def _(s: Stages) -> DataFrame:
    return rs.unnest(s.samples, "day", cal.day_number_span(F.col("START_DATE"), F.col("COLL_DATE")))


@query(
    "hemisphere_shift",
    "SITE date:t jdate:i",
    f"SELECT SITE, date, {seasonal('dayofyear(date)', 'SITE_LATITUDE')} AS jdate FROM env_t",
)
def _(s: Stages) -> DataFrame:
    return s.env.withColumn("jdate", cal.seasonal_day(F.dayofyear("date"), F.col("SITE_LATITUDE")))


@query(
    "circular_wrap",
    "SAMPLE_CODE before:i after:i capped:i whole:d",
    "SELECT SAMPLE_CODE, CASE WHEN d - 120 < 1 THEN d + 245 ELSE d - 120 END AS before, CASE WHEN d + 120 > 365 THEN d - 245 ELSE d + 120 END AS after, least(d + 120, 365) AS capped, "
    "CASE WHEN round_even((d - 91) / 2e0, 0) = 0 THEN 1e0 ELSE round_even((d - 91) / 2e0, 0) END AS whole FROM (SELECT SAMPLE_CODE, dayofyear(START_DATE) AS d FROM samples_t)",
)
def _(s: Stages) -> DataFrame:
    d = F.dayofyear("START_DATE")
    return s.samples.select(
        "SAMPLE_CODE",
        cal.wrap_day(d - 120).alias("before"),
        cal.wrap_day(d + 120).alias("after"),
        cal.cap_day(d + 120).alias("capped"),
        cal.whole_day((d - 91) / F.lit(2.0)).alias("whole"),
    )


@query(
    "harmonics",
    "SITE jdate:i cos1:d sin1:d cos2:d sin2:d",
    f"SELECT SITE, jdate, {harmonics('jdate')} FROM clim_t",
)
def _(s: Stages) -> DataFrame:
    return s.climatology.withColumns(cal.harmonics(F.col("jdate")))


@query(
    "math_scalars",
    "SAMPLE_CODE log_weight:d lat:d half:d per_lap:d rest:i laps:i",
    "SELECT SAMPLE_CODE, ln(Weight) AS log_weight, abs(SITE_LATITUDE / 100) AS lat, round_even(n / 2e0, 0) AS half, Weight / nullif(n % 3, 0) AS per_lap, n % 7 AS rest, n // 7 AS laps FROM (SELECT *, COLL_DATE - START_DATE AS n FROM samples_t)",
)
def _(s: Stages) -> DataFrame:
    n = F.datediff("COLL_DATE", "START_DATE")
    return s.samples.select(
        "SAMPLE_CODE",
        nulls.safe_log(F.col("Weight")).alias("log_weight"),
        F.abs(F.col("SITE_LATITUDE") / 100).alias("lat"),
        F.bround(n / F.lit(2.0)).alias("half"),
        nulls.ratio(F.col("Weight"), F.pmod(n, F.lit(3))).alias("per_lap"),
        F.pmod(n, F.lit(7)).alias("rest"),
        F.floor(n / 7).alias("laps"),
    )


@query(
    "uniform_draw",
    "SAMPLE_CODE drawn:d",
    f"SELECT SAMPLE_CODE, 0.01e0 + (least_mean - 0.01e0) * {unit(chr(39) + '3:' + chr(39) + ' || SAMPLE_CODE')} AS drawn FROM samples_t, (SELECT min(BIOMASS_PostMean) AS least_mean FROM biomass_t)",
)
def _(s: Stages) -> DataFrame:
    least = s.biomass.agg(F.min("BIOMASS_PostMean")).scalar()
    u = draws.unit_draw(draws.draw_key(3, F.col("SAMPLE_CODE")))
    return s.samples.withColumn("least", least).withColumn("drawn", F.lit(0.01) + (F.col("least") - 0.01) * u)


@query("concat_key", "SITE label", "SELECT SITE, SITE || '_' || coalesce(HFI::INTEGER::VARCHAR, 'NA') || '_' || SITE_TYPE AS label FROM sites_t")
def _(s: Stages) -> DataFrame:
    return s.sites.withColumn("label", text.paste(F.col("SITE"), F.col("HFI").cast("int"), F.col("SITE_TYPE")))


@query("split_first", "SITE sitepair", "SELECT SITE, split_part(SITE, '_', 1) AS sitepair FROM sites_t")
def _(s: Stages) -> DataFrame:
    return s.sites.withColumn("sitepair", text.split_part(F.col("SITE"), 1))


@query(
    "regex_test",
    "SITE nordic:b nested:b",
    "SELECT SITE, regexp_matches(SITE_TYPE, 'Nordic') AS nordic, regexp_matches(SITE_TYPE, '[hH]ierarchical$') AS nested FROM sites_t",
)
def _(s: Stages) -> DataFrame:
    return s.sites.withColumns(
        {"nordic": F.col("SITE_TYPE").contains("Nordic"), "nested": F.col("SITE_TYPE").rlike("[hH]ierarchical$")}
    )


@query("regex_remove", "SITE name", "SELECT SITE, regexp_replace(SITE, '_[A-Za-z]+$', '') AS name FROM sites_t")
def _(s: Stages) -> DataFrame:
    return s.sites.withColumn("name", text.remove_first(F.col("SITE"), models.PAIR_SUFFIX))


LEVELS = ["Nordic Hierarchical", "Nordic", "madagascar_hierarchical", "madagascar", "Natural"]


@query(
    "ordered_factor",
    "SITE SITE_TYPE level:d",
    "SELECT SITE, SITE_TYPE, nullif(list_position(" + str(LEVELS) + ", SITE_TYPE), 0) AS level FROM sites_t",
)
def _(s: Stages) -> DataFrame:
    return s.sites.withColumn("level", text.level_index(F.col("SITE_TYPE"), LEVELS))


@query(
    "casts",
    "SAMPLE_CODE in_nord:d start_text code:i",
    "SELECT SAMPLE_CODE, (SITE_TYPE = 'Nordic')::INTEGER::DOUBLE AS in_nord, START_DATE::VARCHAR AS start_text, SAMPLE_CODE::BIGINT AS code FROM samples_t",
)
def _(s: Stages) -> DataFrame:
    return s.samples.select(
        "SAMPLE_CODE",
        (F.col("SITE_TYPE") == "Nordic").cast("double").alias("in_nord"),
        F.col("START_DATE").cast("string").alias("start_text"),
        F.col("SAMPLE_CODE").cast("bigint").alias("code"),
    )


@query(
    "mercator",
    "SITE X:d3 Y:d3",
    "SELECT SITE, 6378137e0 * radians(SITE_LONGITUDE) AS X, 6378137e0 * ln(tan(pi() / 4 + radians(SITE_LATITUDE) / 2)) AS Y FROM sites_t",
)
def _(s: Stages) -> DataFrame:
    return s.sites.withColumns({"X": geo.mercator_x(F.col("SITE_LONGITUDE")), "Y": geo.mercator_y(F.col("SITE_LATITUDE"))})


@query(
    "collapse_pattern",
    "CZ pattern",
    "SELECT CZ, string_agg(DISTINCT climate_class, '|' ORDER BY climate_class) AS pattern FROM zgrid z JOIN zones_t s ON floor(Latitude / 0.5e0) * 0.5e0 + 0.25e0 = z.lat AND floor(Longitude / 0.5e0) * 0.5e0 + 0.25e0 = z.lon WHERE climate_class IS NOT NULL GROUP BY CZ",
)
def _(s: Stages) -> DataFrame:
    looked_up = jn.grid_lookup(s.zones, s.zone_grid, "Latitude", "Longitude", "climate_class")
    known = looked_up.filter(F.col("climate_class").isNotNull())
    return known.groupBy("CZ").agg(text.alternatives(F.col("climate_class")).alias("pattern"))

