"""The stand-in views and intermediate tables in DuckDB SQL, as common table expressions."""

from __future__ import annotations

import re

ENV = ["avg_t2m", "GDD5", "tot_tp", "tot_evavt", "avg_sde", "avg_swvl1"]
ORDER = ["avg_t2m", "GDD5", "avg_sde", "avg_swvl1", "tot_evavt", "tot_tp"]
PERIOD = [f"{v}_{k}" for v in ORDER for k in ("anom", "clim")]
SCALED = [*PERIOD, "HFI", "HII", "elevation", "site_sde"]
SHORT = {"avg_t2m": "temp", "GDD5": "gdd5", "tot_tp": "prec", "tot_evavt": "et", "avg_sde": "snow", "avg_swvl1": "soil"}
RES = [f"{s}_res" for s in SHORT.values()]
HARM = ["cos1", "sin1", "cos2", "sin2"]
TAU = "2 * pi()"


def strict(agg: str, c: str) -> str:
    return f"CASE WHEN count({c}) = count(*) THEN {agg}({c}) END"


def means(names, strictly: bool = True) -> str:
    return ", ".join(f"{strict('avg', c) if strictly else f'avg({c})'} AS {c}" for c in names)


def scaled(names) -> str:
    return ", ".join(
        f"({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0) AS {c}" for c in names
    )


def shift(day: str) -> str:
    return f"CASE WHEN {day} <= 183 THEN {day} + 182 ELSE {day} - 183 END"


def seasonal(day: str, lat: str) -> str:
    return f"CASE WHEN {lat} < 0 THEN {shift(day)} WHEN {lat} >= 0 THEN {day} END"


def harmonics(day: str) -> str:
    return (
        f"cos({TAU} * {day} / 365e0) AS cos1, sin({TAU} * {day} / 365e0) AS sin1, "
        f"cos(2 * {TAU} * {day} / 365e0) AS cos2, sin(2 * {TAU} * {day} / 365e0) AS sin2"
    )


def span(start: str, end: str) -> str:
    """Dates from start to end, downwards when the end is earlier."""
    up = f"generate_series({start}, {end}, INTERVAL 1 DAY)"
    down = f"generate_series({start}, {end}, -INTERVAL 1 DAY)"
    return f"unnest(CASE WHEN {end} >= {start} THEN {up} ELSE {down} END)"


def unit(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296e0)"


def harmonic_sums() -> str:
    """Per-site Fourier coefficients; the seasonal design is a full grid of sites x 365 days."""
    cells = []
    for v in ENV:
        cells.append(f"avg({v}) AS {v}_one")
        cells += [f"sum({v} * {h}) / 182.5e0 AS {v}_{h}" for h in HARM]
    return f"SELECT SITE, any_value(lat) AS lat, {', '.join(cells)} FROM seasonal_t GROUP BY SITE"


def harmonic_fits() -> str:
    """Each Fourier coefficient regressed on latitude: the least-squares fit on a full grid."""
    cells = []
    for v in ENV:
        for h in ("one", *HARM):
            cells.append(f"regr_intercept({v}_{h}, lat) AS {v}_{h}_a, regr_slope({v}_{h}, lat) AS {v}_{h}_b")
    return f"SELECT {', '.join(cells)} FROM fourier"


def prediction(v: str) -> str:
    parts = [f"({v}_one_a + {v}_one_b * lat)"] + [f"({v}_{h}_a + {v}_{h}_b * lat) * {h}" for h in HARM]
    return " + ".join(parts)


def residual_cells() -> str:
    out = []
    for v, s in SHORT.items():
        if v in ("avg_t2m", "GDD5"):
            out.append(f"{v} - {v}_pred AS {s}_res")
        else:
            out.append(f"CASE WHEN {v}_pred < 0 THEN {v} ELSE {v} - {v}_pred END AS {s}_res")
    return ", ".join(out)


HIER = "('madagascar_hierarchical', 'Nordic Hierarchical')"
SITE3 = "SITE, SITE_LATITUDE, SITE_LONGITUDE"

VIEWS: dict[str, str] = {
    "ksites": """
SELECT k, CASE WHEN k % 10 < 4 THEN 'S' || k ELSE 'P' || (k // 2) || CASE WHEN k % 2 = 0 THEN '_Natural' ELSE '_Urban' END END AS SITE,
  CASE WHEN k % 10 = 0 THEN 'madagascar_hierarchical' WHEN k % 10 = 1 THEN 'Nordic Hierarchical' WHEN k % 10 = 2 THEN 'madagascar'
    WHEN k % 10 = 3 THEN 'Nordic' WHEN k % 2 = 0 THEN 'Natural' ELSE 'Urban' END AS SITE_TYPE,
  CASE WHEN k % 10 = 0 THEN -19e0 + ((k // 10) % 10) * 0.02e0 WHEN k % 10 = 1 THEN 60e0 + ((k // 10) % 10) * 0.02e0
    ELSE (k * 37) % 131 - 60e0 END AS SITE_LATITUDE,
  CASE WHEN k % 10 = 0 THEN 47e0 + ((k // 100) % 10) * 0.02e0 WHEN k % 10 = 1 THEN 17e0 + ((k // 100) % 10) * 0.02e0
    ELSE (k * 61) % 351 - 175e0 END AS SITE_LONGITUDE,
  CASE WHEN k % 17 <> 0 THEN ((k * 29) % 50)::DOUBLE END AS HFI,
  CASE WHEN k % 17 <> 0 THEN ((k * 29) % 50) * 1.2e0 END AS HII,
  ((k * 113) % 2900)::DOUBLE AS elevation
FROM (SELECT s_suppkey AS k FROM supplier)""",
    "sites_t": "SELECT SITE, SITE_TYPE, SITE_LATITUDE, SITE_LONGITUDE, HFI, HII, elevation FROM ksites",
    "korders": """
SELECT CASE WHEN (k0 % 20 = 15 AND lap % 40 <> 0) OR (k0 % 20 <> 15 AND k0 % 10 = 5 AND lap % 12 <> 0) THEN k0 - 1 ELSE k0 END AS k,
  o_orderkey::VARCHAR AS SAMPLE_CODE, start_day AS START_DATE, (start_day + ((o_orderkey + lap * 3) % 10)::INTEGER + 1)::DATE AS COLL_DATE,
  o_totalprice / 10000e0 AS Weight
FROM (SELECT *, (make_date(year(day), 4, 1) + ((dayofyear(day) - 1) * 210 // 366)::INTEGER)::DATE AS start_day
  FROM (SELECT o_orderkey, o_totalprice, o_orderdate::DATE AS day, o_orderkey % n AS k0, o_orderkey // n AS lap
    FROM orders, (SELECT count(*) AS n FROM supplier)))""",
    "samples_t": """
SELECT SAMPLE_CODE, START_DATE, COLL_DATE, Weight, SITE, SITE_TYPE, SITE_LATITUDE, SITE_LONGITUDE
FROM korders JOIN ksites USING (k)""",
    "biomass_t": "SELECT SAMPLE_CODE, Weight * 0.8e0 + 0.01e0 AS BIOMASS_PostMean FROM korders",
    "env_t": f"""
SELECT SITE, SITE_LATITUDE, SITE_LONGITUDE, date, t2m AS avg_t2m, t2m - 5 AS GDD5, q / 1000 AS tot_tp, -q / 2000 AS tot_evavt,
  CASE WHEN (k + n) % 97 <> 0 THEN greatest(0e0, (abs(SITE_LATITUDE) - 30) / 60) * greatest(0e0, h) + q / 500 END AS avg_sde,
  CASE WHEN (k + n) % 89 <> 0 THEN q / 1000 + 0.2e0 END AS avg_swvl1
FROM (SELECT *, 22e0 - abs(SITE_LATITUDE) * 0.35e0 - h * 12 * sign(SITE_LATITUDE + 0.5e0) + q / 25 AS t2m FROM (
  SELECT c.k, SITE, SITE_LATITUDE, SITE_LONGITUDE, c.date, coalesce(d.q, 0e0) AS q, cos({TAU} * dayofyear(c.date) / 365e0) AS h,
    c.date - DATE '1995-01-01' AS n
  FROM (SELECT ksites.*, unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY))::DATE AS date FROM ksites) c
  LEFT JOIN (SELECT l_suppkey AS k, l_shipdate::DATE AS date, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) d
    ON c.k = d.k AND c.date = d.date))""",
    "zgrid": """
SELECT lat, lon, CASE k % 8 WHEN 0 THEN 'Af' WHEN 1 THEN 'BWh' WHEN 2 THEN 'BSk' WHEN 3 THEN 'Cfa' WHEN 4 THEN 'Csb'
  WHEN 5 THEN 'Dfb' WHEN 6 THEN 'ET' END AS climate_class
FROM (SELECT floor(SITE_LATITUDE / 0.5e0) * 0.5e0 + 0.25e0 AS lat, floor(SITE_LONGITUDE / 0.5e0) * 0.5e0 + 0.25e0 AS lon, min(k) AS k
  FROM ksites GROUP BY ALL)""",
    "predictors_t": """
SELECT * REPLACE (CASE WHEN GDD5 < 0 THEN 0 ELSE GDD5 END AS GDD5), dayofyear(date) AS jdate FROM env_t WHERE avg_sde IS NOT NULL""",
    "clim_t": f"""
SELECT *, CASE WHEN count(avg_sde) OVER w = count(*) OVER w THEN avg(avg_sde) OVER w END AS site_sde
FROM (SELECT {SITE3}, jdate, {means(ENV)} FROM predictors_t GROUP BY {SITE3}, jdate) WINDOW w AS (PARTITION BY SITE)""",
    "usable_t": """
SELECT * EXCLUDE (a, b) FROM (SELECT *, count(*) OVER (PARTITION BY SITE, year(START_DATE)) AS a,
    count(*) OVER (PARTITION BY SITE, year(COLL_DATE)) AS b FROM samples_t WHERE SITE <> 'NEGreenland')
WHERE NOT (a = 1 AND b = 1)""",
    "dat_t": f"""
SELECT *, ({span('START_DATE', 'COLL_DATE - 1')})::DATE AS date FROM (
  SELECT * EXCLUDE (Weight), Weight AS SAMPLE_WEIGHT, COLL_DATE - START_DATE AS n_days,
    Weight / nullif(COLL_DATE - START_DATE, 0) AS DB_sample
  FROM usable_t QUALIFY count(*) OVER (PARTITION BY SITE) > 3)""",
    "free_t": f"""
SELECT p.*, t.SITE_TYPE FROM predictors_t p LEFT JOIN (SELECT DISTINCT SITE, SITE_TYPE FROM dat_t) t USING (SITE)
WHERE NOT EXISTS (SELECT 1 FROM dat_t d WHERE d.SITE = p.SITE AND d.SITE_LATITUDE = p.SITE_LATITUDE
    AND d.SITE_LONGITUDE = p.SITE_LONGITUDE AND d.date = p.date AND d.SITE_TYPE IS NOT DISTINCT FROM t.SITE_TYPE)
  AND EXISTS (SELECT 1 FROM dat_t d WHERE d.SITE = p.SITE AND year(d.COLL_DATE) = year(p.date))""",
    "chunks_t": """
SELECT *, SITE || '_' || island || '_' || chunk AS SAMPLE_CODE FROM (
  SELECT *, (row_number() OVER (PARTITION BY SITE, island ORDER BY date) - 1) // 7 AS chunk FROM (
    SELECT *, sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY SITE ORDER BY date)::BIGINT AS island FROM (
      SELECT *, coalesce(date - lag(date) OVER (PARTITION BY SITE ORDER BY date), 0) AS gap FROM free_t)))""",
    "weeks_t": f"""
SELECT SAMPLE_CODE, {SITE3}, SITE_TYPE, count(*) AS n, min(date) AS START_DATE, max(date) AS COLL_DATE, {means(['avg_t2m', 'avg_sde'])}
FROM chunks_t GROUP BY SAMPLE_CODE, {SITE3}, SITE_TYPE""",
    "imputed_t": f"""
SELECT *, ({span('START_DATE', 'COLL_DATE - 1')})::DATE AS date FROM (
  SELECT * EXCLUDE (n), 0e0 AS DB_sample, COLL_DATE - START_DATE AS n_days FROM weeks_t
  WHERE n >= 6 AND avg_sde > 0.1e0 AND avg_t2m < 5)""",
    "stacked_t": """
SELECT SAMPLE_CODE, START_DATE, COLL_DATE, SITE, SITE_TYPE, SITE_LATITUDE, SITE_LONGITUDE, SAMPLE_WEIGHT, n_days, DB_sample, date FROM dat_t
UNION ALL SELECT SAMPLE_CODE, START_DATE, COLL_DATE, SITE, SITE_TYPE, SITE_LATITUDE, SITE_LONGITUDE, NULL, n_days, DB_sample, date
FROM imputed_t""",
    "periods_t": f"""
SELECT SAMPLE_CODE, SAMPLE_WEIGHT, {SITE3}, SITE_TYPE, DB_sample, n_days, START_DATE, COLL_DATE, site_sde, {means(PERIOD)},
  {strict('median', 'jdate')} AS jdate
FROM (SELECT s.*, dayofyear(s.date) AS jdate, c.site_sde,
    {', '.join(f'e.{v} - c.{v} AS {v}_anom, c.{v} AS {v}_clim' for v in ENV)}
  FROM stacked_t s LEFT JOIN env_t e USING ({SITE3}, date)
  LEFT JOIN clim_t c ON s.SITE = c.SITE AND s.SITE_LATITUDE = c.SITE_LATITUDE AND s.SITE_LONGITUDE = c.SITE_LONGITUDE
    AND dayofyear(s.date) = c.jdate)
GROUP BY SAMPLE_CODE, SAMPLE_WEIGHT, {SITE3}, SITE_TYPE, DB_sample, n_days, START_DATE, COLL_DATE, site_sde""",
    "enriched_t": """
SELECT p.*, h.HFI, h.HII, h.elevation FROM periods_t p LEFT JOIN (SELECT SITE, HFI, HII, elevation FROM sites_t) h USING (SITE)""",
    "truncated_t": """
SELECT * REPLACE (CASE WHEN avg_t2m_clim < -7 THEN 0e0 WHEN avg_t2m_clim >= -7 THEN avg_t2m_anom END AS avg_t2m_anom,
  CASE WHEN avg_t2m_clim < -7 THEN -7e0 ELSE avg_t2m_clim END AS avg_t2m_clim) FROM enriched_t""",
    "scaled_t": f"SELECT * REPLACE ({scaled(SCALED)}) FROM truncated_t",
    "seasonal_t": f"""
SELECT * REPLACE ({seasonal('jdate', 'SITE_LATITUDE')} AS jdate), abs(SITE_LATITUDE / 100) AS lat,
  {harmonics('(' + seasonal('jdate', 'SITE_LATITUDE') + ')')}
FROM (SELECT {SITE3}, dayofyear(date) AS jdate, {means(ENV, False)} FROM env_t
  WHERE SITE IN (SELECT SITE FROM scaled_t) AND dayofyear(date) <> 366 GROUP BY {SITE3}, dayofyear(date))""",
    "fourier": harmonic_sums(),
    "fits": harmonic_fits(),
    "predicted_t": f"SELECT seasonal_t.*, {', '.join(f'{prediction(v)} AS {v}_pred' for v in ENV)} FROM seasonal_t, fits",
    "residuals_t": f"SELECT {SITE3}, jdate, {residual_cells()} FROM predicted_t",
    "sampled_days_t": f"""
SELECT DISTINCT SITE, {seasonal('dayofyear(day)', 'SITE_LATITUDE')} AS jdate
FROM (SELECT SITE, SITE_LATITUDE, {span('START_DATE', 'COLL_DATE')} AS day FROM scaled_t WHERE DB_sample <> 0)""",
    "limited_t": """
SELECT * REPLACE (CASE WHEN temp_res < -13.5e0 THEN -13.5e0 ELSE temp_res END AS temp_res,
  CASE WHEN snow_res > 0.95e0 THEN 0.95e0 ELSE snow_res END AS snow_res) FROM residuals_t""",
    "zones_t": """
SELECT Site, Longitude, Latitude, CASE WHEN regexp_matches(climate_class, 'A.') THEN 'Tropical-Subtropical'
  WHEN regexp_matches(climate_class, 'B.h') THEN 'Tropical-Subtropical' WHEN regexp_matches(climate_class, 'B.k') THEN 'Temperate'
  WHEN regexp_matches(climate_class, 'C[fw]a') THEN 'Tropical-Subtropical' WHEN regexp_matches(climate_class, 'C..') THEN 'Temperate'
  WHEN regexp_matches(climate_class, '[DE]..?') THEN 'Polar-Continental' END AS CZ
FROM (SELECT DISTINCT SITE AS Site, SITE_LONGITUDE AS Longitude, SITE_LATITUDE AS Latitude FROM scaled_t) s
LEFT JOIN zgrid g ON floor(Latitude / 0.5e0) * 0.5e0 + 0.25e0 = g.lat AND floor(Longitude / 0.5e0) * 0.5e0 + 0.25e0 = g.lon""",
    "mismatched_t": """
SELECT DISTINCT sitepair FROM (SELECT DISTINCT split_part(Site, '_', 1) AS sitepair, CZ FROM zones_t)
GROUP BY sitepair HAVING count(*) > 1""",
    "zone_lat_t": """
SELECT CZ, avg(abs(SITE_LATITUDE) / 100) AS lat FROM scaled_t LEFT JOIN (SELECT Site AS SITE, CZ FROM zones_t) z USING (SITE) GROUP BY CZ""",
    "zone_days_t": f"SELECT CZ, lat, jdate, {harmonics('jdate')} FROM (SELECT *, unnest(range(1, 366)) AS jdate FROM zone_lat_t)",
    "rates_t": f"""
SELECT *, low_included / nullif(n_days, 0) AS DB_post_sample FROM (
  SELECT s.*, b.BIOMASS_PostMean, CASE WHEN DB_sample = 0
      THEN 0.01e0 + (m.least_mean - 0.01e0) * {unit("'1:' || s.SAMPLE_CODE")} ELSE b.BIOMASS_PostMean END AS low_included
  FROM scaled_t s LEFT JOIN biomass_t b USING (SAMPLE_CODE), (SELECT min(BIOMASS_PostMean) AS least_mean FROM biomass_t) m
  WHERE n_days >= 3)""",
    "msamples_t": f"""
SELECT * REPLACE ({scaled(RES)}) FROM (
  SELECT b.*, {', '.join('r.' + r for r in RES)}, {harmonics('b.jdate')} FROM (
    SELECT * REPLACE (CASE WHEN day = 0 THEN 1e0 ELSE day END AS jdate) FROM (
      SELECT *, round_even({seasonal('jdate', 'SITE_LATITUDE')}, 0) AS day, abs(SITE_LATITUDE / 100) AS lat,
        year(COLL_DATE)::VARCHAR AS year, CASE WHEN DB_post_sample > 0 THEN ln(DB_post_sample) END AS logDB_post_sample FROM rates_t)) b
  LEFT JOIN limited_t r ON b.SITE = r.SITE AND b.SITE_LATITUDE = r.SITE_LATITUDE AND b.SITE_LONGITUDE = r.SITE_LONGITUDE
    AND b.jdate = r.jdate)""",
    "siteclim_t": f"""
SELECT {SITE3}, {', '.join(f'{v} AS {v}_siteclim' for v in ENV)} FROM (
  SELECT * REPLACE ({scaled(ENV)}) FROM (SELECT {SITE3}, {means(ENV)} FROM clim_t GROUP BY {SITE3}))""",
    "sitetab_t": f"""
SELECT g.*, c.SITE_LATITUDE, c.SITE_LONGITUDE, {', '.join(f'c.{v}_siteclim' for v in ENV)},
  CASE WHEN contains(SITE_TYPE, 'madagascar') THEN 'MAD' WHEN contains(SITE_TYPE, 'Nordic') THEN 'NORD'
    ELSE regexp_replace(g.SITE, '_[A-Za-z]+$', '') END AS country,
  CASE WHEN SITE_TYPE = 'madagascar_hierarchical' THEN 'MAD_hier' WHEN SITE_TYPE = 'Nordic Hierarchical' THEN 'NORD_hier'
    WHEN contains(SITE_TYPE, 'madagascar') THEN 'MAD' WHEN contains(SITE_TYPE, 'Nordic') THEN 'NORD'
    ELSE regexp_replace(g.SITE, '_[A-Za-z]+$', '') END AS cluster
FROM (SELECT SITE, SITE_TYPE, HFI, HII, elevation, lat, CASE WHEN sum(low_included) > 0 THEN ln(sum(low_included) / sum(n_days)) END AS logDB_site
  FROM (SELECT *, abs(SITE_LATITUDE / 100) AS lat FROM rates_t) GROUP BY SITE, SITE_TYPE, HFI, HII, elevation, lat) g
LEFT JOIN siteclim_t c USING (SITE)""",
    "kept_t": f"""
SELECT SITE, SITE_TYPE FROM (SELECT SITE, SITE_TYPE, row_number() OVER (PARTITION BY SITE_TYPE ORDER BY md5('1:' || SITE), SITE) AS rn
  FROM (SELECT SITE, SITE_TYPE FROM msamples_t WHERE SITE_TYPE IN {HIER} GROUP BY ALL HAVING count(*) > 80)) WHERE rn = 1""",
    "curves_t": "SELECT SITE, jdate, avg_t2m AS pred FROM seasonal_t",
    "rolled_t": """
SELECT SITE, jdate, CASE WHEN count(*) OVER w = 21 AND count(pred) OVER w = 21 THEN avg(pred) OVER w END AS roll_mean FROM curves_t
WINDOW w AS (PARTITION BY SITE ORDER BY jdate ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING)""",
    "peaks_t": """
SELECT SITE, jdate AS start_day, least(jdate + 20, 365) AS end_day, roll_mean FROM rolled_t
QUALIFY row_number() OVER (PARTITION BY SITE ORDER BY round(roll_mean, 9) DESC NULLS LAST, jdate) = 1""",
    "peak_days_t": """
SELECT SITE, CASE WHEN day < 1 THEN day + 365 WHEN day > 365 THEN day - 365 ELSE day END AS jdate
FROM (SELECT SITE, unnest(generate_series(start_day - 14, end_day + 14)) AS day FROM peaks_t)""",
    "peak_years_t": """
SELECT DISTINCT SITE, year FROM msamples_t m WHERE EXISTS (SELECT 1 FROM peak_days_t p WHERE p.SITE = m.SITE AND p.jdate = m.jdate)""",
    "day_rows_t": """
SELECT SITE, year, DB_post_sample, unnest(CASE WHEN b >= a THEN generate_series(a, b) ELSE generate_series(a, b, -1) END) AS sampled_days
FROM (SELECT m.SITE, m.year, DB_post_sample, dayofyear(START_DATE) + 1 AS a, dayofyear(COLL_DATE) AS b
  FROM msamples_t m JOIN peak_years_t USING (SITE, year))""",
    "windows_t": """
SELECT SITE, year, sampled_days, CASE WHEN count(*) OVER w >= 19 AND count(DB_post_sample) OVER w = count(*) OVER w
    THEN sum(DB_post_sample) OVER w END AS total_3wk
FROM day_rows_t WINDOW w AS (PARTITION BY SITE, year ORDER BY sampled_days RANGE BETWEEN CURRENT ROW AND 20 FOLLOWING)""",
    "observed_t": """
SELECT SITE, year, sampled_days AS start_day, sampled_days + 20 AS end_day, total_3wk FROM windows_t
QUALIFY row_number() OVER (PARTITION BY SITE, year ORDER BY round(total_3wk, 9) DESC NULLS LAST, sampled_days) = 1""",
    "sitepeak_t": """
SELECT s.*, log_DB_peak FROM sitetab_t s JOIN (SELECT SITE, avg(CASE WHEN total_3wk > 0 THEN ln(total_3wk / 21) END) AS log_DB_peak
  FROM observed_t GROUP BY SITE) p USING (SITE)""",
    "planar_t": """
SELECT *, 6378137e0 * radians(SITE_LONGITUDE) AS X, 6378137e0 * ln(tan(pi() / 4 + radians(SITE_LATITUDE) / 2)) AS Y,
  CASE WHEN cluster = 'NORD_hier' THEN 1e0 ELSE 0e0 END AS in_nord, CASE WHEN cluster = 'MAD_hier' THEN 1e0 ELSE 0e0 END AS in_mad
FROM sitetab_t""",
    "naturb_t": """
SELECT SITEPAIR, max(CASE WHEN NATURB = 'Natural' THEN s END) AS site_Natural, max(CASE WHEN NATURB = 'Urban' THEN s END) AS site_Urban,
  max(CASE WHEN NATURB = 'Natural' THEN p END) AS peak_Natural, max(CASE WHEN NATURB = 'Urban' THEN p END) AS peak_Urban
FROM (SELECT *, count(*) OVER (PARTITION BY SITEPAIR) AS n FROM (
  SELECT split_part(t.SITE, '_', 1) AS SITEPAIR, nullif(split_part(t.SITE, '_', 2), '') AS NATURB, t.logDB_site AS s, q.log_DB_peak AS p
  FROM sitetab_t t LEFT JOIN (SELECT SITE, log_DB_peak FROM sitepeak_t) q USING (SITE)) WHERE NATURB IS NOT NULL)
WHERE n = 2 GROUP BY SITEPAIR""",
    "latres_t": """
SELECT p.*, logDB_site - regr_intercept(logDB_site, lat) OVER () - regr_slope(logDB_site, lat) OVER () * lat AS z FROM planar_t p""",
    "groups_t": """
SELECT 'country:' || country AS site_group, * FROM latres_t WHERE country IN ('NORD', 'MAD')
UNION ALL SELECT 'cluster:' || cluster AS site_group, * FROM latres_t WHERE cluster IN ('NORD_hier', 'MAD_hier')""",
    "edges_t": """
SELECT a.site_group, a.SITE AS i, b.SITE AS j, 1e0 / count(*) OVER (PARTITION BY a.site_group, a.SITE) AS w
FROM groups_t a JOIN groups_t b ON a.site_group = b.site_group AND a.SITE <> b.SITE
  AND (a.X - b.X) * (a.X - b.X) + (a.Y - b.Y) * (a.Y - b.Y) <= 1e8""",
    "points": """
SELECT SITE, CZ, jdate, avg_t2m, tot_tp, tot_evavt, avg_sde, avg_swvl1
FROM (SELECT * FROM seasonal_t ORDER BY md5('1:' || SITE || ':' || jdate), SITE, jdate LIMIT 20000)
LEFT JOIN (SELECT Site AS SITE, CZ FROM zones_t) z USING (SITE)""",
    "dealt": """
SELECT f.site_group, f.SITE, v.sim, v.z FROM (
  SELECT site_group, SITE, row_number() OVER (PARTITION BY site_group ORDER BY md5('1:0:' || SITE), SITE) AS r FROM centred_t) f
JOIN (SELECT site_group, sim, z, row_number() OVER (PARTITION BY site_group, sim ORDER BY md5('1:' || sim || ':' || SITE), SITE) AS r
  FROM centred_t, range(1, 1000) x(sim)) v ON f.site_group = v.site_group AND f.r = v.r""",
    "centred_t": "SELECT site_group, SITE, z - avg(z) OVER (PARTITION BY site_group) AS z FROM groups_t WHERE z IS NOT NULL",
}

_WORDS = re.compile(r"[A-Za-z_0-9]+")


def with_views(body: str) -> str:
    """Prefix a query with the views it needs, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(_WORDS.findall(text)):
            if word in VIEWS and word not in ordered:
                visit(VIEWS[word])
                if word not in ordered:
                    ordered.append(word)

    visit(body)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in ordered) + "\n" + body
