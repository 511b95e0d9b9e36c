"""Estimators against dense NumPy references on small data."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.stats import linear, mixed, moran, pairs, smooth, solve
from fieldspark.stats.design import cross_products, design_frame, gram


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    rows = []
    for s in range(14):
        b = rng.normal(0, 1.0)
        for t in range(4):
            c = [0.5, -0.7, 0.2, 0.1][t]
            for _ in range(int(rng.integers(1, 7))):
                x, z = rng.normal(), rng.normal()
                rows.append((f"s{s}", str(2000 + t), float(x), float(z), float(1 + 2 * x - 0.5 * x * z + b + c + rng.normal(0, 0.6))))
    return spark.createDataFrame(rows, "site string, year string, x double, z double, y double").cache()


TERMS = [(), ("x",), ("z",), ("x", "z")]


def dense(panel):
    pdf = panel.toPandas()
    X = np.column_stack([np.ones(len(pdf)), pdf.x, pdf.z, pdf.x * pdf.z])
    Zs = (pdf.site.to_numpy()[:, None] == np.unique(pdf.site)[None, :]).astype(float)
    Zt = (pdf.year.to_numpy()[:, None] == np.unique(pdf.year)[None, :]).astype(float)
    return X, Zs, Zt, pdf.y.to_numpy()


def dense_deviance(X, Zs, Zt, y, ts, tt, reml=False):
    n, p = X.shape
    V = np.eye(n) + ts**2 * Zs @ Zs.T + tt**2 * Zt @ Zt.T
    W = np.linalg.inv(V)
    XtWX = X.T @ W @ X
    beta = np.linalg.solve(XtWX, X.T @ W @ y)
    r = y - X @ beta
    rss = r @ W @ r
    if reml:
        return np.linalg.slogdet(V)[1] + np.linalg.slogdet(XtWX)[1] + (n - p) * (1 + math.log(2 * math.pi * rss / (n - p)))
    return np.linalg.slogdet(V)[1] + n * (1 + math.log(2 * math.pi * rss / n))


def test_least_squares_matches_lstsq(panel):
    X, _, _, y = dense(panel)
    fit = linear.fit_linear(panel, ["y"], TERMS).fits["y"]
    beta, rss, _, _ = np.linalg.lstsq(X, y, rcond=None)
    assert fit.beta == pytest.approx(beta, abs=1e-9)
    assert fit.sigma2 == pytest.approx(float(rss[0]) / (len(y) - 4))
    residuals = linear.residuals(panel, linear.FittedModels({"y": fit})).select("y_res", "x").toPandas()
    assert abs(residuals.y_res.sum()) < 1e-8 and abs((residuals.y_res * residuals.x).sum()) < 1e-8


def test_dependent_columns_get_zero(panel):
    fit = linear.fit_linear(panel.withColumn("w", F.col("x") * 2), ["y"], [*TERMS, ("w",)]).fits["y"]
    assert fit.beta[4] == 0 and fit.cov[4, 4] == 0


def test_wide_and_narrow_cross_products_agree(panel):
    frame = design_frame(panel, TERMS, ["y"])
    narrow, n = cross_products(frame, frame.columns)
    many = frame.select(*frame.columns, *[(F.col("y0") * i).alias(f"m{i}") for i in range(12)])
    wide, m = cross_products(many, many.columns)
    assert n == m and wide[:5, :5] == pytest.approx(narrow)
    assert gram(panel, TERMS, ["y"]).n == n


def test_simple_regression_and_band(panel):
    row = linear.simple_regression(panel, "y", "x").first()
    pdf = panel.toPandas()
    slope, intercept = np.polyfit(pdf.x, pdf.y, 1)
    assert row.slope == pytest.approx(slope) and row.intercept == pytest.approx(intercept)
    fit = linear.fit_linear(panel, ["y"], [(), ("x",)]).fits["y"]
    assert row.se == pytest.approx(math.sqrt(fit.cov[1, 1]))
    band = linear.with_band(panel, fit).filter("x > 1").first()
    half = 1.96 * math.sqrt(np.array([1, band.x]) @ fit.cov @ np.array([1, band.x]))
    assert band.upr - band["fit"] == pytest.approx(half)


@pytest.mark.parametrize("reml", [False, True])
def test_mixed_deviance_equals_dense_likelihood(panel, reml):
    X, Zs, Zt, y = dense(panel)
    stats = mixed.collect_stats(panel, "y", TERMS, "site", "year")
    like = mixed._Likelihood(stats, TERMS, reml)
    for ts, tt in ((0.3, 0.9), (1.7, 0.05), (0.0, 0.4), (2.2, 0.0)):
        assert like.deviance(ts, tt) == pytest.approx(dense_deviance(X, Zs, Zt, y, ts, tt, reml), abs=1e-7)


def test_mixed_fit_matches_dense_gls_and_blup(panel):
    X, Zs, Zt, y = dense(panel)
    stats = mixed.collect_stats(panel, "y", TERMS, "site", "year")
    fit = mixed.fit_mixed(stats, TERMS, "site", "year")
    ts, tt = fit.theta
    for a, b in ((1.05, 1), (1 / 1.05, 1), (1, 1.05), (1, 1 / 1.05)):
        assert dense_deviance(X, Zs, Zt, y, ts * a, tt * b) >= fit.deviance - 1e-7
    V = np.eye(len(y)) + ts**2 * Zs @ Zs.T + tt**2 * Zt @ Zt.T
    W = np.linalg.inv(V)
    inverse = np.linalg.inv(X.T @ W @ X)
    beta = inverse @ X.T @ W @ y
    r = y - X @ beta
    sigma2 = r @ W @ r / len(y)
    assert fit.beta == pytest.approx(beta, abs=1e-6) and fit.sigma2 == pytest.approx(sigma2)
    assert fit.cov == pytest.approx(sigma2 * inverse, abs=1e-7)
    assert fit.year_effects == pytest.approx(tt**2 * Zt.T @ W @ r, abs=1e-6)
    effects = {r.site: r.effect for r in mixed.group_effects(panel, fit).collect()}
    names = np.unique(panel.toPandas().site)
    assert [effects[s] for s in names] == pytest.approx(list(ts**2 * Zs.T @ W @ r), abs=1e-6)
    fixed = np.var(X @ beta, ddof=1)
    assert fit.fixed_var == pytest.approx(fixed)
    assert fit.aic == pytest.approx(fit.deviance + 2 * (4 + 3))


def test_selection_is_ordered_and_respects_nulls(panel):
    holes = panel.withColumn("h", F.when(F.col("x") > -1, F.col("z") * F.col("z")))
    terms = [(), ("x",), ("z",), ("x", "z"), ("h",)]
    source = mixed.StatsSource(holes, "y", terms, "site", "year")
    start = source.fit([()])
    log = mixed.forward_selection(source, start, {"x": [("x",)], "z": [("z",)], "xz": [("x", "z")], "h": [("h",)]})
    assert log.selected[0] == "x" and "xz" in log.selected
    assert source.fit([(), ("h",)]).n == holes.filter("h is not null").count() < start.n
    nested = [source.fit(t).deviance for t in ([()], [(), ("x",)], [(), ("x",), ("x", "z")])]
    assert nested == sorted(nested, reverse=True)
    common = mixed.StatsSource(holes, "y", terms, "site", "year", "common")
    assert common.fit([()]).n == source.fit([(), ("h",)]).n


def test_no_group_variance_lands_on_the_edge(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{i % 9}", str(2000 + i % 3), float(i % 5), float(i % 5 + rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "site string, year string, x double, y double")
    fit = mixed.fit_mixed(mixed.collect_stats(df, "y", [(), ("x",)], "site", "year"), [(), ("x",)], "site", "year")
    X = np.column_stack([np.ones(200), [r[2] for r in rows]])
    y = np.array([r[3] for r in rows])
    names, years = np.unique([r[0] for r in rows]), np.unique([r[1] for r in rows])
    Zs = np.array([[r[0] == s for s in names] for r in rows], float)
    Zt = np.array([[r[1] == t for t in years] for r in rows], float)
    grid = min(dense_deviance(X, Zs, Zt, y, a, b) for a in (0, 0.02, 0.05, 0.1, 0.2) for b in (0, 0.02, 0.05, 0.1, 0.2))
    assert fit.deviance <= grid + 1e-8


def test_smooth_fit_matches_dense_penalised_solution(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(90):
        x, y, by = rng.uniform(0, 10), rng.uniform(0, 10), float(i % 3 == 0)
        rows.append((i, float(x), float(y), by, float(rng.normal()), float(math.sin(x) * by + rng.normal(0, 0.2))))
    df = spark.createDataFrame(rows, "id int, X double, Y double, b double, u double, r double")
    source = smooth.SmoothSource(df, "r", [(), ("u",)], [smooth.Smooth("X", "Y", "b", 10)])
    fit = source.fit([(), ("u",)], "ML")
    stats = next(iter(source.cache.values()))
    m = len(stats.cross) - 1
    basis = source.bases[0]
    block = np.zeros((m, m))
    raw = stats.cross[:m, :m]
    scale = 1 / np.sqrt(np.diag(raw))
    s = basis.penalty * np.outer(scale[2:], scale[2:])
    inner = s[3:, 3:]
    block[5:, 5:] = fit.lambdas[0] * inner / (np.trace(inner) / len(inner))
    g = raw * np.outer(scale, scale)
    beta = np.linalg.solve(g + block, stats.cross[:m, m] * scale) * scale
    assert fit.beta == pytest.approx(beta, rel=1e-5, abs=1e-7)
    residual = fit.residuals(df).agg(F.sum(F.col("residual") * F.col("residual"))).first()[0]
    assert residual == pytest.approx(fit.rss, rel=1e-6)
    assert 2 <= fit.edf <= 13 and fit.adjusted_r2 > source.fit([()], "ML").adjusted_r2 - 0.2


def dense_moran(points, radius):
    xy = np.array([[p[1], p[2]] for p in points])
    z = np.array([p[3] for p in points]) - np.mean([p[3] for p in points])
    near = (((xy[:, None] - xy[None]) ** 2).sum(2) <= radius**2) & ~np.eye(len(points), dtype=bool)
    degree = near.sum(1)
    w = near / np.maximum(degree, 1)[:, None]
    return (degree > 0).sum(), float(z @ w @ z / (z @ z))


def test_moran_against_dense_weights_with_shared_positions(spark):
    rng = np.random.default_rng(9)
    points = [(f"p{i}", float(rng.uniform(0, 6)), float(rng.uniform(0, 6)), float(rng.normal())) for i in range(60)]
    points += [(f"q{i}", 3.0, 3.0, float(rng.normal())) for i in range(15)] + [("far", 99.0, 99.0, 1.0)]
    df = spark.createDataFrame(points, "k string, X double, Y double, v double")
    row = moran.morans_i(df, "k", "v", "X", "Y", 1.0).first()
    n, value = dense_moran(points, 1.0)
    assert row.n == n and row.moran_i == pytest.approx(value, abs=1e-12)
    weights = moran.spatial_weights(df, "k", "X", "Y", 1.0).groupBy("i").agg(F.sum("w").alias("w")).collect()
    assert len(weights) == n and all(r.w == pytest.approx(1) for r in weights)
    test = moran.morans_i_test(df, "k", "v", "X", "Y", 1.0, nsim=49).first()
    assert test.nsim == 49 and test.moran_i == pytest.approx(value) and 0.02 <= test.p_value <= 1


def test_moran_finds_a_trend(spark):
    points = [(str(i), float(i % 10), float(i // 10), float(i % 10)) for i in range(100)]
    df = spark.createDataFrame(points, "k string, X double, Y double, v double")
    assert moran.morans_i_test(df, "k", "v", "X", "Y", 1.0, nsim=99).first().p_value == pytest.approx(0.01)


def dense_permutations(points, radius, nsim, seed):
    """p-value with the values dealt by md5 order, run by run."""
    order = lambda sim: sorted(range(len(points)), key=lambda i: (hashlib.md5(f"{seed}:{sim}:{points[i][0]}".encode()).hexdigest(), points[i][0]))
    fixed, (n, observed), large = order(0), dense_moran(points, radius), 0
    for sim in range(1, nsim + 1):
        value_at = dict(zip(fixed, order(sim), strict=True))
        dealt = [(*p[:3], points[value_at[i]][3]) for i, p in enumerate(points)]
        large += dense_moran(dealt, radius)[1] >= observed - 1e-12
    return n, observed, (large + 1) / (nsim + 1)


@pytest.mark.parametrize("block", [7, 64])
def test_moran_permutations_against_dense_runs_per_group(spark, monkeypatch, block):
    monkeypatch.setattr(moran, "RUN_BLOCK", block)
    rng = np.random.default_rng(11)
    groups = {
        "a": [(f"a{i}", float(rng.uniform(0, 4)), float(rng.uniform(0, 4)), float(rng.normal())) for i in range(30)] + [("alone", 50.0, 50.0, 3.0)],
        # two thirds of the points at one position, equal values among them
        None: [(f"n{i}", 1.0, 1.0, float(i % 3)) for i in range(20)] + [(f"m{i}", 1.0 + i / 10, 1.5, float(i)) for i in range(10)],
        "far": [(f"f{i}", 10.0 * i, 0.0, float(i)) for i in range(4)],
        "flat": [(f"e{i}", i / 10, 0.0, 2.0) for i in range(4)],
    }
    rows = [(g, *p) for g, points in groups.items() for p in points] + [("a", "gone", 1.0, 1.0, None), ("empty", "none", 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "g string, k string, X double, Y double, v double")
    got = {r.g: r for r in moran.morans_i_test(df, "k", "v", "X", "Y", 1.0, ["g"], nsim=39, seed=5).collect()}
    assert set(got) == set(groups)
    for g in ("a", None):
        n, value, p = dense_permutations(groups[g], 1.0, 39, 5)
        assert (got[g].n, got[g].nsim) == (n, 39) and got[g].moran_i == pytest.approx(value, abs=1e-12) and got[g].p_value == pytest.approx(p)
    assert (got["far"].n, got["far"].moran_i, got["far"].p_value) == (0, None, None)
    assert (got["flat"].n, got["flat"].moran_i, got["flat"].p_value) == (4, None, None)


def test_paired_t(spark):
    df = spark.createDataFrame([(1.0, 0.2), (2.5, 1.0), (3.0, 2.9), (4.1, 3.0), (None, 1.0)], "a double, b double")
    out = pairs.paired_t_test(df, "a", "b")
    d = np.array([0.8, 1.5, 0.1, 1.1])
    t = d.mean() / (d.std(ddof=1) / 2)
    assert out["t"] == pytest.approx(t) and out["df"] == 3
    assert out["low"] < out["mean_diff"] < out["high"]


@pytest.mark.parametrize(("t", "df", "p"), [(2.0, 10, 0.0733880), (1.0, 1, 0.5), (2.5706, 5, 0.05), (3.1824, 3, 0.05)])
def test_student_t_tail(t, df, p):
    assert solve.t_two_sided(t, df) == pytest.approx(p, abs=1e-5)
    assert solve.t_quantile(1 - p / 2, df) == pytest.approx(t, abs=1e-3)
