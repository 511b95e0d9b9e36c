"""Variance ratios and smoothing parameters against dense likelihoods."""

import itertools
import math

import numpy as np
import pytest

from fieldspark.stats import mixed, smooth, solve


def two_surfaces(seed, height, noise, n=120, k=8):
    """Cross products of an intercept and two surfaces, with the dense design behind them."""
    rng = np.random.default_rng(seed)
    spots = rng.uniform(0, 10, (n, 2))
    inside = [(rng.uniform(size=n) < 0.5).astype(float) for _ in range(2)]
    y = sum(i * height * np.sin(spots[:, 0]) for i in inside) + rng.normal(0, noise, n)
    columns, bases = [np.ones((n, 1))], []
    for j, by in enumerate(inside):
        basis = smooth.build_basis(smooth.Smooth("x", "y", f"b{j}", k), spots[by == 1][: k + 6])
        gaps = np.sqrt(((spots[:, None] - basis.knots[None]) ** 2).sum(2)) / basis.scale
        raw = np.column_stack([np.ones(n), (spots - basis.centre) / basis.scale, smooth.radial(gaps, basis.smooth.kind)])
        columns.append(raw * by[:, None] @ basis.transform)
        bases.append(basis)
    design = np.column_stack([*columns, y])
    return smooth.SmoothStats([()], bases, design.T @ design, n), design


def dense_criterion(stats, design, logs, method):
    """-2 log likelihood of y with V = I + sum_j Z_j (lambda_j S_j)^-1 Z_j', by dense algebra on the rows."""
    n, scale = stats.n, 1 / np.sqrt(np.diag(stats.cross)[:-1])
    columns, y = design[:, :-1] * scale, design[:, -1]
    V, free, at = np.eye(n), [0], 1
    for basis, log in zip(stats.bases, logs, strict=True):
        width = len(basis.penalty)
        bent = list(range(at + 3, at + width))
        s = basis.penalty[3:, 3:] * np.outer(scale[bent], scale[bent])
        s = s / (np.trace(s) / len(bent))
        V += columns[:, bent] @ np.linalg.solve(math.exp(log) * s, columns[:, bent].T)
        free += list(range(at, at + 3))
        at += width
    X, W = columns[:, free], np.linalg.inv(V)
    inner = X.T @ W @ X
    r = y - X @ np.linalg.solve(inner, X.T @ W @ y)
    dof = n - len(free) if method == "REML" else n
    logdet = np.linalg.slogdet(V)[1] + (np.linalg.slogdet(inner)[1] if method == "REML" else 0.0)
    return logdet + dof * (math.log(2 * math.pi * float(r @ W @ r) / dof) + 1)


@pytest.mark.parametrize("method", ["ML", "REML"])
@pytest.mark.parametrize("seed, height, noise", [(1, 1.0, 0.3), (2, 0.0, 1.0), (3, 2.0, 0.05), (4, 0.3, 0.5)])
def test_smoothing_parameters_beat_a_dense_grid(seed, height, noise, method):
    stats, design = two_surfaces(seed, height, noise)
    fit = smooth.fit_smooth(stats, "y", [()], method)
    assert fit.converged
    logs = np.log(fit.lambdas)
    if not fit.boundary:
        assert fit.criterion == pytest.approx(dense_criterion(stats, design, logs, method), abs=1e-6)
    line = np.linspace(-10, 18, 15)
    grid = min(dense_criterion(stats, design, p, method) for p in itertools.product(line, line))
    assert fit.criterion <= grid + 1e-6
    assert bool(fit.boundary) == any(log > 5 for log in logs)
    for j, step in itertools.product(range(2), (-0.01, 0.01)):
        near = logs + step * np.eye(2)[j]
        assert dense_criterion(stats, design, np.minimum(near, 18), method) >= fit.criterion - 1e-6


def test_newton_leaves_saddles_holds_ends_and_reports_failure():
    def wells(x):  # saddle at 0, minima at (+-1, 0)
        value = (x[0] ** 2 - 1) ** 2 + x[1] ** 2
        return value, np.array([4 * x[0] * (x[0] ** 2 - 1), 2 * x[1]]), np.diag([12 * x[0] ** 2 - 4, 2.0])

    box = np.full(2, 5.0)
    found = solve.newton(wells, np.array([0.0, 1.0]), -box, box)
    assert found.converged and abs(found.point[0]) == pytest.approx(1) and found.curvature > 0 and not found.edge.any()
    slope = lambda x: (float(x[0]), np.ones(1), np.zeros((1, 1)))
    held = solve.newton(slope, np.array([2.0]), np.array([-3.0]), np.array([3.0]))
    assert held.converged and held.point[0] == -3 and held.edge.all()
    assert not solve.newton(wells, np.array([9.0, 9.0]), -10 * box, 10 * box, limit=1).converged
    nowhere = lambda x: (math.inf, np.zeros(1), np.zeros((1, 1)))
    assert not solve.newton(nowhere, np.zeros(1), -np.ones(1), np.ones(1)).converged


def test_differences_match_exact_derivatives():
    fn = lambda x: math.exp(x[0]) * math.sin(x[1]) + x[0] ** 3
    value, gradient, hessian = solve.differences(fn)(np.array([0.3, 0.7]))
    e, s, c = math.exp(0.3), math.sin(0.7), math.cos(0.7)
    assert value == fn([0.3, 0.7]) and gradient == pytest.approx([e * s + 0.27, e * c], abs=1e-8)
    assert hessian == pytest.approx(np.array([[e * s + 1.8, e * c], [e * c, -e * s]]), abs=1e-3)


def crossed(spark, deviation, seed=3):
    rng = np.random.default_rng(seed)
    sites, years = rng.normal(0, deviation, 12), rng.normal(0, 0.7, 4)
    rows = []
    for i in range(300):
        g, t, x = int(rng.integers(12)), int(rng.integers(4)), float(rng.normal())
        rows.append((f"s{g:02d}", str(2000 + t), x, float(1 + x + sites[g] + years[t] + rng.normal())))
    return spark.createDataFrame(rows, "site string, year string, x double, y double"), rows


def dense_mixed(rows, ts, tt):
    X, y = np.array([[1.0, r[2]] for r in rows]), np.array([r[3] for r in rows])
    marks = lambda at: np.array([[r[at] == v for v in sorted({q[at] for q in rows})] for r in rows], float)
    Zs, Zt = marks(0), marks(1)
    V = np.eye(len(y)) + ts**2 * Zs @ Zs.T + tt**2 * Zt @ Zt.T
    W = np.linalg.inv(V)
    r = y - X @ np.linalg.solve(X.T @ W @ X, X.T @ W @ y)
    return np.linalg.slogdet(V)[1] + len(y) * (1 + math.log(2 * math.pi * float(r @ W @ r) / len(y)))


def test_extreme_group_ratio_widens_the_range(spark):
    df, rows = crossed(spark, 2000.0)
    terms = [(), ("x",)]
    narrow = mixed.fit_mixed(mixed.collect_stats(df, "y", terms, "site", "year"), terms, "site", "year")
    assert "site" in narrow.boundary  # the first range ends below the ratio
    source = mixed.StatsSource(df, "y", terms, "site", "year")
    fit = source.fit(terms)
    (stats,) = source.cache.values()
    assert fit.converged and fit.boundary == () and 500 < fit.theta[0] < 8000 and stats.node_error <= mixed.NODE_ERROR
    assert fit.deviance == pytest.approx(dense_mixed(rows, *fit.theta), rel=1e-8)
    for a, b in ((1.02, 1), (1 / 1.02, 1), (1, 1.02), (1, 1 / 1.02)):
        assert dense_mixed(rows, fit.theta[0] * a, fit.theta[1] * b) >= fit.deviance - 1e-6
    assert fit.summary()["converged"] is True and fit.summary()["boundary"] == ""


def test_interpolation_error_is_measured_between_the_nodes():
    nodes, between = mixed.chebyshev_nodes(-18.0, 10.0)
    few, middle = mixed.chebyshev_nodes(-18.0, 10.0, 2.0)
    sums = lambda points: np.array([[[math.exp(p) / (1 + math.exp(p) * n) for n in (1, 50)]] for p in points]).sum(-1, keepdims=True)
    assert mixed.interpolation_error(nodes, sums(nodes), between, sums(between)) <= mixed.NODE_ERROR
    assert mixed.interpolation_error(few, sums(few), middle, sums(middle)) > 1e-4
