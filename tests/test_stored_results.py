"""Stored models and bundles, Student's t as columns, landmarks, comparisons of selections, and the entry without its optional parts."""

import math
import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import distributions
from fieldspark.functions.nulls import missing
from fieldspark.plans import models
from fieldspark.sources import io
from fieldspark.stats import linear, mixed, pairs, smooth, solve, store

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def mixed_rows(spark, seed=3, n=240):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        site, year, x = f"s{i % 12}", f"{2000 + i % 5}", float(rng.normal())
        rows.append((site, year, x, None if i % 17 == 0 else float(rng.normal()), 1 + 2 * x + (i % 12) * 0.3 + float(rng.normal())))
    return spark.createDataFrame(rows, "SITE string, year string, x double, u double, y double")


def test_models_come_back_as_fits(spark, tmp_path):
    df = mixed_rows(spark)
    source = mixed.StatsSource(df, "y", [(), ("x",)], "SITE", "year")
    fits = {"lmm": source.fit([(), ("x",)], reml=True), "ols": linear.fit_linear(df, ["y"], [(), ("x",), ("x", "x")]).fits["y"]}
    store.write_models(spark, fits, str(tmp_path / "models"))
    back = store.load_models(spark, str(tmp_path / "models"))
    assert set(back) == {"lmm", "ols"} and type(back["lmm"]) is mixed.MixedFit and type(back["ols"]) is linear.LinearFit
    for name, fit in fits.items():
        assert back[name].terms == fit.terms and (back[name].beta == fit.beta).all() and np.array_equal(back[name].cov, fit.cov)
        was, now = (linear.with_band(df, f).select("fit", "lwr", "upr").orderBy("fit", "lwr").collect() for f in (fit, back[name]))
        assert was == now
    assert back["lmm"].aic == fits["lmm"].aic and back["lmm"].r2_conditional == fits["lmm"].r2_conditional
    was, now = (sorted(mixed.group_effects(df, f).collect()) for f in (fits["lmm"], back["lmm"]))
    assert [r.SITE for r in was] == [r.SITE for r in now] and [r.effect for r in was] == pytest.approx([r.effect for r in now], abs=1e-12)
    assert list(store.load_linear(spark, str(tmp_path / "models")).fits) == ["y"]


def test_bundles_are_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "bundle")
    frame = lambda v: spark.createDataFrame([(v,)], "v int")
    with pytest.raises(ValueError, match="no bundle"):
        io.read_bundle(spark, path)
    io.write_bundle({"a": frame(1), "b": frame(1)}, path)
    broken = frame(2).withColumn("v", F.raise_error(F.lit("stopped")).cast("int"))
    with pytest.raises(Exception, match="stopped"):
        io.write_bundle({"a": frame(2), "b": broken}, path)
    assert {n: f.first().v for n, f in io.read_bundle(spark, path).items()} == {"a": 1, "b": 1}
    io.write_bundle({"a": frame(3)}, path)
    assert {n: f.first().v for n, f in io.read_bundle(spark, path).items()} == {"a": 3}
    with pytest.raises(ValueError, match="not in the bundle: b"):
        io.read_bundle(spark, path, ["a", "b"])
    assert len(io.remove_former(spark, path)) == 2 and io.remove_former(spark, path) == []
    assert io.read_bundle(spark, path, ["a"])["a"].first().v == 3


def test_student_t_columns(spark):
    cases = [(0.0, 3), (2.0, 10), (-1.0, 1), (12.706, 1), (0.3, 250), (5.0, 4), (1.96, 100_000), (40.0, 7)]
    df = spark.createDataFrame([(t, n) for t, n in cases] + [(None, 4), (1.0, 0)], "t double, n int")
    got = df.select("t", "n", distributions.t_two_sided(F.col("t"), F.col("n")).alias("p"), distributions.t_quantile(0.975, F.col("n")).alias("q")).collect()
    for r in got[: len(cases)]:
        u = np.linspace(0, math.atan(abs(r.t) / math.sqrt(r.n)), 200_001)  # t = sqrt(n) tan u: the density is proportional to cos(u)**(n - 1)
        whole = np.linspace(0, math.pi / 2, 200_001)
        area = lambda x: np.trapezoid(np.cos(x) ** (r.n - 1), x)  # noqa: B023, E731
        assert r.p == pytest.approx(1 - area(u) / area(whole), abs=1e-8)
        assert solve.t_two_sided(r.q, r.n) == pytest.approx(0.05, abs=1e-9)
    assert got[-2].p is None and got[-1].p is None and got[-1].q is None
    gamma = df.limit(1).select(*[distributions.log_gamma(F.lit(z)).alias(f"g{i}") for i, z in enumerate((0.5, 1.0, 3.7, 5e5))]).first()
    assert list(gamma) == pytest.approx([math.lgamma(z) for z in (0.5, 1.0, 3.7, 5e5)], rel=1e-13, abs=1e-13)


def test_paired_test_frame(spark):
    df = spark.createDataFrame([(1.0, 0.2), (2.5, 1.0), (3.0, 2.9), (4.1, 3.0), (None, 1.0)], "a double, b double")
    r = pairs.paired_test(df, "a", "b").first()
    assert r.p_value == pytest.approx(solve.t_two_sided(r.t, 3)) and r.high - r.mean_diff == pytest.approx(solve.t_quantile(0.975, 3) * r.se)
    alone = pairs.paired_test(df.limit(1), "a", "b").first()
    assert alone.n == 1 and alone.p_value is None and alone.low is None
    assert pairs.paired_test(df.limit(0), "a", "b").first().n == 0


def spots(seed=8, n=700):
    rng = np.random.default_rng(seed)
    return [(float(x), float(y), 1.0) for x, y in rng.normal(size=(n, 2)) * [10, 3]]


def test_landmarks_ignore_order_and_repetition(spark):
    rows, surface = spots(), smooth.Smooth("X", "Y", "b", 6)
    frame = lambda r: spark.createDataFrame(r, "X double, Y double, b double")
    one = smooth.choose_knots(frame(rows), surface)
    assert one.shape == (smooth.LANDMARKS * 6, 2)
    other = frame(rows[::-1] + rows[:350] + [(99.0, 99.0, 0.0), (None, 1.0, 1.0)]).repartition(7)
    assert np.allclose(one, smooth.choose_knots(other, surface), atol=1e-9)
    few = smooth.choose_knots(frame(rows[:24]), surface)
    assert sorted(map(tuple, few)) == sorted((x, y) for x, y, _ in rows[:24])
    # k-means of all positions: a plain version from the same start
    points = np.array([r[:2] for r in rows])
    low, size = points.min(0), np.ptp(points, axis=0).max()
    cell = np.minimum(np.floor((points - low) / size * smooth.GRID), smooth.GRID - 1)
    means = np.array(sorted(tuple(points[(cell == c).all(1)].mean(0)) for c in np.unique(cell, axis=0)))
    plain = smooth.farthest_points(means, len(one))
    for _ in range(smooth.ROUNDS):
        nearest = ((points[:, None] - plain[None]) ** 2).sum(2).argmin(1)
        plain = np.array([points[nearest == i].mean(0) if (nearest == i).any() else plain[i] for i in range(len(plain))])
    assert np.allclose(np.array(sorted(map(tuple, plain))), np.array(sorted(map(tuple, one))), atol=1e-6)


@pytest.mark.parametrize("kind", ["thinplate", "matern"])
def test_truncated_basis_equals_dense_kernel(spark, kind):
    """All positions are landmarks: the basis spans the k strongest directions of the dense kernel that are orthogonal to the trend."""
    rows, surface = spots(n=24), smooth.Smooth("X", "Y", "b", 6, kind)
    df = spark.createDataFrame(rows, "X double, Y double, b double")
    basis = smooth.build_basis(surface, smooth.choose_knots(df, surface))
    knots = basis.knots
    gap = np.sqrt(((knots[:, None] - knots[None]) ** 2).sum(2))
    kernel = smooth.radial(gap / gap.max(), kind)
    values, vectors = np.linalg.eigh(kernel)
    strong = np.argsort(-np.abs(values))[:6]
    trend = np.column_stack([np.ones(24), knots])
    free = basis.transform[3:, 3:]
    assert free.shape == (24, 3) and np.allclose(trend.T @ free, 0, atol=1e-8) and np.allclose(free.T @ free, np.eye(3), atol=1e-9)
    assert np.allclose(vectors[:, strong] @ vectors[:, strong].T @ free, free, atol=1e-9)
    raw = np.array([list(r) for r in df.orderBy("X", "Y").select(*smooth.basis_columns(basis)).collect()])
    assert np.allclose(raw[:, 3:], kernel[np.lexsort((knots[:, 1], knots[:, 0]))], atol=1e-9)


def test_selections_compared(spark):
    rows = [("all", "climate", 1, "a", True), ("all", "climate", 2, "b", False), ("all", "climate", 3, "c", True), ("all", "human", 1, "h", False)]
    same = rows + [("sub", r, i, c, k) for _, r, i, c, k in rows]
    other = rows + [("sub", "climate", 1, "c", True), ("sub", "climate", 2, "a", True), ("sub", "human", 1, "h", True)]
    frame = lambda r: spark.createDataFrame(r, "dataset string, round string, step int, cand string, kept boolean")
    show = lambda r: sorted(map(tuple, models.compare_selections(frame(r), "all", "sub").select("round", "n_left", "n_right", "same").collect()))
    assert show(same) == [("climate", 2, 2, True), ("human", 0, 0, True)]
    assert show(other) == [("climate", 2, 2, False), ("human", 0, 1, False)]
    left = models.unselected(frame(rows), ["dataset", "round"]).collect()
    assert sorted(map(tuple, left)) == [("all", "climate", "b"), ("all", "human", "h")]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, None)], "x double, s string")
    assert [r[0] for r in df.select(missing(df, "x")).collect()] == [False, True, True]
    assert [r[0] for r in df.select(missing(df, "s")).collect()] == [False, False, True]
    rows = mixed_rows(spark).withColumn("u", F.coalesce("u", F.lit(float("nan"))))
    source = mixed.StatsSource(rows, "y", [(), ("x",), ("u",)], "SITE", "year", "common")
    assert source.fit([(), ("x",)]).n == rows.where("NOT isnan(u)").count()
    got = {r.SITE: r.effect for r in source.effects(source.fit([(), ("x",)])).collect()}
    want = {r.SITE: r.effect for r in mixed.group_effects(rows.where("NOT isnan(u)"), source.fit([(), ("x",)])).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("lost", ["folders", "packages"])
def test_entry_without_optional_parts(tmp_path, lost):
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns(".git", "__pycache__", *(["llm"] if lost == "folders" else []))
    shutil.copytree(ROOT, copy, ignore=skip)
    block = "" if lost == "folders" else "import sys\nfor name in ('regex', 'xxhash', 'public_tokenizers', 'tiktoken'):\n    sys.modules[name] = None\n"
    code = f"{block}import __spark_entry__ as e\nassert 'climatology' in e.queries() and 'climatology' in e.oracle_sql()\nassert not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, env={**os.environ, "PYTHONPATH": ""}).returncode == 0
