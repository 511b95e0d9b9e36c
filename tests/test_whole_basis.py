"""The radial basis has a knot at every distinct position, however many there are."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.stats import smooth
from fieldspark.verify import analyses  # noqa: F401  (importing registers the queries)
from fieldspark.verify.registry import REGISTRY, oracle_text


@pytest.mark.parametrize("n", [1, 3, 60, 61, 150])
def test_spatial_basis_knows_no_largest_number_of_positions(spark, n):
    rng = np.random.default_rng(n)
    spots = rng.uniform(0, 9, (n, 2))
    rows = [(f"s{i}", float(x), float(y), 1.0) for i, (x, y) in enumerate(spots)]
    rows += [("twin", *rows[0][1:3], 1.0), ("other", 99.0, 99.0, 0.0)]
    df = spark.createDataFrame(rows, "SITE string, X double, Y double, in_nord double")
    got = {(r.SITE, r.knot): r.value for r in REGISTRY["spatial_basis"].build(SimpleNamespace(planar=df)).collect()}
    knots = np.array(sorted(map(tuple, spots)))
    gaps = np.sqrt(((knots[:, None] - knots[None]) ** 2).sum(2))
    scale = gaps.max() or 1.0
    want = {}
    for name, x, y, inside in rows:
        d = np.sqrt(((knots - [x, y]) ** 2).sum(1)) / scale
        want |= {(name, i + 1): v for i, v in enumerate((1 + d) * np.exp(-d)) if inside}
    assert len(got) == (n + 1) * n and got == pytest.approx(want, abs=1e-9)


def test_no_position_no_row(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 0.0)], "SITE string, X double, Y double, in_nord double")
    assert REGISTRY["spatial_basis"].build(SimpleNamespace(planar=df)).count() == 0


def test_largest_distance_in_blocks(monkeypatch):
    spots = np.random.default_rng(2).normal(size=(50, 2))
    whole = smooth.build_basis(smooth.Smooth("X", "Y", "b", 6), spots).scale
    monkeypatch.setattr(smooth, "BLOCK", 120)
    assert smooth.build_basis(smooth.Smooth("X", "Y", "b", 6), spots).scale == whole
    assert whole == pytest.approx(np.sqrt(((spots[:, None] - spots[None]) ** 2).sum(2)).max())


def test_the_sql_has_no_largest_number_either():
    assert "<= 60" not in oracle_text(REGISTRY["spatial_basis"])
