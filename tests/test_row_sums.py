"""The rows of a mixed-model selection are summed once, whatever columns its models drop rows for."""

import numpy as np
import pytest

from fieldspark.stats import design, mixed

TERMS = [(), ("x",), ("u",), ("w",), ("u", "w")]


@pytest.fixture
def holes(spark):
    rng, rows = np.random.default_rng(5), []
    for i in range(300):
        x, u, w = (float(v) for v in rng.normal(size=3))
        y = 1 + x + 0.4 * u - 0.3 * w + (i % 11) * 0.2 + float(rng.normal())
        rows.append((f"s{i % 11}", f"{2000 + i % 4}", x, None if i % 7 == 0 else u, float("nan") if i % 5 == 0 else w, None if i % 31 == 0 else y))
    return spark.createDataFrame(rows, "SITE string, year string, x double, u double, w double, y double")


@pytest.mark.parametrize("policy", ["per_model", "common"])
def test_one_pass_serves_every_set_of_complete_rows(holes, monkeypatch, policy):
    passes, gram_rows = [], mixed.gram_rows
    monkeypatch.setattr(mixed, "gram_rows", lambda *a: passes.append(1) or gram_rows(*a))
    source = mixed.StatsSource(holes, "y", TERMS, "SITE", "year", policy)
    asked = ([()], [(), ("x",)], [(), ("u",)], [(), ("x",), ("w",)], TERMS)
    fits = [source.fit(t) for t in asked]
    assert len(passes) == 1
    for terms, fit in zip(asked, fits, strict=True):
        columns = ["x", "u", "w"] if policy == "common" else sorted(design.term_columns(terms))
        rows = holes.dropna(subset=["y", *columns])
        plain = mixed.fit_mixed(mixed.collect_stats(rows.select("SITE", "year", "y", *sorted(design.term_columns(terms))), "y", terms, "SITE", "year"), terms, "SITE", "year")
        assert fit.n == rows.count() == plain.n
        assert fit.deviance == pytest.approx(plain.deviance, abs=1e-7) and fit.beta == pytest.approx(plain.beta, abs=1e-6)


def test_matrices_by_label_survive_being_let_go(spark, monkeypatch):
    monkeypatch.setattr(design, "HELD", 2)
    df = spark.range(0, 500, numPartitions=3).selectExpr("concat('p', id % 5) AS label", "cast(id AS double) AS a", "cast(id % 3 AS double) AS b")
    got = {(r.label, r.i): (r.g0, r.g1, r.g2) for r in design.gram_rows(df, ["a", "b"], "label").collect()}
    pdf = df.toPandas()
    for label, part in pdf.groupby("label"):
        block = np.column_stack([part.a, part.b, np.ones(len(part))])
        for i, row in enumerate(block.T @ block):
            assert got[label, i] == pytest.approx(tuple(row))
    assert len(got) == 15
