"""Fitted models as tables: written, and read back as fits that predict.

Format 1 is a bundle (``sources.io``) of four tables: ``models`` (kind, sizes and
scalars), ``terms`` (in order, with estimates), ``covariance`` (of the estimates)
and ``levels`` (year effects). Tables are as long as the models have terms, so
they pass through the driver as fits do.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from ..sources.io import read_bundle, write_bundle
from .linear import FittedModels, LinearFit
from .mixed import MixedFit

FORMAT = 1
MODELS = "model string, format int, kind string, response string, n long, names map<string,string>, scalars map<string,double>"
TERMS = "model string, position int, term array<string>, estimate double"
COVARIANCE = "model string, i int, j int, value double"
LEVELS = "model string, position int, level string, effect double"
MIXED = ["sigma2", "group_var", "year_var", "deviance", "fixed_var"]
MEMBERS = ["models", "terms", "covariance", "levels"]


def write_models(spark: SparkSession, fits: dict[str, LinearFit | MixedFit], path: str) -> None:
    """Store named fits together; readers see all of them or those stored before."""
    models, terms, covariance, levels = [], [], [], []
    for name, fit in fits.items():
        if isinstance(fit, MixedFit):
            scalars = {s: float(getattr(fit, s)) for s in MIXED} | {"theta_group": float(fit.theta[0]), "theta_year": float(fit.theta[1]), "rank": float(fit.rank), "reml": float(fit.reml), "converged": float(fit.converged)}
            scalars |= {"end_group": float(fit.group in fit.boundary), "end_year": float(fit.year in fit.boundary)}
            models.append((name, FORMAT, "mixed", fit.response, int(fit.n), {"group": fit.group, "year": fit.year}, scalars))
            levels += [(name, i, y, float(e)) for i, (y, e) in enumerate(zip(fit.years, fit.year_effects, strict=True))]
        else:
            models.append((name, FORMAT, "linear", fit.response, int(fit.n), {}, {"sigma2": float(fit.sigma2), "r2": float(fit.r2)}))
        terms += [(name, i, list(t), float(b)) for i, (t, b) in enumerate(zip(fit.terms, fit.beta, strict=True))]
        covariance += [(name, i, j, float(v)) for i, row in enumerate(fit.cov) for j, v in enumerate(row)]
    tables = zip(MEMBERS, (models, terms, covariance, levels), (MODELS, TERMS, COVARIANCE, LEVELS), strict=True)
    write_bundle({member: spark.createDataFrame(rows, schema) for member, rows, schema in tables}, path)


def load_models(spark: SparkSession, path: str) -> dict[str, LinearFit | MixedFit]:
    """The fits stored at ``path``, by name. Another format is an error."""
    stored = {member: frame.collect() for member, frame in read_bundle(spark, path, MEMBERS).items()}
    out: dict[str, LinearFit | MixedFit] = {}
    for m in stored["models"]:
        if m.format != FORMAT:
            raise ValueError(f"model format {m.format}, expected {FORMAT}")
        rows = sorted((r for r in stored["terms"] if r.model == m.model), key=lambda r: r.position)
        terms, beta = [tuple(r.term) for r in rows], np.array([r.estimate for r in rows])
        cov = np.zeros((len(rows),) * 2)
        for r in stored["covariance"]:
            if r.model == m.model:
                cov[r.i, r.j] = r.value
        s = m.scalars
        if m.kind == "linear":
            out[m.model] = LinearFit(m.response, terms, beta, cov, s["sigma2"], m.n, s["r2"])
            continue
        years = sorted((r for r in stored["levels"] if r.model == m.model), key=lambda r: r.position)
        ends = tuple(m["names"][k] for k in ("group", "year") if s.get(f"end_{k}"))
        out[m.model] = MixedFit(
            m.response, m["names"]["group"], m["names"]["year"], terms, beta, cov, s["sigma2"], s["group_var"], s["year_var"],
            (s["theta_group"], s["theta_year"]), s["deviance"], m.n, bool(s["reml"]), [r.level for r in years],
            np.array([r.effect for r in years]), s["fixed_var"], int(s["rank"]),
            bool(s.get("converged", 1.0)), ends,
        )
    return out


def load_linear(spark: SparkSession, path: str) -> FittedModels:
    """Stored linear fits by response, as ``fit_linear`` returned them."""
    return FittedModels({fit.response: fit for fit in load_models(spark, path).values() if isinstance(fit, LinearFit)})
