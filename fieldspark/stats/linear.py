"""Least squares: several responses from one pass, predictions, bands, simple regression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distributions import t_two_sided
from ..functions.nulls import missing, ratio
from ..operators.joins import equi_join
from ..sources.schemas import COEFFICIENTS
from .design import Gram, Term, gram, term_column, term_name, terms_product
from .solve import independent_columns

__all__ = ["FittedModels", "LinearFit", "fit_linear", "predict", "predict_column", "simple_regression", "terms_product"]


@dataclass
class LinearFit:
    """Coefficients of one response (0 for dropped dependent columns)."""

    response: str
    terms: list[Term]
    beta: np.ndarray
    cov: np.ndarray
    sigma2: float
    n: int
    r2: float


@dataclass
class FittedModels:
    fits: dict[str, LinearFit]

    def coefficients(self, spark: SparkSession) -> DataFrame:
        rows = [
            (fit.response, term_name(t), float(b), float(s))
            for fit in self.fits.values()
            for t, b, s in zip(fit.terms, fit.beta, np.sqrt(np.diag(fit.cov)), strict=True)
        ]
        return spark.createDataFrame(rows, COEFFICIENTS)


def solve_response(g: Gram, k: int) -> LinearFit:
    p = g.p
    xtx, xty, yty = g.matrix[:p, :p], g.matrix[:p, p + k], g.matrix[p + k, p + k]
    keep = independent_columns(xtx)
    scale = 1 / np.sqrt(np.diag(xtx)[keep])
    inverse = np.linalg.inv(xtx[np.ix_(keep, keep)] * np.outer(scale, scale)) * np.outer(scale, scale)
    beta = np.zeros(p)
    beta[keep] = inverse @ xty[keep]
    rss = float(yty - 2 * beta @ xty + beta @ xtx @ beta)
    sigma2 = rss / (g.n - len(keep))
    cov = np.zeros((p, p))
    cov[np.ix_(keep, keep)] = sigma2 * inverse
    total = float(yty - xty[0] ** 2 / g.n) if g.terms[0] == () else float(yty)
    return LinearFit(g.responses[k], g.terms, beta, cov, sigma2, g.n, 1 - rss / total if total else float("nan"))


def fit_linear(df: DataFrame, responses: Sequence[str], terms: Sequence[Term]) -> FittedModels:
    """Fit every response on the same terms.

    One pass serves all responses; responses with nulls of their own get a
    second, separate pass because rows are dropped per model.
    """
    nulls = df.agg(*[F.count_if(missing(df, r)).alias(r) for r in responses]).first()
    whole = [r for r in responses if nulls[r] == 0]
    fits: dict[str, LinearFit] = {}
    if whole:
        shared = gram(df, terms, whole)
        fits.update({r: solve_response(shared, k) for k, r in enumerate(whole)})
    for r in responses:
        if r not in fits:
            fits[r] = solve_response(gram(df, terms, [r]), 0)
    return FittedModels({r: fits[r] for r in responses})


def linear_combination(terms: Sequence[Term], beta: Sequence[float]) -> Column:
    parts = [F.lit(float(b)) * term_column(t) if t else F.lit(float(b)) for t, b in zip(terms, beta, strict=True)]
    return reduce(Column.__add__, parts)


def predict_column(fit) -> Column:
    return linear_combination(fit.terms, fit.beta)


def predict(df: DataFrame, models: FittedModels, name: str = "{}_pred") -> DataFrame:
    """Add a prediction column per response."""
    return df.withColumns({name.format(r): predict_column(fit) for r, fit in models.fits.items()})


def residuals(df: DataFrame, models: FittedModels, name: str = "{}_res") -> DataFrame:
    return df.withColumns({name.format(r): F.col(r) - predict_column(fit) for r, fit in models.fits.items()})


def with_band(df: DataFrame, fit, z: float = 1.96) -> DataFrame:
    """Fixed-effect fit and its pointwise 95 % band: fit -+ z * sqrt(x'Vx)."""
    p = len(fit.terms)
    columns = [term_column(t) for t in fit.terms]
    quadratic: Column = reduce(
        Column.__add__,
        [columns[i] * columns[j] * F.lit(float(fit.cov[i, j]) * (1 if i == j else 2)) for i in range(p) for j in range(i, p)],
    )
    half = F.sqrt(F.greatest(quadratic, F.lit(0.0))) * F.lit(z)
    out = df.withColumn("fit", predict_column(fit))
    return out.withColumns({"lwr": F.col("fit") - half, "upr": F.col("fit") + half})


def simple_regression(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope, standard error, t and R-squared of y on x, per group, with Spark's own regression aggregates."""
    stats = df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("__sxx"),
        F.regr_sxy(y, x).alias("__sxy"),
        F.regr_syy(y, x).alias("__syy"),
    )
    rss = F.col("__syy") - ratio(F.col("__sxy") * F.col("__sxy"), F.col("__sxx"))
    se = F.sqrt(ratio(ratio(F.greatest(rss, F.lit(0.0)), F.col("n") - 2), F.col("__sxx")))
    return stats.withColumn("se", se).withColumn("t", ratio(F.col("slope"), F.col("se"))).drop("__sxx", "__sxy", "__syy")


def regression_test(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """``simple_regression`` with the two-sided p-value of the slope (n - 2 degrees of freedom)."""
    stats = simple_regression(df, y, x, by)
    return stats.withColumn("p_value", t_two_sided(F.col("t"), F.col("n") - 2))


def regression_residuals(df: DataFrame, y: str, x: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Residuals of a simple regression, per group, without leaving Spark."""
    fit = simple_regression(df, y, x, by).select(*by, F.col("intercept").alias("__a"), F.col("slope").alias("__b"))
    if by:
        joined = equi_join(df, fit, list(by), "left")
    else:
        row = fit.select(F.struct("__a", "__b").alias("fit")).scalar()
        joined = df.withColumn("__fit", row).withColumns({"__a": F.col("__fit.__a"), "__b": F.col("__fit.__b")}).drop("__fit")
    return joined.withColumn(name, F.col(y) - F.col("__a") - F.col("__b") * F.col(x)).drop("__a", "__b")
