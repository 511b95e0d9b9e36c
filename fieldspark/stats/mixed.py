"""Linear mixed model with two crossed random intercepts (group and year).

y = X beta + b_group + c_year + e. The likelihood for given variance ratios
needs only cross products of X and y, sums per year, and one sum over groups,

    A(l) = sum_g  l / (1 + l n_g) * w_g w_g',   w_g = [rows per year; sums of X; sum of y],

with l the squared relative deviation of the group effect. A(l) is smooth in
log l, so ONE distributed pass over the group table evaluates it at Chebyshev
nodes and every later evaluation interpolates. The driver therefore holds a few
small matrices whose size depends on the number of columns and years, never on
the number of rows or groups, and trying another set of terms costs no job.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import missing
from ..operators.joins import group_effect
from ..sources.io import materialise
from ..sources.schemas import COEFFICIENTS
from .design import Term, gram_rows, term_column, term_columns, term_name
from .linear import predict_column
from .solve import Optimum, differences, independent_columns, newton

MAX_YEARS = 2000  # a year effect has as many levels as the calendar has years
# Logarithm of the group variance ratio: upper end of its first range, what a wider one adds, and the widest.
TOP, WIDER, WIDEST = 10.0, 12.0, 34.0
# Digits aimed at by the nodes, largest error of an interpolated group sum, and the range of the logarithm of the year deviation.
NODE_DIGITS, NODE_ERROR, YEAR_LIMIT = 14.0, 1e-12, 15.0
# Step of the differences, and relative error of the cross products and interpolated sums.
STEP, ROUNDING = 1e-2, 1e-14
# Column of stored sums that tells which of the nullable columns their rows lack: 1 for each of them.
GAPS = "__gaps"


@dataclass
class MixedStats:
    """Everything the likelihood needs about one set of rows."""

    terms: list[Term]
    response: str
    n: int
    groups: int
    cross: np.ndarray
    years: list[str]
    year_n: np.ndarray
    year_sums: np.ndarray
    nodes: np.ndarray
    group_sums: np.ndarray
    group_logdet: np.ndarray
    node_error: float = 0.0  # measured between the nodes

    def positions(self, terms: Sequence[Term]) -> list[int]:
        place = {t: i for i, t in enumerate(self.terms)}
        return [place[t] for t in terms]


def cell_sums(frame: DataFrame, group: str, year: str, columns: Sequence[str]) -> DataFrame:
    """Rows and column sums per group and year."""
    return frame.groupBy(group, year).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in columns]
    )


def year_levels(df: DataFrame, year: str) -> list[str]:
    """The years that occur, as many as the calendar has (checked)."""
    rows = df.select(year).dropna().distinct().limit(MAX_YEARS + 1).collect()
    if len(rows) > MAX_YEARS:
        raise ValueError(f"more than {MAX_YEARS} levels of {year}")
    return sorted(r[0] for r in rows)


class RowSums:
    """Cross products and sums per group of all rows, kept apart by which of the nullable columns a row lacks.

    Two jobs over the rows, each combining partially before the shuffle, so a
    group with a third of all rows costs no more than any other. Both results are
    stored; what a model needs, whatever columns it drops rows for, is a sum over
    some of their rows, as many as groups and kinds of gaps. A missing value
    counts as zero in terms that no model asks of these rows. Rows that lack any
    other column are dropped.
    """

    def __init__(
        self, df: DataFrame, response: str, terms: Sequence[Term], group: str, year: str, years: Sequence[str], nullable: Sequence[str] = ()
    ):
        self.response, self.terms, self.group, self.years, self.nullable = response, list(terms), group, list(years), sorted(nullable)
        used = sorted(term_columns(terms) | {response, group, year})
        gaps = F.concat(F.lit(""), *[F.when(missing(df, c), "1").otherwise("0") for c in self.nullable]).alias(GAPS)
        filled = {c: F.when(~missing(df, c), F.col(c)).otherwise(F.lit(0)) for c in self.nullable}
        complete = df.select(*used).dropna(subset=[c for c in used if c not in filled])
        rows = complete.select(gaps, *[filled.get(c, F.col(c)).alias(c) for c in used])
        self.marks = [f"k{i}" for i in range(len(years))]
        columns = [*self.marks, *[f"t{i}" for i in range(len(terms))], "y0"]
        frame = rows.select(
            GAPS,
            group,
            *[(F.col(year) == y).cast("double").alias(m) for m, y in zip(self.marks, years, strict=True)],
            *[term_column(t).alias(f"t{i}") for i, t in enumerate(terms)],
            F.col(response).cast("double").alias("y0"),
        )
        self.columns = columns
        self.cross = materialise(gram_rows(frame, columns, GAPS))
        self.per_group = materialise(
            frame.groupBy(group, GAPS).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in columns])
        )

    def stats(self, terms: Sequence[Term], needed: Collection[str] = (), top: float = TOP) -> MixedStats:
        """Statistics of the rows that have all the ``needed`` columns, the nullable columns of the terms among them.

        The group sums are also taken at points between the nodes, which measures
        the error of interpolation; where it exceeds ``NODE_ERROR``, half as many
        nodes again are tried.
        """
        whole = F.col(GAPS).like("".join("0" if c in needed else "_" for c in self.nullable))
        place = {t: i for i, t in enumerate(self.terms)}
        names = [*self.marks, *[f"t{place[t]}" for t in terms], "y0"]
        at = [self.columns.index(c) for c in names]
        ends = [*at, len(self.columns)]  # with the column of ones
        found = self.cross.filter(whole & F.col("i").isin(ends)).groupBy("i").agg(*[F.sum(f"g{j}").alias(f"g{j}") for j in ends]).collect()
        where, both = {j: k for k, j in enumerate(ends)}, np.zeros((len(ends),) * 2)
        for r in found:
            both[where[r["i"]]] = [r[f"g{j}"] for j in ends]
        both, n, y = both[:-1, :-1], int(round(both[-1, -1])), len(self.marks)
        per_group = self.per_group.filter(whole).groupBy(self.group).agg(*[F.sum(c).alias(c) for c in ["rows", *names]])
        digits = NODE_DIGITS
        for _ in range(3):
            nodes, between = chebyshev_nodes(-math.log(max(n, 2)) - 12.0, top, digits)
            sums, logdet, groups = group_pass(per_group, names, np.concatenate([nodes, between]))
            k = len(nodes)
            error = interpolation_error(nodes, sums[:k], between, sums[k:])
            if error <= NODE_ERROR:
                break
            digits *= 1.5
        sums, logdet = sums[:k], logdet[:k]
        return MixedStats(
            list(terms), self.response, n, groups, both[y:, y:], self.years, np.diag(both)[:y].copy(), both[:y, y:], nodes, sums, logdet, error
        )


def collect_stats(
    df: DataFrame, response: str, terms: Sequence[Term], group: str, year: str, years: Sequence[str] | None = None, top: float = TOP
) -> MixedStats:
    """Cross products of year marks, terms and response, and their sums per group folded into A(l), of the complete rows."""
    levels = list(years) if years is not None else year_levels(df, year)
    return RowSums(df, response, terms, group, year, levels).stats(terms, top=top)


def chebyshev_nodes(low: float, high: float, digits: float = NODE_DIGITS) -> tuple[np.ndarray, np.ndarray]:
    """Nodes on the log scale, as many as the poles of the logistic at +-i*pi demand, and points half-way between some."""
    half = (high - low) / 2
    rate = math.log(math.pi / half + math.sqrt(1 + (math.pi / half) ** 2))
    count = int(math.ceil(digits * math.log(10) / rate))
    k = np.arange(count + 1)
    place = lambda at: (low + high) / 2 + half * np.cos(math.pi * at / count)
    return place(k), place(np.unique(np.linspace(0, count - 1, 8).astype(int)) + 0.5)


def interpolation_error(nodes: np.ndarray, sums: np.ndarray, between: np.ndarray, direct: np.ndarray) -> float:
    """Largest error of the interpolated sums, in units of the largest diagonals (the sums rise with the ratio)."""
    worst = 0.0
    spread = np.sqrt(np.maximum(np.diagonal(direct, axis1=1, axis2=2).max(axis=0), 0.0))
    units = np.outer(spread, spread)
    for x, want in zip(between, direct, strict=True):
        gap = np.abs(np.tensordot(barycentric(nodes, x), sums, axes=1) - want)
        worst = max(worst, float(np.max(np.divide(gap, units, out=np.zeros_like(gap), where=units > 0), initial=0.0)))
    return worst


def barycentric(nodes: np.ndarray, x: float) -> np.ndarray:
    """Interpolation weights of the nodes at x."""
    gap = x - nodes
    hit = np.argmin(np.abs(gap))
    if abs(gap[hit]) < 1e-13:
        out = np.zeros(len(nodes))
        out[hit] = 1.0
        return out
    sign = np.where(np.arange(len(nodes)) % 2 == 0, 1.0, -1.0)
    sign[0] *= 0.5
    sign[-1] *= 0.5
    w = sign / gap
    return w / w.sum()


def group_pass(wide: DataFrame, columns: list[str], nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A(l) at all nodes, the log-determinant part, and the number of groups."""
    q, k = len(columns), len(nodes)
    upper = np.triu_indices(q)
    factors = np.exp(nodes)
    names = ["cell", *[f"v{i}" for i in range(k)]]

    def fold(frames: Iterator) -> Iterator:
        import pandas as pd

        total, logs, count = np.zeros((k, q, q)), np.zeros(k), 0
        for pdf in frames:
            rows = pdf["rows"].to_numpy(dtype=float)
            block = pdf[columns].to_numpy(dtype=float)
            count += len(rows)
            for i, factor in enumerate(factors):
                total[i] += block.T @ (block * (factor / (1 + factor * rows))[:, None])
                logs[i] += np.log1p(factor * rows).sum()
        values = np.vstack([total[:, upper[0], upper[1]].T, logs[None, :], np.full((1, k), float(count))])
        out = pd.DataFrame(values, columns=names[1:])
        out.insert(0, "cell", np.arange(len(values), dtype=np.int32))
        yield out

    schema = "cell int, " + ", ".join(f"{n} double" for n in names[1:])
    partial = wide.select("rows", *columns).mapInPandas(fold, schema)
    summed = partial.groupBy("cell").agg(*[F.sum(n).alias(n) for n in names[1:]]).toArrow().sort_by("cell")
    values = np.column_stack([summed.column(n).to_numpy() for n in names[1:]])
    sums = np.zeros((k, q, q))
    sums[:, upper[0], upper[1]] = values[: len(upper[0])].T
    sums[:, upper[1], upper[0]] = values[: len(upper[0])].T
    return sums, values[-2], int(round(values[-1, 0]))


@dataclass
class MixedFit:
    response: str
    group: str
    year: str
    terms: list[Term]
    beta: np.ndarray
    cov: np.ndarray
    sigma2: float
    group_var: float
    year_var: float
    theta: tuple[float, float]
    deviance: float
    n: int
    reml: bool
    years: list[str]
    year_effects: np.ndarray
    fixed_var: float
    rank: int = field(default=0)
    converged: bool = True
    boundary: tuple[str, ...] = ()  # grouping columns whose deviation is zero or at the upper end of its range

    @property
    def aic(self) -> float:
        return self.deviance + 2 * (self.rank + 3)

    @property
    def r2_marginal(self) -> float:
        return self.fixed_var / (self.fixed_var + self.group_var + self.year_var + self.sigma2)

    @property
    def r2_conditional(self) -> float:
        explained = self.fixed_var + self.group_var + self.year_var
        return explained / (explained + self.sigma2)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        se = np.sqrt(np.maximum(np.diag(self.cov), 0.0))
        rows = [(self.response, term_name(t), float(b), float(s)) for t, b, s in zip(self.terms, self.beta, se, strict=True)]
        return spark.createDataFrame(rows, COEFFICIENTS)

    def summary(self) -> dict[str, float | bool | str]:
        values = {
            "aic": self.aic, "deviance": self.deviance, "r2m": self.r2_marginal, "r2c": self.r2_conditional,
            "sigma2": self.sigma2, "group_var": self.group_var, "year_var": self.year_var, "n": self.n,
        }
        ends = {"converged": bool(self.converged), "boundary": ",".join(self.boundary)}
        return {name: float(v) for name, v in values.items()} | ends


class _Likelihood:
    """Profiled deviance of one set of terms."""

    def __init__(self, stats: MixedStats, terms: Sequence[Term], reml: bool):
        self.s, self.reml, self.asked = stats, reml, list(terms)
        chosen = stats.positions(terms)
        keep = independent_columns(stats.cross[np.ix_(chosen, chosen)])
        self.kept = keep
        self.columns = [chosen[i] for i in keep] + [len(stats.terms)]
        self.p, self.y = len(keep), len(stats.years)
        cross = stats.cross[np.ix_(self.columns, self.columns)]
        self.scale = 1 / np.sqrt(np.maximum(np.diag(cross), 1e-300))
        self.cross = cross * np.outer(self.scale, self.scale)
        self.year_sums = stats.year_sums[:, self.columns] * self.scale
        rows = list(range(self.y)) + [self.y + c for c in self.columns]
        widen = np.concatenate([np.ones(self.y), self.scale])
        self.group_sums = stats.group_sums[:, rows][:, :, rows] * np.outer(widen, widen)

    def factor(self, theta_g: float, theta_t: float):
        """Cholesky factor of the bordered system and the log-determinant of the group part."""
        s, y = self.s, self.y
        b = np.zeros((y + self.p + 1,) * 2)
        b[:y, :y] = np.diag(s.year_n)
        b[:y, y:] = self.year_sums
        b[y:, :y] = self.year_sums.T
        b[y:, y:] = self.cross
        logdet = 0.0
        if theta_g > 0:
            x = 2 * math.log(theta_g)
            weights = barycentric(s.nodes, min(max(x, s.nodes.min()), s.nodes.max()))
            b -= np.tensordot(weights, self.group_sums, axes=1)
            logdet = float(weights @ s.group_logdet)
        spread = np.concatenate([np.full(y, theta_t), np.ones(self.p + 1)])
        b *= np.outer(spread, spread)
        b[np.arange(y), np.arange(y)] += 1.0
        return np.linalg.cholesky(b), logdet

    def deviance(self, theta_g: float, theta_t: float) -> float:
        s, y, p = self.s, self.y, self.p
        try:
            low, logdet = self.factor(theta_g, theta_t)
        except np.linalg.LinAlgError:
            return 1e300
        diag = np.diag(low)
        rss = (diag[-1] / self.scale[-1]) ** 2
        logdet += 2 * float(np.log(diag[:y]).sum())
        if self.reml:
            fixed = 2 * float((np.log(diag[y : y + p]) - np.log(self.scale[:-1])).sum())
            dof = s.n - p
            return logdet + fixed + dof * (1 + math.log(2 * math.pi * rss / dof))
        return logdet + s.n * (1 + math.log(2 * math.pi * rss / s.n))

    def noise(self, theta_g: float, theta_t: float) -> float:
        """Error of the deviance from the digits that the residual sum loses against the sum of squares."""
        low, _ = self.factor(theta_g, theta_t)
        return ROUNDING * self.s.n / float(low[-1, -1]) ** 2

    def best(self, start: tuple[float, float] | None) -> tuple[float, float, Optimum, tuple[bool, bool]]:
        """Minimum over the inside and the edges (either deviation zero), and which deviation is at an end."""
        # differences reach a little beyond a point
        low = np.array([self.s.nodes.min() / 2 + 0.05, -YEAR_LIMIT])
        high = np.array([self.s.nodes.max() / 2 - 0.05, YEAR_LIMIT])

        def lowest(fn, axes: list[int], starts) -> Optimum:
            origin = min((np.array(p) for p in starts), key=fn)
            return newton(differences(fn, STEP), origin, low[axes], high[axes])

        group_line, year_line = np.linspace(low[0], high[0], 12), np.linspace(-6, 4, 9)
        inside = lambda v: self.deviance(math.exp(v[0]), math.exp(v[1]))
        no_group = lambda v: self.deviance(0.0, math.exp(v[0]))
        no_year = lambda v: self.deviance(math.exp(v[0]), 0.0)
        if start is None or min(start) <= 0:
            starts = [(a, b) for a in group_line for b in year_line]
        else:
            starts = [(math.log(start[0]), math.log(start[1]))]
        found = lowest(inside, [0, 1], starts)
        if start is not None and not found.converged:
            found = lowest(inside, [0, 1], [found.point, *[(a, b) for a in group_line for b in year_line]])
        group_only = lowest(no_year, [0], [found.point[:1], *group_line[:, None]])
        year_only = lowest(no_group, [1], [found.point[1:], *year_line[:, None]])
        none = self.deviance(0.0, 0.0)
        edges = [
            (0.0, 0.0, Optimum(np.zeros(0), none, 0.0, 0.0, np.zeros(0, bool), none < 1e299), (True, True)),
            (math.exp(group_only.point[0]), 0.0, group_only, (False, True)),
            (0.0, math.exp(year_only.point[0]), year_only, (True, False)),
        ]
        edge = min(edges, key=lambda e: e[2].value)
        theta_g, theta_t, best, zero = (math.exp(found.point[0]), math.exp(found.point[1]), found, (False, False))
        if edge[2].value <= found.value + 1e-9:
            theta_g, theta_t, best, zero = edge
        if math.isfinite(best.slope) and not best.converged:
            noise = self.noise(theta_g, theta_t) / STEP
            best.converged = best.slope <= noise and best.curvature >= -noise / STEP
        at_end = (zero[0] or math.log(theta_g) >= high[0], zero[1] or math.log(theta_t) >= high[1])
        return theta_g, theta_t, best, at_end


def fit_mixed(
    stats: MixedStats,
    terms: Sequence[Term],
    group: str,
    year: str,
    reml: bool = False,
    start: tuple[float, float] | None = None,
) -> MixedFit:
    """Maximum likelihood (or REML) fit from collected statistics; runs no Spark job."""
    like = _Likelihood(stats, terms, reml)
    theta_g, theta_t, optimum, at_end = like.best(start)
    deviance = optimum.value
    low, _ = like.factor(theta_g, theta_t)
    y, p, n = like.y, like.p, stats.n
    fixed = low[y : y + p, y : y + p]
    beta = np.linalg.solve(fixed.T, low[-1, y : y + p])
    years = theta_t * np.linalg.solve(low[:y, :y].T, low[-1, :y] - low[y : y + p, :y].T @ beta)
    to_units = like.scale[:-1] / like.scale[-1]
    rss = (low[-1, -1] / like.scale[-1]) ** 2
    sigma2 = rss / (n - p if reml else n)
    inverse = np.linalg.inv(fixed @ fixed.T)
    full_beta, full_cov = np.zeros(len(terms)), np.zeros((len(terms),) * 2)
    full_beta[like.kept] = beta * to_units
    full_cov[np.ix_(like.kept, like.kept)] = sigma2 * inverse * np.outer(like.scale[:-1], like.scale[:-1])
    where = stats.positions(terms)
    cross = stats.cross[np.ix_(where, where)]
    one = [i for i, t in enumerate(terms) if t == ()]
    mean = float(full_beta @ cross[:, one[0]]) / n if one else 0.0
    fixed_var = max(float(full_beta @ cross @ full_beta) - n * mean * mean, 0.0) / (n - 1)
    return MixedFit(
        stats.response, group, year, list(terms), full_beta, full_cov, sigma2,
        sigma2 * theta_g**2, sigma2 * theta_t**2, (theta_g, theta_t), deviance, n, reml,
        stats.years, years / like.scale[-1], fixed_var, p, optimum.converged,
        tuple(name for name, end in zip((group, year), at_end, strict=True) if end),
    )


def group_effects(df: DataFrame, fit: MixedFit) -> DataFrame:
    """Predicted group effects: one aggregation of the residuals, shrunk per group."""
    frame = df.select(*sorted(term_columns(fit.terms) | {fit.response, fit.group, fit.year})).dropna()
    year_effect: Column = F.lit(0.0)
    if fit.years:
        lookup = F.create_map(*chain.from_iterable((F.lit(y), F.lit(float(e))) for y, e in zip(fit.years, fit.year_effects, strict=True)))
        year_effect = F.try_element_at(lookup, F.col(fit.year))
    left = F.col(fit.response) - predict_column(fit) - year_effect
    ratio2 = fit.theta[0] ** 2
    return (
        frame.groupBy(fit.group)
        .agg(F.sum(left).alias("__sum"), F.count(F.lit(1)).alias("__n"))
        .select(fit.group, (F.lit(ratio2) * F.col("__sum") / (F.lit(ratio2) * F.col("__n") + 1)).alias("effect"))
    )


class StatsSource:
    """Collects statistics per set of nullable columns, all from the same sums over the rows.

    ``per_model`` drops the rows with a null in the columns of the model at
    hand (AICs can then compare different row sets, as the analysis does);
    ``common`` drops rows with a null in any candidate.
    """

    def __init__(self, df: DataFrame, response: str, terms: Sequence[Term], group: str, year: str, na_policy: str = "per_model"):
        if na_policy not in ("per_model", "common"):
            raise ValueError("na_policy must be 'per_model' or 'common'")
        self.df, self.response, self.group, self.year = df, response, group, year
        self.terms = list(dict.fromkeys(terms))
        used = sorted(term_columns(self.terms) | {response, group, year})
        nulls = df.agg(*[F.count_if(missing(df, c)).alias(c) for c in used]).first()
        self.always = {c for c in (response, group, year) if nulls[c]}
        self.nullable = {c for c in used if nulls[c]}
        self.common = na_policy == "common"
        self.years = year_levels(df, year)
        self.cache: dict[frozenset, MixedStats] = {}
        self.top: dict[frozenset, float] = {}

    def needed(self, terms: Sequence[Term]) -> frozenset:
        """The columns whose nulls drop a row from a model of these terms."""
        return frozenset(self.nullable if self.common else (term_columns(terms) & self.nullable) | self.always)

    def effects(self, fit: MixedFit) -> DataFrame:
        """Predicted group effects from the very rows of the fit, whatever the null policy."""
        key = self.needed(fit.terms)
        return group_effects(self.df.dropna(subset=sorted(key)) if key else self.df, fit)

    @cached_property
    def sums(self) -> RowSums:
        """The sums of every model; a column that all of them need drops its rows at once."""
        return RowSums(self.df, self.response, self.terms, self.group, self.year, self.years, self.nullable - self.needed([]))

    def stats(self, terms: Sequence[Term]) -> MixedStats:
        key = self.needed(terms)
        if key not in self.cache:
            possible = [t for t in self.terms if not (set(t) & self.nullable) - key]
            self.cache[key] = self.sums.stats(possible, key, self.top.get(key, TOP))
        return self.cache[key]

    def fit(self, terms: Sequence[Term], reml: bool = False, start: tuple[float, float] | None = None) -> MixedFit:
        """The fit; sums over a wider range are collected while its group deviation ends at the top of the present one."""
        key = self.needed(terms)
        while True:
            fit = fit_mixed(self.stats(terms), terms, self.group, self.year, reml, start)
            top = self.top.get(key, TOP)
            if self.group not in fit.boundary or fit.theta[0] == 0 or top >= WIDEST:
                return fit
            self.top[key], start = top + WIDER, None
            del self.cache[key]


@dataclass
class SelectionLog:
    """Outcome of an ordered forward selection."""

    start: object
    model: object
    steps: list[tuple[int, str, bool, float, float, float]]

    @property
    def selected(self) -> list[str]:
        return [s[1] for s in self.steps if s[2]]

    def frame(self, spark: SparkSession, **labels: str) -> DataFrame:
        names = list(labels)
        rows = [(*labels.values(), i, c, k, a, m, r) for i, c, k, a, m, r in self.steps]
        schema = ", ".join([*[f"{n} string" for n in names], "step int, cand string, kept boolean, aic double, r2m double, r2c double"])
        return spark.createDataFrame(rows, schema)


def forward_selection(
    source: StatsSource, start: MixedFit, candidates: dict[str, Sequence[Term]], threshold: float = 2.0
) -> SelectionLog:
    """One ordered pass: keep a candidate when it lowers the AIC by at least ``threshold``.

    The log lists every candidate with the AIC and R-squared of the model tried.
    """
    best, steps = start, []
    for i, (name, extra) in enumerate(candidates.items(), 1):
        terms = list(dict.fromkeys([*best.terms, *extra]))
        trial = source.fit(terms, start=best.theta)
        kept = best.aic - trial.aic >= threshold
        steps.append((i, name, bool(kept), float(trial.aic), float(trial.r2_marginal), float(trial.r2_conditional)))
        if kept:
            best = trial
    return SelectionLog(start, best, steps)


def predict_with_groups(df: DataFrame, fit: MixedFit, effects: DataFrame, missing: str = "error", name: str = "pred") -> DataFrame:
    """Fixed part plus the group effect (year effects left out)."""
    joined = group_effect(df, effects, fit.group, "effect", missing)
    return joined.withColumn(name, predict_column(fit) + F.col("effect")).drop("effect")

