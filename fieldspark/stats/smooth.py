"""Spatial-basis regression: smooth surfaces inside clusters plus linear terms.

Each smooth is a radial basis of k columns: the strongest directions of the kernel
on landmarks that stand for all distinct positions, multiplied with a 0/1 cluster
column. It has the same model structure and criteria (ML or
REML smoothing, AIC, adjusted R-squared) as the analysis, but its own landmarks
and optimiser, so estimates are close to, not equal to, those of another package.
Spark evaluates the basis and sums cross products; the penalised solve is small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import missing
from ..sources.io import materialise
from .design import Term, cross_products, term_column, term_columns
from .mixed import SelectionLog
from .solve import Optimum, independent_columns, newton


# Landmarks per column of a basis, cells along a side of the grid, and rounds of k-means.
LANDMARKS, GRID, ROUNDS = 4, 64, 10
# Distances worked out at once.
BLOCK = 1 << 20
# Range of the logarithms of smoothing parameters, the grid of first guesses, and how many of them are followed.
LOG_LIMIT, START_LOGS, STARTS = 25.0, (-9.0, -4.5, 0.0, 4.5, 9.0), 3


@dataclass
class Smooth:
    """A surface over (x, y) that acts where ``by`` is 1."""

    x: str
    y: str
    by: str
    k: int
    kind: str = "thinplate"  # or "matern"

    def label(self) -> str:
        return f"s({self.x},{self.y}):{self.by}"


@dataclass
class Basis:
    """A smooth with its knots fixed; its directions are worked out when they are first asked for."""

    smooth: Smooth
    knots: np.ndarray
    centre: np.ndarray
    scale: float

    @property
    def transform(self) -> np.ndarray:
        """From raw columns (trend 3 + radial) to basis columns."""
        return self._directions[0]

    @property
    def penalty(self) -> np.ndarray:
        return self._directions[1]

    @cached_property
    def _directions(self) -> tuple[np.ndarray, np.ndarray]:
        return strongest_directions(self)


def radial(distance: np.ndarray, kind: str) -> np.ndarray:
    if kind == "matern":
        return (1 + distance) * np.exp(-distance)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(distance > 0, distance**2 * np.log(distance), 0.0)


def radial_column(distance: Column, kind: str) -> Column:
    if kind == "matern":
        return (1 + distance) * F.exp(-distance)
    return F.when(distance > 0, distance * distance * F.log(distance)).otherwise(F.lit(0.0))


def choose_knots(df: DataFrame, smooth: Smooth, every: bool = False) -> np.ndarray:
    """Landmarks that stand for all distinct positions of the cluster, in order of x and y.

    With ``every``, all distinct positions are knots, however many there are. Else up to ``LANDMARKS`` times k positions are all landmarks. More are summed up
    in cells of a grid over their box; from the centre outwards the cell mean
    farthest from those taken is taken next; then k-means over all positions,
    one aggregation a round, moves the landmarks. The result depends neither on
    the order nor on the number of rows at a position.
    """
    most = LANDMARKS * smooth.k
    spots = df.filter(F.col(smooth.by) == 1).select(F.col(smooth.x).cast("double").alias("x"), F.col(smooth.y).cast("double").alias("y"))
    spots = spots.dropna().distinct()
    if every:
        found = spots.toArrow()  # two numbers for each position
        x, y = (found.column(c).to_numpy() for c in ("x", "y"))
        return np.column_stack([x, y])[np.lexsort((y, x))]
    first = spots.limit(most + 1).collect()  # bounded by the size of the basis
    if len(first) <= most:
        return np.array(sorted((r.x, r.y) for r in first), dtype=float).reshape(-1, 2)
    spots = materialise(spots)
    box = spots.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    size = max(box.x1 - box.x0, box.y1 - box.y0)
    cell = lambda c, low: F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(size) * GRID), F.lit(GRID - 1))
    cells = spots.groupBy(cell("x", box.x0).alias("i"), cell("y", box.y0).alias("j")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    means = np.array(sorted((r.x, r.y) for r in cells.collect()))  # GRID x GRID at most
    landmarks = farthest_points(means, most)
    for _ in range(ROUNDS):
        sums = _nearest_sums(spots, landmarks).collect()  # one row per landmark
        moved = landmarks.copy()
        for r in sums:
            moved[r.place] = (r.x / r.n, r.y / r.n)
        still = np.abs(moved - landmarks).max() <= 1e-9 * size
        landmarks = moved
        if still:
            break
    landmarks = np.round(landmarks / size, 12) * size
    return landmarks[np.lexsort((landmarks[:, 1], landmarks[:, 0]))]


def farthest_points(points: np.ndarray, most: int) -> np.ndarray:
    """The point nearest to the mean, then always the one farthest from all taken; the first of equally far ones."""
    taken = [int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))]
    gap = ((points - points[taken[0]]) ** 2).sum(axis=1)
    while len(taken) < min(most, len(points)):
        taken.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((points - points[taken[-1]]) ** 2).sum(axis=1))
    return points[taken]


def _nearest_sums(spots: DataFrame, landmarks: np.ndarray) -> DataFrame:
    """Number and sums of the positions nearest to each landmark (the first of equally near ones)."""
    import pyarrow as pa

    def fold(batches: Iterator) -> Iterator:
        total = np.zeros((len(landmarks), 3))
        for batch in batches:
            points = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for part in np.array_split(points, max(1, len(points) // 4096)):
                place = ((part[:, None, :] - landmarks[None]) ** 2).sum(axis=2).argmin(axis=1)
                np.add.at(total, place, np.column_stack([np.ones(len(part)), part]))
        there = np.flatnonzero(total[:, 0])
        arrays = [pa.array(there.astype(np.int32)), *[pa.array(total[there, i]) for i in range(3)]]
        yield pa.RecordBatch.from_arrays(arrays, ["place", "n", "x", "y"])

    partial = spots.select("x", "y").mapInArrow(fold, "place int, n double, x double, y double")
    return partial.groupBy("place").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y")])


def build_basis(smooth: Smooth, knots: np.ndarray) -> Basis:
    """Trend plus the k strongest directions of the kernel on the landmarks, orthogonal to the trend there, with their penalty."""
    centre = knots.mean(axis=0) if len(knots) else np.zeros(2)
    return Basis(smooth, knots, centre, _widest(knots) or 1.0)


def _widest(knots: np.ndarray) -> float:
    """Largest distance of two knots, in blocks of bounded size."""
    widest, rows = 0.0, max(1, BLOCK // max(len(knots), 1))
    for at in range(0, len(knots), rows):
        gaps = knots[at : at + rows, None, :] - knots[None, :, :]
        widest = max(widest, float(np.sqrt((gaps**2).sum(axis=2)).max()))
    return widest


def strongest_directions(basis: Basis) -> tuple[np.ndarray, np.ndarray]:
    """Transform and penalty of a basis."""
    smooth, knots, m = basis.smooth, basis.knots, len(basis.knots)
    gaps = knots[:, None, :] - knots[None, :, :]
    distances = np.sqrt((gaps**2).sum(axis=2)) if m else np.zeros((0, 0))
    trend = np.column_stack([np.ones(m), (knots - basis.centre) / basis.scale]) if m else np.zeros((0, 3))
    values, vectors = np.linalg.eigh(radial(distances / basis.scale, smooth.kind)) if m else (np.zeros(0), np.zeros((0, 0)))
    strong = np.argsort(-np.abs(values), kind="stable")[: smooth.k]
    values, vectors = values[strong], vectors[:, strong]
    _, s, right = np.linalg.svd(trend.T @ vectors, full_matrices=True) if m else (None, np.zeros(0), np.zeros((0, 0)))
    inside = right[int((s > 1e-9).sum()) :].T  # combinations of the directions without trend
    free = vectors @ inside
    width = 3 + free.shape[1]
    transform = np.zeros((3 + m, width))
    transform[:3, :3] = np.eye(3)
    transform[3:, 3:] = free
    penalty = np.zeros((width, width))
    if free.shape[1]:
        inner = inside.T @ (values[:, None] * inside)
        energy, turns = np.linalg.eigh((inner + inner.T) / 2)
        penalty[3:, 3:] = turns @ np.diag(np.maximum(np.abs(energy), 1e-10)) @ turns.T
    return transform, penalty


def basis_columns(basis: Basis) -> list[Column]:
    """Raw columns of a smooth: three for the trend and one per knot."""
    s = basis.smooth
    dx = (F.col(s.x) - F.lit(float(basis.centre[0]))) / F.lit(basis.scale)
    dy = (F.col(s.y) - F.lit(float(basis.centre[1]))) / F.lit(basis.scale)
    by = F.col(s.by).cast("double")
    out = [by, by * dx, by * dy]
    for kx, ky in basis.knots:
        distance = F.sqrt(F.pow(F.col(s.x) - F.lit(float(kx)), 2) + F.pow(F.col(s.y) - F.lit(float(ky)), 2)) / F.lit(basis.scale)
        out.append(by * radial_column(distance, s.kind))
    return out


def basis_table(df: DataFrame, key: str, basis: Basis) -> DataFrame:
    """Long table (key, knot, value) of the radial columns inside the cluster: every row with every knot, where the row lies."""
    s = basis.smooth
    schema = "knot int, __kx double, __ky double"
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(basis.knots, 1)]
    knots = df.sparkSession.createDataFrame(rows, schema)
    distance = F.sqrt(F.pow(F.col(s.x) - F.col("__kx"), 2) + F.pow(F.col(s.y) - F.col("__ky"), 2)) / F.lit(basis.scale)
    value = F.col(s.by).cast("double") * radial_column(distance, s.kind)
    inside = df.filter(F.col(s.by) == 1).select(F.col(key).alias("__key"), s.x, s.y, s.by)
    return inside.crossJoin(F.broadcast(knots)).select(F.col("__key").alias(key), "knot", value.alias("value"))


@dataclass
class SmoothStats:
    terms: list[Term]
    bases: list[Basis]
    cross: np.ndarray
    n: int


def collect_smooth_stats(df: DataFrame, response: str, terms: Sequence[Term], bases: Sequence[Basis]) -> SmoothStats:
    """One pass: cross products of linear terms, basis columns and the response."""
    raw = [c for b in bases for c in basis_columns(b)]
    used = sorted(term_columns(terms) | {response} | {c for b in bases for c in (b.smooth.x, b.smooth.y, b.smooth.by)})
    frame = df.select(*used).dropna().select(
        *[term_column(t).alias(f"t{i}") for i, t in enumerate(terms)],
        *[c.alias(f"b{i}") for i, c in enumerate(raw)],
        F.col(response).cast("double").alias("y0"),
    )
    cross, n = cross_products(frame, frame.columns)
    widths = [b.transform.shape for b in bases]
    total_in = len(terms) + sum(w[0] for w in widths) + 1
    total_out = len(terms) + sum(w[1] for w in widths) + 1
    change = np.zeros((total_in, total_out))
    change[: len(terms), : len(terms)] = np.eye(len(terms))
    row = col = len(terms)
    for b in bases:
        r, c = b.transform.shape
        change[row : row + r, col : col + c] = b.transform
        row, col = row + r, col + c
    change[-1, -1] = 1.0
    return SmoothStats(list(terms), list(bases), change.T @ cross @ change, n)


@dataclass
class SmoothFit:
    response: str
    terms: list[Term]
    bases: list[Basis]
    beta: np.ndarray  # linear terms, then basis columns per smooth
    lambdas: np.ndarray
    edf: float
    rss: float
    n: int
    method: str
    criterion: float
    adjusted_r2: float
    converged: bool = True
    boundary: tuple[str, ...] = ()  # smooths whose parameter is at an end of its range, or beyond any effect

    @property
    def aic(self) -> float:
        if self.n == 0 or self.rss <= 0 or self.edf >= self.n:
            return math.inf  # saturated: never preferred
        return self.n * (math.log(2 * math.pi * self.rss / self.n) + 1) + 2 * (self.edf + 1)

    def column(self) -> Column:
        """Fitted value as a column expression."""
        parts = [F.lit(float(b)) * term_column(t) for t, b in zip(self.terms, self.beta, strict=False)]
        at = len(self.terms)
        for b in self.bases:
            width = b.transform.shape[1]
            raw = b.transform @ self.beta[at : at + width]
            parts += [F.lit(float(w)) * c for w, c in zip(raw, basis_columns(b), strict=True)]
            at += width
        return reduce(Column.__add__, parts)

    def residuals(self, df: DataFrame, name: str = "residual") -> DataFrame:
        return df.withColumn(name, F.col(self.response) - self.column())


def fit_smooth(stats: SmoothStats, response: str, terms: Sequence[Term], method: str = "ML") -> SmoothFit:
    """Penalised fit with smoothing parameters by ML or REML; runs no Spark job.

    Newton steps with exact derivatives descend from the lowest points of a
    coarse grid; the fit tells whether its end is a minimum, and which smooths
    have none inside the range. A saturated model has no criterion and does not
    converge.
    """
    if method not in ("ML", "REML"):
        raise ValueError("method must be 'ML' or 'REML'")
    place = {t: i for i, t in enumerate(stats.terms)}
    t_all, m = len(stats.terms), len(stats.cross) - 1
    wanted = [place[t] for t in terms] + list(range(t_all, m))
    kept = [wanted[i] for i in independent_columns(stats.cross[np.ix_(wanted, wanted)], 1e-9)]
    scale = 1 / np.sqrt(np.diag(stats.cross)[kept])
    g = stats.cross[np.ix_(kept, kept)] * np.outer(scale, scale)
    c = stats.cross[kept, m] * scale
    yy, n = float(stats.cross[m, m]), stats.n
    blocks, at = [], t_all
    for b in stats.bases:
        width = b.transform.shape[1]
        inside = [i for i, col in enumerate(kept) if at + 3 <= col < at + width]
        local = [kept[i] - at for i in inside]
        s = b.penalty[np.ix_(local, local)] * np.outer(scale[inside], scale[inside]) if inside else np.zeros((0, 0))
        if inside:
            s = s / (np.trace(s) / len(inside))
        blocks.append((inside, s))
        at += width
    penalised = sorted(i for inside, _ in blocks for i in inside)
    base_logdet = sum(np.linalg.slogdet(s)[1] if len(i) else 0.0 for i, s in blocks)
    free = len(kept) - len(penalised)

    def assemble(logs: np.ndarray) -> np.ndarray:
        out = np.zeros_like(g)
        for (inside, s), log in zip(blocks, logs, strict=True):
            out[np.ix_(inside, inside)] += math.exp(log) * s
        return out

    active = [j for j, (inside, _) in enumerate(blocks) if inside]

    def criterion(part: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Criterion at the logarithms of the active parameters, with gradient and Hessian."""
        size = len(active)
        nothing = math.inf, np.zeros(size), np.zeros((size, size))
        logs = np.zeros(len(blocks))
        logs[active] = part
        whole = g + assemble(logs)
        try:
            low = np.linalg.cholesky(whole)
            half = np.linalg.solve(low, c)
            rss = yy - float(half @ half)
            if rss <= 0 or n <= free:
                return nothing
            inverse = np.linalg.inv(whole)
            if method == "REML":
                logdet, dof, spread, place = 2 * float(np.log(np.diag(low)).sum()), n - free, inverse, {i: i for i in range(len(whole))}
            else:
                inner = whole[np.ix_(penalised, penalised)]
                logdet, dof, spread = (np.linalg.slogdet(inner)[1] if penalised else 0.0), n, np.linalg.inv(inner)
                place = {i: k for k, i in enumerate(penalised)}
        except np.linalg.LinAlgError:
            return nothing
        beta = np.linalg.solve(low.T, half)
        scaled = [math.exp(logs[j]) * blocks[j][1] for j in active]
        where = [blocks[j][0] for j in active]
        pulls = [s @ beta[inside] for inside, s in zip(where, scaled, strict=True)]
        slope = np.array([beta[inside] @ pull for inside, pull in zip(where, pulls, strict=True)])
        rows = [[place[i] for i in inside] for inside in where]
        traces = np.array([np.sum(spread[np.ix_(r, r)] * s) for r, s in zip(rows, scaled, strict=True)])
        bend, twist = np.diag(slope), np.diag(traces)
        for a in range(size):
            for b in range(size):
                bend[a, b] -= 2 * pulls[a] @ inverse[np.ix_(where[a], where[b])] @ pulls[b]
                cross = spread[np.ix_(rows[a], rows[b])]
                twist[a, b] -= np.sum((scaled[a] @ cross) * (cross @ scaled[b]))
        ranks = np.array([float(len(inside)) for inside in where])
        value = logdet - base_logdet - float(ranks @ part) + dof * (math.log(2 * math.pi * rss / dof) + 1)
        gradient = traces - ranks + dof * slope / rss
        return value, gradient, twist + dof * (bend / rss - np.outer(slope, slope) / rss**2)

    if active:
        from itertools import product

        starts = sorted((np.array(p) for p in product(START_LOGS, repeat=len(active))), key=lambda p: criterion(p)[0])
        limits = np.full(len(active), LOG_LIMIT)
        best = min((newton(criterion, p, -limits, limits) for p in starts[:STARTS]), key=lambda o: (not math.isfinite(o.value), o.value))
    else:
        value = criterion(np.zeros(0))[0]
        best = Optimum(np.zeros(0), value, 0.0, 0.0, np.zeros(0, bool), math.isfinite(value))
    logs = np.zeros(len(blocks))
    logs[active] = best.point
    boundary = tuple(stats.bases[j].smooth.label() for j, edge in zip(active, best.edge, strict=True) if edge)
    whole = g + assemble(logs)
    beta = np.linalg.solve(whole, c)
    edf = float(np.trace(np.linalg.solve(whole, g)))
    rss = float(yy - 2 * beta @ c + beta @ g @ beta)
    full = np.zeros(m)
    full[kept] = beta * scale
    order = [place[t] for t in terms] + list(range(t_all, m))
    one = place.get(())
    adjusted = float("nan")
    if n > max(edf, 1):
        mean = float(stats.cross[one, m]) / n if one is not None else 0.0
        fitted_mean = float(stats.cross[one][:m] @ full) / n if one is not None else 0.0
        spread = (yy - n * mean * mean) / (n - 1)
        residual_var = (rss - n * (mean - fitted_mean) ** 2) / (n - 1)
        adjusted = 1 - residual_var * (n - 1) / (spread * (n - edf)) if spread > 0 else adjusted
    return SmoothFit(response, list(terms), stats.bases, full[order], np.exp(logs), edf, rss, n, method, best.value, adjusted, best.converged, boundary)


class SmoothSource:
    """Cross products per set of nullable columns, knots fixed once."""

    def __init__(self, df: DataFrame, response: str, terms: Sequence[Term], smooths: Sequence[Smooth]):
        self.df, self.response, self.terms = df, response, list(dict.fromkeys(terms))
        self.bases = [build_basis(s, choose_knots(df, s)) for s in smooths]
        used = sorted(term_columns(self.terms))
        nulls = df.agg(*[F.count_if(missing(df, c)).alias(c) for c in used]).first() if used else {}
        self.nullable = {c for c in used if nulls[c]}
        self.cache: dict[frozenset, SmoothStats] = {}

    def fit(self, terms: Sequence[Term], method: str = "ML") -> SmoothFit:
        key = frozenset(term_columns(terms) & self.nullable)
        if key not in self.cache:
            possible = [t for t in self.terms if not (set(t) & self.nullable) - key]
            rows = self.df.dropna(subset=sorted(key)) if key else self.df
            self.cache[key] = collect_smooth_stats(rows, self.response, possible, self.bases)
        return fit_smooth(self.cache[key], self.response, terms, method)


def forward_selection_smooth(
    source: SmoothSource, start: SmoothFit, candidates: dict[str, Sequence[Term]], threshold: float = 2.0
) -> SelectionLog:
    """One ordered pass on AIC; the log opens with ``base`` and reports the adjusted R-squared."""
    best = start
    steps = [(0, "base", True, float(start.aic), float(start.adjusted_r2), float(start.adjusted_r2))]
    for i, (name, extra) in enumerate(candidates.items(), 1):
        trial = source.fit(list(dict.fromkeys([*best.terms, *extra])), "ML")
        kept = best.aic - trial.aic >= threshold
        steps.append((i, name, bool(kept), float(trial.aic), float(trial.adjusted_r2), float(trial.adjusted_r2)))
        if kept:
            best = trial
    return SelectionLog(start, best, steps)
