"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

A vector counts if it is there, has no null, NaN or infinite entry, and is as
long as most such vectors are (of equally frequent lengths the largest). Entry c
becomes x = floor(64 c) + 1000000, held within +-2**52. Counts and sums of x are
exact, so the mean is S / n without rounding error, and the scatter is summed
from centred values.

The scatter is factored as L L' with the largest remaining diagonal entry as the
pivot of each step, up to its numerical rank. One-sided Jacobi then rotates
columns of the triangular factor until all are orthogonal: squared column norms
are the eigenvalues of the scatter, normalised columns its eigenvectors. The
covariance itself is never decomposed.

Rows meet the driver only as sums: one count and sum per dimension, one
half-matrix, and one half-matrix of whitened values for the check. Repeated rows
count as often as they occur. Directions without variance are left out, so a
table whose vectors are all equal, or an empty one, has no components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import materialise

SCALE, OFFSET, LIMIT = 64.0, 1_000_000, 2**52
COMPONENTS = 32
# Entries handled at once within a task.
BLOCK = 1 << 21
SWEEPS = 40


def valid_vectors(column: pa.Array, length: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, and lengths, of the vectors without null or non-finite entries, and all their entries end to end."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    there = lengths >= 0 if length is None else lengths == length
    at = np.flatnonzero(there)
    flat = column.filter(pa.array(there)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths[at])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = bad[ends] == bad[ends - lengths[at]]
    return at[good], lengths[at][good], flat[np.repeat(good, lengths[at])]


def grid(entries: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(entries * SCALE), -LIMIT, LIMIT).astype(np.int64) + OFFSET


def blocks_of(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and x-vectors of a batch, a bounded number of entries at a time."""
    at, _, flat = valid_vectors(column, length)
    x = flat.reshape(-1, length)
    step = max(1, BLOCK // max(1, length))
    for i in range(0, len(at), step):
        yield at[i : i + step], grid(x[i : i + step])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for batch in batches:
        _, lengths, flat = valid_vectors(batch.column(0))
        starts = np.cumsum(lengths) - lengths
        for d in np.unique(lengths).tolist():
            rows = starts[lengths == d]
            counts[d] = counts.get(d, 0) + len(rows)
            total = sums.setdefault(d, [0] * d)
            for i in range(0, len(rows), 1024):  # 1024 numbers of 2**52 fit a long
                part = grid(flat[rows[i : i + 1024, None] + np.arange(d)]).sum(0)
                total[:] = [a + b for a, b in zip(total, part.tolist(), strict=True)]
    if counts:
        kinds = sorted(counts)
        whole = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.int32()), pa.array([counts[d] for d in kinds], pa.int64()), pa.array([[int(v) for v in sums[d]] for d in kinds], pa.list_(whole))],
            names=["length", "n", "sums"],
        )


def _summed(rows: DataFrame, size: int, products: Callable[[pa.Array], Iterator[np.ndarray]]) -> np.ndarray:
    """Sum of z'z over all blocks z that ``products`` makes of a batch's vectors."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for z in products(batch.column(0)):
                total += z.T @ z
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    cells = rows.mapInArrow(fold, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    matrix = np.zeros((size, size))
    i, j, v = (cells.column(c).to_numpy() for c in ("i", "j", "v"))
    matrix[i, j] = matrix[j, i] = v
    return matrix


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with a = L L', rows in the order of ``a``: lower triangular once its rows are sorted by pivot. As many columns as the numerical rank."""
    size = len(a)
    left = np.diag(a).astype(float).copy()
    out = np.zeros((size, size))
    least = np.finfo(float).eps * size * max(left.max(initial=0.0), 0.0)
    free = np.ones(size, bool)
    for k in range(size):
        p = int(np.argmax(np.where(free, left, -np.inf)))
        if left[p] <= least:
            return out[:, :k]
        free[p] = False
        out[p, k] = np.sqrt(left[p])
        rest = np.flatnonzero(free)
        out[rest, k] = (a[rest, p] - out[rest, :k] @ out[p, :k]) / out[p, k]
        left[rest] -= out[rest, k] ** 2
    return out


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of factor factor', falling, by plane rotations of the factor's columns.

    Each round rotates disjoint pairs of columns; a sweep has every pair once.
    """
    size = factor.shape[1]
    w = np.concatenate([factor, np.zeros((len(factor), size % 2))], axis=1)
    m = w.shape[1]
    ring = np.arange(m)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(max(0, m - 1)):
            p, q = ring[: m // 2], ring[m // 2 :][::-1]
            x, y = w[:, p], w[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            both = np.sqrt(alpha * beta)
            turn = np.abs(gamma) > 1e-16 * both
            worst = max(worst, float(np.max(np.abs(gamma[turn]) / both[turn], initial=0.0)))
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1.0)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            w[:, p], w[:, q] = c * x - c * t * y, c * t * x + c * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if worst < 1e-15 * max(1, len(factor)):
            break
    norms = np.sqrt((w * w).sum(0))
    order = np.argsort(-norms, kind="stable")[:size]
    order = order[norms[order] > 0]
    return norms[order] ** 2, w[:, order] / norms[order]


@dataclass
class Whitening:
    """``sums``: exact sums of x by dimension. ``values``: eigenvalues of the covariance, falling. ``axes``: components as columns."""

    length: int
    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; the whole part of the mean is taken off in integers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.axes) / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n x - S)**2; null where that is no long."""
        low, high = x.min(0).tolist(), x.max(0).tolist()
        gap = max((max(abs(a * self.n - s), abs(b * self.n - s)) for a, b, s in zip(low, high, self.sums, strict=True)), default=0)
        side = max((max(abs(a), abs(b)) * self.n for a, b in zip(low, high, strict=True)), default=0)
        if gap * gap * self.length < 2**63 and side + gap < 2**63:
            away = x * np.int64(self.n) - np.array(self.sums, np.int64)
            return (away * away).sum(1).tolist()
        exact = ((x.astype(object) * self.n - np.array(self.sums, object)) ** 2).sum(1)
        return [int(v) if v < 2**63 else None for v in exact]


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """None for a table without any vector to count."""
    rows = df.select(F.col(f"`{vector}`"))
    partial = materialise(rows.mapInArrow(_sums, "length int, n bigint, sums array<decimal(38,0)>"))
    lengths = partial.groupBy("length").agg(F.sum("n").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    if most is None:
        return None
    d, n = most.length, most.n
    totals = partial.where(F.col("length") == d).select(F.posexplode("sums").alias("j", "s")).groupBy("j").agg(F.sum("s").alias("s"))
    sums = [int(r.s) for r in totals.orderBy("j").collect()]
    model = Whitening(d, n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    scatter = _summed(rows, d, lambda column: (model.centred(x) for _, x in blocks_of(column, d))) / n
    values, axes = one_sided_jacobi(pivoted_cholesky(scatter))
    return Whitening(d, n, sums, values[:components], axes[:, :components], float(np.trace(scatter)))


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened vectors, as measured over all rows, less the identity."""
    size = len(model.values)
    if not size:
        return 0.0

    def products(column: pa.Array) -> Iterator[np.ndarray]:
        for _, x in blocks_of(column, model.length):
            yield np.concatenate([model.whitened(x), np.ones((len(x), 1))], axis=1)

    total = _summed(df.select(F.col(f"`{vector}`")), size + 1, products) / model.n
    mean = total[:size, size]
    return float(np.abs(total[:size, :size] - np.outer(mean, mean) - np.eye(size)).max())


def transform(df: DataFrame, model: Whitening | None, vector: str = "embedding", out: str = "whitened") -> DataFrame:
    """Add the whitened vector to every row; null where the vector does not count. A column called ``out`` is replaced."""
    kept = [c for c in df.columns if c != out]
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*source.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    at = kept.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column: list = [None] * batch.num_rows
            if model is not None:
                for places, x in blocks_of(batch.column(at), model.length):
                    for i, row in zip(places.tolist(), model.whitened(x), strict=True):
                        column[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(column, pa.list_(pa.float64()))], names=[*kept, out])

    return source.mapInArrow(run, schema)


REPORT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def report(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector that counts and component, as ``REPORT``. ``deviation`` is null where it exceeds a long."""
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    model = fit(rows, "vector", components)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], REPORT)
    error = identity_error(rows, model, "vector")
    size = len(model.values)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in blocks_of(batch.column(1), model.length):
                many = len(x) * size
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(places, size))),
                        pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(many, model.n, np.int64)),
                        pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), size))),
                        pa.array(model.whitened(x).ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(many, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, REPORT)
