"""Small dense helpers for the driver: rank-aware solves, a Newton minimiser with a certificate, Student's t."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


def independent_columns(gram: np.ndarray, tolerance: float = 1e-10) -> list[int]:
    """Indices of the columns kept when later columns that depend on earlier ones are dropped."""
    d = np.sqrt(np.maximum(np.diag(gram), 0.0))
    keep: list[int] = []
    factor = np.zeros((0, 0))
    for j in range(len(gram)):
        if d[j] == 0:
            continue
        scaled = gram[np.ix_(keep, [j])][:, 0] / (d[keep] * d[j]) if keep else np.zeros(0)
        head = np.linalg.solve(factor, scaled) if keep else scaled
        rest = 1.0 - float(head @ head)
        if rest <= tolerance:
            continue
        m = len(keep)
        bigger = np.zeros((m + 1, m + 1))
        bigger[:m, :m], bigger[m, :m], bigger[m, m] = factor, head, math.sqrt(rest)
        factor = bigger
        keep.append(j)
    return keep


@dataclass
class Optimum:
    """A minimum inside a box, and what shows it to be one.

    ``slope`` is the largest gradient entry among the coordinates not held at an
    end of the box, ``curvature`` the smallest eigenvalue of their Hessian.
    ``edge`` marks coordinates at an end, or so far out that the function is flat.
    """

    point: np.ndarray
    value: float
    slope: float
    curvature: float
    edge: np.ndarray
    converged: bool


def newton(
    fn: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]],
    start: np.ndarray,
    low: np.ndarray,
    high: np.ndarray,
    tolerance: float = 1e-6,
    limit: int = 200,
) -> Optimum:
    """Minimum of a smooth function from value, gradient and Hessian; an infinite value marks a point outside its domain.

    Directions of negative curvature are followed downwards, so a saddle is no stop.
    """
    x = np.clip(np.array(start, dtype=float), low, high)
    value, gradient, hessian = fn(x)
    if not math.isfinite(value):
        return Optimum(x, value, math.inf, -math.inf, np.zeros(len(x), bool), False)
    small = tolerance * max(1.0, abs(value) * 1e-3)
    for _ in range(limit):
        free = ~(((x <= low) & (gradient > 0)) | ((x >= high) & (gradient < 0)))
        if not free.any():
            break
        curves, axes = np.linalg.eigh(hessian[np.ix_(free, free)])
        along = axes.T @ gradient[free]
        if np.abs(gradient[free]).max() <= small:
            if curves[0] >= -small:
                break
            along[0] += -10 * small if along[0] <= 0 else 10 * small
        step = np.zeros(len(x))
        step[free] = -axes @ (along / np.maximum(np.abs(curves), 1e-8))
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-300))
        size, moved = 1.0, False
        while size > 1e-12 and not moved:
            there = np.clip(x + size * step, low, high)
            trial = fn(there)
            # the slack lets the last steps pass below the rounding of the value
            if trial[0] <= value + 1e-4 * min(0.0, float(gradient @ (there - x))) + 1e-13 * abs(value):
                moved = bool(np.abs(there - x).max() > 0)
                x, (value, gradient, hessian) = there, trial
                break
            size /= 2
        if not moved:
            break
    held = ((x <= low) & (gradient > 0)) | ((x >= high) & (gradient < 0))
    free = ~held
    slope = float(np.abs(gradient[free]).max()) if free.any() else 0.0
    curvature = float(np.linalg.eigvalsh(hessian[np.ix_(free, free)])[0]) if free.any() else 0.0
    edge = held | (x <= low) | (x >= high) | (np.abs(np.diag(hessian)) <= 100 * small)
    return Optimum(x, float(value), slope, curvature, edge, slope <= 10 * small and curvature >= -10 * small)


def differences(fn: Callable[[np.ndarray], float], step: float = 1e-2) -> Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]:
    """Value, gradient and Hessian of a function by central differences of fourth order (mixed ones of second)."""

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        dim, middle = len(x), fn(x)
        gradient, hessian, unit = np.zeros(dim), np.zeros((dim, dim)), step * np.eye(dim)
        for i in range(dim):
            a, b, c, d = (fn(x + k * unit[i]) for k in (-2, -1, 1, 2))
            gradient[i] = (a - 8 * b + 8 * c - d) / (12 * step)
            hessian[i, i] = (-a + 16 * b - 30 * middle + 16 * c - d) / (12 * step * step)
            for j in range(i):
                corners = [fn(x + p * unit[i] + q * unit[j]) * p * q for p in (-1, 1) for q in (-1, 1)]
                hessian[i, j] = hessian[j, i] = sum(corners) / (4 * step * step)
        if not (np.isfinite(gradient).all() and np.isfinite(hessian).all() and np.abs(gradient).max() < 1e200):
            return math.inf, np.zeros(dim), np.zeros((dim, dim))
        return middle, gradient, hessian

    return at


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            numerator = 1.0
        elif i % 2 == 0:
            numerator = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            numerator = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + numerator * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + numerator / c
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile of Student's t by bisection (p above 0.5)."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - t_two_sided(mid, df) / 2 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2
