"""Student's t as column expressions: log-gamma, the incomplete beta function, p-values and quantiles.

The continued fraction of the incomplete beta function is evaluated from its end
with a fixed number of terms, enough for some hundred thousand degrees of freedom.
Null arguments, and degrees of freedom below one, give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 400
HALVINGS = 100
SHIFT = 10
# Stirling's series of the log-gamma function, and log(2 pi) / 2.
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188]
HALF_LOG_TAU = 0.9189385332046727


def log_gamma(z: Column) -> Column:
    """For positive arguments: Stirling's series ten steps up, brought back by the recurrence."""
    up = z + F.lit(float(SHIFT))
    series = F.lit(0.0)
    for i, c in enumerate(STIRLING):
        series = series + F.lit(c) / F.pow(up, F.lit(2.0 * i + 1))
    steps = F.lit(0.0)
    for i in range(SHIFT):
        steps = steps + F.log(z + F.lit(float(i)))
    return (up - 0.5) * F.log(up) - up + F.lit(HALF_LOG_TAU) + series - steps


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """x^a (1 - x)^b / (a B(a, b)) times the continued fraction; converges below (a + 1) / (a + b + 2)."""

    def step(rest: Column, i: Column) -> Column:
        m = F.floor(i / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(i % 2 == 0, even).otherwise(odd) / (rest + 1)

    tail = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(0.0), step)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)) / a
    return front / (tail + 1)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function."""
    inside = F.when(x < (a + 1) / (a + b + 2), _fraction(a, b, x)).otherwise(1 - _fraction(b, a, 1 - x))
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inside)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t."""
    df = df.cast("double")
    return F.when(df >= 1, incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t)))


def t_quantile(p: float, df: Column) -> Column:
    """Upper quantile of Student's t by halving (p above one half)."""

    def half(range_: Column, _: Column) -> Column:
        middle = (range_["low"] + range_["high"]) / 2
        below = 1 - t_two_sided(middle, df) / 2 < F.lit(p)
        return F.struct(F.when(below, middle).otherwise(range_["low"]).alias("low"), F.when(below, range_["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(0.0).alias("low"), F.lit(1e6).alias("high")), half)
    return F.when(df >= 1, (found["low"] + found["high"]) / 2)
