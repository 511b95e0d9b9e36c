"""Null-aware aggregates and arithmetic.

Two kinds of mean coexist: the strict ones are null as soon as one input is
null, the plain Spark ones skip nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def missing(df: DataFrame, name: str) -> Column:
    """Whether ``dropna`` drops a row for this column: null, or NaN in a floating-point column."""
    floating = df.schema[name].dataType.typeName() in ("double", "float")
    return F.col(name).isNull() | F.isnan(name) if floating else F.col(name).isNull()


def strict(agg: Callable[[Column], Column], value: Column, over: WindowSpec | None = None) -> Column:
    """``agg(value)``, or null when any value in the group is null."""
    known, rows, result = F.count(value), F.count(F.lit(1)), agg(value)
    if over is not None:
        known, rows, result = known.over(over), rows.over(over), result.over(over)
    return F.when(known == rows, result)


def strict_mean(value: Column, over: WindowSpec | None = None) -> Column:
    """Mean, or null when any value is null; one sum and two counts (the row count is shared)."""
    if over is not None:
        return strict(F.avg, value, over)
    rows = F.count(F.lit(1))
    return F.when(F.count(value) == rows, F.sum(value.cast("double")) / rows)


def strict_sum(value: Column, over: WindowSpec | None = None) -> Column:
    return strict(F.sum, value, over)


def strict_median(value: Column) -> Column:
    """Exact median; its state is one counter per distinct value (days of year: at most 366)."""
    return strict(F.median, value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that is null (not an error) for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def safe_log(value: Column) -> Column:
    """Natural log, null for zero and below."""
    return F.when(value > 0, F.log(value))


def clamp(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit a value; nulls stay null (``greatest``/``least`` would skip them)."""
    out = value
    if low is not None:
        out = F.when(value < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(value > high, F.lit(high)).otherwise(out)
    return out
