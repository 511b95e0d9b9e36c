"""Grouped and global summaries; all of them combine partially before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import ratio, safe_log, strict_mean
from .projection import across


def mean_by(df: DataFrame, keys: Sequence[str], values: Sequence[str], strict: bool = True) -> DataFrame:
    """Grouped means; strict ones are null when any value is null. Null keys form a group."""
    return df.groupBy(*keys).agg(*across(values, strict_mean if strict else F.avg))


def one_row(df: DataFrame, **aggregates: Column) -> Column:
    """Global aggregates as one scalar-subquery struct, usable in any expression over other frames."""
    row = F.struct(*[c.alias(name) for name, c in aggregates.items()])
    return df.agg(row.alias("row")).scalar()


def extrema(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def column_stats(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per column: mean and sample standard deviation of the non-null values."""
    wide = df.agg(
        *[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.count(c).alias("n")).alias(c) for c in names]
    )
    return wide.unpivot([], list(names), "variable", "stats").select("variable", "stats.*")


def standardise(df: DataFrame, names: Sequence[str], stats_from: DataFrame | None = None) -> DataFrame:
    """Z-scores over the whole frame (n - 1, nulls skipped), without a global window.

    The statistics come from one aggregation used as a scalar subquery.
    """
    source = df if stats_from is None else stats_from
    stats = one_row(
        source, **{f"{kind}_{c}": fn(c) for c in names for kind, fn in (("mean", F.avg), ("sd", F.stddev_samp))}
    )
    with_stats = df.withColumn("__stats", stats)
    scaled = {
        c: ratio(F.col(c) - F.col(f"__stats.mean_{c}"), F.col(f"__stats.sd_{c}")) for c in names
    }
    return with_stats.withColumns(scaled).drop("__stats")


def correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pairwise correlations (a, b, r) with a before b, from one aggregation."""
    pairs = list(combinations(names, 2))
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a), F.col(b)).alias("r")) for a, b in pairs
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def histogram(df: DataFrame, names: Sequence[str], bins: int = 30) -> DataFrame:
    """Counts per variable over equal-width bins between its minimum and maximum."""
    bounds = one_row(df, **{f"{kind}_{c}": fn(c) for c in names for kind, fn in (("lo", F.min), ("hi", F.max))})
    with_bounds = df.select(*names, bounds.alias("b"))

    def bin_of(c: str) -> Column:
        lo, hi = F.col(f"b.lo_{c}"), F.col(f"b.hi_{c}")
        position = F.floor(ratio((F.col(c) - lo) * bins, hi - lo)).cast("int")
        return F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1))

    long = with_bounds.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("value"), bin_of(c).alias("bin")) for c in names]))
    )
    return long.filter(F.col("value").isNotNull()).groupBy("variable", "bin").agg(F.count(F.lit(1)).alias("n"))


def log_ratio_of_sums(numerator: Column, denominator: Column) -> Column:
    """Aggregate: log(sum(a) / sum(b)), nulls of a skipped, null instead of an infinite value."""
    return safe_log(ratio(F.sum(numerator), F.sum(denominator)))


def mean_of_log(value: Column) -> Column:
    return F.avg(safe_log(value))


def distinct_values(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names).distinct()


