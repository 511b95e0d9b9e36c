"""Long/wide reshaping, unnesting, splitting and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_part


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "var", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def to_wide(
    df: DataFrame, ids: Sequence[str], key: str, levels: Sequence[str], values: dict[str, str]
) -> DataFrame:
    """One column ``{short}_{level}`` per value column and level; ``values`` maps short names to columns.

    The levels are given, so Spark needs no extra pass to find them.
    """
    cells = [
        F.max(F.when(F.col(key) == level, F.col(column))).alias(f"{short}_{level}")
        for short, column in values.items()
        for level in levels
    ]
    return df.groupBy(*ids).agg(*cells)


def split_column(df: DataFrame, column: str, into: Sequence[str], sep: str = "_") -> DataFrame:
    """Replace a column by its pieces: missing pieces are null, further ones are dropped."""
    parts: list[Column] = [split_part(F.col(column), i + 1, sep).alias(name) for i, name in enumerate(into)]
    return df.select(*parts, *[c for c in df.columns if c != column])


def unnest(df: DataFrame, name: str, values: Column) -> DataFrame:
    """One row per array element; rows with an empty or null array vanish."""
    return df.withColumn(name, F.explode(values))


def stack_rows(*frames: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` lacks; copies go before the join, not after it."""
    return a.distinct().subtract(b.distinct())


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows found in both; copies go before the join, not after it."""
    return a.distinct().intersect(b.distinct())


def same_sequence(a: DataFrame, b: DataFrame, position: str, value: str) -> DataFrame:
    """One row telling whether two ordered lists agree at every position."""
    left = a.select(F.col(position).alias("p"), F.col(value).alias("va"), F.lit(True).alias("in_a"))
    right = b.select(F.col(position).alias("p"), F.col(value).alias("vb"), F.lit(True).alias("in_b"))
    equal = F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & F.col("va").eqNullSafe(F.col("vb"))
    return left.join(right, "p", "full").agg(F.coalesce(F.bool_and(equal), F.lit(True)).alias("same"))
