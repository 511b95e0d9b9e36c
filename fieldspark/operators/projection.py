"""Column selection, across-column expressions, filters and linked truncation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import clamp


def names_matching(df: DataFrame, prefix: str = "", suffix: str = "") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]


def shared_names(a: DataFrame | Sequence[str], b: DataFrame | Sequence[str]) -> list[str]:
    """Names present in both, in the order of the first."""
    left = a.columns if isinstance(a, DataFrame) else list(a)
    right = set(b.columns if isinstance(b, DataFrame) else b)
    return [c for c in left if c in right]


def select_renamed(df: DataFrame, **new_to_old: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for new, old in new_to_old.items()])


def drop_matching(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefixes)])


def across(names: Iterable[str], fn: Callable[[Column], Column], name: str = "{}") -> list[Column]:
    """The same expression for many columns; ``name`` is a template for the results."""
    return [fn(F.col(c)).alias(name.format(c)) for c in names]


def filter_multiple_of(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.filter(F.pmod(F.col(column), F.lit(k)) == 0)


def truncate_linked(df: DataFrame, value: str, anomaly: str, cutoff: float) -> DataFrame:
    """Raise values below the cut-off to it and zero the matching anomaly.

    Both results use the value from before the change.
    """
    below = F.col(value) < cutoff
    return df.withColumns(
        {
            anomaly: F.when(F.col(value).isNotNull(), F.when(below, F.lit(0.0)).otherwise(F.col(anomaly))),
            value: clamp(F.col(value), low=cutoff),
        }
    )
