"""Text expressions: joining, splitting, patterns, ordered factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def paste(*parts: Column, sep: str = "_") -> Column:
    """Join values; a null prints as ``NA`` instead of vanishing."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def split_part(value: Column, position: int, sep: str = "_") -> Column:
    """1-based piece of a split, null when there is none."""
    return F.try_element_at(F.split(value, f"\\Q{sep}\\E"), F.lit(position))


def first_match(value: Column, rules: Sequence[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """Label of the first unanchored pattern that occurs in the value."""
    out = None
    for pattern, label in rules:
        hit = value.rlike(pattern)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out if otherwise is None else out.otherwise(otherwise)


def remove_first(value: Column, pattern: str) -> Column:
    """Drop an end-anchored pattern (at most one match)."""
    return F.regexp_replace(value, pattern, "")


def level_index(value: Column, levels: Sequence[str]) -> Column:
    """1-based position among ordered factor levels, null when absent."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), value)
    return F.when(pos > 0, pos.cast("int"))


def alternatives(value: Column) -> Column:
    """Aggregate: sorted distinct values joined with ``|``.

    Use it on vocabularies of fixed size (class codes, labels); membership of
    open-ended lists is a semi-join (``operators.joins.contains_any``).
    """
    return F.array_join(F.sort_array(F.collect_set(value)), "|")
