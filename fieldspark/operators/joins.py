"""Joins with the null and naming rules of the analysis, and a distance-band self join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cell_centre
from .projection import shared_names


def equi_join(
    a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner", nullable: Sequence[str] | None = None
) -> DataFrame:
    """Equi-join in which a null key matches a null key.

    ``nullable`` names the keys that can be null (default: all). The others
    compare plainly, which halves the width of the join and sort keys. Either
    way Spark plans a hash or sort-merge join, so it may broadcast a side it
    knows to be small and adaptively split hot keys.
    """
    other = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    may_be_null = set(keys if nullable is None else nullable)
    matches = [
        F.col(k).eqNullSafe(F.col(f"__{k}")) if k in may_be_null else F.col(k) == F.col(f"__{k}") for k in keys
    ]
    return a.join(other, reduce(Column.__and__, matches), how).drop(*[f"__{k}" for k in keys])


def never_sent(days: DataFrame) -> DataFrame:
    """A side of a join that must not be broadcast: rows made by ``explode`` outgrow the size that Spark knows."""
    return days.hint("merge")


def natural_join(
    a: DataFrame,
    b: DataFrame,
    how: str = "inner",
    keys: Sequence[str] | None = None,
    nullable: Sequence[str] | None = None,
) -> DataFrame:
    """Join on all shared columns; pass ``keys`` to assert which ones they are."""
    shared = shared_names(a, b)
    if not shared:
        raise ValueError("the frames share no column")
    if keys is not None and set(keys) != set(shared):
        raise ValueError(f"expected the keys {sorted(keys)}, found {sorted(shared)}")
    return equi_join(a, b, shared, how, nullable)


def equi_join_apart(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner", nullable: Sequence[str] = ()) -> DataFrame:
    """As ``equi_join``, with the rows that have a null key joined apart.

    All others compare plainly, so sides that lie dealt by one of the keys stay
    where they are. Not for right or full joins. Both sides are evaluated twice, the
    second time behind a filter on the nullable keys.
    """
    unknown = reduce(Column.__or__, [F.col(k).isNull() for k in nullable], F.lit(False))
    known = equi_join(a.filter(~unknown), b, keys, how, [])
    return known.union(equi_join(a.filter(unknown), b.filter(unknown), keys, how, nullable))


def suffix_join(
    a: DataFrame, b: DataFrame, keys: Sequence[str], suffix: str, how: str = "left", nullable: Sequence[str] | None = None, apart: bool = False
) -> DataFrame:
    """Equi-join; columns of ``b`` that also occur in ``a`` get the suffix. ``apart``: see ``equi_join_apart``."""
    clash = [c for c in shared_names(b, a) if c not in keys]
    other = b.withColumnsRenamed({c: c + suffix for c in clash})
    return equi_join_apart(a, other, keys, how, nullable or ()) if apart else equi_join(a, other, keys, how, nullable)


def keep_matching(
    a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None, nullable: Sequence[str] | None = None
) -> DataFrame:
    return equi_join(a, b, keys or shared_names(a, b), "left_semi", nullable)


def drop_matching_rows(
    a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None, nullable: Sequence[str] | None = None
) -> DataFrame:
    return equi_join(a, b, keys or shared_names(a, b), "left_anti", nullable)


def expand_days(df: DataFrame, column: str = "jdate", last: int = 365) -> DataFrame:
    """Every row combined with every day 1..last: a generator, not a cross join."""
    return df.withColumn(column, F.explode(F.sequence(F.lit(1), F.lit(last))))


def enrich(df: DataFrame, *dimensions: DataFrame, nullable: Sequence[str] | None = None) -> DataFrame:
    """Natural left joins with one or more dimension tables; their size decides the strategy."""
    return reduce(lambda left, dim: natural_join(left, dim, "left", nullable=nullable), dimensions, df)


def grid_lookup(
    df: DataFrame, grid: DataFrame, lat: str, lon: str, value: str, size: float = 0.5, grid_lat: str = "lat", grid_lon: str = "lon"
) -> DataFrame:
    """Value of the grid cell that holds each coordinate, null for unknown cells."""
    keyed = df.withColumns({"__lat": cell_centre(F.col(lat), size), "__lon": cell_centre(F.col(lon), size)})
    cells = grid.select(F.col(grid_lat).alias("__lat"), F.col(grid_lon).alias("__lon"), value)
    return keyed.join(cells, ["__lat", "__lon"], "left").drop("__lat", "__lon")


def group_effect(df: DataFrame, effects: DataFrame, key: str, effect: str, missing: str = "error") -> DataFrame:
    """Attach a per-group effect; an unknown group raises at run time or counts as 0."""
    joined = equi_join(df, effects.select(key, effect), [key], "left")
    if missing == "zero":
        fill: Column = F.lit(0.0)
    elif missing == "error":
        fill = F.raise_error(F.concat(F.lit(f"no effect for {key} "), F.col(key))).cast("double")
    else:
        raise ValueError("missing must be 'error' or 'zero'")
    return joined.withColumn(effect, F.coalesce(F.col(effect), fill))


def contains_any(df: DataFrame, column: str, words: DataFrame, word: str) -> DataFrame:
    """Rows whose text contains at least one of the words.

    The substrings of the (short) text are matched by a hash semi-join, so the
    word list may be any size and no nested-loop join arises. An empty word
    list keeps no row.
    """
    texts = df.select(F.col(column).alias("__text")).distinct()
    hits = (
        texts.select("__text", F.explode(substrings(F.col("__text"))).alias("__piece"))
        .join(words.select(F.col(word).alias("__piece")).distinct(), "__piece", "left_semi")
        .select(F.col("__text").alias(column))
        .distinct()
    )
    return df.join(hits, column, "left_semi")


def substrings(text: Column) -> Column:
    """All distinct substrings of a short text (names, codes) as an array."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))

    def from_start(start: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.greatest(F.length(text) - start + 1, F.lit(1)))
        return F.transform(sizes, lambda size: F.substring(text, start, size))

    return F.array_distinct(F.flatten(F.transform(starts, from_start)))


def distance_band_pairs(
    points: DataFrame, key: str, x: str, y: str, radius: float, by: Sequence[str] = (), cell_load: int = 2000
) -> DataFrame:
    """Directed pairs (i, j) of different points no further apart than ``radius``.

    Points meet only in their own and the eight surrounding grid cells of side
    ``radius``. A cell with more than ``cell_load`` points is cut into slices:
    each left point goes to one slice and the right points to all of them, so a
    crowded cell is spread over many tasks.
    """
    by = list(by)
    cell = [*by, "__cx", "__cy"]
    left = points.select(
        *by,
        F.col(key).alias("i"),
        F.col(x).alias("__xi"),
        F.col(y).alias("__yi"),
        F.floor(F.col(x) / F.lit(radius)).alias("__cx"),
        F.floor(F.col(y) / F.lit(radius)).alias("__cy"),
    )
    load = left.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / F.lit(cell_load)).cast("int").alias("__slices"))
    left = equi_join(left, load, cell, "left").withColumn(
        "__slice", F.pmod(F.xxhash64("i"), F.col("__slices")).cast("int")
    )
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    right = (
        points.select(
            *by,
            F.col(key).alias("j"),
            F.col(x).alias("__xj"),
            F.col(y).alias("__yj"),
            F.floor(F.col(x) / F.lit(radius)).alias("__x0"),
            F.floor(F.col(y) / F.lit(radius)).alias("__y0"),
        )
        .withColumn("__dx", F.explode(steps))
        .withColumn("__dy", F.explode(steps))
        .withColumns({"__cx": F.col("__x0") + F.col("__dx"), "__cy": F.col("__y0") + F.col("__dy")})
    )
    right = equi_join(never_sent(right), load, cell, "inner").withColumn(
        "__slice", F.explode(F.sequence(F.lit(0), F.col("__slices") - 1))
    )
    right = right.drop("__slices", "__x0", "__y0", "__dx", "__dy")
    near = F.pow(F.col("__xi") - F.col("__xj"), 2) + F.pow(F.col("__yi") - F.col("__yj"), 2) <= radius * radius
    return (
        equi_join(left.drop("__slices"), never_sent(right), [*cell, "__slice"], "inner")
        .filter(near & ~F.col("i").eqNullSafe(F.col("j")))
        .select(*by, "i", "j")
    )
