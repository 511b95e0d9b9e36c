"""Group sizes, calendar windows and top rows, arranged so that no hot group lands in one task.

* Group sizes and group means are aggregations (combined before the shuffle)
  joined back, so adaptive skew splitting can divide a hot key.
* Ordered windows only run after the rows have been reduced to one per day of
  the group; such a group is bounded by the calendar, not by the data.
* Top rows use ``row_number() <= k``, which Spark limits before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.nulls import strict_mean, strict_sum
from .joins import equi_join

GROUP_LIMIT = 1000


def group_sizes(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def with_group_size(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return equi_join(df, group_sizes(df, keys, name), keys, "left")


def filter_group_size(df: DataFrame, keys: Sequence[str], low: int = 1, high: int | None = None) -> DataFrame:
    """Rows whose group has between ``low`` and ``high`` rows."""
    n = F.col("__n")
    fits = (n >= low) if high is None else ((n >= low) & (n <= high))
    return equi_join(df, group_sizes(df, keys, "__n").filter(fits).drop("__n"), keys, "left_semi")


def drop_isolated(df: DataFrame, *groupings: Sequence[str]) -> DataFrame:
    """Drop the rows that are alone in *every* one of the groupings."""
    cells = linked_cells(df, *groupings)
    return equi_join(df, cells, [c for c in cells.columns if c != "n"], "left_semi")


def linked_cells(df: DataFrame, *groupings: Sequence[str]) -> DataFrame:
    """Row counts per combination of all grouping columns, without cells whose row is alone in every grouping.

    The rows are counted once; the groupings are then summed over the counts
    (site and year combinations: a few cells per group).
    """
    keys = list(dict.fromkeys(k for grouping in groupings for k in grouping))
    cells = group_sizes(df, keys)
    sizes = [F.sum("n").over(W.partitionBy(*grouping)) for grouping in groupings]
    marked = cells.withColumns({f"__n{i}": size for i, size in enumerate(sizes)})
    alone = F.lit(True)
    for i in range(len(sizes)):
        alone = alone & (F.col(f"__n{i}") == 1)
    return marked.filter(~alone).select(*keys, "n")


def with_group_mean(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    means = df.groupBy(*keys).agg(strict_mean(F.col(value)).alias(name))
    return equi_join(df, means, keys, "left")


def day_gaps(days: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Days since the previous day of the group (0 for the first). Input: one row per group and day."""
    w = W.partitionBy(*keys).orderBy(date)
    return days.withColumn("gap", F.coalesce(F.datediff(F.col(date), F.lag(date).over(w)), F.lit(0)))


def day_islands(days: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Number the runs of consecutive days of each group from 0. Input: one row per group and day."""
    w = W.partitionBy(*keys).orderBy(date)
    breaks = F.sum((F.col("gap") > 1).cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return day_gaps(days, keys, date).withColumn("island", breaks.cast("int"))


def day_chunks(days: DataFrame, keys: Sequence[str], date: str = "date", length: int = 7) -> DataFrame:
    """Cut every run of consecutive days into chunks of ``length`` days (the last may be shorter)."""
    run = W.partitionBy(*keys, "island").orderBy(date)
    position = F.row_number().over(run) - 1
    return day_islands(days, keys, date).withColumn("chunk", F.floor(position / length).cast("int"))


def rolling_mean_ahead(days: DataFrame, keys: Sequence[str], day: str, value: str, width: int, name: str) -> DataFrame:
    """Mean of this and the next ``width - 1`` rows, null near the end of the group.

    Input: one row per group and day.
    """
    w = W.partitionBy(*keys).orderBy(day).rowsBetween(0, width - 1)
    complete = F.count(F.lit(1)).over(w) == width
    return days.withColumn(name, F.when(complete, strict_mean(F.col(value), w)))


def window_sum_ahead(
    rows: DataFrame, keys: Sequence[str], day: str, value: str, width: int, min_rows: int, name: str
) -> DataFrame:
    """Sum of the rows on days [d, d + width - 1], null with fewer than ``min_rows`` rows.

    Every *row* counts, also several on one day. Rows are first summed per
    group and day, so the ordered window sees at most 366 rows per group and
    year, and the result has one row per group and day.
    """
    daily = rows.groupBy(*keys, day).agg(
        strict_sum(F.col(value)).alias("__sum"), F.count(F.lit(1)).alias("__rows")
    )
    w = W.partitionBy(*keys).orderBy(F.col(day).cast("int")).rangeBetween(0, width - 1)
    enough = F.sum("__rows").over(w) >= min_rows
    total = strict_sum(F.col("__sum"), w)
    return daily.withColumn(name, F.when(enough, total)).select(*keys, day, name)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of every group in the given order (no ties beyond ``k``).

    For ``k`` within Spark's own group limit the rows are cut before the
    shuffle; for larger ``k`` a salted first cut does the same.
    """
    if k > GROUP_LIMIT:
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(256))
        salted = df.withColumn("__salt", salt)
        first = W.partitionBy(*keys, "__salt").orderBy(*order)
        df = salted.withColumn("__rn", F.row_number().over(first)).filter(F.col("__rn") <= k).drop("__rn", "__salt")
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")
