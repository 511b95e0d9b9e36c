"""Paired t-test over rows that carry both values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import t_quantile, t_two_sided
from ..functions.nulls import ratio


def paired_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, mean difference, its standard error, t and df, from one aggregation over complete pairs."""
    d = F.col(a) - F.col(b)
    agg = df.agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("__sd"))
    se = F.col("__sd") / F.sqrt(F.col("n"))
    return agg.select(
        "n", "mean_diff", se.alias("se"), ratio(F.col("mean_diff"), se).alias("t"), (F.col("n") - 1).alias("df")
    )


def paired_test(df: DataFrame, a: str, b: str, level: float = 0.95) -> DataFrame:
    """The same with the two-sided p-value and the confidence interval; null with fewer than two pairs or equal differences."""
    stats = paired_stats(df, a, b)
    width = F.when(F.col("t").isNotNull(), t_quantile(0.5 + level / 2, F.col("df")) * F.col("se"))
    return stats.withColumns(
        {"p_value": t_two_sided(F.col("t"), F.col("df")), "low": F.col("mean_diff") - width, "high": F.col("mean_diff") + width}
    )


def paired_t_test(df: DataFrame, a: str, b: str, level: float = 0.95) -> dict[str, float]:
    """``paired_test`` as scalars, NaN for null."""
    row = paired_test(df, a, b, level).first()
    return {k: math.nan if v is None else float(v) for k, v in row.asDict().items()}
