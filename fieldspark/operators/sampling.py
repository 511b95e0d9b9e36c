"""Repeatable random rows: md5 of a key replaces the random number generator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.draws import bucket_of, draw_key
from .joins import equi_join, never_sent
from .windows import top_rows


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """Exactly ``n`` random rows (all rows when there are fewer).

    A histogram over the leading 16 digest bits tells in which bucket the ``n``
    smallest digests end. Buckets before it are taken whole, wherever they are;
    only rows of that bucket are ranked. The input is evaluated three times.
    """
    drawn = df.withColumn("__draw", draw_key(seed, *[F.col(k) for k in keys]))
    drawn = drawn.withColumn("__bucket", bucket_of(F.col("__draw")))
    histogram = drawn.groupBy("__bucket").agg(F.count(F.lit(1)).alias("c"))
    running = F.sum("c").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    # at most 65,536 histogram rows enter this window
    before = histogram.select("__bucket", (running - F.col("c")).alias("before")).filter(F.col("before") < n)
    cut = before.orderBy(F.desc("__bucket")).first()
    if cut is None:
        return df.limit(0)
    inside = drawn.filter(F.col("__bucket") == cut["__bucket"])
    chosen = top_rows(inside, ["__bucket"], [F.col("__draw"), *[F.col(k) for k in keys]], n - cut["before"])
    return drawn.filter(F.col("__bucket") < cut["__bucket"]).unionByName(chosen).drop("__draw", "__bucket")


def sample_per_stratum(df: DataFrame, strata: Sequence[str], keys: Sequence[str], seed: int, k: int = 1) -> DataFrame:
    """``k`` random rows of every stratum."""
    drawn = df.withColumn("__draw", draw_key(seed, *[F.col(c) for c in keys]))
    return top_rows(drawn, strata, [F.col("__draw"), *[F.col(c) for c in keys]], k).drop("__draw")


def hashed_rank(df: DataFrame, groups: Sequence[str], digest: str, ties: Sequence[str], name: str) -> DataFrame:
    """Rank (from 1) by digest inside each group, null being a group, without sorting a whole group in one task.

    Digests are uniform, so their leading bits split every group into 256 even
    buckets: rows are ranked inside a bucket and shifted by the size of the
    buckets before it. The groups travel as one struct, which compares null with
    null by plain equality, so that ranked rows stay where they are and the sizes
    of the buckets, as many as groups have buckets, come to them.
    """
    others = [F.col(c) for c in df.columns if c not in groups]
    bucketed = df.select(F.struct(*groups).alias("__g"), *others, bucket_of(F.col(digest), 2).alias("__b"))
    sizes = bucketed.groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = W.partitionBy("__g").orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = sizes.withColumn("__before", F.sum("__c").over(before) - F.col("__c")).drop("__c")
    inside = W.partitionBy("__g", "__b").orderBy(digest, *ties)
    ranked = bucketed.withColumn("__r", F.row_number().over(inside))
    met = equi_join(ranked, never_sent(offsets), ["__g", "__b"], "inner", [])
    return met.select("*", "__g.*").select(*df.columns, (F.col("__r") + F.col("__before")).alias(name))
