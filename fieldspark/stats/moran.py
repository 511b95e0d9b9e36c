"""Spatial weights, Moran's I and its permutation test as Spark jobs.

Sites at one position act alike, so the statistic is computed on positions:
with S_L the sum of values at position L, Q_L their sum of squares and N(L)
the positions within the radius (L included), the row-standardised numerator is

    sum_L ( S_L * sum_{M in N(L)} S_M - Q_L ) / c_L,    c_L = sum_{M in N(L)} n_M - 1.

Copies of a position never form pairs with each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw_key
from ..functions.nulls import ratio
from ..operators.joins import distance_band_pairs, equi_join, never_sent
from ..operators.sampling import hashed_rank
from ..sources.io import materialise

# Runs of the permutation test that travel together as one array.
RUN_BLOCK = 64


def spatial_weights(points: DataFrame, key: str, x: str, y: str, radius: float, by: Sequence[str] = ()) -> DataFrame:
    """Edges (i, j, w): row-standardised neighbours within the radius; isolated points have no row."""
    edges = distance_band_pairs(points, key, x, y, radius, by)
    degree = edges.groupBy(*by, "i").agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"))
    return equi_join(edges, degree, [*by, "i"], "left").select(*by, "i", "j", "w")


def _place(x: str, y: str) -> Column:
    return F.concat_ws(":", F.hex(F.col(x).cast("string")), F.hex(F.col(y).cast("string")))


def _positions(points: DataFrame, x: str, y: str, by: Sequence[str], radius: float) -> tuple[DataFrame, DataFrame]:
    """Positions with their size, and their neighbourhoods (a, b), each position its own neighbour."""
    spots = points.groupBy(*by, _place(x, y).alias("spot"), F.col(x).alias("x"), F.col(y).alias("y")).agg(
        F.count(F.lit(1)).alias("size")
    )
    near = distance_band_pairs(spots, "spot", "x", "y", radius, by).withColumnsRenamed({"i": "a", "j": "b"})
    own = spots.select(*by, F.col("spot").alias("a"), F.col("spot").alias("b"))
    return spots, near.unionByName(own)


def _statistic(
    placed: DataFrame, spots: DataFrame, near: DataFrame, by: Sequence[str], run: Sequence[str]
) -> DataFrame:
    """Moran's I per run from rows (by, run, spot, z); z is centred per ``by`` group.

    ``n`` is the number of points with a neighbour. Rows of the weights sum to
    one for exactly these points, so the factor n / S0 is one.
    """
    by, run = list(by), list(run)
    sums = placed.groupBy(*by, *run, "spot").agg(
        F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q")
    )
    sizes = spots.select(*by, F.col("spot").alias("b"), "size")
    degree = (
        equi_join(near, sizes, [*by, "b"], "inner")
        .groupBy(*by, F.col("a").alias("spot"))
        .agg((F.sum("size") - 1).alias("c"))
        .filter(F.col("c") > 0)
    )
    neighbour = sums.select(*by, *run, F.col("spot").alias("b"), F.col("s").alias("sb"))
    lag = (
        equi_join(near, neighbour, [*by, "b"], "inner")
        .groupBy(*by, *run, F.col("a").alias("spot"))
        .agg(F.sum("sb").alias("lag"))
    )
    joined = equi_join(equi_join(sums, degree, [*by, "spot"], "left"), lag, [*by, *run, "spot"], "left")
    part = (F.col("s") * F.col("lag") - F.col("q")) / F.col("c")
    linked = equi_join(spots.select(*by, "spot", "size"), degree, [*by, "spot"], "inner")
    weight = linked.groupBy(*by).agg(F.sum("size").alias("n"))
    totals = joined.groupBy(*by, *run).agg(F.sum(F.coalesce(part, F.lit(0.0))).alias("top"), F.sum("q").alias("square"))
    if by:
        out = equi_join(totals, weight, by, "left")
    else:
        out = totals.withColumn("n", weight.scalar())
    return out.select(*by, *run, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, ratio(F.col("top"), F.col("square"))).alias("moran_i"))


def _centred(points: DataFrame, value: str, x: str, y: str, by: Sequence[str], key: str) -> DataFrame:
    means = points.groupBy(*by).agg(F.avg(value).alias("__mean"))
    joined = equi_join(points, means, list(by), "left") if by else points.withColumn("__mean", means.scalar())
    return joined.select(*by, F.col(key).alias("key"), _place(x, y).alias("spot"), (F.col(value) - F.col("__mean")).alias("z"))


def morans_i(points: DataFrame, key: str, value: str, x: str, y: str, radius: float, by: Sequence[str] = ()) -> DataFrame:
    """Moran's I per group; null where no point has a neighbour."""
    present = points.filter(F.col(value).isNotNull())
    spots, near = _positions(present, x, y, by, radius)
    return _statistic(_centred(present, value, x, y, by, key), spots, near, by, [])


def _links(points: DataFrame, x: str, y: str, by: Sequence[str], radius: float) -> DataFrame:
    """Neighbour list (by, a, b, c, own) of the positions that have a neighbour.

    ``c`` counts the other points around position a; ``own`` is the size of a on
    the row a = b and 0 on all others.
    """
    spots, near = _positions(points, x, y, by, radius)
    sized = equi_join(near, spots.select(*by, F.col("spot").alias("b"), "size"), [*by, "b"], "inner")
    degree = sized.groupBy(*by, "a").agg((F.sum("size") - 1).alias("c")).filter(F.col("c") > 0)
    own = F.when(F.col("a") == F.col("b"), F.col("size")).otherwise(0)
    return equi_join(sized, degree, [*by, "a"], "inner").select(*by, "a", "b", "c", own.alias("own"))


def permuted_sums(centred: DataFrame, by: Sequence[str], nsim: int, seed: int) -> DataFrame:
    """Sums ``s`` and sums of squares ``q`` at every position, for blocks of runs held as arrays.

    Run ``sim`` orders the points of a group by md5(seed:sim:key); the point in
    place r of the order of run 0 gets the value of the point in place r of that
    order, so that run 0 holds the values as observed. Every run deals a value
    to every point: element i of a block belongs to run ``RUN_BLOCK * block + i``.
    """
    by = list(by)
    fixed = hashed_rank(
        centred.withColumn("__d", draw_key(seed, F.lit(0), F.col("key"))), by, "__d", ["key"], "r"
    ).select(*by, "spot", "r")
    runs = centred.select(*by, "key", "z", F.explode(F.sequence(F.lit(0), F.lit(nsim))).alias("sim"))
    # a row for every point and run, of which Spark sees the points alone
    dealt = hashed_rank(
        runs.withColumn("__d", draw_key(seed, F.col("sim"), F.col("key"))), [*by, "sim"], "__d", ["key"], "r"
    ).select(*by, "sim", "r", "z")
    sums = (
        equi_join(never_sent(dealt), fixed, [*by, "r"], "inner")
        .groupBy(*by, "spot", "sim")
        .agg(F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q"))
    )
    block = F.floor(F.col("sim") / RUN_BLOCK).cast("int").alias("block")
    held = sums.groupBy(*by, "spot", block).agg(F.array_sort(F.collect_list(F.struct("sim", "s", "q"))).alias("runs"))
    return held.select(*by, "spot", "block", F.col("runs.s").alias("s"), F.col("runs.q").alias("q"))


def _run_totals(links: DataFrame, sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """The numerator of every run, (by, sim, top), by one aggregation over the neighbour list.

    A link carries a block of runs, so rows are only taken apart after the
    joins, straight into the partial sums of the task.
    """
    by = list(by)
    here = sums.select(*by, F.col("spot").alias("a"), "block", "s", "q")
    there = sums.select(*by, F.col("spot").alias("b"), "block", F.col("s").alias("sb"))
    met = equi_join(equi_join(links, never_sent(there), [*by, "b"], "inner"), never_sent(here), [*by, "a", "block"], "inner")
    products = F.when(
        F.col("a") == F.col("b"), F.zip_with("s", "q", lambda s, q: s * s - q)
    ).otherwise(F.zip_with("s", "sb", lambda s, t: s * t))
    parts = met.select(*by, "block", "c", F.posexplode(products).alias("i", "product"))
    run = (F.col("block") * RUN_BLOCK + F.col("i")).alias("sim")
    return parts.groupBy(*by, run).agg(F.sum(F.col("product") / F.col("c")).alias("top"))


def morans_i_test(
    points: DataFrame, key: str, value: str, x: str, y: str, radius: float, by: Sequence[str] = (), nsim: int = 999, seed: int = 1
) -> DataFrame:
    """Moran's I with a one-sided permutation p-value, (1 + runs at least as large) / (nsim + 1).

    Points, neighbour list and dealt values are stored in the shared folder; the
    observed statistic is run 0 of the same sums. Without a neighbour anywhere in
    a group, or with equal values alone, statistic and p-value are null.
    """
    # a stored constant stands in for the group, so that joins on it stay joins
    groups = list(by) or ["__all"]
    present = points.filter(F.col(value).isNotNull())
    if not by:
        present = present.withColumn("__all", F.lit(0))
    means = present.groupBy(*groups).agg(F.avg(value).alias("__mean"))
    centred = materialise(
        equi_join(present.select(*groups, F.col(key).alias("key"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(value).alias("z")), means, groups)
        .withColumns({"spot": _place("x", "y"), "z": F.col("z") - F.col("__mean")})
        .drop("__mean")
    )
    links = materialise(_links(centred, "x", "y", groups, radius))
    sums = materialise(permuted_sums(centred, groups, nsim, seed))
    # at most nsim + 1 numbers per group
    tops = _run_totals(links, sums, groups).groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("sim", "top"))).alias("__runs"))
    linked = links.groupBy(*groups).agg(F.sum("own").alias("n"))
    squares = centred.groupBy(*groups).agg(F.sum(F.col("z") * F.col("z")).alias("__square"))
    joined = equi_join(equi_join(squares, linked, groups, "left"), tops, groups, "left")
    shown = joined.withColumn("__i", F.transform("__runs.top", lambda top: ratio(top, F.col("__square"))))
    shown = shown.withColumns({"moran_i": F.col("__i")[0], "n": F.coalesce("n", F.lit(0).cast("long"))})
    # guard the comparison of equal permutations against rounding
    as_large = F.size(F.filter(F.slice("__i", 2, nsim), lambda i: i >= F.col("moran_i") - 1e-12)) if nsim else F.lit(0)
    p_value = F.when(F.col("moran_i").isNotNull(), (as_large + 1) / F.lit(float(nsim + 1)))
    return shown.select(*by, "n", "moran_i", p_value.alias("p_value"), F.lit(nsim).cast("long").alias("nsim"))
