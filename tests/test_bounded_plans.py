"""Rows made by explode are never broadcast: Spark sees only the rows they come from."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import joins, sampling
from fieldspark.stats import moran
from fieldspark.verify import analyses, relational  # noqa: F401  (importing registers the queries)
from fieldspark.verify.registry import REGISTRY
from fieldspark.verify.stages import Stages


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def points(spark, tmp_path):
    rows = [(f"g{i % 2}" if i % 5 else None, f"p{i}", float(i % 7), f"s{i % 11}") for i in range(300)]
    spark.createDataFrame(rows, "g string, key string, z double, spot string").write.parquet(f"{tmp_path}/points")
    return spark.read.parquet(f"{tmp_path}/points")


def test_dealt_runs_and_their_bucket_sizes_are_not_broadcast(points):
    assert "Broadcast" not in plan_of(moran.permuted_sums(points, ["g"], 999, 1))


def test_ranked_rows_are_dealt_once_and_null_is_a_group(points):
    drawn = points.withColumn("d", F.md5("key"))
    ranked = sampling.hashed_rank(drawn, ["g"], "d", ["key"], "r")
    assert ranked.columns == [*drawn.columns, "r"] and plan_of(ranked).count("Window [row_number()") == 1
    above = plan_of(ranked).split("Window [row_number()")[0]
    assert "Exchange" not in above.split("SortMergeJoin")[1].split("+- Sort")[0]
    got = ranked.toPandas()
    assert len(got) == 300
    for _, part in got.groupby("g", dropna=False):
        assert part.sort_values("d")["r"].tolist() == list(range(1, len(part) + 1))


def test_neighbouring_cells_are_not_broadcast(points):
    spots = points.select(F.col("key").alias("i"), F.col("z").alias("x"), F.col("z").alias("y"))
    # the counts of the cells alone may be
    assert plan_of(joins.distance_band_pairs(spots, "i", "x", "y", 1.0)).count("BroadcastHashJoin") <= 1


def test_sample_days_and_weather_meet_where_their_site_lies(spark, tmp_path):
    day = lambda d: dt.datetime(1998, 7, 1) + dt.timedelta(d)
    tables = {
        "supplier": ([(k,) for k in range(10)], "s_suppkey long"),
        "orders": ([(i, day(i % 40), 100.0) for i in range(200)], "o_orderkey long, o_orderdate timestamp, o_totalprice double"),
        "lineitem": ([(i % 10, day(i % 50), float(i)) for i in range(300)], "l_suppkey long, l_shipdate timestamp, l_quantity double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    stages = Stages(spark, str(tmp_path))
    joined = REGISTRY["day_join"].build(stages)
    above = plan_of(joined).split("Generate explode")[0]
    assert "Exchange" not in above and "Broadcast" not in above and "SortMergeJoin" in above
    rain = {(r.SITE, r.date): r.tot_tp for r in stages.env.collect()}
    want = {}
    for r in stages.sample_days.collect():
        want.setdefault((r.SITE, r.date.timetuple().tm_yday), []).append(rain[r.SITE, r.date])
    got = {(r.SITE, r.jdate): (r.n, r.tp) for r in joined.collect()}
    assert want and got == {k: (len(v), pytest.approx(sum(v) / len(v))) for k, v in want.items()}
