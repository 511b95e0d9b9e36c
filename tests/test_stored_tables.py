"""What the sample and model queries store, and what they leave on the disk."""

import time

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from fieldspark.plans import models
from fieldspark.plans.samples import PERIOD_MEANS
from fieldspark.sources import io
from fieldspark.verify.stages import Stages

from .test_daily_rows import above


@pytest.fixture
def stages(spark, tmp_path):
    """Two sites with a sample every third week of two years, and weather for both."""
    spark.createDataFrame([(0,), (4,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    orders = spark.range(0, 140).select(
        F.col("id").alias("o_orderkey"),
        F.date_add(F.lit("1996-01-01").cast("date"), (F.col("id") * 5).cast("int")).cast("timestamp").alias("o_orderdate"),
        (F.col("id") * 131 % 977 + 100.5).alias("o_totalprice"),
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(0, 900).select(
        (F.col("id") % 2 * 4).alias("l_suppkey"),
        F.date_add(F.lit("1995-02-01").cast("date"), (F.col("id") * 2).cast("int")).cast("timestamp").alias("l_shipdate"),
        (F.col("id") * 37 % 50 + 1.0).alias("l_quantity"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    return Stages(spark, str(tmp_path))


@pytest.fixture
def stored(monkeypatch):
    """The columns of every frame that the stages store."""
    columns = []

    def noted(df):
        columns.append(set(df.columns))
        return io.materialise(df)

    monkeypatch.setattr("fieldspark.verify.stages.materialise", noted)
    return columns


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_stored_frame_leaves_no_shuffle_files(spark):
    former = spark.conf.get(io.SHUFFLE_CLEANUP)
    before = shuffle_files(spark)
    frame = io.materialise(spark.range(0, 5000, 1, 4).groupBy((F.col("id") % 700).alias("k")).agg(F.sum("id").alias("s")))
    deadline = time.time() + 20
    while shuffle_files(spark) > before and time.time() < deadline:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before and spark.conf.get(io.SHUFFLE_CLEANUP) == former
    assert frame.agg(F.sum("s")).first()[0] == 4999 * 2500 and frame.count() == 700


def test_a_failed_write_restores_the_setting(spark):
    former = spark.conf.get(io.SHUFFLE_CLEANUP)
    with pytest.raises(Exception, match="stopped"):
        io.materialise(spark.range(1).select(F.raise_error(F.lit("stopped")).alias("x")))
    assert spark.conf.get(io.SHUFFLE_CLEANUP) == former


@pytest.mark.parametrize("name", ["climate_zone", "gram", "drop_hierarchical"])
def test_weather_means_are_not_stored_where_nothing_reads_them(stages, stored, name):
    frame = queries()[name].frame(stages)
    assert stored and not any(columns & set(PERIOD_MEANS) for columns in stored)
    assert frame.count() or name == "drop_hierarchical"  # its sites may all be nested ones


def test_the_narrow_table_has_every_sample(stages):
    narrow = stages.described
    assert stages.truncated.count() == narrow.count() > 0
    assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, stages.truncated.select(*narrow.columns).collect()))


def test_samples_meet_the_residuals_where_their_site_lies(stages):
    joined = stages.model_samples
    assert not any("hashpartitioning" in line and "ENSURE_REQUIREMENTS" in line for line in above(joined, "Generate explode").splitlines())
    assert joined.count() == stages.rates.count() > 0 and joined.where("temp_res IS NOT NULL").count() > 0


def test_season_models_store_only_their_columns(stages, stored):
    rows = stages.season_samples
    assert set(rows.columns) == {models.RESPONSE, "SITE", "year", "lat", "cos1", "sin1", "cos2", "sin2"}
    assert set(rows.columns) in stored and rows.count() == stages.rates.count()
