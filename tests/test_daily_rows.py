"""Daily rows are made where their site lies and are not dealt out again."""

import datetime as dt

import pytest

from fieldspark.operators.aggregates import mean_by
from fieldspark.operators.reshape import difference, intersection
from fieldspark.plans import climate, samples
from fieldspark.sources.schemas import ENV_VARIABLES, SITE_KEYS
from fieldspark.sources.standin import DAYS, FIRST_DAY, LAST_DAY
from fieldspark.verify.stages import Stages
from pyspark.sql import functions as F

SHIPPED = [
    (0, "1995-01-01", 3.0), (0, "1995-01-01", 4.0), (0, "1995-01-05", 1.0), (0, "2001-12-31", 2.0),
    (0, "1994-12-31", 9.0), (0, "2002-01-01", 9.0), (0, None, 9.0),
    (4, "1995-01-06", None), (4, "1998-02-28", 5.0), (None, "1998-02-28", 7.0), (99, "1998-02-28", 7.0),
]


@pytest.fixture
def stages(spark, tmp_path):
    keys = [(0,), (4,), (5,), (5,), (None,)]
    spark.createDataFrame(keys, "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    lines = spark.createDataFrame(SHIPPED, "l_suppkey long, day string, l_quantity double")
    lines.withColumn("l_shipdate", F.col("day").cast("timestamp")).drop("day").write.parquet(f"{tmp_path}/lineitem.parquet")
    return Stages(spark, str(tmp_path))


def above(frame, below: str) -> str:
    """The part of the physical plan that comes after an operator."""
    lines = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    return "\n".join(lines[: next(i for i, line in enumerate(lines) if below in line)])


def test_every_site_has_every_day_with_its_quantity(stages):
    rows = stages.env.collect()
    assert len(rows) == 5 * DAYS
    got = {(r.SITE, str(r.date)): round(r.tot_tp * 1000) for r in rows if r.tot_tp}
    assert got == {("S0", "1995-01-01"): 7, ("S0", "1995-01-05"): 1, ("S0", "2001-12-31"): 2, ("P2_Natural", "1998-02-28"): 5}
    days = sorted(r.date for r in rows if r.SITE == "S0")
    assert days == [dt.date.fromisoformat(FIRST_DAY) + dt.timedelta(i) for i in range(DAYS)] and str(days[-1]) == LAST_DAY
    assert sum(r.SITE is None for r in rows) == DAYS and sum(r.SITE == "P2_Urban" for r in rows) == 2 * DAYS


@pytest.mark.parametrize("source", ["env", "daily"])
def test_means_per_site_move_no_day(stages, source):
    env = getattr(stages, source)
    means = mean_by(env.withColumn("jdate", F.dayofyear("date")), [*SITE_KEYS, "jdate"], ENV_VARIABLES)
    assert "Exchange" not in above(means, "Generate explode")
    assert "Exchange" not in above(climate.climatology(climate.clean_predictors(env)), "Generate explode")


@pytest.mark.parametrize("name", ["harmonics", "sample_n"])
def test_line_items_are_summed_where_their_site_is_dealt(stages, name):
    from __spark_entry__ import queries

    plan = queries()[name].frame(stages)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    scan = max(i for i, line in enumerate(plan) if "l_suppkey" in line and "Relation" in line)
    dealt = max(i for i, line in enumerate(plan[:scan]) if "RepartitionByExpression" in line)
    summed = max(i for i, line in enumerate(plan[:scan]) if "sum(l_quantity" in line or "Aggregate [" in line)
    assert summed < dealt


def test_tasks_grow_with_the_sites(stages, monkeypatch):
    monkeypatch.setattr("fieldspark.sources.standin.SITES_PER_TASK", 0.1)
    assert stages.site_parts >= 50


def test_active_years_are_found_where_the_days_lie(spark, stages):
    rows = [("S0", "a", -19.0, 47.0, "1995-06-01", "1995-06-03"), ("S0", "a", -19.0, 47.0, "1995-06-02", "1995-06-03"), ("S0", "a", -19.0, 47.0, "1997-06-02", None)]
    days = spark.createDataFrame(rows, "SITE string, SITE_TYPE string, SITE_LATITUDE double, SITE_LONGITUDE double, date string, COLL_DATE string")
    days = days.withColumns({c: F.col(c).cast("date") for c in ("date", "COLL_DATE")})
    chunks = samples.unsampled_chunks(stages.env, days)
    assert not any("Exchange" in line and "year#" in line for line in above(chunks, "Generate explode").splitlines())
    got = chunks.collect()
    assert {r.date.year for r in got} == {1995} and len(got) == 363
    assert not {str(r.date) for r in got} & {"1995-06-01", "1995-06-02"} and {r.island for r in got} == {0, 1}


def test_sample_days_meet_the_weather_where_it_lies(spark, stages):
    rows = [("S0", f"c{i}", -19.0, 47.0, f"1995-0{m}-28", f"1995-0{m + 1}-03") for i, m in enumerate((2, 4, 4, 6))]
    periods = spark.createDataFrame(rows, "SITE string, SAMPLE_CODE string, SITE_LATITUDE double, SITE_LONGITUDE double, START_DATE string, COLL_DATE string")
    fixed = {"SITE_TYPE": F.lit("t"), "SAMPLE_WEIGHT": F.lit(None).cast("double"), "DB_sample": F.lit(1.0), "n_days": F.datediff("COLL_DATE", "START_DATE")}
    stages.stored_rates = periods.withColumns({c: F.col(c).cast("date") for c in ("START_DATE", "COLL_DATE")}).withColumns(fixed)
    found = stages.periods
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan
    got = {r.SAMPLE_CODE: r for r in found.where("DB_sample = 1").collect()}
    assert sorted(got) == ["c0", "c1", "c2", "c3"]
    days = stages.env.where("SITE = 'S0' AND date BETWEEN '1995-02-28' AND '1995-03-02'").toPandas()
    clim = stages.climatology.where("SITE = 'S0' AND jdate BETWEEN 59 AND 61").toPandas()
    assert got["c0"].avg_t2m_anom == pytest.approx(days.avg_t2m.mean() - clim.avg_t2m.mean()) and got["c0"].jdate == 60


def test_copies_go_before_the_set_joins(spark):
    a = spark.createDataFrame([("x", None), ("x", None), ("y", "1"), ("y", "1"), ("z", "2")], "k string, v string")
    b = spark.createDataFrame([("x", None), ("z", "2"), ("z", "2"), ("w", "2")], "k string, v string")
    for found, want in ((difference(a, b), [("y", "1")]), (intersection(a, b), [("x", None), ("z", "2")])):
        assert sorted(map(tuple, found.collect())) == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate", plan.index("Join")) == 2


def test_stored_weather_is_dealt_once_in_plain_arrays(stages):
    kinds = dict(stages.site_weather.dtypes)
    assert kinds["shipped"] == "array<smallint>" and kinds["quantities"] == "array<double>"
    plan = stages.daily.join(stages.daily_climatology.hint("merge"), [*SITE_KEYS], "left")
    text = plan._jdf.queryExecution().executedPlan().toString()
    scans = {line.split("PushedFilters: ")[1].split("ReadSchema")[0] for line in text.splitlines() if "FileScan" in line and "shipped" in line}
    assert len(scans) == 1
    assert stages.climatology.where("SITE IS NULL").isEmpty()
