"""Sample periods whose climatology has gaps."""

import datetime

from pyspark.sql import functions as F

from fieldspark.plans.samples import ENV_VARIABLES, PERIOD_KEYS, SITE_KEYS, weather_anomalies


def test_a_split_period_has_a_median_for_each_part(spark):
    first = datetime.date(2021, 5, 1)
    days = spark.createDataFrame([(first + datetime.timedelta(i),) for i in range(4)], "date date")
    site = {k: F.lit("s") if k == "SITE" else F.lit(1.0) for k in SITE_KEYS}
    fixed = {"START_DATE": F.lit(first), "COLL_DATE": F.lit(first + datetime.timedelta(4)), "SAMPLE_CODE": F.lit("c"), "SITE_TYPE": F.lit("t")}
    others = {k: F.lit(1.0) for k in PERIOD_KEYS if k not in {*site, *fixed, "site_sde"}}
    weather = {v: F.lit(2.0) for v in ENV_VARIABLES}
    env = days.withColumns(site | weather)
    climate = days.where("date < '2021-05-03'").select(F.dayofyear("date").alias("jdate")).withColumns(site | weather | {"site_sde": F.lit(0.5)})
    got = weather_anomalies(days.withColumns(site | fixed | others), env, climate).select("site_sde", "jdate").collect()
    assert sorted((str(r.site_sde), r.jdate) for r in got) == [("0.5", 121.5), ("None", 123.5)]
