"""One small frame per rule on nulls, calendar edges, joins, windows and ties."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fieldspark.functions import calendar as cal
from fieldspark.functions import nulls, text
from fieldspark.operators import aggregates as agg
from fieldspark.operators import joins as jn
from fieldspark.operators import projection as pr
from fieldspark.operators import reshape as rs
from fieldspark.operators import sampling, windows
from fieldspark.plans import climate, samples


def day(text_date: str) -> dt.date:
    return dt.date.fromisoformat(text_date)


def column(df, name):
    return [r[name] for r in df.collect()]


def test_strict_and_skipping_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", 2.0)], "g string, x double")
    strict = {r.g: r.x for r in agg.mean_by(df, ["g"], ["x"]).collect()}
    plain = {r.g: r.x for r in agg.mean_by(df, ["g"], ["x"], strict=False).collect()}
    assert strict == {"a": None, "b": 2.0} and plain == {"a": 2.0, "b": 2.0}


def test_joins_match_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (2, "r")], "k int, b string")
    assert sorted(column(jn.natural_join(a, b), "b")) == ["p", "q"]
    assert jn.drop_matching_rows(b, a, ["k"]).collect()[0].b == "r"
    with pytest.raises(ValueError):
        jn.natural_join(a, b, keys=["z"])


def test_suffix_join_renames_clashes(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 5.0, 7.0)], "k int, v double, w double")
    assert jn.suffix_join(a, b, ["k"], "_clim").first().asDict() == {"k": 1, "v": 2.0, "v_clim": 5.0, "w": 7.0}


def test_descending_spans(spark):
    df = spark.createDataFrame([(day("2020-01-02"), day("2020-01-02")), (day("2021-12-28"), day("2022-01-04"))], "s date, e date")
    left = df.select(cal.date_span(F.col("s"), F.col("e")).alias("d")).collect()
    assert left[0].d == [day("2020-01-02"), day("2020-01-01")] and len(left[1].d) == 7
    both = df.select(cal.date_span(F.col("s"), F.col("e"), "both").alias("d")).collect()
    assert len(both[0].d) == 1 and len(both[1].d) == 8
    plain = df.select(cal.day_number_span(F.col("s"), F.col("e")).alias("d")).collect()
    assert plain[1].d == list(range(363, 3, -1)) and plain[0].d == [3, 2]
    wrapped = df.select(cal.day_number_span(F.col("s"), F.col("e"), wrap=True).alias("d")).collect()
    assert wrapped[1].d == [363, 364, 365, 1, 2, 3, 4] and wrapped[0].d == []


def test_half_year_shift_and_rounding(spark):
    df = spark.createDataFrame([(1,), (183,), (184,), (366,)], "d int")
    assert column(df.select(cal.seasonal_day(F.col("d"), F.lit(-1.0)).alias("s")), "s") == [183, 365, 1, 183]
    assert column(df.select(cal.seasonal_day(F.col("d"), F.lit(0.0)).alias("s")), "s") == [1, 183, 184, 366]
    half = spark.createDataFrame([(183.5,)], "d double").select(cal.whole_day(cal.seasonal_day(F.col("d"), F.lit(-1.0))).alias("s"))
    assert half.first().s == 1.0
    bij = spark.range(1, 366).select(cal.shift_half_year(F.col("id")).alias("s")).distinct()
    assert bij.count() == 365


def test_zero_division_and_log(spark):
    row = spark.range(1).select(
        nulls.ratio(F.lit(1), F.lit(0)).alias("r"), nulls.safe_log(F.lit(0.0)).alias("l"), text.paste(F.lit("a"), F.lit(None)).alias("p")
    ).first()
    assert row.r is None and row.l is None and row.p == "a_NA"


def test_clamp_keeps_null_and_truncation_uses_old_values(spark):
    df = spark.createDataFrame([(-9.0, 2.0), (1.0, 3.0), (None, 4.0)], "x double, a double")
    assert [tuple(r) for r in pr.truncate_linked(df, "x", "a", -7.0).collect()] == [(-7.0, 0.0), (1.0, 3.0), (None, None)]


def test_top_row_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 5.0), ("a", 2, 5.0), ("b", 1, None), ("b", 2, None)], "g string, d int, v double")
    best = windows.top_rows(df, ["g"], [F.desc_nulls_last("v"), F.asc("d")])
    assert {r.g: r.d for r in best.collect()} == {"a": 1, "b": 1}


def test_top_rows_beyond_the_group_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    got = windows.top_rows(df, ["g"], [F.desc("v")], 1500)
    assert got.count() == 3000 and got.agg(F.min("v")).first()[0] == 2000


def test_islands_and_chunks(spark):
    days = [day("2020-01-01") + dt.timedelta(d - 1) for d in [*range(1, 9), *range(10, 16)]]
    df = spark.createDataFrame([("s", d) for d in days], "SITE string, date date")
    rows = windows.day_chunks(df, ["SITE"]).groupBy("island", "chunk").count().collect()
    assert {(r.island, r.chunk): r["count"] for r in rows} == {(0, 0): 7, (0, 1): 1, (1, 0): 6}


def test_window_sum_counts_rows_not_days(spark):
    random.seed(3)
    rows = [("s", "1999", random.randint(1, 60), float(random.randint(1, 9))) for _ in range(80)]
    df = spark.createDataFrame(rows, "SITE string, year string, d int, v double")
    got = {r.d: r.t for r in windows.window_sum_ahead(df, ["SITE", "year"], "d", "v", 21, 19, "t").collect()}
    for d in {r[2] for r in rows}:
        inside = [r[3] for r in rows if d <= r[2] <= d + 20]
        assert got[d] == (pytest.approx(sum(inside)) if len(inside) >= 19 else None)


def test_isolated_samples_and_sparse_sites(spark):
    def sample(code, site, start, end):
        return (code, site, "Natural", 1.0, 1.0, day(start), day(end), 2.0)

    rows = [sample(f"a{i}", "A", f"2001-05-0{i}", f"2001-05-0{i + 1}") for i in range(1, 6)]
    rows += [sample("a9", "A", "2003-05-01", "2003-05-04")]  # alone in both years
    rows += [sample(f"b{i}", "B", f"2001-05-0{i}", f"2001-05-0{i + 1}") for i in range(1, 4)]  # too few
    rows += [sample("c1", "C", "2000-12-30", "2001-01-02")]  # alone by start and end
    rows += [sample(f"g{i}", "NEGreenland", f"2001-05-0{i}", f"2001-05-0{i + 1}") for i in range(1, 6)]
    schema = "SAMPLE_CODE string, SITE string, SITE_TYPE string, SITE_LATITUDE double, SITE_LONGITUDE double, START_DATE date, COLL_DATE date, Weight double"
    kept = samples.keep_usable(spark.createDataFrame(rows, schema))
    assert sorted(column(kept, "SAMPLE_CODE")) == [f"a{i}" for i in range(1, 6)]
    dated = spark.createDataFrame(rows, schema).withColumns({"ys": cal.year_text(F.col("START_DATE")), "ye": cal.year_text(F.col("COLL_DATE"))})
    left = windows.drop_isolated(dated, ["SITE", "ys"], ["SITE", "ye"])
    assert "a9" not in column(left, "SAMPLE_CODE") and "c1" not in column(left, "SAMPLE_CODE") and left.count() == 13


def test_sequence_equality(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "p int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "p int, v string")
    assert rs.same_sequence(a, a, "p", "v").first().same is True
    assert rs.same_sequence(a, b, "p", "v").first().same is False


def test_contains_any_matches_substrings(spark):
    df = spark.createDataFrame([("P1_Urban",), ("P12_Urban",), ("Q7",)], "s string")
    words = spark.createDataFrame([("P1",), ("zz",)], "w string")
    assert sorted(column(jn.contains_any(df, "s", words, "w"), "s")) == ["P12_Urban", "P1_Urban"]
    assert jn.contains_any(df, "s", words.filter("false"), "w").count() == 0


def test_distance_pairs_against_brute_force(spark):
    random.seed(5)
    points = [(i, random.uniform(0, 10), random.uniform(0, 10)) for i in range(120)] + [(200 + i, 5.0, 5.0) for i in range(40)]
    df = spark.createDataFrame(points, "i int, x double, y double")
    got = {(r.i, r.j) for r in jn.distance_band_pairs(df, "i", "x", "y", 1.5, cell_load=7).collect()}
    want = {
        (a[0], b[0]) for a in points for b in points if a[0] != b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 1.5**2
    }
    assert got == want


def test_exact_sample_size_and_repeatability(spark):
    df = spark.range(10000).select(F.col("id").alias("k"))
    one = column(sampling.sample_rows(df, ["k"], 777, 4), "k")
    two = column(sampling.sample_rows(df.repartition(13), ["k"], 777, 4), "k")
    assert len(one) == 777 and sorted(one) == sorted(two)
    assert sampling.sample_rows(df, ["k"], 20000, 4).count() == 10000


def test_hashed_rank_is_a_dense_ranking(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id"), F.md5(F.col("id").cast("string")).alias("d"))
    ranked = sampling.hashed_rank(df, ["g"], "d", ["id"], "r").toPandas().sort_values(["g", "d"])
    for _, part in ranked.groupby("g"):
        assert part["r"].tolist() == list(range(1, 1001))


def test_standardise_ignores_nulls(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    got = column(agg.standardise(df, ["x"]), "x")
    assert got[2] is None and got[0] == pytest.approx(-(2**-0.5)) and got[1] == pytest.approx(2**-0.5)


def test_group_effect_missing_level(spark):
    df = spark.createDataFrame([("a",), ("b",)], "g string")
    effects = spark.createDataFrame([("a", 1.5)], "g string, e double")
    assert sorted(column(jn.group_effect(df, effects, "g", "e", "zero"), "e")) == [0.0, 1.5]
    with pytest.raises(Exception, match="no effect"):
        jn.group_effect(df, effects, "g", "e").collect()


def test_wide_reshape_and_split(spark):
    df = spark.createDataFrame([("P1_Natural", 1.0), ("P1_Urban", 2.0), ("S3", 3.0)], "SITE string, v double")
    parts = rs.split_column(df, "SITE", ["pair", "side"])
    assert {r.pair: r.side for r in parts.filter("side is null").collect()} == {"S3": None}
    wide = rs.to_wide(parts.filter("side is not null"), ["pair"], "side", ["Natural", "Urban"], {"v": "v"})
    assert wide.first().asDict() == {"pair": "P1", "v_Natural": 1.0, "v_Urban": 2.0}


def test_cutoffs_are_null_with_a_null_residual(spark):
    days = [("a", 45.0, dt.date(2020, 5, 1), dt.date(2020, 5, 3), 2.0), ("b", 45.0, dt.date(2020, 5, 1), dt.date(2020, 5, 3), 0.0)]
    samples_ = spark.createDataFrame(days, "SITE string, SITE_LATITUDE double, START_DATE date, COLL_DATE date, DB_sample double")
    rows = [("a", 122, -3.0, 0.1), ("a", 123, -5.0, None), ("a", 200, -9.0, 0.9), ("b", 122, -8.0, 0.8)]
    residuals = spark.createDataFrame(rows, "SITE string, jdate int, temp_res double, snow_res double")
    assert climate.residual_cutoffs(residuals, samples_).first().asDict() == {"min_temp": -5.0, "max_snow": None}


SMALL = "/root/testdata/sf0.001"


def test_rounded_equals_round(spark):
    from fieldspark.verify.columns import rounded

    values = [None, 0.0, -0.0, 0.0000005, 0.0000015, -0.0000005, 2.5e-7, 1.0000005, 99999.9999995, 123456.1234565, 1e300, float("inf"), float("nan"), -3.14159265]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    spread = spark.range(50000).select((F.sin("id") * F.pow(F.lit(10.0), F.col("id") % 12 - 5)).alias("v"))
    every = rows.union(spread).select((rounded(F.col("v"), 6) + 0.0).alias("got"), (F.round("v", 6) + 0.0).alias("want"))
    assert every.where("NOT got <=> want").count() == 0
    plan = every.select("got")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "floor" in plan


def test_rows_with_null_keys_join_apart(spark):
    from fieldspark.operators.joins import suffix_join

    a = spark.createDataFrame([("x", 1, 1.0), (None, 1, 2.0), ("y", 2, 3.0), ("x", 1, 4.0)], "k string, d int, v double")
    b = spark.createDataFrame([("x", 1, 5.0), (None, 1, 6.0), (None, 2, 7.0), ("x", 1, 8.0)], "k string, d int, v double")
    for how in ("left", "inner", "left_semi", "left_anti"):
        old = suffix_join(a, b, ["k", "d"], "_b", how, ["k"])
        new = suffix_join(a, b, ["k", "d"], "_b", how, ["k"], apart=True)
        assert old.columns == new.columns
        assert sorted(map(str, old.collect())) == sorted(map(str, new.collect()))


def test_days_and_climatology_join_without_a_shuffle_of_days(spark):
    from __spark_entry__ import queries
    from fieldspark.verify.stages import Stages

    plan = queries()["left_join_suffix"].frame(Stages(spark, SMALL))._jdf.queryExecution().executedPlan().toString().splitlines()
    days = [line for line in plan if "Exchange" in line and ("jdate" in line or "dayofyear" in line or "BroadcastExchange" in line and "date" in line)]
    # only rows without a site are dealt again, by their null-safe keys
    assert all("coalesce(SITE" in line or "coalesce(__SITE" in line for line in days)
    assert any("SortMergeJoin [SITE#" in line for line in plan)
