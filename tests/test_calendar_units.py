from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from nivalgrid.functions import calendar as cal
from nivalgrid.functions import physics, units
from nivalgrid.operators import rollup, timeaxis


def hours(spark, n, value, cells=1, start="2020-01-01 00:00:00"):
    return (spark.range(n * cells).select(
        (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(hours=F.floor(F.col("id") / cells).cast("int"))).alias("ts"),
        (F.col("id") % cells).cast("int").alias("row"), F.lit(0).alias("col"), F.lit(value).alias("v")))


def one(df):
    return df.collect()[0]


def fails(df, text):
    with pytest.raises(Exception, match=text):
        df.collect()


def test_text_times(spark):
    df = spark.createDataFrame([("2017-10-01_00:00:00",), ("2017-10-01T01:00:00",), (" 2017-10-01 02:00:00\x00",)], "s string")
    got = [r[0] for r in df.select(cal.require_timestamp("s")).collect()]
    assert got == [dt.datetime(2017, 10, 1, h) for h in range(3)]


def test_numbers_are_not_guessed_as_times(spark):
    fails(spark.range(3).select(cal.require_timestamp(F.col("id").cast("string"))), "No parseable")


def test_index_to_time(spark):
    df = spark.range(85439).select(cal.index_to_timestamp("id", "2016-10-01 01:00:00").alias("t"))
    r = one(df.agg(F.min("t"), F.max("t"), F.count("t")))
    assert r[0] == dt.datetime(2016, 10, 1, 1) and r[1] == dt.datetime(2026, 6, 30, 23) and r[2] == 85439
    with pytest.raises(ValueError, match="output start datetime"):
        cal.index_to_timestamp("id", None)


def test_index_gap_is_an_error(spark):
    df = spark.createDataFrame([(0,), (1,), (3,)], "i int")
    fails(timeaxis.require_unit_steps(df, [], "i"), "increment by 1")
    assert one(timeaxis.require_unit_steps(df.where("i < 2"), [], "i")).bad_increment_count == 0


def test_depth_totals(spark):
    day = rollup.daily_flux(hours(spark, 24, 2.0, 4), ["row"], {"p": ("v", "mm/timestep")})
    assert [r.p for r in day.collect()] == [48.0] * 4
    rate = rollup.daily_flux(hours(spark, 24, 0.001), ["row"], {"p": ("v", "mm/s")})
    assert one(rate).p == pytest.approx(86.4)
    short = rollup.daily_flux(hours(spark, 23, 2.0), ["row"], {"p": ("v", "mm")})
    assert one(short).p is None
    fails(rollup.daily_flux(hours(spark, 24, 1.0), ["row"], {"p": ("v", "furlong")}), "Unexpected depth units")


def test_shortwave(spark):
    h = hours(spark, 24, 100.0).withColumn("a", F.col("v") * 0.25)
    r = one(rollup.daily_shortwave(h, ["row"], "v", "a"))
    assert r.incoming_sw_w_m2 == pytest.approx(100.0) and r.incoming_sw_energy_mj_m2 == pytest.approx(8.64)
    assert r.effective_albedo == pytest.approx(0.75)


def test_time_step_and_gaps(spark):
    h = hours(spark, 3, 1.0).withColumn("k", F.lit("a"))
    assert one(timeaxis.time_step_seconds(h, ["k"])).step_seconds == 3600.0
    assert one(timeaxis.axis_report(h, ["k"])).unexpected_gap_count == 0
    gap = h.where(F.hour("ts") != 1)
    assert one(timeaxis.axis_report(gap, ["k"])).unexpected_gap_count == 1
    twice = timeaxis.axis_report(h.unionByName(h.limit(1)), ["k"])
    fails(timeaxis.enforce_axis(twice), "duplicates")


def test_gap_over_a_chunk_boundary(spark):
    h = hours(spark, 4, 1.0, start="2020-01-31 22:00:00").withColumn("k", F.lit("a"))
    r = one(timeaxis.axis_report(h.where(F.hour("ts") != 0), ["k"]))
    assert (r.record_count, r.unexpected_gap_count) == (3, 1)


def test_completeness_policy(spark):
    ok = timeaxis.daily_completeness(hours(spark, 24, 1.0), ["row"])
    assert one(ok).complete_00_23 and one(ok).has_state_hour
    bad = timeaxis.daily_completeness(hours(spark, 23, 1.0), ["row"])
    fails(timeaxis.apply_incomplete_policy(bad), "incomplete day")
    assert timeaxis.apply_incomplete_policy(bad, "warn").count() == 0
    doubled = hours(spark, 23, 1.0).unionByName(hours(spark, 1, 1.0))
    r = one(timeaxis.daily_completeness(doubled, ["row"]))
    assert r.hour_count == 24 and not r.complete_00_23


def test_state_hour_must_be_unique(spark):
    h = hours(spark, 24, 1.5)
    assert one(rollup.daily_state(h, ["row"], {"v": 1000.0}, hour=23)).v == 1500.0
    fails(rollup.daily_state(h.unionByName(h), ["row"], {"v": 1.0}, hour=23), "exactly one state")


def test_fraction_scale(spark):
    df = spark.createDataFrame([("a", 0.2), ("a", 1.2), ("b", 40.0), ("b", 100.2), ("c", None)], "k string, v double")
    got = {r.k: r.fraction_divisor for r in rollup.fraction_scale(df, ["k"], "v").collect()}
    assert got == {"a": 1.0, "b": 100.0, "c": 1.0}
    for bad in (-0.1, 101.0):
        fails(rollup.fraction_scale(spark.createDataFrame([("a", bad)], "k string, v double"), ["k"], "v"), "fraction column")


def test_missing_hours_do_not_become_zero(spark):
    h = hours(spark, 24, 1.0).select("ts", F.when(F.hour("ts") != 5, F.col("v")).alias("rain_mm_s"), F.lit(280.0).alias("temp_k"),
                                     F.col("v").alias("sw_w_m2"), F.col("v").alias("lw_w_m2"))
    r = one(rollup.daily_forcing(h, []))
    assert r.precip_mm_day is None and r.incoming_sw_mean_w_m2 == 1.0


def test_units(spark):
    df = spark.createDataFrame([("  Kg   m**-2 ",)], "u string")
    assert one(df.select(units.normalize_units("u")))[0] == "kg m^-2"
    fails(df.select(units.require_units("u", units.WIND_UNITS, "wind")), "Unexpected units for wind")
    t = spark.createDataFrame([(280.15, "K"), (7.0, "degrees_celsius")], "v double, u string")
    assert [round(r[0], 6) for r in t.select(units.temperature_to_c("v", "u")).collect()] == [7.0, 7.0]


def test_bins(spark):
    v = [0.0, 0.05, 0.1, 0.5, 0.9, 0.95, 1.0 - 1e-7, 1.0, None]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    got = df.select(physics.cover_bin5("v"), physics.cover_bin10("v")).collect()
    assert [r[0] for r in got] == [None, 4, 3, 2, 1, 1, 0, 0, None]
    assert [r[1] for r in got] == [0, 0, 1, 5, 9, 9, 9, 9, None]


def test_breaks(spark):
    df = spark.createDataFrame([(1234.0,), (0.2,)], "m double")
    got = [[round(x, 6) for x in r[0]] for r in df.select(physics.nice_breaks("m")).collect()]
    assert got == [[0, 150, 375, 750, 1125, 1500], [0, 0.1, 0.25, 0.5, 0.75, 1.0]]
    diff = one(df.limit(1).select(physics.nice_breaks("m", True)))[0]
    assert len(diff) == 11 and diff[0] == -1500 and diff[5] == 0
    with pytest.raises(ValueError):
        physics.check_breaks([0, 2, 1])
    with pytest.raises(ValueError):
        physics.check_breaks([0, 1, 2], difference=True)


def test_season_dates(spark):
    df = spark.createDataFrame([(2020,)], "wy int").select(cal.season_date("wy", "11-01"), cal.season_date("wy", "03-15"))
    assert list(one(df)) == [dt.date(2019, 11, 1), dt.date(2020, 3, 15)]
    with pytest.raises(ValueError):
        cal.parse_month_day("13-01")
    feb = spark.createDataFrame([("02-29",), ("10-05",)], "m string").select(cal.focus_date("m", 2021))
    assert [r[0] for r in feb.collect()] == [None, dt.date(2020, 10, 5)]
