from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nivalgrid.functions import stats
from nivalgrid.operators import events, relate, series
from nivalgrid.plans import accumulation, stations

D = dt.date


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bias_sign(spark):
    df = frame(spark, [(1.0, 2.0), (2.0, 3.0), (3.0, 4.0), (9.0, None)], "x double, y double")
    r = df.agg(stats.pearson("x", "y").alias("r"), stats.mean_bias("x", "y").alias("b"), stats.pair_count("x", "y").alias("n")).first()
    assert r.r == pytest.approx(1.0) and r.b == 1.0 and r.n == 3


def test_constant_series_has_no_correlation(spark):
    df = frame(spark, [(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(stats.pearson("x", "y")).first()[0] is None


def test_either_rule_and_gap_handling(spark):
    rows = [(1, D(2020, 1, 1), 0.0, 0.0), (1, D(2020, 1, 2), 0.5, 2.0), (1, D(2020, 1, 3), 0.5, 2.0), (1, D(2020, 1, 4), 0.5, 2.0)]
    df = frame(spark, rows, "k int, date date, x double, y double")
    got = events.change_events(df, ["k"], "x", "y", "accumulation", 1.0).collect()
    assert [(r.change_x, r.change_y) for r in got] == [(0.5, 2.0)]
    assert events.change_events(df, ["k"], "x", "y", "accumulation", 1.0, rule="both").count() == 0
    holed = df.where("date <> DATE'2020-01-02'")
    assert events.change_events(holed, ["k"], "x", "y", "accumulation", 1.0).count() == 1
    assert events.change_events(holed, ["k"], "x", "y", "accumulation", 1.0, consecutive=True).count() == 0


def test_case_years_and_ties(spark):
    df = frame(spark, [(2018, -2.0), (2019, 8.0), (2020, -0.5), (2021, -8.0), (2022, 0.5)], "water_year int, m double")
    r = accumulation.case_years(df, "m").first()
    assert (r.largest_year, r.largest_signed_value, r.smallest_year, r.smallest_signed_value) == (2019, 8.0, 2020, -0.5)
    none = accumulation.case_years(df.where("m > 99"), "m").first()
    assert none.largest_year is None


def test_half_date(spark):
    rows = [("a", D(2020, 3, i + 1), v) for i, v in enumerate([1.0, 1.0, 6.0, 2.0])]
    rows += [("z", D(2020, 3, 1), 0.0), ("z", D(2020, 3, 2), None), ("n", D(2020, 3, 1), -3.0), ("n", D(2020, 3, 5), 4.0)]
    got = {r.k: r.h for r in series.half_dates(frame(spark, rows, "k string, date date, v double"), ["k"], {"h": "v"}).collect()}
    assert got == {"a": D(2020, 3, 3), "z": None, "n": D(2020, 3, 5)}


def test_decomposition_closes(spark):
    rows = []
    for s, swe, snow, prec in (("I", (20, 120), (50, 150), (60, 160)), ("N", (15, 90), (45, 120), (55, 130))):
        for i, d in enumerate((D(2017, 11, 1), D(2018, 3, 15))):
            rows.append((s, 2018, d, float(swe[i]), float(snow[i]), float(prec[i])))
    df = frame(spark, rows, "source string, water_year int, date date, swe_mm double, snowfall_mm double, precip_mm double")
    r = accumulation.decomposition(df).first()
    assert r.closure == pytest.approx(0.0, abs=1e-9)
    assert r.share_initial_pct + r.share_snowfall_pct + r.share_retention_pct == pytest.approx(100.0)
    assert r.delta_end == -30.0 and r.c_initial == -5.0
    empty = accumulation.decomposition(df.withColumn("snowfall_mm", F.lit(0.0))).first()
    assert empty.eta_I is None and empty.closure is None


def test_peak_ratio(spark):
    data = {"S": ((0, 10, 30, 20), (2, 3, 5, 7)), "I": ((0, 8, 24, 20), (1, 2, 3, 4)), "N": ((0, 7, 21, 18), (2, 2, 2, 2))}
    rows = [(s, 1, 2018, D(2017, 10, i + 1), float(a[i]), float(a[i]) * 3, float(p[i])) for s, (a, p) in data.items() for i in range(4)]
    df = frame(spark, rows, "source string, station_id bigint, water_year int, date date, swe_mm double, snow_depth_mm double, precip_mm double")
    got = {r.source: (r.precip_to_peak_mm, r.f_swe_precip) for r in stations.annual_by_source(df).collect()}
    assert got == {"S": (10.0, 3.0), "I": (6.0, 4.0), "N": (6.0, 3.5)}
    holed = stations.annual_by_source(df.where("NOT (source = 'S' AND date = DATE'2017-10-02')"))
    assert holed.where("source = 'S'").first().f_swe_precip is None


def naive_depletion(values, threshold, run):
    s = pd.Series(values).dropna().sort_index()
    if s.empty:
        return None
    peak, when = s.max(), s.idxmax()
    post = s[s.index >= when]
    days = []
    for f in (0.75, 0.5, 0.25):
        hit = post.index[post / peak <= f] if peak > 0 else []
        days.append((hit[0] - when).days if len(hit) else None)
    full = s.reindex(pd.date_range(s.index.min(), s.index.max()))
    after = full[full.index > when]
    streak, gone = 0, None
    for d, v in after.items():
        streak = streak + 1 if (v == v and v < threshold) else 0
        if streak == run:
            gone = (d - pd.Timedelta(days=run - 1)).date()
            break
    return float(peak), when.date(), *days, gone


def test_depletion_against_naive_model(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for k in range(60):
        values = {}
        for i in range(rng.randint(1, 60)):
            if rng.random() < 0.85:
                level = max(0, 20 - abs(i - 15)) if k % 2 else rng.randint(0, 12)
                values[pd.Timestamp(2020, 1, 1) + pd.Timedelta(days=i)] = None if rng.random() < 0.1 else float(level)
        rows += [(k, d.date(), v) for d, v in values.items()]
        want[k] = naive_depletion({d: np.nan if v is None else v for d, v in values.items()}, 4.0, 3)
    df = frame(spark, rows, "k int, date date, v double")
    got = {r.k: (r.peak_value, r.peak_date, r.days_to_75, r.days_to_50, r.days_to_25, r.disappearance_date)
           for r in series.depletion(df, ["k"], "v", threshold=4.0, run_days=3).collect()}
    assert got == {k: w for k, w in want.items() if w is not None}


def test_running_sums_and_rolling(spark):
    rows = [("a", D(2020, 1, i + 1), v) for i, v in enumerate([1.0, None, 2.0, 4.0, None, 8.0, 3.0, 5.0])]
    df = frame(spark, rows, "k string, date date, v double")
    out = df.select("date", series.running_sum("v", ["k"]).alias("a"), series.running_sum("v", ["k"], missing="zero").alias("b"),
                    series.centered_mean("v", ["k"], min_periods=4).alias("c"), series.trailing_full_sum("v", ["k"], length=3).alias("d")).orderBy("date").toPandas()
    s = pd.Series([r[2] for r in rows], dtype=float)
    for col, want in (("a", s.cumsum()), ("b", s.fillna(0).cumsum()), ("c", s.rolling(7, center=True, min_periods=4).mean()), ("d", s.rolling(3, min_periods=3).sum())):
        np.testing.assert_allclose(out[col].astype(float), want, equal_nan=True)


def test_one_to_one_join_rejects_duplicates(spark):
    a = frame(spark, [(D(2020, 1, 1), 1.0), (D(2020, 1, 2), 2.0)], "date date, x double")
    b = frame(spark, [(D(2020, 1, 1), 3.0)], "date date, y double")
    assert relate.one_to_one(a, b, ["date"]).count() == 1
    with pytest.raises(Exception, match="duplicate key"):
        relate.one_to_one(a, b.unionByName(b), ["date"]).collect()


def test_coverage_policy(spark):
    days = frame(spark, [(D(2020, 1, 1),), (D(2020, 1, 2),)], "date date")
    data = frame(spark, [(D(2020, 1, 1), 3.0)], "date date, y double")
    assert relate.require_coverage(days, data, ["date"], "warn-skip").count() == 1
    with pytest.raises(Exception, match="missing input"):
        relate.require_coverage(days, data, ["date"], "error").collect()


def test_multiplicative_flags(spark):
    rows = []
    for s, gain in (("I", 1.0), ("N", 0.5)):
        d = D(2019, 10, 1)
        swe = 0.0
        while d <= D(2020, 3, 15):
            rows.append((s, 2020, d, swe, 1.0))
            swe, d = swe + gain, d + dt.timedelta(days=1)
    df = frame(spark, rows, "source string, water_year int, date date, swe_mm double, snowfall_mm double")
    r = accumulation.multiplicative(df).first()
    assert r.snowfall_complete_I and r.m_I == pytest.approx(0.0) and r.m_N == pytest.approx(0.5)
    assert r.epsilon_total == pytest.approx(-0.5) and r.multiplicative_closure == pytest.approx(0.0, abs=1e-12)
    holed = accumulation.multiplicative(df.where("NOT (source = 'I' AND date = DATE'2020-01-01')")).first()
    assert not holed.snowfall_complete_I and holed.snowfall_I is None and holed.epsilon_accumulation is None
