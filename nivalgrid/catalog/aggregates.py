"""Aggregations: roll-ups, areal statistics, distributions, climatology."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import physics, stats
from ..operators import areal, events, quality, relate, rollup, scale, spatial, timeaxis
from ..plans import climatology, separation
from ..sources import readers
from .bindings import COMMON, FINE, MIDDLE, Tables
from .registry import query

_DAY = "CAST(ts AS DATE)"
_W = 'JOIN weights w ON c."row" = w."row" AND c.col = w.col AND w.weight > 0'


@query("e1_strict_daily_flux", "source:s row:i col:i date:d precip_mm:f rain_mm:f",
       f"""SELECT source, "row", col, {_DAY} AS date, CASE WHEN count(precip_mm) = 24 THEN sum(precip_mm) END AS precip_mm,
       CASE WHEN count(rain_mm_s) = 24 THEN sum(rain_mm_s * 3600) END AS rain_mm FROM hours GROUP BY 1, 2, 3, 4""", "hours")
def _(t: Tables):
    return rollup.daily_flux(t.hours, ["source", "row", "col"],
                             {"precip_mm": ("precip_mm", "mm/timestep"), "rain_mm": ("rain_mm_s", "mm s-1")})


@query("e2_daily_state", "source:s row:i col:i date:d depth_m:f",
       f"""SELECT source, "row", col, {_DAY} AS date, max_by(depth_m, ts) * 1000 AS depth_m FROM hours GROUP BY 1, 2, 3, 4""", "hours")
def _(t: Tables):
    return rollup.daily_state(t.hours, ["source", "row", "col"], {"depth_m": 1000.0})


@query("e3_daily_shortwave", "source:s row:i col:i date:d incoming_sw_w_m2:f absorbed_sw_w_m2:f incoming_sw_energy_mj_m2:f "
       "absorbed_sw_energy_mj_m2:f effective_albedo:f",
       f"""SELECT *, CASE WHEN incoming_sw_energy_mj_m2 > 0 THEN 1 - absorbed_sw_energy_mj_m2 / incoming_sw_energy_mj_m2 END AS effective_albedo FROM (
       SELECT source, "row", col, {_DAY} AS date, CASE WHEN count(sw_w_m2) = 24 THEN avg(sw_w_m2) END AS incoming_sw_w_m2,
       CASE WHEN count(absorbed_w_m2) = 24 THEN avg(absorbed_w_m2) END AS absorbed_sw_w_m2,
       CASE WHEN count(sw_w_m2) = 24 THEN sum(sw_w_m2) * 3600e-6 END AS incoming_sw_energy_mj_m2,
       CASE WHEN count(absorbed_w_m2) = 24 THEN sum(absorbed_w_m2) * 3600e-6 END AS absorbed_sw_energy_mj_m2 FROM hours GROUP BY 1, 2, 3, 4)""", "hours")
def _(t: Tables):
    return rollup.daily_shortwave(t.hours, ["source", "row", "col"], "sw_w_m2", "absorbed_w_m2")


@query("e4_snowfall", "source:s row:i col:i date:d precip_mm:f snowfall_mm:f fraction_scale:s",
       f"""SELECT source, "row", col, {_DAY} AS date, CASE WHEN count(precip_mm) = 24 THEN sum(precip_mm) END AS precip_mm,
       CASE WHEN count(precip_mm * snow_fraction) = 24 THEN sum(precip_mm * snow_fraction) END AS snowfall_mm,
       CASE WHEN source = 'N' AND max(max(snow_fraction * 100)) OVER (PARTITION BY source, {_DAY}) > 1.5 THEN 'percent' ELSE 'fraction' END AS fraction_scale
       FROM hours GROUP BY 1, 2, 3, 4""", "hours")
def _(t: Tables):
    v = F.when(F.col("source") == "N", F.col("snow_fraction") * 100).otherwise(F.col("snow_fraction"))
    return rollup.daily_snowfall(t.hours.withColumn("f", v), ["source", "row", "col"], "precip_mm", "f")


@query("e5_daily_by_kind", "date:d water_year:i air_mean_c:f air_min_c:f air_max_c:f air_finite_hours:i wind_mean_m_s:f wind_max_m_s:f "
       "lw_mean_w_m2:f lw_energy_mj_m2:f lw_finite_hours:i rain_mm_day:f rain_finite_hours:i",
       f"""SELECT {_DAY} AS date, 2024 AS water_year, avg(temp_k) - 273.15 AS air_mean_c, min(temp_k) - 273.15 AS air_min_c, max(temp_k) - 273.15 AS air_max_c,
       count(temp_k) AS air_finite_hours, avg(wind_v) AS wind_mean_m_s, max(wind_v) AS wind_max_m_s, avg(lw_w_m2) AS lw_mean_w_m2,
       CASE WHEN count(lw_w_m2) = 24 THEN sum(lw_w_m2) * 3600e-6 END AS lw_energy_mj_m2, count(lw_w_m2) AS lw_finite_hours,
       CASE WHEN count(rain_mm_s) = 24 THEN sum(rain_mm_s) * 3600 END AS rain_mm_day, count(rain_mm_s) AS rain_finite_hours FROM basin_hours GROUP BY 1""", "basin_hours")
def _(t: Tables):
    return rollup.daily_by_kind(t.basin_hours, [], {
        "air": ("temp_k", "temperature", "K"), "wind": ("wind_v", "wind", "m/s"),
        "lw": ("lw_w_m2", "radiation", "W m-2"), "rain": ("rain_mm_s", "depth", "mm/s")})


@query("e6_daily_completeness", "source:s row:i col:i date:d hour_count:i complete_00_23:b has_state_hour:b",
       f"""SELECT source, "row", col, {_DAY} AS date, count(*) AS hour_count, count(*) = 24 AND count(DISTINCT hour(ts)) = 24 AS complete_00_23,
       count(*) FILTER (hour(ts) = 23) = 1 AS has_state_hour FROM hours GROUP BY 1, 2, 3, 4""", "hours")
def _(t: Tables):
    return timeaxis.daily_completeness(t.hours, ["source", "row", "col"])


@query("e7_time_axis", "source:s row:i col:i record_count:i first_time:t last_time:t duplicate_count:i unexpected_gap_count:i null_count:i",
       """, g AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY source, "row", col ORDER BY ts)) AS gap FROM hours)
       SELECT source, "row", col, count(*) AS record_count, min(ts) AS first_time, max(ts) AS last_time, 0 AS duplicate_count,
       count(*) FILTER (abs(gap - 3600) > 1) AS unexpected_gap_count, 0 AS null_count FROM g GROUP BY 1, 2, 3""", "hours")
def _(t: Tables):
    return timeaxis.axis_report(t.hours, ["source", "row", "col"])


@query("e8_weighted_mean", "source:s date:d swe_mm:f swe_mm_valid_area_fraction:f melt_mm:f melt_mm_valid_area_fraction:f",
       f""", tw AS (SELECT sum(weight) AS tw FROM weights WHERE weight > 0)
       SELECT source, date, sum(swe_mm * weight) / sum(weight) FILTER (swe_mm IS NOT NULL) AS swe_mm,
       sum(weight) FILTER (swe_mm IS NOT NULL) / (SELECT tw FROM tw) AS swe_mm_valid_area_fraction,
       sum(melt_mm * weight) / sum(weight) FILTER (melt_mm IS NOT NULL) AS melt_mm,
       sum(weight) FILTER (melt_mm IS NOT NULL) / (SELECT tw FROM tw) AS melt_mm_valid_area_fraction
       FROM cells c {_W} GROUP BY 1, 2""", "cells weights")
def _(t: Tables):
    return areal.basin_means(t.cells, t.weights, ["source", "date"], ["swe_mm", "melt_mm"])


@query("e9_strict_mean", "source:s date:d swe_mm:f",
       f"""SELECT source, date, CASE WHEN count(*) = (SELECT count(*) FROM weights WHERE weight > 0) THEN sum(swe_mm * weight) / sum(weight) END AS swe_mm
       FROM cells c {_W} GROUP BY 1, 2""", "cells weights")
def _(t: Tables):
    return areal.basin_means_strict(t.cells, t.weights, ["source", "date"], ["swe_mm"], on_missing="null")


@query("e10_area_fraction_all", "source:s date:d gt10:f gt50:f",
       f"""SELECT source, date, coalesce(sum(weight) FILTER (swe_mm > 10), 0) / (SELECT sum(weight) FROM weights WHERE weight > 0) AS gt10,
       coalesce(sum(weight) FILTER (swe_mm > 50), 0) / (SELECT sum(weight) FROM weights WHERE weight > 0) AS gt50
       FROM cells c {_W} GROUP BY 1, 2""", "cells weights")
def _(t: Tables):
    return areal.area_fractions(t.cells, t.weights, ["source", "date"], {"gt10": F.col("swe_mm") > 10, "gt50": F.col("swe_mm") > 50})


@query("e10_area_fraction_valid", "source:s date:d gt10:f gt50:f",
       f"""SELECT source, date, coalesce(sum(weight) FILTER (swe_mm > 10), 0) / sum(weight) AS gt10,
       coalesce(sum(weight) FILTER (swe_mm > 50), 0) / sum(weight) AS gt50 FROM cells c {_W} GROUP BY 1, 2""", "cells weights")
def _(t: Tables):
    return areal.area_fractions(t.cells, t.weights, ["source", "date"],
                                {"gt10": F.col("swe_mm") > 10, "gt50": F.col("swe_mm") > 50}, F.col("swe_mm").isNotNull())


@query("e11_paired_means", "date:d swe_i:f swe_n:f",
       f"""SELECT date, sum(swe_mm_i * weight) / sum(weight) AS swe_i, sum(swe_mm_n * weight) / sum(weight) AS swe_n FROM pairs c {_W} GROUP BY 1""", "pairs weights")
def _(t: Tables):
    a, b = stats.paired("swe_mm_i", "swe_mm_n")
    return areal.on_support(t.pairs, t.weights).groupBy("date").agg(
        stats.weighted_mean(a, "weight").alias("swe_i"), stats.weighted_mean(b, "weight").alias("swe_n"))


@query("e12_snow_energy_albedo", "source:s date:d incoming_mj_m2:f8 absorbed_mj_m2:f8 effective_albedo:f energy_area_fraction:f",
       f""", a AS (SELECT source, date, sum(incoming_sw_energy_mj_m2 * weight) FILTER (swe_mm > 30) / sum(weight) FILTER (swe_mm > 30) AS incoming_mj_m2,
       sum(absorbed_sw_energy_mj_m2 * weight) FILTER (swe_mm > 30) / sum(weight) FILTER (swe_mm > 30) AS absorbed_mj_m2,
       sum(weight) FILTER (swe_mm > 30) / (SELECT sum(weight) FROM weights WHERE weight > 0) AS energy_area_fraction FROM cells c {_W} GROUP BY 1, 2)
       SELECT *, CASE WHEN incoming_mj_m2 > 0.05 THEN 1 - absorbed_mj_m2 / incoming_mj_m2 END AS effective_albedo FROM a""", "cells weights")
def _(t: Tables):
    return areal.energy_albedo(t.cells, t.weights, ["source", "date"], F.col("swe_mm") > 30,
                               "incoming_sw_energy_mj_m2", "absorbed_sw_energy_mj_m2")


@query("e13_depth_to_volume", "source:s date:d volume_m3:f3",
       f"SELECT source, date, sum(release_mm * 1e-3 * weight * 1e6) AS volume_m3 FROM cells c {_W} GROUP BY 1, 2", "cells weights")
def _(t: Tables):
    return areal.basin_volume(t.cells, t.weights, ["source", "date"], "release_mm", 1_000_000.0)


_LOOKUP = """, f AS (SELECT "row", col, (col + 0.5) * 10 AS x, ("row" + 0.5) * 10 AS y FROM fine WHERE c_acctbal >= 0),
   k AS (SELECT "row", col, (col + 0.5) * 50 AS x, ("row" + 0.5) * 50 AS y FROM common),
   nf AS (SELECT station_id, "row", col, d, row_number() OVER (PARTITION BY station_id ORDER BY round(d, 9), "row", col) AS n
     FROM (SELECT station_id, f."row", f.col, sqrt((p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y)) AS d FROM points p, f)),
   nc AS (SELECT station_id, "row", col, d, row_number() OVER (PARTITION BY station_id ORDER BY round(d, 9), "row", col) AS n
     FROM (SELECT station_id, k."row", k.col, sqrt((p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y)) AS d FROM points p, k)),
   env AS (SELECT nc.station_id, f."row", f.col FROM nc JOIN f ON nc.n = 1 AND f.x BETWEEN nc.col * 50 AND (nc.col + 1) * 50
     AND f.y BETWEEN nc."row" * 50 AND (nc."row" + 1) * 50)"""


def lookup(t: Tables):
    return spatial.station_lookup(t.points, t.fine.where("c_acctbal >= 0"), FINE, COMMON, t.common.select("row", "col"))


@query("e14_station_envelope", "station_id:i obs_date:d variable:s value_nearest:f value_envelope_min:f value_envelope_max:f envelope_pixels:i",
       _LOOKUP + """, o AS (SELECT * FROM obs_fields)
       SELECT station_id, obs_date, variable, max(near) AS value_nearest, min(env) AS value_envelope_min, max(env) AS value_envelope_max,
       count(e) AS envelope_pixels FROM (
         SELECT nf.station_id, obs_date, variable, value AS near, NULL AS env, NULL AS e FROM nf JOIN o ON nf.n = 1 AND nf."row" = o."row" AND nf.col = o.col
         UNION ALL SELECT env.station_id, obs_date, variable, NULL, value, 1 FROM env JOIN o ON env."row" = o."row" AND env.col = o.col)
       GROUP BY 1, 2, 3""", "fine points common obs_fields")
def _(t: Tables):
    roles = lookup(t).where("role <> 'coarse'")
    return areal.station_samples(t.obs_fields, roles, ["obs_date", "variable"], ["value"])


_DIST = """count(v) AS cell_count, avg(v) AS mean_mm, quantile_cont(v, 0.5) AS median_mm, avg(abs(v)) AS mae_mm, sqrt(avg(v * v)) AS rmse_mm,
   stddev_pop(v) AS std_mm, quantile_cont(v, 0.05) AS p05_mm, quantile_cont(v, 0.25) AS p25_mm, quantile_cont(v, 0.75) AS p75_mm, quantile_cont(v, 0.95) AS p95_mm"""


@query("e15_distribution", "water_year:i cell_count:i mean_mm:f median_mm:f mae_mm:f rmse_mm:f std_mm:f p05_mm:f p25_mm:f p75_mm:f p95_mm:f",
       f", d AS (SELECT water_year, snow_depth_mm_n - snow_depth_mm_i AS v FROM pairs) SELECT water_year, {_DIST} FROM d GROUP BY 1", "pairs")
def _(t: Tables):
    d = t.pairs.select("water_year", (F.col("snow_depth_mm_n") - F.col("snow_depth_mm_i")).alias("v"))
    return scale.exact_percentiles(d, ["water_year"], "v", {
        "median_mm": 0.5, "p05_mm": 0.05, "p25_mm": 0.25, "p75_mm": 0.75, "p95_mm": 0.95},
        {"cell_count": "count", "mean_mm": "mean", "mae_mm": "mean_abs", "rmse_mm": "rms", "std_mm": "std_pop"})


FLAGGED = """, q AS (SELECT *, CASE variable WHEN 'SWE' THEN 5000 ELSE 15000 END AS top FROM raw_obs),
   flagged AS (SELECT *, coalesce(raw_mm < 0 AND raw_mm >= -60, false) AS clipped_to_zero, coalesce(raw_mm < -60, false) AS masked_negative,
     coalesce(raw_mm > top, false) AS masked_above, coalesce(raw_mm < 0 OR raw_mm > top, false) AS adjusted,
     CASE WHEN raw_mm < 0 AND raw_mm >= -60 THEN 0 WHEN raw_mm >= -60 AND raw_mm <= top THEN raw_mm END AS cleaned_mm FROM q)"""


@query("e16_percentile_blocks", "obs_date:d variable:s block:s count:i min_mm:f8 p50_mm:f8 p95_mm:f8 p99_mm:f8 p99_9_mm:f8 p99_99_mm:f8 max_mm:f8",
       FLAGGED + """, l AS (SELECT obs_date, variable, 'raw' AS block, raw_mm AS v FROM flagged UNION ALL SELECT obs_date, variable, 'cleaned', cleaned_mm FROM flagged
         UNION ALL SELECT obs_date, variable, 'inside_raw', CASE WHEN inside THEN raw_mm END FROM flagged
         UNION ALL SELECT obs_date, variable, 'inside_cleaned', CASE WHEN inside THEN cleaned_mm END FROM flagged)
       SELECT obs_date, variable, block, count(v) AS "count", min(v) AS min_mm, quantile_cont(v, 0.5) AS p50_mm, quantile_cont(v, 0.95) AS p95_mm,
       quantile_cont(v, 0.99) AS p99_mm, quantile_cont(v, 0.999) AS p99_9_mm, quantile_cont(v, 0.9999) AS p99_99_mm, max(v) AS max_mm FROM l GROUP BY 1, 2, 3""", "raw_obs")
def _(t: Tables):
    return quality.percentile_blocks(quality.apply_limits(t.raw_obs, tolerance=60.0), ["obs_date", "variable"])


@query("e17_complete_sum", "source:s water_year:i total:f complete:b expected_days:i valid_days:i",
       """, e AS (SELECT source, water_year, max(make_date(water_year, 3, 15) - make_date(water_year - 1, 10, 2) + 1) AS expected_days,
         sum(snowfall_mm) FILTER (date BETWEEN make_date(water_year - 1, 10, 2) AND make_date(water_year, 3, 15)) AS total,
         count(snowfall_mm) FILTER (date BETWEEN make_date(water_year - 1, 10, 2) AND make_date(water_year, 3, 15)) AS valid_days FROM basin GROUP BY 1, 2)
       SELECT source, water_year, CASE WHEN valid_days = expected_days THEN total END AS total, valid_days = expected_days AS complete, expected_days, valid_days FROM e""", "basin")
def _(t: Tables):
    start, end = F.date_add(cal.season_date("water_year", "10-01"), 1), cal.season_date("water_year", "03-15")
    v = F.when(F.col("date").between(start, end), F.col("snowfall_mm"))
    days = F.max(F.datediff(end, start) + 1)
    return t.basin.groupBy("source", "water_year").agg(
        stats.complete_sum(v, days).alias("total"), (F.count(v) == days).alias("complete"), days.alias("expected_days"),
        F.count(v).alias("valid_days"))


@query("e18_value_on_date", "source:s station_id:i water_year:i nov1:f nov1_single:f",
       """SELECT source, station_id, water_year, max(swe_mm) FILTER (date = make_date(water_year - 1, 11, 1)) AS nov1,
       max(swe_mm) FILTER (date = make_date(water_year - 1, 11, 1)) AS nov1_single FROM station GROUP BY 1, 2, 3""", "station")
def _(t: Tables):
    on = cal.season_date("water_year", "11-01")
    return t.station.groupBy("source", "station_id", "water_year").agg(
        stats.value_on("date", "swe_mm", on).alias("nov1"), stats.single_value_on("date", "swe_mm", on).alias("nov1_single"))


@query("e19_pearson_bias", "water_year:i n:i pearson_r:f mean_bias:f",
       """SELECT i.water_year, count(*) AS n, CASE WHEN count(*) >= 2 AND stddev_pop(i.swe_mm) > 0 AND stddev_pop(n.swe_mm) > 0 THEN corr(i.swe_mm, n.swe_mm) END AS pearson_r,
       avg(n.swe_mm - i.swe_mm) AS mean_bias FROM basin i JOIN basin n ON i.date = n.date WHERE i.source = 'I' AND n.source = 'N' GROUP BY 1""", "basin")
def _(t: Tables):
    p = relate.pair_long(t.basin, ["date", "water_year"], ["swe_mm"])
    return events.agreement(p, ["water_year"], "swe_mm_i", "swe_mm_n")


@query("e20_spearman", "water_year:i n:i spearman_rho:f",
       """, p AS (SELECT i.water_year AS wy, i.swe_mm AS x, n.swe_mm AS y FROM basin i JOIN basin n ON i.date = n.date WHERE i.source = 'I' AND n.source = 'N'),
       r AS (SELECT wy, rank() OVER (PARTITION BY wy ORDER BY x) + (count(*) OVER (PARTITION BY wy, x) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY wy ORDER BY y) + (count(*) OVER (PARTITION BY wy, y) - 1) / 2.0 AS ry FROM p)
       SELECT wy AS water_year, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(rx, ry) END AS spearman_rho FROM r GROUP BY 1""", "basin")
def _(t: Tables):
    p = relate.pair_long(t.basin, ["date", "water_year"], ["swe_mm"])
    return events.spearman(p, ["water_year"], "swe_mm_i", "swe_mm_n")


def cell_loss_sql(rule: str, bins: str) -> str:
    """Consecutive-day losses of paired cells with the cover class at the start of the interval."""
    return f""", lagged AS (SELECT *, date - lag(date) OVER w = 1 AS ok, lag(swe_mm_i) OVER w AS pi, lag(swe_mm_n) OVER w AS pn, lag(cover_n) OVER w AS pc
         FROM pairs WINDOW w AS (PARTITION BY water_year, "row", col ORDER BY date)),
       loss AS (SELECT water_year, "row", col, date, pi - swe_mm_i AS loss_i, pn - swe_mm_n AS loss_n, pc AS c FROM lagged WHERE ok),
       ev AS (SELECT *, loss_n - loss_i AS extra, {bins} AS bin_code FROM loss WHERE (loss_i > 1 {rule} loss_n > 1)
         AND date BETWEEN make_date(water_year, 2, 1) AND make_date(water_year, 4, 30))"""


BIN5 = """CASE WHEN abs(c - 1) <= 1e-6 THEN 0 WHEN c >= 0.9 AND c < 1 THEN 1 WHEN c >= 0.5 AND c < 0.9 THEN 2 WHEN c >= 0.1 AND c < 0.5 THEN 3
   WHEN c > 0 AND c < 0.1 THEN 4 END"""
BIN10 = "CASE WHEN c >= 1 - 1e-6 THEN 9 ELSE CAST(floor(c * 10) AS INT) END"
BINNED = """, y AS (SELECT DISTINCT water_year FROM items WHERE source <> 'S'), scaffold AS (SELECT water_year, b AS bin_code FROM y, range(0, {n}) r(b)),
   bins AS (SELECT s.water_year, s.bin_code, count(extra) AS event_n, avg(loss_i) AS mean_loss_i, avg(loss_n) AS mean_loss_n, avg(extra) AS mean_extra_loss,
     avg(CASE WHEN extra > 0 THEN 1.0 WHEN extra <= 0 THEN 0.0 END) AS fraction_extra_positive,
     CASE WHEN count(extra) >= 2 AND stddev_pop(loss_i) > 0 AND stddev_pop(loss_n) > 0 THEN corr(loss_i, loss_n) END AS pearson_r,
     quantile_cont(extra, 0.25) AS q25_extra_loss, quantile_cont(extra, 0.5) AS median_extra_loss, quantile_cont(extra, 0.75) AS q75_extra_loss
     FROM scaffold s LEFT JOIN {ev} e ON e.water_year = s.water_year AND e.bin_code = s.bin_code GROUP BY 1, 2)"""
_BIN_COLUMNS = ("water_year:i bin_code:i event_n:i mean_loss_i:f mean_loss_n:f mean_extra_loss:f fraction_extra_positive:f pearson_r:f "
                "q25_extra_loss:f median_extra_loss:f q75_extra_loss:f")


@query("e21_binned_events", _BIN_COLUMNS, cell_loss_sql("OR", BIN5) + BINNED.format(n=5, ev="ev") + " SELECT * FROM bins", "pairs")
def _(t: Tables):
    e = events.cell_events_by_bin(t.pairs, "swe_mm_i", "swe_mm_n", "cover_n", physics.cover_bin5, "02-01", "04-30")
    return events.summarize_bins(e, t.years, 5)


@query("e21_binned_events_ten", _BIN_COLUMNS, cell_loss_sql("AND", BIN10) + BINNED.format(n=10, ev="ev") + " SELECT * FROM bins", "pairs")
def _(t: Tables):
    e = events.cell_events_by_bin(t.pairs, "swe_mm_i", "swe_mm_n", "cover_n", physics.cover_bin10, "02-01", "04-30", rule="both")
    return events.summarize_bins(e, t.years, 10)


@query("e22_focus_vs_baseline", "bin_code:i focus_mean:f focus_q25:f focus_q75:f focus_events:i baseline_mean_of_means:f baseline_q25_of_means:f "
       "baseline_q75_of_means:f baseline_mean_events:f baseline_q25_events:f baseline_q75_events:f baseline_years_with_mean:i baseline_years_with_count:i",
       cell_loss_sql("AND", BIN10) + BINNED.format(n=10, ev="ev") + """, f AS (SELECT * FROM bins WHERE water_year = 2001),
       b AS (SELECT bin_code, avg(mean_extra_loss) AS m, quantile_cont(mean_extra_loss, 0.25) AS q1, quantile_cont(mean_extra_loss, 0.75) AS q3,
         avg(event_n) AS em, quantile_cont(CAST(event_n AS DOUBLE), 0.25) AS e1, quantile_cont(CAST(event_n AS DOUBLE), 0.75) AS e3, count(mean_extra_loss) AS nm, count(event_n) AS ne
         FROM bins WHERE water_year BETWEEN 1996 AND 2000 GROUP BY 1)
       SELECT bin_code, f.mean_extra_loss AS focus_mean, f.q25_extra_loss AS focus_q25, f.q75_extra_loss AS focus_q75, f.event_n AS focus_events,
       m AS baseline_mean_of_means, q1 AS baseline_q25_of_means, q3 AS baseline_q75_of_means, em AS baseline_mean_events, e1 AS baseline_q25_events,
       e3 AS baseline_q75_events, nm AS baseline_years_with_mean, ne AS baseline_years_with_count FROM f JOIN b USING (bin_code)""", "pairs")
def _(t: Tables):
    e = events.cell_events_by_bin(t.pairs, "swe_mm_i", "swe_mm_n", "cover_n", physics.cover_bin10, "02-01", "04-30", rule="both")
    return events.focus_vs_baseline(events.summarize_bins(e, t.years, 10), 2001, 1996, 2000)


@query("e23_density_counts", "water_year:i density_i_valid:i density_n_valid:i density_pairs:i density_i_above_water:i density_n_above_water:i density_i_max:f density_n_max:f",
       """, d AS (SELECT water_year, CASE WHEN swe_mm_i >= 10 AND snow_depth_mm_i > 0 THEN 1000 * swe_mm_i / snow_depth_mm_i END AS di,
         CASE WHEN swe_mm_n >= 10 AND snow_depth_mm_n > 0 THEN 1000 * swe_mm_n / snow_depth_mm_n END AS dn FROM pairs)
       SELECT water_year, count(di) AS density_i_valid, count(dn) AS density_n_valid, count(di + dn) AS density_pairs, count(*) FILTER (di > 1000) AS density_i_above_water,
       count(*) FILTER (dn > 1000) AS density_n_above_water, max(di) AS density_i_max, max(dn) AS density_n_max FROM d GROUP BY 1""", "pairs")
def _(t: Tables):
    return separation.density_counts(separation.cell_columns(t.pairs))


FORCING = """, daily AS (SELECT date, water_year, strftime(date, '%m-%d') AS month_day, precip_mm AS precip_mm_day, swe_mm / 10 - 20 AS temperature_mean_c,
     sqrt(incoming_sw_energy_mj_m2) * 50 AS incoming_sw_mean_w_m2, incoming_sw_energy_mj_m2 AS incoming_sw_energy_mj_m2_day,
     snow_depth_mm / 10 AS incoming_lw_mean_w_m2, snow_depth_mm / 100 AS incoming_lw_energy_mj_m2_day,
     sum(precip_mm) OVER (PARTITION BY water_year ORDER BY date) AS precip_accum_oct1_mm FROM basin WHERE source = 'I')"""


def forcing_daily(t: Tables):
    from ..operators.series import running_sum
    c = F.col
    return (t.basin_of("I").select(
        "date", "water_year", cal.month_day("date").alias("month_day"), c("precip_mm").alias("precip_mm_day"),
        (c("swe_mm") / 10 - 20).alias("temperature_mean_c"), (F.sqrt("incoming_sw_energy_mj_m2") * 50).alias("incoming_sw_mean_w_m2"),
        c("incoming_sw_energy_mj_m2").alias("incoming_sw_energy_mj_m2_day"), (c("snow_depth_mm") / 10).alias("incoming_lw_mean_w_m2"),
        (c("snow_depth_mm") / 100).alias("incoming_lw_energy_mj_m2_day"))
        .withColumn("precip_accum_oct1_mm", running_sum("precip_mm_day", ["water_year"])))


WINDOWS = """, win AS (SELECT * FROM (VALUES ('oct1_jun30', 10, 1, 6, 30), ('nov1_mar15', 11, 1, 3, 15), ('apr1_jun30', 4, 1, 6, 30)) w(name, m0, d0, m1, d1)),
   wm AS (SELECT water_year, name AS "window", make_date(CASE WHEN m0 >= 10 THEN water_year - 1 ELSE water_year END, m0, d0) AS start_date,
     make_date(water_year, m1, d1) AS end_date, * FROM daily, win),
   metrics AS (SELECT water_year, "window", count(*) AS n_days, max(end_date - start_date + 1) AS expected_days, sum(precip_mm_day) AS precip_total_mm,
     avg(temperature_mean_c) AS temperature_mean_c, avg(incoming_sw_mean_w_m2) AS incoming_sw_mean_w_m2, sum(incoming_sw_energy_mj_m2_day) AS incoming_sw_energy_mj_m2,
     avg(incoming_lw_mean_w_m2) AS incoming_lw_mean_w_m2, sum(incoming_lw_energy_mj_m2_day) AS incoming_lw_energy_mj_m2 FROM wm
     WHERE date BETWEEN start_date AND end_date GROUP BY 1, 2)"""


@query("e24_window_metrics", "water_year:i window:s n_days:i expected_days:i complete:b precip_total_mm:f temperature_mean_c:f incoming_sw_mean_w_m2:f "
       "incoming_sw_energy_mj_m2:f incoming_lw_mean_w_m2:f incoming_lw_energy_mj_m2:f",
       FORCING + WINDOWS + " SELECT *, n_days = expected_days AS complete FROM metrics", "basin")
def _(t: Tables):
    return climatology.window_metrics(forcing_daily(t), on_incomplete="flag")


SPECIAL = """, ml AS (SELECT water_year, "window", 'precip_total_mm' AS metric, precip_total_mm AS v FROM metrics UNION ALL SELECT water_year, "window", 'temperature_mean_c', temperature_mean_c FROM metrics
     UNION ALL SELECT water_year, "window", 'incoming_sw_energy_mj_m2', incoming_sw_energy_mj_m2 FROM metrics UNION ALL SELECT water_year, "window", 'incoming_lw_energy_mj_m2', incoming_lw_energy_mj_m2 FROM metrics),
   rk AS (SELECT *, row_number() OVER (PARTITION BY "window", metric ORDER BY v DESC, water_year) AS rk, count(*) OVER (PARTITION BY "window", metric) AS ny FROM ml),
   hist AS (SELECT "window", metric, avg(v) AS hm, quantile_cont(v, 0.5) AS hmed, stddev_samp(v) AS hs FROM ml WHERE water_year < 2000 GROUP BY 1, 2),
   special AS (SELECT r."window", r.metric, v AS focus_value, hm AS historical_mean, hmed AS historical_median, hs AS historical_std, v - hm AS anomaly,
     CASE WHEN r.metric <> 'temperature_mean_c' AND hm <> 0 THEN (v - hm) / hm * 100 END AS percent_anomaly, CASE WHEN hs > 0 THEN (v - hm) / hs END AS zscore,
     rk AS rank_highest_1, ny AS rank_n_years FROM rk r JOIN hist h ON r."window" = h."window" AND r.metric = h.metric WHERE water_year = 2000)"""


@query("e25_specialness", "window:s metric:s focus_value:f historical_mean:f historical_median:f historical_std:f anomaly:f percent_anomaly:f zscore:f rank_highest_1:i rank_n_years:i",
       FORCING + WINDOWS + SPECIAL + " SELECT * FROM special", "basin")
def _(t: Tables):
    return climatology.specialness(climatology.window_metrics(forcing_daily(t), on_incomplete="flag"), 2000)


_ROLL = ", ".join(f"CASE WHEN count({c}) OVER r >= 4 THEN avg({c}) OVER r END AS {c}_7day" for c in
                  ("precip_mm_day", "temperature_mean_c", "incoming_sw_mean_w_m2", "incoming_lw_mean_w_m2"))
_LONG = " UNION ALL ".join(f"SELECT date, water_year, month_day, '{c}' AS variable, {c} AS v FROM rolled" for c in
                           ("precip_accum_oct1_mm", "precip_mm_day_7day", "temperature_mean_c_7day", "incoming_sw_mean_w_m2_7day", "incoming_lw_mean_w_m2_7day"))
CLIMATOLOGY = f""", rolled AS (SELECT *, {_ROLL} FROM daily WINDOW r AS (PARTITION BY water_year ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
   lng AS ({_LONG}),
   h AS (SELECT month_day, variable, avg(v) AS hist_mean, quantile_cont(v, 0.5) AS hist_median, min(v) AS hist_min, max(v) AS hist_max, quantile_cont(v, 0.1) AS hist_p10,
     quantile_cont(v, 0.9) AS hist_p90, stddev_samp(v) AS hist_std, count(v) AS hist_n FROM lng WHERE water_year < 2000 GROUP BY 1, 2),
   anomalies AS (SELECT f.date, f.water_year, f.month_day, f.variable, v AS focus_value, hist_mean, hist_median, hist_min, hist_max, hist_p10, hist_p90, hist_std,
     coalesce(hist_n, 0) AS hist_n, v - hist_mean AS anomaly, CASE WHEN hist_std > 0 THEN (v - hist_mean) / hist_std END AS zscore
     FROM lng f LEFT JOIN h ON f.month_day = h.month_day AND f.variable = h.variable WHERE f.water_year = 2000)"""


@query("e26_calendar_day_climatology", "date:d water_year:i month_day:s variable:s focus_value:f hist_mean:f hist_median:f hist_min:f hist_max:f hist_p10:f hist_p90:f "
       "hist_std:f hist_n:i anomaly:f zscore:f", FORCING + CLIMATOLOGY + " SELECT * FROM anomalies", "basin")
def _(t: Tables):
    return climatology.calendar_day_anomalies(climatology.with_rolling(forcing_daily(t)), 2000)


EXTREMES = """, ex AS (SELECT variable, 'largest_positive_anomaly' AS extreme_type, date, focus_value, hist_mean, anomaly, zscore,
       row_number() OVER (PARTITION BY variable ORDER BY anomaly DESC, date) AS k FROM anomalies WHERE anomaly IS NOT NULL
     UNION ALL SELECT variable, 'largest_negative_anomaly', date, focus_value, hist_mean, anomaly, zscore,
       row_number() OVER (PARTITION BY variable ORDER BY anomaly, date) FROM anomalies WHERE anomaly IS NOT NULL
     UNION ALL SELECT variable, 'largest_absolute_zscore', date, focus_value, hist_mean, anomaly, zscore,
       row_number() OVER (PARTITION BY variable ORDER BY abs(zscore) DESC, date) FROM anomalies WHERE zscore IS NOT NULL)"""


@query("e27_extremes", "variable:s extreme_type:s date:d focus_value:f hist_mean:f anomaly:f zscore:f",
       FORCING + CLIMATOLOGY + EXTREMES + " SELECT * FROM ex WHERE k = 1", "basin")
def _(t: Tables):
    return climatology.extremes(climatology.calendar_day_anomalies(climatology.with_rolling(forcing_daily(t)), 2000))


@query("e28_group_weighted_mean", "water_year:i mean_loss:f",
       cell_loss_sql("OR", BIN5) + " SELECT water_year, avg(extra) AS mean_loss FROM ev WHERE bin_code IS NOT NULL GROUP BY 1", "pairs")
def _(t: Tables):
    e = events.cell_events_by_bin(t.pairs, "swe_mm_i", "swe_mm_n", "cover_n", physics.cover_bin5, "02-01", "04-30")
    bins = e.groupBy("water_year", "bin_code").agg(F.count("extra_loss").alias("n"), F.avg("extra_loss").alias("m"))
    return bins.groupBy("water_year").agg(stats.group_weighted_mean("m", "n").alias("mean_loss"))


@query("e29_weight_area", "area_first_m2:f area_second_m2:f relative_area_difference:f9",
       """, a AS (SELECT (SELECT sum(weight) FROM middle_weights WHERE weight > 0) * 400.0 AS a, (SELECT sum(weight) FROM common_weights WHERE weight > 0) * 2500.0 AS b)
       SELECT a AS area_first_m2, b AS area_second_m2, abs(a - b) / ((a + b) / 2) AS relative_area_difference FROM a""", "middle_weights common_weights")
def _(t: Tables):
    w = t.middle_weights.unionByName(t.common_weights)
    area = F.when(F.col("grid_id") == "middle", MIDDLE.cell_area_m2).otherwise(COMMON.cell_area_m2)
    grids = w.select("grid_id").distinct().withColumn("cell_area_m2", area)
    return areal.relative_area_difference(areal.weight_area(w, grids), "middle", "common")


HIST = """, l AS (SELECT water_year, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {xy} GROUP BY 1)
   SELECT e.water_year, least(CAST(floor((x - CASE WHEN x0 = x1 THEN x0 - 0.5 ELSE x0 END) / CASE WHEN x0 = x1 THEN 1 ELSE x1 - x0 END * 65) AS INT), 64) AS bin_x,
   least(CAST(floor((y - CASE WHEN y0 = y1 THEN y0 - 0.5 ELSE y0 END) / CASE WHEN y0 = y1 THEN 1 ELSE y1 - y0 END * 65) AS INT), 64) AS bin_y, count(*) AS pair_count
   FROM {xy} e JOIN l USING (water_year) GROUP BY 1, 2, 3"""


@query("e30_histogram2d", "water_year:i bin_x:i bin_y:i pair_count:i",
       ", xy AS (SELECT water_year, swe_mm_i AS x, swe_mm_n AS y FROM pairs)" + HIST.format(xy="xy"), "pairs")
def _(t: Tables):
    return events.histogram2d(t.pairs, ["water_year"], "swe_mm_i", "swe_mm_n")


@query("e31_boxplot", "source:s n:i whisker_low:f q1:f median:f q3:f whisker_high:f",
       """, q AS (SELECT source, quantile_cont(swe_mm, 0.25) AS q1, quantile_cont(swe_mm, 0.5) AS m, quantile_cont(swe_mm, 0.75) AS q3 FROM cells GROUP BY 1)
       SELECT c.source, count(*) AS n, least(min(swe_mm) FILTER (swe_mm >= q1 - 1.5 * (q3 - q1)), max(q1)) AS whisker_low, max(q1) AS q1, max(m) AS "median", max(q3) AS q3,
       greatest(max(swe_mm) FILTER (swe_mm <= q3 + 1.5 * (q3 - q1)), max(q3)) AS whisker_high FROM cells c JOIN q USING (source) GROUP BY 1""", "cells")
def _(t: Tables):
    return quality.boxplot(t.cells, ["source"], "swe_mm")


@query("e32_unit_consistency", "event_type:s units:s consistent:b",
       """, u AS (SELECT DISTINCT event_type, CASE WHEN event_type = 'error' AND value > 100 THEN 'k' WHEN event_type = 'error' THEN 'degc' ELSE 'w/m2' END AS u FROM events)
       SELECT event_type, string_agg(u, '|' ORDER BY u) AS units, count(*) = 1 AS consistent FROM u GROUP BY 1""")
def _(t: Tables):
    u = (F.when((F.col("event_type") == "error") & (F.col("value") > 100), " K ").when(F.col("event_type") == "error", "degC")
         .when(F.col("value") > 50, "W/m2").otherwise("w/M2 "))
    return readers.unit_consistency(t.read("events").withColumn("u", u), "event_type", "u")


_LCC = """, p AS (SELECT 'fine' AS grid_id, "row", col, 38.5 + "row" * 0.009 + (c_nationkey % 3) * 0.00001 AS lat, -107.2 + col * 0.0115 AS lon FROM fine),
   k AS (SELECT ln(cos(radians(30)) / cos(radians(50))) / ln(tan(pi() / 4 + radians(50) / 2) / tan(pi() / 4 + radians(30) / 2)) AS n),
   f AS (SELECT n, cos(radians(30)) * pow(tan(pi() / 4 + radians(30) / 2), n) / n AS f FROM k),
   xy AS (SELECT grid_id, "row", col, 6370000 * f / pow(tan(pi() / 4 + radians(lat) / 2), n) * sin(n * radians(lon + 107)) AS x,
     6370000 * f / pow(tan(pi() / 4 + radians(39) / 2), n) - 6370000 * f / pow(tan(pi() / 4 + radians(lat) / 2), n) * cos(n * radians(lon + 107)) AS y FROM p, f)"""


def _projected(t: Tables):
    p = t.fine.select(t._grid("fine", "c_custkey"), "row", "col",
                      (38.5 + F.col("row") * 0.009 + (F.col("c_nationkey") % 3) * 0.00001).alias("lat"), (-107.2 + F.col("col") * 0.0115).alias("lon"))
    x, y = spatial.lambert_forward("lat", "lon", 30.0, 50.0, 39.0, -107.0)
    return p.withColumn("x", x).withColumn("y", y)


@query("e33_lambert", "row:i col:i x:f3 y:f3", _LCC + ' SELECT "row", col, x, y FROM xy', "fine")
def _(t: Tables):
    return _projected(t)


@query("e33_lattice_residual", "grid_id:s cell_count:i maximum_center_residual_m:f3 median_center_residual_m:f3",
       _LCC + """, o AS (SELECT x AS ox, y AS oy FROM xy WHERE "row" = 0 AND col = 0),
       r AS (SELECT grid_id, sqrt(pow(x - ox - col * 1000, 2) + pow(y - oy - "row" * 1000, 2)) AS d FROM xy, o)
       SELECT grid_id, count(*) AS cell_count, max(d) AS maximum_center_residual_m, quantile_cont(d, 0.5) AS median_center_residual_m FROM r GROUP BY 1""", "fine")
def _(t: Tables):
    return spatial.lattice_residual(_projected(t), 1000.0, 1000.0)


@query("e33_axis_regularity", "axis:s spacing:f max_deviation:f regular:b",
       """, a AS (SELECT col, (col + 0.5) * 10 AS x FROM fine GROUP BY 1), d AS (SELECT x - lag(x) OVER (ORDER BY col) AS g FROM a), m AS (SELECT quantile_cont(g, 0.5) AS s FROM d)
       SELECT 'x' AS axis, s AS spacing, max(abs(g - s)) AS max_deviation, max(abs(g - s)) <= greatest(abs(s), 1) * 1e-5 AS regular FROM d, m GROUP BY s""", "fine")
def _(t: Tables):
    return spatial.axis_regularity(spatial.with_centers(t.fine, FINE), "col", "x")


@query("e34_sample", "source:s n:i n_full:i distinct_rows:i",
       """, c AS (SELECT source, count(*) AS n_full FROM cells GROUP BY 1) SELECT source, least(n_full, 5000) AS n, n_full, least(n_full, 5000) AS distinct_rows FROM c""", "cells")
def _(t: Tables):
    s = scale.hash_sample(t.cells, ["source"], ["date", "row", "col"], 5000, seed=7)
    rows = s.groupBy("source", "date", "row", "col").agg(F.count(F.lit(1)).alias("k"), F.max("n_full").alias("n_full"))
    return rows.groupBy("source").agg(F.sum("k").alias("n"), F.max("n_full").alias("n_full"), F.count(F.lit(1)).alias("distinct_rows"))


@query("e34_sample_rows", "source:s date:d row:i col:i swe_mm:f n_full:i",
       """, h AS (SELECT source, date, "row", col, swe_mm, count(*) OVER (PARTITION BY source) AS n_full,
         CAST('0x' || substr(md5('7:' || strftime(date, '%Y-%m-%d') || ':' || "row" || ':' || col), 1, 10) AS BIGINT) AS h FROM cells)
       SELECT source, date, "row", col, swe_mm, n_full FROM h QUALIFY row_number() OVER (PARTITION BY source ORDER BY h, date, "row", col) <= 700""", "cells")
def _(t: Tables):
    text = F.concat(F.lit("7:"), F.date_format("date", "yyyy-MM-dd"), F.lit(":"), F.col("row").cast("string"), F.lit(":"), F.col("col").cast("string"))
    digest = F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("bigint")
    return scale.hash_sample(t.cells, ["source"], ["date", "row", "col"], 700, digest=digest)


@query("e35_masked_mean", "source:s date:d masked_mean:f",
       f"SELECT source, date, sum(melt_mm * weight) FILTER (swe_mm >= 40) / sum(weight) FILTER (swe_mm >= 40) AS masked_mean FROM cells c {_W} GROUP BY 1, 2", "cells weights")
def _(t: Tables):
    return areal.on_support(t.cells, t.weights).groupBy("source", "date").agg(
        stats.weighted_mean_where("melt_mm", "weight", F.col("swe_mm") >= 40).alias("masked_mean"))


