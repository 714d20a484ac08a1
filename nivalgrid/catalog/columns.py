"""Calendar, unit and physics projections; filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import physics, units
from ..operators import areal, events, quality, rollup, series, timeaxis
from .bindings import Tables
from .registry import query



@query("b1_water_year", "water_year:i days:i items:i",
       "SELECT water_year, count(DISTINCT date) AS days, count(*) AS items FROM items GROUP BY 1", "items")
def _(t: Tables):
    days = t.read("lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return (days.withColumn("water_year", cal.water_year("date")).groupBy("water_year")
            .agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("items")))


@query("b2_season_windows", "water_year:i window:s start_date:d end_date:d",
       """, y AS (SELECT DISTINCT water_year AS w FROM items)
       SELECT w AS water_year, 'oct1_jun30' AS "window", make_date(w - 1, 10, 1) AS start_date, make_date(w, 6, 30) AS end_date FROM y
       UNION ALL SELECT w, 'nov1_mar15', make_date(w - 1, 11, 1), make_date(w, 3, 15) FROM y
       UNION ALL SELECT w, 'apr1_jun30', make_date(w, 4, 1), make_date(w, 6, 30) FROM y""", "items")
def _(t: Tables):
    return cal.season_windows(t.basin)


@query("b3_day_of_water_year", "date:d dowy:i",
       "SELECT DISTINCT date, date - make_date(water_year - 1, 10, 1) + 1 AS dowy FROM items", "items")
def _(t: Tables):
    days = t.read("lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return days.withColumn("dowy", cal.day_of_water_year("date"))


@query("b4_season_day", "date:d season_day:i reference_date:d",
       """SELECT DISTINCT date, date - make_date(water_year - 1, 10, 1) AS season_day,
       DATE '2000-10-01' + CAST(date - make_date(water_year - 1, 10, 1) AS INT) AS reference_date FROM items""", "items")
def _(t: Tables):
    days = t.read("lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return days.withColumn("season_day", cal.season_day("date")).withColumn(
        "reference_date", cal.reference_date("season_day"))


@query("b5_focus_date", "month_day:s focus_date:d n:i",
       """SELECT strftime(date, '%m-%d') AS month_day,
       CASE WHEN strftime(date, '%m-%d') = '02-29' THEN NULL
            WHEN month(date) >= 10 THEN CAST('2000-' || strftime(date, '%m-%d') AS DATE)
            ELSE CAST('2001-' || strftime(date, '%m-%d') AS DATE) END AS focus_date, count(*) AS n
       FROM items GROUP BY 1, 2""", "items")
def _(t: Tables):
    days = t.read("lineitem").groupBy(cal.month_day(F.to_date("l_shipdate")).alias("month_day")).agg(
        F.count(F.lit(1)).alias("n"))
    return days.withColumn("focus_date", cal.focus_date("month_day", 2001))


@query("b6_index_to_time", "event_id:i ts:t",
       "SELECT event_id, TIMESTAMP '2016-10-01 01:00:00' + to_seconds(event_id * 3600) AS ts FROM events")
def _(t: Tables):
    return t.read("events").select("event_id", cal.index_to_timestamp("event_id", "2016-10-01 01:00:00").alias("ts"))


@query("b6_index_steps", "record_count:i bad_increment_count:i first_index:f last_index:f",
       """SELECT count(*) AS record_count, count(*) FILTER (abs(event_id - p - 1) > 1e-9) AS bad_increment_count,
       min(event_id) AS first_index, max(event_id) AS last_index
       FROM (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS p FROM events)""")
def _(t: Tables):
    return timeaxis.check_index_steps(t.read("events"), [], "event_id")


@query("b7_text_time", "event_id:i ts:t",
       "SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS ts FROM events")
def _(t: Tables):
    e = t.read("events")
    text = F.concat(F.lit("  "), F.date_format("ts", "yyyy-MM-dd_HH:mm:ss"), F.lit("\x00\x00"))
    shown = F.when(F.col("event_type") == "error", "no time here").otherwise(text)
    return e.select("event_id", cal.text_to_timestamp(shown).alias("ts"))


@query("b9_time_step", "source:s step_seconds:f",
       """, d AS (SELECT DISTINCT source, ts FROM hours),
       g AS (SELECT source, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY source ORDER BY ts)) AS gap FROM d)
       SELECT source, coalesce(quantile_cont(gap, 0.5), 3600) AS step_seconds FROM g GROUP BY 1""", "hours")
def _(t: Tables):
    return timeaxis.time_step_seconds(t.hours, ["source"])


_UNIT_SQL = "CASE event_type WHEN 'click' THEN ' MM/s ' WHEN 'view' THEN 'kg  m**-2' WHEN 'error' THEN 'W m-2' WHEN 'signup' THEN 'degC' ELSE 'K' END"
_NORMAL_SQL = f"trim(regexp_replace(replace(lower({_UNIT_SQL}), '**', '^'), '\\s+', ' ', 'g'))"


def _unit():
    e = F.col("event_type")
    return (F.when(e == "click", " MM/s ").when(e == "view", "kg  m**-2").when(e == "error", "W m-2")
            .when(e == "signup", "degC").otherwise("K"))


@query("b10_unit_text", "unit:s kind:s n:i",
       f"""SELECT {_NORMAL_SQL} AS unit, CASE event_type WHEN 'click' THEN 'depth' WHEN 'view' THEN 'depth'
       WHEN 'error' THEN 'radiation' ELSE 'unsupported' END AS kind, count(*) AS n FROM events GROUP BY 1, 2""")
def _(t: Tables):
    e = t.read("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("_u", _unit())
    return e.groupBy(units.normalize_units("_u").alias("unit"), units.quantity_kind("_u").alias("kind")).agg(
        F.sum("n").alias("n"))


@query("b10_unit_gate", "unit:s n:i",
       "SELECT 'w m-2' AS unit, count(*) AS n FROM events WHERE event_type = 'error'")
def _(t: Tables):
    e = t.read("events").where("event_type = 'error'")
    return e.groupBy(units.require_units(_unit(), units.RADIATION_UNITS, "shortwave").alias("unit")).agg(
        F.count(F.lit(1)).alias("n"))


@query("b11_temperature", "event_id:i celsius:f",
       """SELECT event_id, CASE WHEN event_type = 'signup' THEN value ELSE value - 273.15 END AS celsius
       FROM events""")
def _(t: Tables):
    unit = F.when(F.col("event_type") == "signup", "degC").otherwise(" Kelvin")
    return t.read("events").select("event_id", units.temperature_to_c("value", unit).alias("celsius"))


@query("b12_depth_conversion", "event_id:i depth_mm:f",
       """SELECT event_id, CASE WHEN event_type = 'click' THEN value * 3600 ELSE value END AS depth_mm
       FROM events""")
def _(t: Tables):
    unit = F.when(F.col("event_type") == "click", "mm s^(-1)").otherwise("kg  m**-2")
    return t.read("events").select("event_id", (F.col("value") * units.depth_factor(unit, 3600.0)).alias("depth_mm"))


@query("b13_power_energy", "event_id:i energy_mj_m2:f9 power_w_m2:f",
       "SELECT event_id, value * 3600 * 1e-6 AS energy_mj_m2, value * (1e6 / 86400) AS power_w_m2 FROM events")
def _(t: Tables):
    return t.read("events").select("event_id", units.power_to_energy("value").alias("energy_mj_m2"),
                                   units.daily_energy_to_power("value").alias("power_w_m2"))


@query("b14_discharge", "o_orderkey:i m3_day:f2",
       "SELECT o_orderkey, o_totalprice * 0.028316846592 * 86400 AS m3_day FROM orders")
def _(t: Tables):
    return t.read("orders").select("o_orderkey", units.cfs_to_m3_day("o_totalprice").alias("m3_day"))


@query("b15_fraction_scale", "source:s date:d fraction_divisor:f",
       """, f AS (SELECT source, CAST(ts AS DATE) AS date,
         CASE WHEN source = 'I' THEN snow_fraction ELSE snow_fraction * 100 END AS v FROM hours)
       SELECT source, date, CASE WHEN max(v) <= 1.5 THEN 1 ELSE 100 END AS fraction_divisor FROM f GROUP BY 1, 2""", "hours")
def _(t: Tables):
    v = F.when(F.col("source") == "I", F.col("snow_fraction")).otherwise(F.col("snow_fraction") * 100)
    return rollup.fraction_scale(t.hours.withColumn("date", F.to_date("ts")).withColumn("v", v), ["source", "date"], "v")


@query("b16_wind_speed", "source:s row:i col:i ts:t speed:f",
       'SELECT source, "row", col, ts, sqrt(wind_u * wind_u + wind_v * wind_v) AS speed FROM hours', "hours")
def _(t: Tables):
    return t.hours.withColumn("speed", physics.wind_speed("wind_u", "wind_v"))


@query("b17_albedo", "source:s date:d albedo:f",
       """SELECT source, date, CASE WHEN incoming_sw_energy_mj_m2 > 12
       THEN 1 - absorbed_sw_energy_mj_m2 / incoming_sw_energy_mj_m2 END AS albedo FROM basin""", "basin")
def _(t: Tables):
    return t.basin.withColumn("albedo", physics.effective_albedo(
        "incoming_sw_energy_mj_m2", "absorbed_sw_energy_mj_m2", 12.0))


@query("b18_density", "source:s date:d density:f",
       """SELECT source, date, CASE WHEN swe_mm >= 150 AND snow_depth_mm > 0
       THEN 1000 * swe_mm / snow_depth_mm END AS density FROM basin""", "basin")
def _(t: Tables):
    return t.basin.withColumn("density", physics.bulk_density("swe_mm", "snow_depth_mm", 150.0))


@query("b19_unit_range", "event_id:i clipped:f bad:b",
       """, v AS (SELECT event_id, value / 200 - 0.1 AS x FROM events)
       SELECT event_id, CASE WHEN x >= -1e-6 AND x <= 1 + 1e-6 THEN least(greatest(x, 0), 1) END AS clipped,
       x < -1e-6 OR x > 1 + 1e-6 AS bad FROM v""")
def _(t: Tables):
    v = t.read("events").select("event_id", (F.col("value") / 200 - 0.1).alias("x"))
    return v.select("event_id", physics.unit_range_qc("x").alias("clipped"), physics.outside_unit_range("x").alias("bad"))


@query("b20_safe_ratio", "source:s date:d ratio:f",
       "SELECT source, date, release_mm / nullif(melt_mm, 0) AS ratio FROM basin", "basin")
def _(t: Tables):
    return t.basin.withColumn("ratio", physics.safe_ratio("release_mm", "melt_mm"))


@query("b21_cover_bins5", "source:s bin_code:i n:i",
       """SELECT source, CASE WHEN abs(cover - 1) <= 1e-6 THEN 0 WHEN cover >= 0.9 AND cover < 1 THEN 1
       WHEN cover >= 0.5 AND cover < 0.9 THEN 2 WHEN cover >= 0.1 AND cover < 0.5 THEN 3
       WHEN cover > 0 AND cover < 0.1 THEN 4 END AS bin_code, count(*) AS n FROM cells GROUP BY 1, 2""", "cells")
def _(t: Tables):
    return t.cells.groupBy("source", physics.cover_bin5("cover").alias("bin_code")).agg(F.count(F.lit(1)).alias("n"))


@query("b22_cover_bins10", "source:s bin_code:i n:i",
       "SELECT source, least(CAST(floor(cover * 10) AS INT), 9) AS bin_code, count(*) AS n FROM cells GROUP BY 1, 2", "cells")
def _(t: Tables):
    return t.cells.groupBy("source", physics.cover_bin10("cover").alias("bin_code")).agg(F.count(F.lit(1)).alias("n"))


@query("b23_state_classes", "source:s snowfree:i marginal:i shallow:i substantial:i cover_full:i cover_partial:i",
       """SELECT source, count(*) FILTER (swe_mm <= 1) AS snowfree, count(*) FILTER (swe_mm > 1 AND swe_mm <= 10) AS marginal,
       count(*) FILTER (swe_mm > 10 AND swe_mm <= 25) AS shallow, count(*) FILTER (swe_mm > 25) AS substantial,
       count(*) FILTER (cover >= 1 - 1e-6) AS cover_full,
       count(*) FILTER (cover > 1e-6 AND cover < 1 - 1e-6) AS cover_partial FROM cells GROUP BY 1""", "cells")
def _(t: Tables):
    s, c = physics.swe_state_classes("swe_mm"), physics.cover_state_classes("cover")
    return t.cells.groupBy("source").agg(
        F.count_if(s["snowfree_le_1mm"]).alias("snowfree"), F.count_if(s["marginal_1_10mm"]).alias("marginal"),
        F.count_if(s["shallow_10_25mm"]).alias("shallow"), F.count_if(s["substantial_gt_25mm"]).alias("substantial"),
        F.count_if(c["full_1"]).alias("cover_full"), F.count_if(c["any_partial_gt0_lt1"]).alias("cover_partial"))


@query("b24_elevation_bands", "lattice:s band:s cells:i mean_elev:f",
       """, b AS (SELECT * FROM (VALUES ('Lower', -1e9, 2896.0), ('Middle', 2896.0, 3353.0), ('Upper', 3353.0, 1e9),
         ('All', -1e9, 1e9)) b(band, lo, hi))
       SELECT lattice, band, count(*) AS cells, avg(elev_m) AS mean_elev FROM elevations, b
       WHERE elev_m >= lo AND elev_m < hi GROUP BY 1, 2""", "elevations")
def _(t: Tables):
    from ..operators.spatial import join_bands
    return join_bands(t.elevations).groupBy("lattice", "band").agg(
        F.count(F.lit(1)).alias("cells"), F.avg("elev_m").alias("mean_elev"))


@query("b25_numeric_coercion", "event_id:i number:f",
       "SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS number FROM events")
def _(t: Tables):
    text = F.when(F.col("event_type") == "view", F.concat(F.col("value").cast("string"), F.lit(" n/a"))).otherwise(
        F.col("value").cast("string"))
    return t.read("events").select("event_id", text.try_cast("double").alias("number"))


@query("b26_class_breaks", "source:s class_code:i n:i top:f",
       """, r AS (SELECT source, greatest(quantile_cont(swe_mm, 0.99), 1) AS q FROM basin GROUP BY 1),
       m AS (SELECT source, ceil(q / pow(10, floor(log10(q))) * 2) / 2 * pow(10, floor(log10(q))) AS top FROM r),
       c AS (SELECT b.source, top, CASE WHEN swe_mm < 0.1 * top THEN 0 WHEN swe_mm < 0.25 * top THEN 1
         WHEN swe_mm < 0.5 * top THEN 2 WHEN swe_mm < 0.75 * top THEN 3 ELSE 4 END AS class_code
         FROM basin b JOIN m USING (source))
       SELECT source, class_code, count(*) AS n, max(top) AS top FROM c GROUP BY 1, 2""", "basin")
def _(t: Tables):
    from ..operators.scale import exact_percentiles
    robust = exact_percentiles(t.basin, ["source"], "swe_mm", {"robust": 0.99})
    b = t.basin.join(robust.select("source", physics.nice_breaks("robust").alias("breaks")), "source")
    return (b.groupBy("source", physics.class_code("swe_mm", "breaks").alias("class_code"))
            .agg(F.count(F.lit(1)).alias("n"), F.max(F.element_at("breaks", -1)).alias("top")))


@query("b27_clipped_windows", "water_year:i window:s start_date:d end_date:d",
       """, y AS (SELECT DISTINCT water_year AS w FROM items),
       a AS (SELECT w AS water_year, 'focus' AS "window", greatest(make_date(w, 2, 1), DATE '1996-03-01') AS start_date,
             least(make_date(w, 4, 30), DATE '2000-04-10') AS end_date FROM y)
       SELECT * FROM a WHERE start_date <= end_date""", "items")
def _(t: Tables):
    return cal.season_windows(t.basin, {"focus": ("02-01", "04-30")}, ("1996-03-01", "2000-04-10"))


# -- filters -----------------------------------------------------------------------------

@query("c1_analysis_window", "spinup_record_count:i analysis_record_count:i trailing_record_count:i window_inside_axis:b",
       """SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-03 00:00:00') AS spinup_record_count,
       count(*) FILTER (ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-28 23:00:00') AS analysis_record_count,
       count(*) FILTER (ts > TIMESTAMP '2024-01-28 23:00:00') AS trailing_record_count,
       min(ts) <= TIMESTAMP '2024-01-03 00:00:00' AND max(ts) >= TIMESTAMP '2024-01-28 23:00:00' AS window_inside_axis
       FROM hours""", "hours")
def _(t: Tables):
    return rollup.spinup_report(t.hours, "2024-01-03 00:00:00", "2024-01-28 23:00:00")


@query("c2_season_filter", "source:s water_year:i n:i swe_total:f",
       """SELECT source, water_year, count(*) AS n, sum(swe_mm) AS swe_total FROM basin
       WHERE date BETWEEN make_date(water_year - 1, 11, 1) AND make_date(water_year, 3, 15) GROUP BY 1, 2""", "basin")
def _(t: Tables):
    return (t.basin.where(cal.in_season("date", "water_year", "11-01", "03-15")).groupBy("source", "water_year")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("swe_mm").alias("swe_total")))


@query("c3_window_with_lead_day", "source:s water_year:i first_date:d n_changes:i",
       """, w AS (SELECT *, swe_mm - lag(swe_mm) OVER (PARTITION BY source, water_year ORDER BY date) AS d FROM basin
         WHERE date BETWEEN make_date(water_year, 4, 1) - 1 AND make_date(water_year, 6, 30))
       SELECT source, water_year, min(date) AS first_date, count(d) AS n_changes FROM w GROUP BY 1, 2""", "basin")
def _(t: Tables):
    w = events.event_window(t.basin, "04-01", "06-30")
    w = w.withColumn("d", series.row_difference("swe_mm", ["source", "water_year"]))
    return w.groupBy("source", "water_year").agg(F.min("date").alias("first_date"), F.count("d").alias("n_changes"))


@query("c4_spatial_support", "row:i col:i weight:f n:i",
       """SELECT c."row", c.col, w.weight, count(*) AS n FROM cells c JOIN weights w ON c."row" = w."row" AND c.col = w.col
       WHERE w.weight > 0 GROUP BY 1, 2, 3""", "cells weights")
def _(t: Tables):
    return areal.on_support(t.cells, t.weights).groupBy("row", "col", "weight").agg(F.count(F.lit(1)).alias("n"))


@query("c4_support_bounds", "row_start:i row_stop:i col_start:i col_stop:i",
       """SELECT min("row") AS row_start, max("row") + 1 AS row_stop, min(col) AS col_start, max(col) + 1 AS col_stop
       FROM weights WHERE weight > 0""", "weights")
def _(t: Tables):
    return areal.support_bounds(t.weights)


@query("c5_drop_feb29", "water_year:i days:i",
       """SELECT water_year, count(DISTINCT date) AS days FROM items WHERE strftime(date, '%m-%d') <> '02-29' GROUP BY 1""", "items")
def _(t: Tables):
    days = t.read("lineitem").select(F.to_date("l_shipdate").alias("date")).distinct().where(~cal.is_feb29("date"))
    return days.groupBy(cal.water_year("date").alias("water_year")).agg(F.count(F.lit(1)).alias("days"))


_EVENT_SQL = """, p AS (SELECT i.date, i.water_year, i.swe_mm AS x, n.swe_mm AS y FROM basin i JOIN basin n
      ON i.date = n.date AND i.source = 'I' AND n.source = 'N'),
   d AS (SELECT date, water_year, {sign} * (x - lag(x) OVER w) AS dx, {sign} * (y - lag(y) OVER w) AS dy FROM p
      WINDOW w AS (PARTITION BY water_year ORDER BY date))
   SELECT date, dx, dy FROM d WHERE dx IS NOT NULL AND dy IS NOT NULL AND (dx > 20 {rule} dy > 20)"""


def _pairs(t: Tables):
    from ..operators.relate import pair
    return pair(t.basin_of("I"), t.basin_of("N"), ["date", "water_year"], ["swe_mm"])


@query("c6_events_either", "date:d dx:f dy:f", _EVENT_SQL.format(sign="1", rule="OR"), "basin")
def _(t: Tables):
    e = events.change_events(_pairs(t), ["water_year"], "swe_mm_i", "swe_mm_n", "accumulation", 20.0)
    return e.withColumnsRenamed({"change_x": "dx", "change_y": "dy"})


@query("c6_events_both", "date:d dx:f dy:f", _EVENT_SQL.format(sign="-1", rule="AND"), "basin")
def _(t: Tables):
    e = events.change_events(_pairs(t), ["water_year"], "swe_mm_i", "swe_mm_n", "ablation", 20.0, rule="both")
    return e.withColumnsRenamed({"change_x": "dx", "change_y": "dy"})


@query("c7_state_hour", "source:s row:i col:i date:d depth_m:f",
       """SELECT source, "row", col, CAST(ts AS DATE) AS date, depth_m * 1000 AS depth_m FROM hours WHERE hour(ts) = 23""", "hours")
def _(t: Tables):
    return rollup.daily_state(t.hours, ["source", "row", "col"], {"depth_m": 1000.0}, hour=23)


@query("c8_hourly_physics", "source:s row:i col:i ts:t violations:s",
       """, v AS (SELECT *, rain_mm_s - 0.0001 AS rain, sw_w_m2 - 5 AS sw, lw_w_m2 - 205 AS lw, temp_k + 85 AS tk FROM hours)
       SELECT source, "row", col, ts, concat_ws(',', CASE WHEN rain < -1e-12 THEN 'negative_rain' END,
         CASE WHEN sw < -1e-6 THEN 'negative_shortwave' END, CASE WHEN lw < -1e-6 THEN 'negative_longwave' END,
         CASE WHEN NOT tk BETWEEN 150 AND 350 THEN 'implausible_temperature' END) AS violations FROM v
       WHERE rain < -1e-12 OR sw < -1e-6 OR lw < -1e-6 OR NOT tk BETWEEN 150 AND 350""", "hours")
def _(t: Tables):
    h = (t.hours.withColumn("rain", F.col("rain_mm_s") - 0.0001).withColumn("sw", F.col("sw_w_m2") - 5)
         .withColumn("lw", F.col("lw_w_m2") - 205).withColumn("tk", F.col("temp_k") + 85))
    return rollup.hourly_physics_violations(h, "rain", "sw", "lw", "tk").withColumn(
        "violations", F.array_join("violations", ","))


@query("c9_month_subset", "source:s season:s snowfall:f",
       """SELECT source, CASE WHEN month(date) IN (4, 5, 6) THEN 'apr_jun' ELSE 'oct_mar' END AS season,
       sum(snowfall_mm) AS snowfall FROM basin WHERE month(date) NOT IN (7, 8, 9) GROUP BY 1, 2""", "basin")
def _(t: Tables):
    m = F.month("date")
    season = F.when(m.isin(10, 11, 12, 1, 2, 3), "oct_mar").when(m.isin(4, 5, 6), "apr_jun")
    return (t.basin.withColumn("season", season).where(F.col("season").isNotNull())
            .groupBy("source", "season").agg(F.sum("snowfall_mm").alias("snowfall")))


@query("c10_flagged_rows", "obs_date:d variable:s row:i col:i raw_mm:f cleaned_mm:f",
       """SELECT obs_date, variable, "row", col, raw_mm, CASE WHEN raw_mm < 0 AND raw_mm >= -60 THEN 0 END AS cleaned_mm
       FROM raw_obs WHERE raw_mm < 0 OR raw_mm > CASE variable WHEN 'SWE' THEN 5000 ELSE 15000 END""", "raw_obs")
def _(t: Tables):
    return quality.apply_limits(t.raw_obs, tolerance=60.0).where("adjusted")


