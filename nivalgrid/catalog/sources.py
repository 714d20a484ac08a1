"""Scans, sinks and input checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import areal, rollup, spatial, timeaxis
from ..sources import readers, sinks
from .bindings import FINE, Tables
from .registry import query


@query("a1_hourly_scan", "row:i col:i ts:t temp_k:f",
       """SELECT "row", col, ts, temp_k FROM hours WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 23:00:00'
       AND source = 'N'""", "hours")
def _(t: Tables):
    start, end = "2024-01-05 00:00:00", "2024-01-12 23:00:00"
    return readers.hourly_grid(t.hours_of(start, end).where("source = 'N'"), ["temp_k"], start, end)


@query("a2_daily_folders", "date:d n:i swe:f",
       """SELECT date, count(*) AS n, sum(swe_mm) AS swe FROM cells WHERE month(date) IN (10, 11, 12, 1, 2, 3, 4, 5, 6)
       GROUP BY 1""", "cells")
def _(t: Tables):
    path = sinks.scratch_path(t.spark, "a2")
    sinks.write_cube(t.cells, path)
    stored = t.spark.read.parquet(path)
    days = timeaxis.day_scaffold(stored).select("date")
    return readers.daily_folders(stored, days, "warn-skip").groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("swe_mm").alias("swe"))


_FILES = """, files AS (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM events WHERE event_type <> 'error'
      UNION ALL SELECT DISTINCT date_trunc('hour', ts) FROM events WHERE event_type = 'error'),
   grid AS (SELECT CAST(d AS DATE) AS date, h AS hour FROM range(TIMESTAMP '2023-10-01', TIMESTAMP '2024-07-01', INTERVAL 1 DAY) a(d),
      range(0, 24) b(h)),
   found AS (SELECT g.date, g.hour, count(f.ts) AS n FROM grid g LEFT JOIN files f
      ON f.ts = CAST(g.date AS TIMESTAMP) + to_hours(CAST(g.hour AS INT)) GROUP BY 1, 2)"""


def _archive(t: Tables):
    """Paths of the landed archive and the hours expected in it."""
    e = t.read("events")
    landed = e.select(F.when(F.col("event_type") == "error", "b").otherwise("a").alias("archive"),
                      F.concat(F.date_format("ts", "yyyyMMddHH"), F.lit(".FORCING")).alias("file")).distinct()
    path = sinks.scratch_path(t.spark, "a3")
    landed.withColumn("value", F.lit("")).repartition("archive", "file").write.partitionBy("archive", "file").option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)  # many small folders: no second move by the driver
    paths = readers.list_archive(t.spark, path)
    years = e.select(cal.water_year(F.to_date("ts")).alias("water_year")).distinct()
    return paths, timeaxis.hour_scaffold(timeaxis.day_scaffold(years))


def _inventory(t: Tables):
    return timeaxis.archive_inventory(*_archive(t), suffix="FORCING")


@query("a3_archive_inventory", "date:d expected_hour_count:i found_hour_count:i complete_00_23:b missing_hours:s",
       _FILES + """ SELECT date, count(*) AS expected_hour_count, count(*) FILTER (n > 0) AS found_hour_count,
       count(*) FILTER (n > 0) = 24 AS complete_00_23,
       coalesce(string_agg(lpad(CAST(hour AS VARCHAR), 2, '0'), ',' ORDER BY hour) FILTER (n = 0), '') AS missing_hours
       FROM found GROUP BY 1""")
def _(t: Tables):
    return _inventory(t)[0]


@query("a3_archive_duplicates", "ts:t file_count:i",
       _FILES + """ SELECT CAST(date AS TIMESTAMP) + to_hours(CAST(hour AS INT)) AS ts, n AS file_count FROM found WHERE n > 1""")
def _(t: Tables):
    return _inventory(t)[1]


@query("a3_checked_inventory", "date:d expected_hour_count:i found_hour_count:i complete_00_23:b duplicate_hour_count:i",
       _FILES + """ SELECT date, count(*) AS expected_hour_count, count(*) FILTER (n > 0) AS found_hour_count,
       count(*) FILTER (n > 0) = 24 AS complete_00_23, count(*) FILTER (n > 1) AS duplicate_hour_count FROM found GROUP BY 1""")
def _(t: Tables):
    return timeaxis.checked_inventory(*_archive(t), suffix="FORCING", on_duplicate="report")


@query("a4_station_csv", "station_id:i date:d water_year:i precip_observed_mm:f swe_mm:f snow_depth_mm:f",
       """SELECT station_id, date, water_year, CASE WHEN station_id <> 3 THEN precip_mm END AS precip_observed_mm,
       swe_mm, snow_depth_mm FROM station WHERE source = 'S' AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""", "station")
def _(t: Tables):
    path = sinks.scratch_path(t.spark, "a4")
    landed = t.station.where("source = 'S'").select(
        F.col("date").alias("Date"), F.col("station_id").alias("ID"),
        F.when(F.col("station_id") == 3, F.lit("n/a")).otherwise(F.col("precip_mm").cast("string"))
        .alias("Precipitation Increment (mm)"),
        F.col("swe_mm").alias("Snow Water Equivalent (mm)"), F.col("snow_depth_mm").alias("Snow Depth (mm)"))
    sinks.write_table(landed, path, "csv")
    return readers.station_csv(t.spark, path, "1996-01-01", "2000-12-31")


@query("a5_gauge_text", "date:d discharge_cfs:f8 discharge_m3_day:f3 water_year:i",
       "SELECT date, discharge_cfs, discharge_m3_day, water_year FROM gauge", "gauge")
def _(t: Tables):
    path = sinks.scratch_path(t.spark, "a5")
    landed = t.gauge.select(F.lit("SITE").alias("agency_cd"), F.col("date").alias("datetime"),
                            F.col("discharge_cfs").alias("1234_00060_00003"), F.lit("A").alias("1234_00060_00003_cd"))
    landed.write.option("sep", "\t").option("header", True).csv(path)
    return readers.gauge_text(t.spark, path)


@query("a6_gauge_json", "date:d discharge_cfs:f water_year:i",
       """SELECT CAST(o_orderdate AS DATE) AS date, max_by(o_totalprice, o_orderkey) AS discharge_cfs,
       max_by(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END, o_orderkey) AS water_year
       FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def _(t: Tables):
    path = sinks.scratch_path(t.spark, "a6")
    feature = F.struct(F.struct(
        F.when(F.col("o_orderstatus") == "F", "00010").otherwise("00060").alias("parameter_code"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("time"),
        F.col("o_totalprice").cast("string").alias("value")).alias("properties"))
    # pages of consecutive records: about 500 orders each, written in page order
    page = F.floor(F.col("o_orderkey") / 500)
    pages = (t.read("orders").groupBy(page.alias("page"))
             .agg(F.sort_array(F.collect_list(F.struct("o_orderkey", feature.alias("f")))).alias("_l"))
             .select("page", F.transform("_l", lambda x: x.getField("f")).alias("features")))
    (pages.repartitionByRange("page").sortWithinPartitions("page").select("features").write.json(path))
    return readers.gauge_json(t.spark, path, multi_line=False)


@query("a7_static_grid", "row:i col:i x:f y:f elev_m:f valid:b",
       """SELECT "row", col, (col + 0.5) * 10 AS x, ("row" + 0.5) * 10 AS y,
       CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS elev_m, c_acctbal >= 0 AS valid FROM fine""", "fine")
def _(t: Tables):
    z = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).otherwise(F.lit(float("nan")))
    return readers.static_grid(spatial.with_centers(t.fine.withColumn("elev_m", z), FINE))


@query("a8_select_feature", "n_name:s n_nationkey:i",
       "SELECT n_name, n_nationkey FROM nation WHERE lower(trim(n_name)) = 'nation_1'")
def _(t: Tables):
    return spatial.select_feature(t.read("nation"), "n_name", " nation_1 ")


@query("a9_observation_units", "row:i col:i raw_mm:f",
       """SELECT "row", col, CASE WHEN c_acctbal >= 0 THEN c_acctbal / 1000 * 1000 END AS raw_mm FROM fine""", "fine")
def _(t: Tables):
    v = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 1000).otherwise(-9999.0)
    return readers.observation_cells(t.fine.withColumn("value", v).withColumn("units", F.lit("SWE [m]")))


@query("a10_processed_daily", "date:d water_year:i swe_mm:f snowfall_mm:f",
       "SELECT date, water_year, swe_mm, snowfall_mm FROM basin WHERE source = 'N'", "basin")
def _(t: Tables):
    path = sinks.scratch_path(t.spark, "a10")
    sinks.write_table(t.basin_of("N").select("date", "swe_mm", "snowfall_mm"), path, "csv")
    stored = t.spark.read.option("header", True).csv(path)
    return readers.processed_daily(stored, ["swe_mm", "snowfall_mm"])


@query("a11_hour_state", "source:s row:i col:i date:d state_count:i cover:f",
       """SELECT source, "row", col, CAST(ts AS DATE) AS date, count(*) AS state_count,
       CASE WHEN count(*) = 1 THEN max(cover) END AS cover FROM hours WHERE hour(ts) = 23 GROUP BY 1, 2, 3, 4""", "hours")
def _(t: Tables):
    return rollup.hour_of_day_state(t.hours, ["source", "row", "col"], "cover")


@query("a13_input_report", "source:s rows:i first_time:t last_time:t id_count:i",
       """SELECT source, count(*) AS "rows", min(ts) AS first_time, max(ts) AS last_time, count(DISTINCT "row" * 5 + col) AS id_count
       FROM hours GROUP BY 1""", "hours")
def _(t: Tables):
    return readers.input_report(t.hours.withColumn("cell", F.col("row") * 5 + F.col("col")), ["source"], "ts", "cell")


@query("a13_station_report", "source:s station_id:i rows:i first_time:t last_time:t missing_days:i units:s consistent_units:b",
       """, u AS (SELECT source, string_agg(DISTINCT CASE WHEN source = 'S' THEN 'mm' ELSE 'kg m^-2' END, '|') AS units FROM station GROUP BY 1)
       SELECT s.source, station_id, count(*) AS "rows", CAST(min(date) AS TIMESTAMP) AS first_time, CAST(max(date) AS TIMESTAMP) AS last_time,
       max(date) - min(date) + 1 - count(*) AS missing_days, max(units) AS units, true AS consistent_units
       FROM station s JOIN u ON s.source = u.source GROUP BY 1, 2""", "station")
def _(t: Tables):
    per_station = readers.input_report(t.station, ["source", "station_id"], "date")
    units = readers.unit_consistency(t.station.withColumn("unit", F.when(F.col("source") == "S", " MM").otherwise("kg m**-2")), "source", "unit")
    days = F.datediff("last_time", "first_time") + 1
    return per_station.withColumn("missing_days", days - F.col("rows")).join(units.withColumnRenamed("consistent", "consistent_units"), "source")


@query("a13_axis_report", "source:s rows:i first_time:t last_time:t id_count:i null_count:i duplicate_count:i unexpected_gap_count:i regular:b",
       """, e AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'I' ELSE 'N' END AS source, user_id // 75 AS cell, date_trunc('hour', ts) AS ts FROM events),
       d AS (SELECT source, cell, ts, count(*) AS n, ts - lag(ts) OVER (PARTITION BY source, cell ORDER BY ts) AS gap FROM e GROUP BY 1, 2, 3)
       SELECT source, sum(n) AS "rows", min(ts) AS first_time, max(ts) AS last_time, count(DISTINCT cell) AS id_count, 0 AS null_count, sum(n - 1) AS duplicate_count,
       count(*) FILTER (abs(epoch(gap) - 3600) > 1) AS unexpected_gap_count, false AS regular FROM d GROUP BY 1""")
def _(t: Tables):
    e = t.read("events").select(F.when(F.col("event_type").isin("click", "view"), "I").otherwise("N").alias("source"),
                                F.floor(F.col("user_id") / 75).alias("cell"), F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("ts"))
    return readers.axis_input_report(e, ["source"], "ts", ["cell"])


@query("a14_last_state", "source:s row:i col:i date:d depth_m:f temp_k:f",
       """SELECT source, "row", col, CAST(ts AS DATE) AS date, max_by(depth_m, ts) * 1000 AS depth_m, max_by(temp_k, ts) AS temp_k
       FROM hours GROUP BY 1, 2, 3, 4""", "hours")
def _(t: Tables):
    return rollup.daily_state(t.hours, ["source", "row", "col"], {"depth_m": 1000.0, "temp_k": 1.0})


@query("a15_grid_subset", "row:i col:i ts:t sw_w_m2:f lw_w_m2:f",
       """SELECT "row", col, ts, sw_w_m2, lw_w_m2 FROM hours WHERE source = 'I' AND "row" < 3 AND col < 2
       AND ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 23:00:00'""", "hours")
def _(t: Tables):
    start, end = "2024-01-10 00:00:00", "2024-01-20 23:00:00"
    return readers.grid_subset(t.hours_of(start, end, rows=3).where("source = 'I'"), ["sw_w_m2", "lw_w_m2"], (0, 3), (0, 2), start, end)


@query("a15_clustered_box", "source:s row:i col:i date:d swe_mm:f",
       """SELECT source, "row", col, date, swe_mm FROM cells WHERE "row" < 1 AND col BETWEEN 1 AND 2
       AND date BETWEEN DATE '1996-02-01' AND DATE '1996-06-30'""", "cells")
def _(t: Tables):
    path = sinks.scratch_path(t.spark, "a15")
    sinks.write_clustered(t.cells.select("source", "row", "col", "date", "swe_mm"), path)
    return sinks.read_box(t.spark, path, (0, 1), (1, 3), ("1996-02-01", "1996-06-30"))


@query("a17_weights_check", "support_cells:i total_weight:f",
       "SELECT count(*) FILTER (weight > 0) AS support_cells, sum(weight) FILTER (weight > 0) AS total_weight FROM weights", "weights")
def _(t: Tables):
    return areal.require_support(t.weights)


@query("a18_table_sink", "source:s water_year:i date:d swe_mm:f",
       "SELECT source, water_year, date, swe_mm FROM basin", "basin")
def _(t: Tables):
    path = sinks.scratch_path(t.spark, "a18")
    sinks.write_table(t.basin.select("source", "water_year", "date", "swe_mm"), path, "csv", partition_by=["water_year"])
    return t.spark.read.option("header", True).schema("source string, date date, swe_mm double, water_year int").csv(path)


@query("a19_cube_cache", "source:s water_year:i cells:i swe:f cover:f",
       """SELECT source, water_year, count(*) AS cells, sum(swe_mm) AS swe, sum(cover) AS cover FROM cells
       GROUP BY 1, 2""", "cells")
def _(t: Tables):
    path = sinks.scratch_path(t.spark, "a19")
    sinks.write_cube(t.cells, path)
    return t.spark.read.parquet(path).groupBy("source", "water_year").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("swe_mm").alias("swe"), F.sum("cover").alias("cover"))


@query("a21_reuse_or_build", "reused_first:b reused_second:b days:i swe:f",
       "SELECT false AS reused_first, true AS reused_second, count(*) AS days, sum(swe_mm) AS swe FROM basin WHERE source = 'I'", "basin")
def _(t: Tables):
    path = sinks.scratch_path(t.spark, "a21")
    wanted = t.basin_of("I").select("date")
    make = lambda: t.basin_of("I").select("date", "swe_mm")
    _, first = sinks.reuse_or_build(t.spark, path, make, wanted)
    table, second = sinks.reuse_or_build(t.spark, path, make, wanted)
    return table.agg(F.count(F.lit(1)).alias("days"), F.sum("swe_mm").alias("swe")).select(
        F.lit(first).alias("reused_first"), F.lit(second).alias("reused_second"), "days", "swe")


@query("a18_published_table", "source:s water_year:i days:i swe:f old_days:i versions:i",
       """SELECT source, water_year, count(*) AS days, sum(swe_mm) AS swe, count(*) FILTER (month(date) >= 10) AS old_days, 2 AS versions
       FROM basin GROUP BY 1, 2 HAVING count(*) FILTER (month(date) >= 10) > 0""", "basin")
def _(t: Tables):
    """A table that is extended by a build that reads its own earlier version."""
    path = sinks.scratch_path(t.spark, "a18-published")
    daily = t.basin.select("source", "water_year", "date", "swe_mm")
    autumn = F.month("date") >= 10
    sinks.publish_table(daily.where(autumn), path, partition_by=["water_year"])
    sinks.publish_table(sinks.published(t.spark, path).unionByName(daily.where(~autumn)), path, partition_by=["water_year"])
    old = sinks.published(t.spark, path, back=1).groupBy("source", "water_year").agg(F.count(F.lit(1)).alias("old_days"))
    new = sinks.published(t.spark, path).groupBy("source", "water_year").agg(F.count(F.lit(1)).alias("days"), F.sum("swe_mm").alias("swe"))
    return new.join(old, ["source", "water_year"]).withColumn("versions", F.lit(len(sinks.versions(t.spark, path))))


@query("a21_extend_stored", "water_year:i date:d swe_mm:f reused:b",
       """SELECT water_year, date, swe_mm, false AS reused FROM basin WHERE source = 'I'""", "basin")
def _(t: Tables):
    """The request grows: the build keeps the stored days and adds the missing ones."""
    path = sinks.scratch_path(t.spark, "a21-extend")
    daily = t.basin_of("I").select("water_year", "date", "swe_mm")
    first = daily.where(F.month("date") <= 6)
    sinks.reuse_or_build(t.spark, path, lambda: first, first.select("date"))

    def grow():
        stored = sinks.published(t.spark, path)
        return stored.unionByName(daily.join(stored.select("date"), "date", "left_anti").select(*stored.columns))

    table, reused = sinks.reuse_or_build(t.spark, path, grow, daily.select("date"))
    return table.withColumn("reused", F.lit(reused))
