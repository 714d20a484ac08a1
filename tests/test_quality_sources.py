from __future__ import annotations

import datetime as dt
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from nivalgrid.operators import quality, timeaxis
from nivalgrid.plans import climatology
from nivalgrid.sources import readers, sinks

OBS = "variable string, row int, col int, raw_mm double, inside boolean"


def test_hard_limits(spark):
    v = [[0.0, -0.5, -5.0], [100.0, 5000.0, 6000.0]]
    df = spark.createDataFrame([("SWE", r, c, v[r][c], True) for r in range(2) for c in range(3)], OBS)
    q = quality.apply_limits(df)
    got = {(r.row, r.col): r.cleaned_mm for r in q.collect()}
    assert got == {(0, 0): 0.0, (0, 1): 0.0, (0, 2): None, (1, 0): 100.0, (1, 1): 5000.0, (1, 2): None}
    s = quality.summary(q, ["variable"]).first()
    assert (s.clipped_to_zero_count, s.masked_negative_count, s.masked_above_hard_max_count, s.adjusted_count) == (1, 1, 1, 3)
    blocks = {r.block: r for r in quality.percentile_blocks(q, ["variable"]).collect()}
    assert blocks["raw"]["count"] == 6 and blocks["raw"].max_mm == 6000.0 and blocks["cleaned"]["count"] == 4 and blocks["cleaned"].p50_mm == 50.0
    with pytest.raises(Exception, match="no limit for variable"):
        quality.apply_limits(df.withColumn("variable", F.lit("Ice"))).collect()


def test_percentile_blocks_count_dealt_rows(spark):
    """Values are dealt out before any task counts them, and each is counted once for both of its blocks; clipped values meet at 0."""
    v = [-50.0, -20.0, 0.0, -0.0, 7.0, 7.0, 9000.0, None, -80.0, float("nan")]
    df = spark.createDataFrame([("SWE", 0, c, x, c % 2 == 0 if c < 9 else None) for c, x in enumerate(v)], OBS).coalesce(1)
    df = df.unionByName(spark.createDataFrame([("Snow depth", 1, 0, None, True)], OBS))
    blocks = quality.percentile_blocks(quality.apply_limits(df, tolerance=60.0), ["variable"])
    got = {(r.variable, r.block): (r["count"], r.min_mm, r.p50_mm, r.max_mm) for r in blocks.collect()}
    assert got == {("SWE", "raw"): (8, -80.0, 0.0, 9000.0), ("SWE", "cleaned"): (6, 0.0, 0.0, 7.0),
                   ("SWE", "inside_raw"): (5, -80.0, 0.0, 9000.0), ("SWE", "inside_cleaned"): (3, 0.0, 0.0, 7.0),
                   **{("Snow depth", b): (0, None, None, None) for b in ("raw", "cleaned", "inside_raw", "inside_cleaned")}}
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    first = [i for i, line in enumerate(lines) if "HashAggregate" in line and re.search(r"keys=\[[^]]*\bv#", line) and "partial_count" in line]
    assert first
    for i in first:
        below = next(line for line in lines[i + 1:] if re.search(r"Exchange|Scan|HashAggregate", line))
        assert "REBALANCE_PARTITIONS_BY_COL" in below


def test_flag_log_has_unique_cells(spark):
    df = spark.createDataFrame([("SWE", 0, c, x, True) for c, x in enumerate([-0.5, -5.0, 6000.0])], OBS)
    log = quality.flagged_log(quality.apply_limits(df), ["variable"]).collect()
    assert sorted(r.reason for r in log) == ["above_hard_maximum", "negative_below_tolerance", "small_negative"]
    assert len({(r.row, r.col) for r in log}) == 3 and not any(r.truncated for r in log)
    cut = quality.flagged_log(quality.apply_limits(df), ["variable"], maximum=2).collect()
    assert [r.position for r in sorted(cut, key=lambda r: r.position)] == [1, 2] and all(r.truncated for r in cut)


def test_boxplot_whiskers(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [1, 2, 3, 4, 5, 100]], "k string, v double")
    r = quality.boxplot(df, ["k"], "v").first()
    assert (r.whisker_low, r.q1, r.median, r.q3, r.whisker_high, r.n) == (1.0, 2.25, 3.5, 4.75, 5.0, 6)


def test_station_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "Date,ID,Precipitation Increment (mm),Snow Water Equivalent (mm),Snow Depth (mm)\n"
        "2018-10-01,380,1.5,10,30\n2018-10-02,380,M,11,\n2019-10-02,x,1,1,1\n")
    got = readers.station_csv(spark, str(tmp_path / "s.csv"), end="2018-12-31").orderBy("date").collect()
    assert [(r.station_id, r.water_year, r.precip_observed_mm, r.snow_depth_mm) for r in got] == [(380, 2019, 1.5, 30.0), (380, 2019, None, None)]
    (tmp_path / "bad.csv").write_text("Date,ID\n2018-10-01,1\n")
    with pytest.raises(ValueError, match="missing required columns"):
        readers.station_csv(spark, str(tmp_path / "bad.csv"))


def test_gauge_text(spark, tmp_path):
    (tmp_path / "g.rdb").write_text("# note\nagency_cd\tdatetime\t9_00060_00003\t9_00060_00003_cd\n5s\t20d\t14n\t10s\nX\t2018-10-01\t100\tA\nX\t2018-10-02\t\tA\n")
    got = readers.gauge_text(spark, str(tmp_path / "g.rdb")).orderBy("date").collect()
    assert [r.discharge_cfs for r in got] == [100.0, None]
    assert got[0].discharge_m3_day == pytest.approx(100 * 0.028316846592 * 86400)
    (tmp_path / "two.rdb").write_text("datetime\t1_00060_00003\t2_00060_00003\n2018-10-01\t1\t2\n")
    with pytest.raises(ValueError, match="uniquely"):
        readers.gauge_text(spark, str(tmp_path / "two.rdb"))


def test_gauge_json_pages_last_wins(spark, tmp_path):
    def page(*items):
        return json.dumps({"features": [{"properties": {"parameter_code": p, "time": t, "value": v}} for p, t, v in items]}, indent=1)
    (tmp_path / "p1.json").write_text(page(("00060", "2018-10-01", "1"), ("00010", "2018-10-02", "9"), ("00060", None, "4")))
    (tmp_path / "p2.json").write_text(page(("00060", "2018-10-01", "2"), ("00060", "2018-10-01", "3"), ("00060", "2018-10-03", "bad")))
    got = readers.gauge_json(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.date, r.discharge_cfs) for r in got] == [(dt.date(2018, 10, 1), 3.0), (dt.date(2018, 10, 3), None)]


def test_archive_listing(spark, tmp_path):
    for name in ("a/2018100100.GRID", "b/2018100100.GRID", "a/2018100101.GRID", "a/notes.txt", "a/2018100102.OTHER", "a/2031010100.GRID"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    days = spark.createDataFrame([(2019, dt.date(2018, 10, 1))], "water_year int, date date")
    report, dup = timeaxis.archive_inventory(readers.list_archive(spark, str(tmp_path)), timeaxis.hour_scaffold(days), suffix="GRID")
    r = report.first()
    assert r.found_hour_count == 2 and r.missing_hours.startswith("02,03") and not r.complete_00_23
    assert [(d.ts, d.file_count) for d in dup.collect()] == [(dt.datetime(2018, 10, 1), 2)]


def test_observation_units(spark):
    df = spark.createDataFrame([(0, 0, 1.5), (0, 1, -9999.0), (0, 2, float("nan"))], "row int, col int, value double")
    got = readers.observation_cells(df.withColumn("units", F.lit("SWE [m]"))).orderBy("col").collect()
    assert [r.raw_mm for r in got] == [1500.0, None, None]
    assert readers.observation_cells(df.withColumn("units", F.lit(" MM ")), cleaned=True).first().raw_mm == 1.5
    with pytest.raises(Exception, match="does not declare"):
        readers.observation_cells(df.withColumn("units", F.lit("feet"))).collect()


def test_processed_daily(spark):
    df = spark.createDataFrame([("2018-10-01", "1.5"), ("2018-10-02", "x")], "date string, swe_mm string")
    got = readers.processed_daily(df, ["swe_mm"]).orderBy("date").collect()
    assert [(r.water_year, r.swe_mm) for r in got] == [(2019, 1.5), (2019, None)]
    with pytest.raises(Exception, match="duplicate key"):
        readers.processed_daily(df.unionByName(df), ["swe_mm"]).collect()
    with pytest.raises(Exception, match="unparseable date"):
        readers.processed_daily(df.withColumn("date", F.lit("soon")), ["swe_mm"]).collect()


def test_reuse_or_build(spark, tmp_path):
    days = lambda n: spark.range(n).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").alias("v"))
    path = str(tmp_path / "c")
    calls = []

    def build(n):
        calls.append(n)
        return days(n)
    _, reused = sinks.reuse_or_build(spark, path, lambda: build(5), days(5).select("date"))
    assert not reused
    t, reused = sinks.reuse_or_build(spark, path, lambda: build(3), days(3).select("date"), mode="covers")
    assert reused and t.count() == 3
    t, reused = sinks.reuse_or_build(spark, path, lambda: build(3), days(3).select("date"))
    assert not reused and t.count() == 3 and calls == [5, 3]
    # a table with a gap does not cover, an empty request is covered, a half-written table is not taken
    gap = str(tmp_path / "gap")
    sinks.reuse_or_build(spark, gap, lambda: days(9).where("v <> 4"), days(9).where("v <> 4").select("date"))
    assert not sinks.reuse_or_build(spark, gap, lambda: build(9), days(9).select("date"), mode="covers")[1]
    t, reused = sinks.reuse_or_build(spark, gap, lambda: build(0), days(0).select("date"), mode="covers")
    assert reused and t.count() == 0
    half = str(tmp_path / "half")
    days(3).write.parquet(f"{half}/data")
    assert not sinks.reuse_or_build(spark, half, lambda: build(3), days(3).select("date"))[1]
    with pytest.raises(ValueError):
        sinks.reuse_or_build(spark, half, lambda: build(3), days(3).select("date"), mode="some")


def test_time_bounds_reach_the_scan(spark, tmp_path):
    from nivalgrid.catalog.bindings import Tables

    spark.sql("SELECT id AS event_id, id * 50 AS user_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id) AS ts, 'click' AS event_type, 1.0D AS value FROM range(200)").write.parquet(str(tmp_path / "events.parquet"))
    t = Tables(spark, str(tmp_path))
    hours = readers.grid_subset(t.hours_of("2024-01-02 00:00:00", "2024-01-02 05:00:00", rows=3), ["temp_k"], (0, 3), (0, 5), "2024-01-02 00:00:00", "2024-01-02 05:00:00")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = hours._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):].split("]")[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed and "LessThan(user_id" in pushed
    assert hours.count() == t.hours.where("ts >= '2024-01-02 00:00:00' AND ts <= '2024-01-02 05:00:00' AND row < 3").count()


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), 2.0)], "a double, b double")
    assert [tuple(r) for r in readers.null_nan(df).collect()] == [(None, 1.0), (None, 2.0)]


def test_window_completeness(spark):
    days = spark.sql("SELECT d AS date, year(d) + IF(month(d) >= 10, 1, 0) AS water_year FROM (SELECT explode(sequence(DATE'2019-10-01', DATE'2020-06-30')) AS d)")
    for c in ("precip_mm_day", "temperature_mean_c", "incoming_sw_mean_w_m2", "incoming_sw_energy_mj_m2_day", "incoming_lw_mean_w_m2", "incoming_lw_energy_mj_m2_day"):
        days = days.withColumn(c, F.lit(1.0))
    full = {r.window: r.n_days for r in climatology.window_metrics(days).collect()}
    assert full == {"oct1_jun30": 274, "nov1_mar15": 136, "apr1_jun30": 91}
    leap = {r.window: r.n_days for r in climatology.window_metrics(days, drop_feb29=True).collect()}
    assert leap == {"oct1_jun30": 273, "nov1_mar15": 135, "apr1_jun30": 91}
    with pytest.raises(Exception, match="incomplete window"):
        climatology.window_metrics(days.where("date <> DATE'2020-05-05'")).collect()


def test_failed_build_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    days = lambda n: spark.range(n).select(F.col("id").alias("date"), F.lit(n).alias("v"))
    sinks.reuse_or_build(spark, path, lambda: days(3), days(3).select("date"))
    broken = lambda: days(5).withColumn("v", F.raise_error(F.lit("no input")).cast("int"))
    with pytest.raises(Exception, match="no input"):
        sinks.reuse_or_build(spark, path, broken, days(5).select("date"))
    assert sinks.published(spark, path).count() == 3 and len(sinks.versions(spark, path)) == 1
    t, reused = sinks.reuse_or_build(spark, path, broken, days(3).select("date"))
    assert reused and t.count() == 3


def test_build_may_read_the_stored_table(spark, tmp_path):
    path = str(tmp_path / "t")
    days = lambda n: spark.range(n).select(F.col("id").alias("date"), F.lit(n).alias("v"))
    sinks.reuse_or_build(spark, path, lambda: days(3), days(3).select("date"))
    old = sinks.published(spark, path)
    grow = lambda: sinks.published(spark, path).unionByName(days(6).where("date >= 3"))
    t, reused = sinks.reuse_or_build(spark, path, grow, days(6).select("date"))
    assert not reused and sorted((r.date, r.v) for r in t.collect()) == [(0, 3), (1, 3), (2, 3), (3, 6), (4, 6), (5, 6)]
    assert old.count() == 3 == sinks.published(spark, path, back=1).count() and sinks.published(spark, path, back=2) is None


def test_published_tables_and_cubes(spark, tmp_path):
    cells = spark.range(40).selectExpr("IF(id % 2 = 0, 'I', 'N') AS source", "CAST(2000 + id % 3 AS INT) AS water_year", "date_add(DATE'2020-01-01', CAST(id AS INT)) AS date",
                                       "CAST(id AS INT) AS row", "0 AS col", "id * 1.0D AS v")
    cube = str(tmp_path / "cube")
    sinks.publish_cube(cells.where("row < 20"), cube)
    sinks.publish_cube(sinks.published(spark, cube).unionByName(cells.where("row >= 20")), cube)
    assert sinks.published(spark, cube).count() == 40 and sinks.published(spark, cube, back=1).count() == 20
    table = str(tmp_path / "csv")
    sinks.publish_table(cells.select("row", "v"), table, "csv")
    assert sinks.published(spark, table).columns == ["row", "v"] and sinks.versions(spark, table)[0][2] == "csv"


def test_duplicate_files_are_fatal(spark):
    hours = timeaxis.hour_scaffold(spark.createDataFrame([(2021,)], "water_year int").selectExpr("water_year", "DATE'2021-01-05' AS date"))
    files = spark.createDataFrame([("a/2021010503.F",), ("b/2021010503.F",), ("a/2021010504.F",)], "path string")
    with pytest.raises(Exception, match="several files for 2021-01-05 03:00:00"):
        timeaxis.checked_inventory(files, hours).collect()
    row = timeaxis.checked_inventory(files, hours, on_duplicate="report").first()
    assert (row.found_hour_count, row.duplicate_hour_count) == (2, 1)
    assert timeaxis.checked_inventory(files.where("path NOT LIKE 'b%'"), hours).first().duplicate_hour_count == 0
    with pytest.raises(ValueError):
        timeaxis.checked_inventory(files, hours, on_duplicate="drop")


def test_bucketed_cube_needs_no_exchange(spark, tmp_path):
    """Pairing, lags and event windows on a cube stored in buckets of its cell."""
    from nivalgrid.operators import events, relate

    cells = spark.range(4000).selectExpr("IF(id % 2 = 0, 'I', 'N') AS source", "2000 + CAST(id % 3 AS INT) AS water_year", "CAST(id % 7 AS INT) AS row",
                                         "CAST(id % 5 AS INT) AS col", "date_add(DATE'2000-11-01', CAST(id / 210 AS INT)) AS date", "CAST(id * 37 % 101 AS DOUBLE) AS swe_mm").dropDuplicates(["source", "water_year", "row", "col", "date"])
    keys = ["water_year", "row", "col"]
    run = lambda df: events.change_events(relate.pair_long(df, [*keys, "date"], ["swe_mm"]), keys, "swe_mm_i", "swe_mm_n", "accumulation")
    stored = sinks.write_bucketed(cells, sinks.scratch_table("t"), str(tmp_path / "b"), ["row", "col"], buckets=3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = run(stored)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Exchange" not in plan and "Bucketed: true" in plan
    rows = lambda df: sorted(tuple(r) for r in df.select(*keys, "date", "change_x", "change_y").collect())
    assert rows(run(stored)) == rows(run(cells)) != []


def scanned(df):
    """Rows that the file scans of a plan handed on."""
    df.collect()
    node, found = df._jdf.queryExecution().executedPlan(), []

    def walk(n):
        if n.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(n.executedPlan())
        if "FileSourceScan" in n.getClass().getSimpleName():
            found.append(n.metrics().get("numOutputRows").get().value())
        for i in range(n.children().size()):
            walk(n.children().apply(i))

    walk(node)
    return sum(found)


def test_box_reads_few_row_groups(spark, tmp_path):
    """A box of one per cent of a clustered cube reads less than a tenth of it."""
    cells = spark.range(100 * 100 * 64).selectExpr("CAST(id % 100 AS INT) AS row", "CAST(id / 100 % 100 AS INT) AS col",
                                                   "date_add(DATE'2003-10-01', CAST(id / 10000 AS INT)) AS date", "id * 0.5D AS v")
    path = str(tmp_path / "z")
    sinks.write_clustered(cells, path, row_group_bytes=64 << 10)
    box = sinks.read_box(spark, path, (40, 62), (10, 32), ("2003-10-11", "2003-10-23"))
    want = cells.where("row BETWEEN 40 AND 61 AND col BETWEEN 10 AND 31 AND date BETWEEN DATE'2003-10-11' AND DATE'2003-10-23'")
    assert sorted(tuple(r) for r in box.collect()) == sorted(tuple(r) for r in want.collect()) and want.count() / 640_000 < 0.011
    read = scanned(sinks.read_box(spark, path, (40, 62), (10, 32), ("2003-10-11", "2003-10-23")))
    assert 0 < read < 64_000, read
    assert sinks.read_box(spark, path, (40, 40), (10, 32), ("2003-10-11", "2003-10-23")).count() == 0


def test_cluster_ranges_cover_the_box(spark):
    import random

    random.seed(3)
    for _ in range(20):
        low = [random.randrange(64) for _ in range(3)]
        high = [min(63, x + random.randrange(20)) for x in low]
        ranges = sinks.cluster_ranges(low, high, bits=6)
        assert len(ranges) <= 64 and all(a <= b for a, b in ranges) and all(x[1] + 1 < y[0] for x, y in zip(ranges, ranges[1:]))
        for _ in range(60):
            p = [random.randint(a, b) for a, b in zip(low, high)]
            z = sum((x >> i & 1) << (3 * i + 2 - k) for k, x in enumerate(p) for i in range(6))
            assert any(a <= z <= b for a, b in ranges)
    row = spark.sql("SELECT 5 AS row, 3 AS col, DATE'1970-01-07' AS date").select(sinks.cluster_key(bits=6)).first()[0]
    assert row == sum((x >> i & 1) << (3 * i + 2 - k) for k, x in enumerate((5, 3, 6)) for i in range(6))


def test_products_from_one_pass_equal_the_joins(spark):
    """All products and the density from one aggregation, and no table is read twice."""
    from nivalgrid.catalog.analyses import BANDS
    from nivalgrid.catalog.bindings import COMMON, FINE, MIDDLE, Tables
    from nivalgrid.plans import observations

    t = Tables(spark, "/root/testdata/sf0.001")
    products = observations.lattice_products(t.obs_fields, t.first_fields, t.second_fields, FINE, MIDDLE, COMMON, t.lattice_cells)
    fields = observations.common_fields(t.obs_fields, t.first_fields, t.second_fields, FINE, MIDDLE, COMMON, t.common_weights)
    native = observations.native_differences(t.obs_fields, t.first_fields, FINE, MIDDLE, t.middle_weights)
    want = observations.difference_products(fields, native)
    key = lambda r: (r.product, r.obs_date, r.variable, r.row, r.col)
    have = {key(r): r.value for r in products.where(F.col("product") != observations.DENSITY).collect()}
    joined = {key(r): r.difference for r in want.collect()}
    assert have.keys() == joined.keys() and all(have[k] == pytest.approx(joined[k], abs=1e-9) for k in have) and have
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    table = observations.band_table(products, BANDS)
    plan = table._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert products._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 6 and plan.count("ReusedExchange") >= 1


def test_period_bounds_reach_any_stored_time(spark, tmp_path):
    """The reader itself prunes: timestamps with and without zone, and dates."""
    base = spark.sql("SELECT id AS row, 0 AS col, id * 1.0D AS v, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS ntz FROM range(100)")
    stored = base.withColumn("zoned", F.col("ntz").cast("timestamp")).withColumn("day", F.col("ntz").cast("date")).withColumn("text", F.col("ntz").cast("string"))
    stored.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    for ts, n in (("ntz", 13), ("zoned", 13), ("text", 13), ("day", 24)):
        got = readers.hourly_grid(t, ["v"], "2024-01-02 00:00:00", "2024-01-02 12:00:00", ts)
        assert got.count() == n, ts
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert (f"GreaterThanOrEqual({ts}" in plan) == (ts != "text"), ts


def test_axis_checks_in_the_input_report(spark):
    rows = [("a", 1, "2024-01-01 00:00:00"), ("a", 1, "2024-01-01 01:00:00"), ("a", 1, "2024-01-01 01:00:00"), ("a", 2, "2024-01-01 05:00:00"), ("a", 2, "2024-01-01 07:00:00"),
            ("a", 2, None), ("b", 1, "2024-01-01 00:00:00"), ("b", 1, "2024-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "k string, i int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.k: r for r in readers.axis_input_report(df, ["k"], "ts", ["i"]).collect()}
    a, b = got["a"], got["b"]
    assert (a.rows, a.id_count, a.null_count, a.duplicate_count, a.unexpected_gap_count, a.regular) == (6, 2, 1, 1, 1, False)
    assert (b.rows, b.id_count, b.duplicate_count, b.regular) == (2, 1, 0, True)


def test_density_limits_do_not_depend_on_the_order_of_sums(spark):
    depth = math.nextafter(100.0, 0.0)  # what another order of the same sum may give
    df = spark.createDataFrame([("a", 29.0, depth), ("a", 31.0, depth), ("b", 29.0, 100.0), ("b", 31.0, 100.0)], "k string, swe double, depth double")
    got = {r.k: tuple(r)[1:] for r in quality.density_summary(df, ["k"], 100.0, (290.0, 310.0), 330.0).collect()}
    assert got["a"] == got["b"] and got["a"][:3] == (2, 0, 0)


def test_lattices_are_never_broadcast(spark):
    from nivalgrid.catalog.analyses import BANDS, _differences, _fields
    from nivalgrid.catalog.bindings import COMMON, FINE, MIDDLE, Tables
    from nivalgrid.plans import observations

    t = Tables(spark, "/root/testdata/sf0.001")
    products = observations.lattice_products(t.obs_fields, t.first_fields, t.second_fields, FINE, MIDDLE, COMMON, t.lattice_cells)
    frames = {"fields": _fields(t), "differences": _differences(t), "products": products,
              "statistics": observations.band_statistics(_differences(t), t.elevations, BANDS).select("median_mm"),
              "density": observations.observed_density(_fields(t), t.elevations, BANDS).select("density_mean")}
    for name, df in frames.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join " in line and "row#" in line]
        assert joins and all("strategy=merge" in line for line in joins), (name, joins)


def test_cluster_key_interleaves_bits_in_few_operations(spark):
    top = (1 << sinks.CLUSTER_BITS) - 1
    cells = [(0, 0, 0), (1, 2, 3), (-5, top + 9, 10957), (top, top, 19999), (699051, 349525, 20742), (1023, 1024, 1 << 17)]
    df = spark.createDataFrame(cells, "row int, col int, d int").withColumn("date", F.date_from_unix_date("d"))

    def plain(cell):
        at = [max(0, min(top, x)) for x in cell]
        return sum((x >> i & 1) << (3 * i + 2 - a) for a, x in enumerate(at) for i in range(sinks.CLUSTER_BITS))

    for bits in (20, 21, 5):
        keyed = df.select("row", "col", "d", sinks.cluster_key(bits=bits).alias("k"))
        if bits == 20:
            assert {tuple(r)[:3]: r.k for r in keyed.collect()} == {c: plain(c) for c in cells}
        assert keyed.select("k").where("k < 0").isEmpty()
    # a shift for each bit and axis took most of the time of a large write
    plan = df.select(sinks.cluster_key().alias("k"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("shiftright") + plan.count("shiftleft") <= 12
