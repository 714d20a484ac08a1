"""Joins, spatial relations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import relate, spatial, timeaxis
from .bindings import COMMON, FINE, UNEVEN, Tables
from .registry import query


@query("d1_paired_sources", "date:d swe_mm_i:f swe_mm_n:f melt_mm_i:f melt_mm_n:f",
       """SELECT i.date, i.swe_mm AS swe_mm_i, n.swe_mm AS swe_mm_n, i.melt_mm AS melt_mm_i, n.melt_mm AS melt_mm_n
       FROM basin i JOIN basin n ON i.date = n.date WHERE i.source = 'I' AND n.source = 'N'""", "basin")
def _(t: Tables):
    return relate.pair(t.basin_of("I"), t.basin_of("N"), ["date"], ["swe_mm", "melt_mm"])


@query("d1_paired_cells", "water_year:i row:i col:i date:d swe_mm_i:f swe_mm_n:f",
       'SELECT water_year, "row", col, date, swe_mm_i, swe_mm_n FROM pairs', "pairs")
def _(t: Tables):
    return t.pairs


_ALIGN = """, a AS (SELECT station_id, date, max(CASE WHEN source = 'I' THEN 1 ELSE 0 END) AS r,
     max(CASE WHEN source = 'N' THEN 1 ELSE 0 END) AS m FROM station WHERE source <> 'S' GROUP BY 1, 2)
   SELECT station_id, sum(r) AS reference_date_count, sum(m) AS model_date_count, count(*) FILTER (r = 1 AND m = 1) AS common_date_count,
     count(*) FILTER (r = 1 AND m = 0) AS reference_only_count, count(*) FILTER (r = 0 AND m = 1) AS model_only_count,
     min(date) FILTER (r = 1 AND m = 1) AS first_common_date, max(date) FILTER (r = 1 AND m = 1) AS last_common_date
   FROM a GROUP BY 1"""


@query("d2_date_alignment", "station_id:i reference_date_count:i model_date_count:i common_date_count:i reference_only_count:i "
       "model_only_count:i first_common_date:d last_common_date:d", _ALIGN, "station")
def _(t: Tables):
    s = t.station
    return relate.alignment_report(s.where("source = 'I'"), s.where("source = 'N'"), by=["station_id"])


_GAP = """, s AS (SELECT station_id, date, water_year, CASE WHEN cover <= 0.8 THEN precip_mm END AS precip_mm
     FROM station WHERE source = 'S'), i AS (SELECT station_id, date, precip_mm AS fill FROM station WHERE source = 'I'),
   g AS (SELECT s.*, fill, coalesce(precip_mm, fill) AS precip_mm_gapfilled, CASE WHEN precip_mm IS NOT NULL THEN 'observed'
     WHEN fill IS NOT NULL THEN 'model nearest cell' ELSE 'missing' END AS precip_mm_gapfill_source
     FROM s LEFT JOIN i USING (station_id, date))"""


def _gaps(t: Tables):
    s = t.station.where("source = 'S'").withColumn(
        "precip_mm", F.when(F.col("cover") <= 0.8, F.col("precip_mm")))
    i = t.station.where("source = 'I'")
    return relate.fill_gaps(s, i, ["station_id", "date"], "precip_mm", "precip_mm")


@query("d3_gap_fill", "station_id:i date:d precip_mm_gapfilled:f precip_mm_gapfill_source:s",
       _GAP + " SELECT station_id, date, precip_mm_gapfilled, precip_mm_gapfill_source FROM g", "station")
def _(t: Tables):
    return _gaps(t)


@query("d3_gap_log", "station_id:i date:d precip_mm_gapfilled:f precip_mm_gapfill_source:s",
       _GAP + " SELECT station_id, date, precip_mm_gapfilled, precip_mm_gapfill_source FROM g WHERE precip_mm IS NULL", "station")
def _(t: Tables):
    return relate.gap_log(_gaps(t), ["station_id", "date"], "precip_mm")


@query("d4_three_way_outer", "date:d release_i:f release_n:f discharge_cfs:f8",
       """, i AS (SELECT date, release_mm AS release_i FROM basin WHERE source = 'I'), n AS (SELECT date, release_mm AS release_n FROM basin WHERE source = 'N')
       SELECT date, release_i, release_n, discharge_cfs FROM i FULL JOIN n USING (date) FULL JOIN gauge USING (date)""", "basin gauge")
def _(t: Tables):
    return relate.join_three(t.basin_of("I").select("date", F.col("release_mm").alias("release_i")),
                             t.basin_of("N").select("date", F.col("release_mm").alias("release_n")),
                             t.gauge.select("date", "discharge_cfs"))


@query("d5_one_to_one", "date:d water_year:i swe_mm:f discharge_cfs:f8",
       """SELECT b.date, b.water_year, swe_mm, discharge_cfs FROM basin b JOIN gauge g ON b.date = g.date AND b.water_year = g.water_year
       WHERE source = 'I'""", "basin gauge")
def _(t: Tables):
    return relate.one_to_one(t.basin_of("I"), t.gauge.select("date", "water_year", "discharge_cfs"), ["date", "water_year"])


@query("d6_key_difference", "date:d side:s",
       """, a AS (SELECT date FROM basin WHERE source = 'I'), b AS (SELECT date FROM gauge)
       SELECT date, 'left_only' AS side FROM a WHERE date NOT IN (SELECT date FROM b)
       UNION ALL SELECT date, 'right_only' FROM b WHERE date NOT IN (SELECT date FROM a)""", "basin gauge")
def _(t: Tables):
    return relate.key_difference(t.basin_of("I"), t.gauge, ["date"])


@query("d7_missing_dates", "station_id:i date:d",
       """, k AS (SELECT DISTINCT station_id FROM station), d AS (SELECT DISTINCT date FROM basin)
       SELECT k.station_id, d.date FROM k, d WHERE NOT EXISTS (SELECT 1 FROM station s WHERE s.source = 'S'
         AND s.station_id = k.station_id AND s.date = d.date)""", "basin station")
def _(t: Tables):
    have = t.station.where("source = 'S'").select("station_id", "date")
    first, last = t.basin.agg(F.min("date"), F.max("date")).first()  # two dates; the calendar bounds what each station expands to
    days = F.sequence(F.lit(first), F.lit(last)) if first else F.array().cast("array<date>")
    every = (t.station.select("station_id").distinct().withColumn("date", F.explode(days))
             .join(t.basin.select("date").distinct(), "date", "left_semi"))
    return relate.missing_keys(every, have, ["station_id", "date"])


@query("d8_nearest_cells", "station_id:i neighbour:i row:i col:i distance_m:f",
       """, c AS (SELECT "row", col, (col + 0.5) * 10 AS cx, ("row" + 0.5) * 10 AS cy FROM fine WHERE c_acctbal >= 0),
       d AS (SELECT station_id, "row", col, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS distance_m FROM points, c),
       r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY round(distance_m, 9), "row", col) AS neighbour FROM d)
       SELECT * FROM r WHERE neighbour <= 4""", "fine points")
def _(t: Tables):
    return spatial.nearest_cells(t.points, t.fine.where("c_acctbal >= 0"), FINE, k=4)


@query("d9_centers_in_cells", "coarse_row:i coarse_col:i row:i col:i",
       """, c AS (SELECT "row", col, (col + 0.5) * 10 AS x, ("row" + 0.5) * 10 AS y FROM fine),
       g AS (SELECT r AS coarse_row, k AS coarse_col, -5 + k * 30.0 AS xa, -5 + (k + 1) * 30.0 AS xb, -5 + r * 30.0 AS ya, -5 + (r + 1) * 30.0 AS yb
         FROM (SELECT unnest(range(0, CAST((SELECT max("row") FROM fine) AS BIGINT) + 2)) AS r), range(0, 12) b(k))
       SELECT coarse_row, coarse_col, "row", col FROM g JOIN c ON x BETWEEN xa AND xb AND y BETWEEN ya AND yb""", "fine")
def _(t: Tables):
    coarse = spatial.Grid("shifted", -5.0, -5.0, 30.0, 30.0, 12, None)
    return spatial.centers_in_cells(spatial.with_centers(t.fine, FINE), coarse)


_BOX = """, b AS (SELECT name, floor(min(xa) / 10) AS c0, floor(max(xa) / 10) AS c1, floor(min(ya) / 10) AS r0, floor(max(ya) / 10) AS r1 FROM edges GROUP BY 1),
   cols AS (SELECT name, unnest(range(CAST(greatest(c0, 0) AS BIGINT), CAST(least(c1, 29) AS BIGINT) + 1)) AS col, r0, r1 FROM b),
   box AS (SELECT name, col, unnest(range(CAST(greatest(r0, 0) AS BIGINT), CAST(r1 AS BIGINT) + 1)) AS "row" FROM cols)"""


@query("d10_polygon_weights", "name:s row:i col:i weight:f",
       # area below each edge inside the cell, from the antiderivative of the clamped line
       _BOX + """, s AS (SELECT x.name, x."row", x.col, sign(e.xb - e.xa) AS dir, greatest(least(e.xa, e.xb) / 10, x.col) AS ua,
            least(greatest(e.xa, e.xb) / 10, x.col + 1) AS ub, (e.yb - e.ya) / (e.xb - e.xa) AS m, e.xa / 10 AS u0, e.ya / 10 AS v0
          FROM box x JOIN edges e ON x.name = e.name WHERE e.xa <> e.xb),
        v AS (SELECT *, v0 + m * (ua - u0) - "row" AS a, v0 + m * (ub - u0) - "row" AS b FROM s WHERE ub > ua),
        g AS (SELECT *, CASE WHEN a <= 0 THEN 0 WHEN a >= 1 THEN a - 0.5 ELSE a * a / 2 END AS ga,
            CASE WHEN b <= 0 THEN 0 WHEN b >= 1 THEN b - 0.5 ELSE b * b / 2 END AS gb FROM v),
        w AS (SELECT name, "row", col, abs(sum(dir * (ub - ua) * CASE WHEN abs(b - a) < 1e-9 THEN least(greatest((a + b) / 2, 0), 1)
            ELSE (gb - ga) / (b - a) END)) AS weight FROM g GROUP BY 1, 2, 3)
        SELECT name, "row", col, least(weight, 1) AS weight FROM w WHERE weight > 1e-12""", "edges")
def _(t: Tables):
    return spatial.polygon_weights(t.polygons, FINE)


@query("d11_center_mask", "name:s row:i col:i",
       _BOX + """ SELECT x.name, x."row", x.col FROM box x JOIN edges e ON x.name = e.name
        WHERE (e.ya / 10 > x."row" + 0.5) <> (e.yb / 10 > x."row" + 0.5)
          AND e.xa / 10 + (x."row" + 0.5 - e.ya / 10) / (e.yb / 10 - e.ya / 10) * (e.xb / 10 - e.xa / 10) > x.col + 0.5
        GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1""", "edges")
def _(t: Tables):
    return spatial.center_mask(t.polygons, FINE)


@query("d10_weights_of_cells", "name:s row:i col:i weight:f",
       _BOX + """, s AS (SELECT x.name, x."row", x.col, sign(e.xb - e.xa) AS dir, greatest(least(e.xa, e.xb) / 10, x.col) AS ua,
            least(greatest(e.xa, e.xb) / 10, x.col + 1) AS ub, (e.yb - e.ya) / (e.xb - e.xa) AS m, e.xa / 10 AS u0, e.ya / 10 AS v0
          FROM box x JOIN edges e ON x.name = e.name JOIN (SELECT DISTINCT "row", col FROM fine WHERE c_acctbal >= 0) f ON f."row" = x."row" AND f.col = x.col
          WHERE e.xa <> e.xb),
        v AS (SELECT *, v0 + m * (ua - u0) - "row" AS a, v0 + m * (ub - u0) - "row" AS b FROM s WHERE ub > ua),
        g AS (SELECT *, CASE WHEN a <= 0 THEN 0 WHEN a >= 1 THEN a - 0.5 ELSE a * a / 2 END AS ga,
            CASE WHEN b <= 0 THEN 0 WHEN b >= 1 THEN b - 0.5 ELSE b * b / 2 END AS gb FROM v),
        w AS (SELECT name, "row", col, abs(sum(dir * (ub - ua) * CASE WHEN abs(b - a) < 1e-9 THEN least(greatest((a + b) / 2, 0), 1)
            ELSE (gb - ga) / (b - a) END)) AS weight FROM g GROUP BY 1, 2, 3)
        SELECT name, "row", col, least(weight, 1) AS weight FROM w WHERE weight > 1e-12""", "fine edges")
def _(t: Tables):
    return spatial.polygon_weights(t.polygons, FINE, cells=t.fine.where("c_acctbal >= 0"))


@query("d11_mask_of_cells", "name:s row:i col:i",
       _BOX + """ SELECT x.name, x."row", x.col FROM box x JOIN edges e ON x.name = e.name
        WHERE (e.ya / 10 > x."row" + 0.5) <> (e.yb / 10 > x."row" + 0.5)
          AND e.xa / 10 + (x."row" + 0.5 - e.ya / 10) / (e.yb / 10 - e.ya / 10) * (e.xb / 10 - e.xa / 10) > x.col + 0.5
          AND EXISTS (SELECT 1 FROM fine f WHERE f."row" = x."row" AND f.col = x.col AND f.c_acctbal >= 0)
        GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1""", "fine edges")
def _(t: Tables):
    return spatial.center_mask(t.polygons, FINE, cells=t.fine.where("c_acctbal >= 0"))


@query("d12_regrid", "obs_date:d variable:s row:i col:i value:f value_coverage:f",
       """, g AS (SELECT r AS "row", k AS col, -7 + k * 24.0 AS xa, -7 + (k + 1) * 24.0 AS xb, -3 + r * 36.0 AS ya, -3 + (r + 1) * 36.0 AS yb
         FROM (SELECT unnest(range(0, CAST((SELECT max("row") FROM fine) AS BIGINT) + 2)) AS r), range(0, 13) b(k)),
       o AS (SELECT obs_date, variable, g."row", g.col, value, (least(xb, (f.col + 1) * 10.0) - greatest(xa, f.col * 10.0))
           * (least(yb, (f."row" + 1) * 10.0) - greatest(ya, f."row" * 10.0)) AS area
         FROM obs_fields f JOIN g ON f.col * 10.0 < xb AND (f.col + 1) * 10.0 > xa AND f."row" * 10.0 < yb AND (f."row" + 1) * 10.0 > ya),
       a AS (SELECT obs_date, variable, "row", col, sum(value * area) / sum(area) FILTER (value IS NOT NULL) AS v,
         coalesce(sum(area) FILTER (value IS NOT NULL), 0) / (24.0 * 36.0) AS coverage FROM o GROUP BY 1, 2, 3, 4)
       SELECT obs_date, variable, "row", col, CASE WHEN coverage >= 0.6 THEN v END AS value, coverage AS value_coverage FROM a""", "obs_fields")
def _(t: Tables):
    return spatial.regrid_area_average(t.obs_fields, FINE, UNEVEN, ["obs_date", "variable"], ["value"], 0.6)


@query("d13_calendar_day_join", "date:d swe_mm:f hist_mean:f hist_n:i",
       """, h AS (SELECT strftime(date, '%m-%d') AS md, avg(swe_mm) AS hist_mean, count(swe_mm) AS hist_n FROM basin
         WHERE source = 'I' AND water_year < 2000 GROUP BY 1)
       SELECT date, swe_mm, hist_mean, hist_n FROM basin b LEFT JOIN h ON h.md = strftime(b.date, '%m-%d')
       WHERE source = 'I' AND water_year = 2000""", "basin")
def _(t: Tables):
    b = t.basin_of("I").withColumn("month_day", cal.month_day("date"))
    h = b.where("water_year < 2000").groupBy("month_day").agg(F.avg("swe_mm").alias("hist_mean"), F.count("swe_mm").alias("hist_n"))
    return b.where("water_year = 2000").join(h, "month_day", "left")


_TWO_YEARS = """, d AS (SELECT source, water_year, date - make_date(water_year - 1, 10, 1) AS season_day, swe_mm FROM basin),
   a AS (SELECT x.source, x.season_day, x.swe_mm AS swe_mm_first, y.swe_mm AS swe_mm_second, y.swe_mm - x.swe_mm AS delta_swe_mm
     FROM d x JOIN d y ON x.source = y.source AND x.season_day = y.season_day WHERE x.water_year = 1997 AND y.water_year = 2000)"""


@query("d14_year_pair", "source:s season_day:i swe_mm_first:f swe_mm_second:f delta_swe_mm:f", _TWO_YEARS + " SELECT * FROM a", "basin")
def _(t: Tables):
    b = t.basin.withColumn("season_day", cal.season_day("date", "water_year"))
    return relate.same_day_years(b, ["source"], ["swe_mm"], 1997, 2000)


@query("d14_double_difference", "season_day:i double_difference_delta_swe_mm:f",
       _TWO_YEARS + """ SELECT n.season_day, n.delta_swe_mm - i.delta_swe_mm AS double_difference_delta_swe_mm
       FROM a n JOIN a i USING (season_day) WHERE n.source = 'N' AND i.source = 'I'""", "basin")
def _(t: Tables):
    b = t.basin.withColumn("season_day", cal.season_day("date", "water_year"))
    return relate.difference_of_sources(relate.same_day_years(b, ["source"], ["swe_mm"], 1997, 2000), ["season_day"], ["delta_swe_mm"])


@query("d15_attach_where", "source:s water_year:i n:i mean_density:f",
       """, p AS (SELECT source, water_year, count(*) AS n FROM basin GROUP BY 1, 2),
       q AS (SELECT water_year, avg(1000 * swe_mm / snow_depth_mm) AS mean_density FROM basin GROUP BY 1)
       SELECT source, p.water_year, n, CASE WHEN source = 'N' THEN mean_density END AS mean_density FROM p LEFT JOIN q USING (water_year)""", "basin")
def _(t: Tables):
    p = t.basin.groupBy("source", "water_year").agg(F.count(F.lit(1)).alias("n"))
    q = t.basin.groupBy("water_year").agg(F.avg(F.try_divide(1000 * F.col("swe_mm"), F.col("snow_depth_mm"))).alias("mean_density"))
    return relate.attach_where(p, q, ["water_year"], F.col("source") == "N")


@query("d16_weights_join", "source:s date:d weighted:f",
       """SELECT source, date, sum(swe_mm * weight) AS weighted FROM cells c JOIN weights w ON c."row" = w."row" AND c.col = w.col
       WHERE weight > 0 GROUP BY 1, 2""", "cells weights")
def _(t: Tables):
    from ..operators.areal import on_support
    return on_support(t.cells, t.weights).groupBy("source", "date").agg(F.sum(F.col("swe_mm") * F.col("weight")).alias("weighted"))


@query("d17_grid_alignment", "common_cells:i first_only:i second_only:i max_dx:f max_dy:f",
       """, a AS (SELECT "row", col, (col + 0.5) * 10 AS x, ("row" + 0.5) * 10 AS y FROM fine),
       b AS (SELECT "row", col, (col + 0.5) * 10 + p_size * 0.001 AS x, ("row" + 0.5) * 10 AS y FROM middle)
       SELECT count(*) FILTER (a.x IS NOT NULL AND b.x IS NOT NULL) AS common_cells, count(*) FILTER (b.x IS NULL) AS first_only,
       count(*) FILTER (a.x IS NULL) AS second_only, max(abs(a.x - b.x)) AS max_dx, max(abs(a.y - b.y)) AS max_dy
       FROM a FULL JOIN b USING ("row", col)""", "fine middle")
def _(t: Tables):
    stored = spatial.with_centers(t.middle, FINE).withColumn("x", F.col("x") + F.col("p_size") * 0.001)
    return spatial.grid_alignment(spatial.with_centers(t.fine, FINE), stored)


@query("d18_calendar_scaffold", "water_year:i date:d discharge_cfs:f8",
       """, y AS (SELECT DISTINCT water_year AS w FROM gauge),
       s AS (SELECT w AS water_year, CAST(unnest(range(CAST(make_date(w - 1, 10, 1) AS TIMESTAMP), CAST(make_date(w, 7, 1) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM y)
       SELECT s.water_year, s.date, discharge_cfs FROM s LEFT JOIN gauge g ON g.date = s.date""", "gauge")
def _(t: Tables):
    days = timeaxis.day_scaffold(t.gauge)
    return days.join(t.gauge.select("date", "discharge_cfs"), "date", "left")


@query("d19_footprints", "row:i col:i x_min:f x_max:f y_min:f y_max:f",
       """SELECT "row", col, col * 20.0 AS x_min, (col + 1) * 20.0 AS x_max, 4000 - ("row" + 1) * 20.0 AS y_min, 4000 - "row" * 20.0 AS y_max FROM middle""", "middle")
def _(t: Tables):
    return spatial.footprints(t.middle, spatial.Grid("north_up", 0.0, 4000.0, 20.0, -20.0, 15, None))


@query("d19_grid_extent", "grid:s left:f bottom:f right:f top:f cell_count:i area_m2:f",
       """SELECT 'fine' AS "grid", min(col) * 10.0 AS "left", min("row") * 10.0 AS bottom, (max(col) + 1) * 10.0 AS "right", (max("row") + 1) * 10.0 AS top,
       count(*) AS cell_count, count(*) * 100.0 AS area_m2 FROM fine
       UNION ALL SELECT 'common', min(col) * 50.0, min("row") * 50.0, (max(col) + 1) * 50.0, (max("row") + 1) * 50.0, count(*), count(*) * 2500.0 FROM common""",
       "fine common")
def _(t: Tables):
    cols = ["grid", "row", "col"]
    boxes = spatial.footprints(t.fine.withColumn("grid", F.lit("fine")).select(cols), FINE).unionByName(
        spatial.footprints(t.common.withColumn("grid", F.lit("common")).select(cols), COMMON))
    return spatial.grid_extent(boxes, ["grid"])


# -- reshaping and set operations ----------------------------------------------------------

@query("g1_stack_sources", "date:d water_year:i source:s discharge_cfs:f8 swe_mm:f",
       """SELECT date, water_year, source, NULL AS discharge_cfs, swe_mm FROM basin
       UNION ALL SELECT date, water_year, 'gauge', discharge_cfs, NULL FROM gauge""", "basin gauge")
def _(t: Tables):
    return relate.stack_sources([t.basin.select("source", "date", "water_year", "swe_mm"),
                                 t.gauge.select("date", "water_year", F.lit("gauge").alias("source"), "discharge_cfs")])


@query("g2_date_sets", "kind:s station_id:i date:d",
       """, i AS (SELECT station_id, date FROM station WHERE source = 'I'), n AS (SELECT station_id, date FROM station WHERE source = 'N')
       SELECT 'common' AS kind, i.* FROM i JOIN n ON i.station_id = n.station_id AND i.date = n.date
       UNION ALL SELECT 'only_i', i.* FROM i WHERE NOT EXISTS (SELECT 1 FROM n WHERE i.station_id = n.station_id AND i.date = n.date)""", "station")
def _(t: Tables):
    i, n = [t.station.where(F.col("source") == s).select("station_id", "date") for s in ("I", "N")]
    return i.intersect(n).select(F.lit("common").alias("kind"), "station_id", "date").unionByName(
        i.exceptAll(n).select(F.lit("only_i").alias("kind"), "station_id", "date"))


@query("g3_last_wins", "date:d o_orderkey:i o_totalprice:f",
       """SELECT CAST(o_orderdate AS DATE) AS date, max(o_orderkey) AS o_orderkey, max_by(o_totalprice, o_orderkey) AS o_totalprice
       FROM orders GROUP BY 1""")
def _(t: Tables):
    o = t.read("orders").select(F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_totalprice")
    return relate.last_by(o, ["date"], ["o_orderkey"])


@query("g4_duplicates", "date:d copies:i",
       "SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS copies FROM orders GROUP BY 1 HAVING count(*) > 1")
def _(t: Tables):
    return relate.duplicates(t.read("orders").select(F.to_date("o_orderdate").alias("date")), ["date"])


@query("g5_unpivot", "source:s date:d variable:s value:f",
       """SELECT source, date, 'swe_mm' AS variable, swe_mm AS value FROM basin UNION ALL SELECT source, date, 'melt_mm', melt_mm FROM basin
       UNION ALL SELECT source, date, 'cover', cover FROM basin""", "basin")
def _(t: Tables):
    return t.basin.unpivot(["source", "date"], ["swe_mm", "melt_mm", "cover"], "variable", "value")


@query("g6_pivot_years", "source:s month_day:s y1997:f y1998:f y1999:f",
       """SELECT source, strftime(date, '%m-%d') AS month_day, max(swe_mm) FILTER (water_year = 1997) AS y1997,
       max(swe_mm) FILTER (water_year = 1998) AS y1998, max(swe_mm) FILTER (water_year = 1999) AS y1999 FROM basin
       WHERE water_year IN (1997, 1998, 1999) GROUP BY 1, 2""", "basin")
def _(t: Tables):
    b = t.basin.where(F.col("water_year").isin(1997, 1998, 1999))
    wide = b.groupBy("source", cal.month_day("date").alias("month_day")).pivot("water_year", [1997, 1998, 1999]).agg(F.max("swe_mm"))
    return wide.withColumnsRenamed({"1997": "y1997", "1998": "y1998", "1999": "y1999"})


@query("g7_distinct_keys", "water_year:i date:d", "SELECT DISTINCT water_year, date FROM items", "items")
def _(t: Tables):
    return t.read("lineitem").select(F.to_date("l_shipdate").alias("date")).distinct().select(
        cal.water_year("date").alias("water_year"), "date").orderBy("water_year", "date")


@query("g8_sorted_daily", "source:s water_year:i date:d swe_mm:f", "SELECT source, water_year, date, swe_mm FROM basin ORDER BY 1, 2, 3", "basin")
def _(t: Tables):
    return t.basin.orderBy("source", "water_year", "date")


