"""Window functions over daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import quality, scale, series
from .aggregates import FLAGGED
from .bindings import Tables
from .registry import query

SW = ["source", "water_year"]
_OVER = "WINDOW w AS (PARTITION BY source, water_year ORDER BY date)"
_CELL = ["source", "water_year", "row", "col"]


@query("f1_row_difference", "source:s date:d change:f",
       f"SELECT source, date, swe_mm - lag(swe_mm) OVER w AS change FROM basin {_OVER}", "basin")
def _(t: Tables):
    return t.basin.withColumn("change", series.row_difference("swe_mm", SW))


_LAG = """, l AS (SELECT *, CASE WHEN date - lag(date) OVER w = 1 THEN lag(swe_mm) OVER w END AS before, CASE WHEN date - lag(date) OVER w = 1 THEN lag(cover) OVER w END AS cover_start
   FROM cells WINDOW w AS (PARTITION BY source, water_year, "row", col ORDER BY date))"""


@query("f2_signed_loss", "source:s row:i col:i date:d loss:f", _LAG + ' SELECT source, "row", col, date, before - swe_mm AS loss FROM l', "cells")
def _(t: Tables):
    return t.cells.withColumn("loss", series.signed_loss("swe_mm", _CELL))


@query("f3_start_state", "source:s row:i col:i date:d cover_start:f", _LAG + ' SELECT source, "row", col, date, cover_start FROM l', "cells")
def _(t: Tables):
    return t.cells.withColumn("cover_start", series.start_state("cover", _CELL))


_MASKED = "CASE WHEN cover <= 0.55 THEN melt_mm END"


@query("f4_running_sums", "source:s date:d skip:f zero:f",
       f""", m AS (SELECT source, water_year, date, {_MASKED} AS v FROM basin)
       SELECT source, date, CASE WHEN v IS NOT NULL THEN sum(v) OVER w END AS "skip", coalesce(sum(v) OVER w, 0) AS zero FROM m {_OVER}""", "basin")
def _(t: Tables):
    m = t.basin.withColumn("v", F.when(F.col("cover") <= 0.55, F.col("melt_mm")))
    return m.select("source", "date", series.running_sum("v", SW).alias("skip"), series.running_sum("v", SW, missing="zero").alias("zero"))


@query("f5_centered_mean", "source:s date:d mean1:f8 mean4:f8",
       f""", m AS (SELECT source, water_year, date, {_MASKED} AS v FROM basin)
       SELECT source, date, avg(v) OVER r AS mean1, CASE WHEN count(v) OVER r >= 4 THEN avg(v) OVER r END AS mean4 FROM m
       WINDOW r AS (PARTITION BY source, water_year ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""", "basin")
def _(t: Tables):
    m = t.basin.withColumn("v", F.when(F.col("cover") <= 0.55, F.col("melt_mm")))
    return m.select("source", "date", series.centered_mean("v", SW).alias("mean1"), series.centered_mean("v", SW, min_periods=4).alias("mean4"))


@query("f5_long_axis_mean", "date:d rolling:f",
       """SELECT date, avg(swe_mm) OVER (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS rolling FROM basin WHERE source = 'I'""", "basin")
def _(t: Tables):
    return scale.centered_row_means(t.basin_of("I"), "date", F.trunc("date", "month"), {"rolling": "swe_mm"}, block=64)


@query("f6_max_trailing_sum", "source:s water_year:i max7:f",
       """, m AS (SELECT source, water_year, date, CASE WHEN swe_mm >= 80 THEN swe_mm END AS v FROM basin),
       s AS (SELECT source, water_year, CASE WHEN count(v) OVER r = 7 THEN sum(v) OVER r END AS s FROM m WINDOW r AS (PARTITION BY source, water_year ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
       SELECT source, water_year, max(s) AS max7 FROM s GROUP BY 1, 2""", "basin")
def _(t: Tables):
    m = t.basin.withColumn("v", F.when(F.col("swe_mm") >= 80, F.col("swe_mm")))
    return m.withColumn("s", series.trailing_full_sum("v", SW)).groupBy(*SW).agg(F.max("s").alias("max7"))


def depletion_sql(table: str, keys: str, value: str, threshold: float, run: int, out: str = "dep") -> str:
    """Peak, days to fractions and run-based disappearance, by joins on consecutive days."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ks = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f""", {out}_s AS (SELECT {keys}, date, {value} AS v FROM {table} WHERE {value} IS NOT NULL),
      {out}_p AS (SELECT {keys}, max(v) AS peak, min(date) AS pd FROM (SELECT *, max(v) OVER (PARTITION BY {keys}) AS m FROM {out}_s) WHERE v = m GROUP BY {keys}),
      {out}_j AS (SELECT {ks}, a.date, a.v, b.peak, b.pd FROM {out}_s a JOIN {out}_p b ON {on}),
      {out}_low AS (SELECT * FROM {out}_j WHERE date > pd AND v < {threshold}),
      {out}_r AS (SELECT {ks}, a.date FROM {out}_low a JOIN {out}_low b ON {on} AND b.date BETWEEN a.date AND a.date + {run - 1} GROUP BY {ks}, a.date HAVING count(*) = {run}),
      {out}_h AS (SELECT {keys}, max(peak) AS peak_value, max(pd) AS peak_date, min(date) FILTER (peak > 0 AND date >= pd AND v / peak <= 0.75) AS h75,
        min(date) FILTER (peak > 0 AND date >= pd AND v / peak <= 0.5) AS h50, min(date) FILTER (peak > 0 AND date >= pd AND v / peak <= 0.25) AS h25 FROM {out}_j GROUP BY {keys}),
      {out}_d AS (SELECT {keys}, min(date) AS disappearance_date FROM {out}_r GROUP BY {keys}),
      {out} AS (SELECT {ks}, peak_value, peak_date, peak_date - make_date(year(peak_date) - CASE WHEN month(peak_date) >= 10 THEN 0 ELSE 1 END, 10, 1) + 1 AS peak_dowy,
        h75 - peak_date AS days_to_75, h50 - peak_date AS days_to_50, h25 - peak_date AS days_to_25, disappearance_date,
        disappearance_date - make_date(year(peak_date) - CASE WHEN month(peak_date) >= 10 THEN 0 ELSE 1 END, 10, 1) + 1 AS disappearance_dowy
        FROM {out}_h a LEFT JOIN {out}_d b ON {on})"""


@query("f7_disappearance", "source:s station_id:i water_year:i disappearance_date:d disappearance_dowy:i",
       depletion_sql("station", "source, station_id, water_year", "swe_mm", 40, 3) + " SELECT * FROM dep", "station")
def _(t: Tables):
    return series.depletion(t.station, ["source", "station_id", "water_year"], "swe_mm", threshold=40.0, run_days=3)


@query("f8_peak_fractions", "source:s station_id:i water_year:i peak_value:f peak_date:d peak_dowy:i days_to_75:i days_to_50:i days_to_25:i",
       depletion_sql("station", "source, station_id, water_year", "swe_mm", 40, 3) + " SELECT * FROM dep", "station")
def _(t: Tables):
    return series.depletion(t.station, ["source", "station_id", "water_year"], "swe_mm", threshold=40.0, run_days=3)


@query("f9_first_crossings", "source:s water_year:i first_post_peak:d first_below:d",
       """, m AS (SELECT *, max(swe_mm) OVER (PARTITION BY source, water_year) AS top FROM basin), p AS (SELECT source, water_year, min(date) AS pd FROM m WHERE swe_mm = top GROUP BY 1, 2)
       SELECT b.source, b.water_year, min(date) FILTER (date >= pd AND cover <= 0.3) AS first_post_peak, min(date) FILTER (cover < 0.35 AND month(date) IN (2, 3, 4)) AS first_below
       FROM basin b JOIN p ON b.source = p.source AND b.water_year = p.water_year GROUP BY 1, 2""", "basin")
def _(t: Tables):
    rows = series.with_peak(t.basin, SW, "swe_mm")
    return rows.groupBy(*SW).agg(
        series.first_date_where((F.col("date") >= F.col("peak_date")) & (F.col("cover") <= 0.3)).alias("first_post_peak"),
        series.first_date_where((F.col("cover") < 0.35) & cal.in_season("date", "water_year", "02-01", "04-30")).alias("first_below"))


@query("f10_half_date", "source:s water_year:i half_date:d",
       f""", v AS (SELECT source, water_year, date, melt_mm - 5 AS m FROM basin WHERE melt_mm - 5 >= 0),
       c AS (SELECT *, sum(m) OVER w AS c FROM v {_OVER}), t AS (SELECT source, water_year, max(c) AS tot FROM c GROUP BY 1, 2),
       h AS (SELECT c.source, c.water_year, min(date) AS half_date FROM c JOIN t ON c.source = t.source AND c.water_year = t.water_year AND tot > 0 AND c.c >= 0.5 * tot GROUP BY 1, 2)
       SELECT b.source, b.water_year, max(half_date) AS half_date FROM basin b LEFT JOIN h ON b.source = h.source AND b.water_year = h.water_year GROUP BY 1, 2""", "basin")
def _(t: Tables):
    return series.half_dates(t.basin.withColumn("m", F.col("melt_mm") - 5), SW, {"half_date": "m"})


@query("f11_share_of_maximum", "source:s date:d share:f",
       "SELECT source, date, swe_mm / max(swe_mm) OVER (PARTITION BY source, water_year) AS share FROM basin", "basin")
def _(t: Tables):
    return t.basin.withColumn("share", series.share_of_maximum("swe_mm", SW))


PEAKS = """, pk AS (SELECT source, water_year, max(swe_mm) AS peak, min(date) AS pd FROM (SELECT *, max(swe_mm) OVER (PARTITION BY source, water_year) AS m FROM basin) WHERE swe_mm = m GROUP BY 1, 2)"""


@query("f12_normalized_curve", "source:s water_year:i date:d days_since_peak:i fraction_of_peak:f",
       PEAKS + """ SELECT b.source, b.water_year, date, date - pd AS days_since_peak, swe_mm / peak AS fraction_of_peak FROM basin b JOIN pk
       ON b.source = pk.source AND b.water_year = pk.water_year WHERE peak > 0 AND date >= pd""", "basin")
def _(t: Tables):
    return series.normalized_curve(t.basin, SW, "swe_mm")


@query("f13_cumulative_fraction", "source:s water_year:i date:d days_since_start:i cumulative_fraction:f",
       """, s AS (SELECT *, CASE WHEN cover <= 0.55 THEN greatest(release_mm - 2, 0) ELSE 0 END AS v FROM basin WHERE date >= make_date(water_year, 3, 1))
       SELECT source, water_year, date, date - make_date(water_year, 3, 1) AS days_since_start, sum(v) OVER w / nullif(sum(v) OVER (PARTITION BY source, water_year), 0) AS cumulative_fraction
       FROM s WINDOW w AS (PARTITION BY source, water_year ORDER BY date)""", "basin")
def _(t: Tables):
    v = F.when(F.col("cover") <= 0.55, F.col("release_mm") - 2)
    return series.cumulative_fraction_curve(t.basin.withColumn("v", v), SW, "v")


@query("f14_post_peak_chain", "source:s water_year:i date:d days_after_peak:i swe_fraction:f effective_albedo:f absorbed_sw_energy_mj_m2:f8 melt_mm:f",
       PEAKS + """ SELECT b.source, b.water_year, date, date - pd AS days_after_peak, swe_mm / peak AS swe_fraction, effective_albedo, absorbed_sw_energy_mj_m2, melt_mm
       FROM basin b JOIN pk ON b.source = pk.source AND b.water_year = pk.water_year WHERE date >= pd""", "basin")
def _(t: Tables):
    return series.post_peak_chain(t.basin, SW, "swe_mm", ["effective_albedo", "absorbed_sw_energy_mj_m2", "melt_mm"])


@query("f15_top_values", "obs_date:d variable:s rank:i row:i col:i raw_mm:f inside:b adjusted:b reason:s",
       FLAGGED + """, r AS (SELECT *, row_number() OVER (PARTITION BY obs_date, variable ORDER BY raw_mm DESC, "row" DESC, col DESC) AS rank FROM flagged WHERE raw_mm IS NOT NULL)
       SELECT obs_date, variable, rank, "row", col, raw_mm, inside, adjusted, CASE WHEN clipped_to_zero THEN 'small_negative' WHEN masked_negative THEN 'negative_below_tolerance'
         WHEN masked_above THEN 'above_hard_maximum' ELSE '' END AS reason FROM r WHERE rank <= 20""", "raw_obs")
def _(t: Tables):
    return quality.top_values(quality.apply_limits(t.raw_obs, tolerance=60.0), ["obs_date", "variable"], 20)


@query("f16_flagged_log", "obs_date:d variable:s position:i reason:s action:s row:i col:i raw_mm:f cleaned_mm:f inside:b adjusted_total:i truncated:b",
       FLAGGED + """, p AS (SELECT *, CASE WHEN clipped_to_zero THEN 0 WHEN masked_negative THEN 1 ELSE 2 END AS pr FROM flagged WHERE adjusted),
       r AS (SELECT *, row_number() OVER (PARTITION BY obs_date, variable ORDER BY pr, "row", col) AS position, count(*) OVER (PARTITION BY obs_date, variable) AS adjusted_total FROM p)
       SELECT obs_date, variable, position, CASE pr WHEN 0 THEN 'small_negative' WHEN 1 THEN 'negative_below_tolerance' ELSE 'above_hard_maximum' END AS reason,
       CASE pr WHEN 0 THEN 'set_to_zero' ELSE 'set_to_nodata' END AS action, "row", col, raw_mm, cleaned_mm, inside, adjusted_total, false AS truncated FROM r""", "raw_obs")
def _(t: Tables):
    return quality.flagged_log(quality.apply_limits(t.raw_obs, tolerance=60.0), ["obs_date", "variable"])


@query("f17_rank_highest", "source:s water_year:i total:f rank:i",
       """, s AS (SELECT source, water_year, sum(swe_mm) AS total FROM basin GROUP BY 1, 2)
       SELECT *, row_number() OVER (PARTITION BY source ORDER BY total DESC, water_year) AS rank FROM s""", "basin")
def _(t: Tables):
    from pyspark.sql.window import Window
    s = t.basin.groupBy(*SW).agg(F.sum("swe_mm").alias("total"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.col("total").desc(), "water_year")))


DIAGNOSTICS = """, d0 AS (SELECT *, lag(swe_mm) OVER w AS previous_swe_mm, swe_mm - lag(swe_mm) OVER w AS dswe_mm_day FROM {table} WINDOW w AS (PARTITION BY source, water_year ORDER BY date)),
   d1 AS (SELECT *, CASE WHEN dswe_mm_day IS NOT NULL THEN greatest(dswe_mm_day, 0) END AS swe_gain_mm_day, CASE WHEN dswe_mm_day IS NOT NULL THEN greatest(-dswe_mm_day, 0) END AS swe_loss_mm_day,
     coalesce(dswe_mm_day > 1, false) AS is_accumulation_event, coalesce(dswe_mm_day < -1, false) AS is_ablation_event FROM d0),
   d2 AS (SELECT *, CASE WHEN is_ablation_event AND previous_swe_mm >= 10 THEN swe_loss_mm_day / previous_swe_mm END AS fractional_swe_loss,
     sum(precip_mm) OVER w AS cumulative_precip_mm, sum(snowfall_mm) OVER w AS cumulative_snowfall_mm, sum(melt_mm) OVER w AS cumulative_melt_mm,
     coalesce(sum(swe_gain_mm_day) OVER w, 0) AS cumulative_swe_gain_mm_day, coalesce(sum(swe_loss_mm_day) OVER w, 0) AS cumulative_swe_loss_mm_day,
     swe_mm - first_value(swe_mm) OVER w AS since_start, max(swe_mm) OVER (PARTITION BY source, water_year) AS peak,
     avg(dswe_mm_day) OVER (PARTITION BY source, water_year ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS dswe_7day_mean_mm_day FROM d1 WINDOW w AS (PARTITION BY source, water_year ORDER BY date)),
   diag AS (SELECT *, cumulative_snowfall_mm / nullif(cumulative_precip_mm, 0) AS cumulative_snowfall_fraction, CASE WHEN cumulative_snowfall_mm > 1 THEN since_start / cumulative_snowfall_mm END AS retention_fraction,
     swe_mm / peak AS swe_normalized_by_own_peak FROM d2)"""


@query("f18_season_diagnostics", "source:s date:d dswe_mm_day:f swe_gain_mm_day:f swe_loss_mm_day:f is_accumulation_event:b is_ablation_event:b fractional_swe_loss:f cumulative_precip_mm:f "
       "cumulative_swe_gain_mm_day:f cumulative_swe_loss_mm_day:f cumulative_snowfall_fraction:f retention_fraction:f swe_normalized_by_own_peak:f dswe_7day_mean_mm_day:f",
       DIAGNOSTICS.format(table="basin") + " SELECT * FROM diag", "basin")
def _(t: Tables):
    return series.season_diagnostics(t.basin, SW)


@query("f19_difference_change", "water_year:i date:d change:f",
       """, d AS (SELECT i.water_year, i.date, n.swe_mm - i.swe_mm AS delta FROM basin i JOIN basin n ON i.date = n.date WHERE i.source = 'I' AND n.source = 'N')
       SELECT water_year, date, delta - lag(delta) OVER (PARTITION BY water_year ORDER BY date) AS change FROM d""", "basin")
def _(t: Tables):
    from ..operators.relate import pair
    p = pair(t.basin_of("I"), t.basin_of("N"), ["water_year", "date"], ["swe_mm"])
    p = p.withColumn("delta", F.col("swe_mm_n") - F.col("swe_mm_i"))
    return p.withColumn("change", series.row_difference("delta", ["water_year"]))
