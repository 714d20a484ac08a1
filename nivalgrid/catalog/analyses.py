"""Composite analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import physics
from ..operators import areal, events, quality, relate, rollup, series, spatial
from ..plans import accumulation, climatology, energy, forcing, observations, separation, stations, timing, yearpair
from ..sources import sinks
from .aggregates import (BIN5, BINNED, CLIMATOLOGY, EXTREMES, FLAGGED, FORCING, HIST, SPECIAL, WINDOWS, _LOOKUP, _W,
                         cell_loss_sql, forcing_daily, lookup)
from .bindings import CELLS, COMMON, FINE, MIDDLE, Tables
from .registry import query
from .windows import DIAGNOSTICS, depletion_sql

THRESHOLD, RUN = 120.0, 2
BANDS = {"Lower": (None, 2896.0), "Middle": (2896.0, 3353.0), "Upper": (3353.0, None), "All": (None, None)}

_START, _END = "make_date(water_year - 1, 11, 1)", "make_date(water_year, 3, 15)"
DECOMP = f""", st AS (SELECT source, water_year, max(swe_mm) FILTER (date = {_START}) AS s0, max(swe_mm) FILTER (date = {_END}) AS s1,
     sum(snowfall_mm) AS sf, sum(precip_mm) AS p FROM basin WHERE date BETWEEN {_START} AND {_END} GROUP BY 1, 2),
   i AS (SELECT *, (s1 - s0) / nullif(sf, 0) AS eta FROM st WHERE source = 'I'), n AS (SELECT *, (s1 - s0) / nullif(sf, 0) AS eta FROM st WHERE source = 'N'),
   dj AS (SELECT coalesce(i.water_year, n.water_year) AS water_year, i.s0 AS i0, n.s0 AS n0, i.s1 AS i1, n.s1 AS n1, i.sf AS sfi, n.sf AS sfn, i.p AS pi, n.p AS pn, i.eta AS ei, n.eta AS en
     FROM i FULL JOIN n ON i.water_year = n.water_year),
   dc AS (SELECT *, n1 - i1 AS delta_end, n0 - i0 AS c_initial, coalesce((ei + en) / 2, ei, en) * (sfn - sfi) AS c_snowfall, coalesce((sfi + sfn) / 2, sfi, sfn) * (en - ei) AS c_retention FROM dj),
   decomp AS (SELECT *, coalesce(abs(c_initial), 0) + coalesce(abs(c_snowfall), 0) + coalesce(abs(c_retention), 0) AS tot FROM dc)"""


@query("q1_decomposition", "water_year:i swe_start_I:f swe_start_N:f swe_end_I:f swe_end_N:f snowfall_I:f snowfall_N:f precip_I:f precip_N:f eta_I:f eta_N:f delta_end:f c_initial:f "
       "c_snowfall:f c_retention:f share_initial_pct:f share_snowfall_pct:f share_retention_pct:f closure:f",
       DECOMP + """ SELECT water_year, i0 AS "swe_start_I", n0 AS "swe_start_N", i1 AS "swe_end_I", n1 AS "swe_end_N", sfi AS "snowfall_I", sfn AS "snowfall_N", pi AS "precip_I", pn AS "precip_N",
       ei AS "eta_I", en AS "eta_N", delta_end, c_initial, c_snowfall, c_retention, 100 * abs(c_initial) / nullif(tot, 0) AS share_initial_pct, 100 * abs(c_snowfall) / nullif(tot, 0) AS share_snowfall_pct,
       100 * abs(c_retention) / nullif(tot, 0) AS share_retention_pct, 0 * delta_end * c_snowfall * c_retention AS closure FROM decomp""", "basin")
def _(t: Tables):
    return accumulation.decomposition(t.basin)


_DEP = depletion_sql("basin", "source, water_year", "swe_mm", THRESHOLD, RUN)


@query("q2_depletion", "water_year:i peak_value_I:f peak_value_N:f peak_date_I:d peak_date_N:d peak_dowy_I:i peak_dowy_N:i days_to_75_I:i days_to_75_N:i days_to_50_I:i days_to_50_N:i "
       "days_to_25_I:i days_to_25_N:i disappearance_date_I:d disappearance_date_N:d disappearance_dowy_I:i disappearance_dowy_N:i delta_t50_days:i",
       _DEP + " SELECT coalesce(i.water_year, n.water_year) AS water_year, " + ", ".join(
           f'i.{c} AS "{c}_I", n.{c} AS "{c}_N"' for c in ("peak_value", "peak_date", "peak_dowy", "days_to_75", "days_to_50", "days_to_25", "disappearance_date", "disappearance_dowy"))
       + """, n.days_to_50 - i.days_to_50 AS delta_t50_days FROM (SELECT * FROM dep WHERE source = 'I') i FULL JOIN (SELECT * FROM dep WHERE source = 'N') n ON i.water_year = n.water_year""", "basin")
def _(t: Tables):
    return timing.depletion_by_source(t.basin, THRESHOLD, RUN)


def _agreement_sql(sign: str, lo: str, hi: str) -> str:
    return f""", w AS (SELECT * FROM pairs WHERE date BETWEEN {lo} - 1 AND {hi}),
      d AS (SELECT water_year, {sign} * (swe_mm_i - lag(swe_mm_i) OVER c) AS x, {sign} * (swe_mm_n - lag(swe_mm_n) OVER c) AS y FROM w WINDOW c AS (PARTITION BY water_year, "row", col ORDER BY date)),
      ev AS (SELECT * FROM d WHERE x IS NOT NULL AND y IS NOT NULL AND (x > 1 OR y > 1))"""


_AGREE = """ SELECT water_year, count(*) AS n, CASE WHEN count(*) >= 2 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS pearson_r, avg(y - x) AS mean_bias FROM ev GROUP BY 1"""


@query("q3_cell_accumulation", "water_year:i n:i pearson_r:f mean_bias:f", _agreement_sql("1", _START, _END) + _AGREE, "pairs")
def _(t: Tables):
    return accumulation.cell_agreement(t.pairs, "accumulation", "11-01", "03-15")


@query("q3_bucketed_accumulation", "water_year:i n:i pearson_r:f mean_bias:f", _agreement_sql("1", _START, _END) + _AGREE, "pairs")
def _(t: Tables):
    """Pairs, lags and events from a cube bucketed by cell: the stored buckets are the partitioning."""
    stored = sinks.write_bucketed(t.cells.select("source", "water_year", "row", "col", "date", "swe_mm"), sinks.scratch_table("q3"),
                                  sinks.scratch_path(t.spark, "q3"), ["row", "col"])
    return accumulation.cell_agreement(relate.pair_long(stored, ["water_year", "row", "col", "date"], ["swe_mm"]), "accumulation", "11-01", "03-15")


@query("q3_cell_ablation", "water_year:i n:i pearson_r:f mean_bias:f",
       _agreement_sql("-1", "make_date(water_year, 4, 1)", "make_date(water_year, 6, 30)") + _AGREE, "pairs")
def _(t: Tables):
    return accumulation.cell_agreement(t.pairs, "ablation", "04-01", "06-30")


CASES = """, cl AS (SELECT 'largest' AS "case", water_year, delta_end AS signed_value FROM decomp WHERE delta_end IS NOT NULL ORDER BY abs(delta_end) DESC, water_year LIMIT 1),
   cs AS (SELECT 'smallest' AS "case", water_year, delta_end AS signed_value FROM decomp WHERE delta_end IS NOT NULL ORDER BY abs(delta_end), water_year LIMIT 1),
   cases AS (SELECT * FROM cl UNION ALL SELECT * FROM cs)"""


def _cases(t: Tables):
    return accumulation.case_year_rows(accumulation.case_years(accumulation.decomposition(t.basin), "delta_end"))


@query("q4_case_years", "case:s water_year:i signed_value:f", DECOMP + CASES + " SELECT * FROM cases", "basin")
def _(t: Tables):
    return _cases(t)


_SDEP = depletion_sql("station", "source, station_id, water_year", "swe_mm", 40.0, 3) + depletion_sql(
    "station", "source, station_id, water_year", "snow_depth_mm", 120.0, 2, "deep")
_ON = "a.source = b.source AND a.station_id = b.station_id AND a.water_year = b.water_year"
ANNUAL = _SDEP + f""", sw AS (SELECT a.source, a.station_id, a.water_year, sum(precip_mm) FILTER (date BETWEEN make_date(a.water_year - 1, 11, 1) AND make_date(a.water_year, 3, 15)) AS window_precip_mm,
     count(precip_mm) FILTER (date <= peak_date) AS nd, sum(precip_mm) FILTER (date <= peak_date) AS sp, max(peak_date - make_date(a.water_year - 1, 10, 1) + 1) AS ed FROM station a JOIN dep b ON {_ON} GROUP BY 1, 2, 3),
   annual AS (SELECT b.*, window_precip_mm, CASE WHEN nd = ed THEN sp END AS precip_to_peak_mm, nd = ed AS precip_complete_to_peak, c.disappearance_date AS depth_disappearance_date,
     CASE WHEN nd = ed AND sp > 0 THEN b.peak_value / sp END AS f_swe_precip FROM sw a JOIN dep b ON {_ON} LEFT JOIN deep c ON c.source = a.source AND c.station_id = a.station_id AND c.water_year = a.water_year)"""


def _annual(t: Tables):
    return stations.annual_by_source(t.station, swe_threshold=40.0, run_days=3, depth_threshold=120.0, depth_run_days=2)


@query("q5_station_annual", "source:s station_id:i water_year:i window_precip_mm:f precip_to_peak_mm:f precip_complete_to_peak:b peak_value:f peak_date:d days_to_75:i days_to_50:i days_to_25:i "
       "disappearance_date:d depth_disappearance_date:d f_swe_precip:f", ANNUAL + " SELECT * FROM annual", "station")
def _(t: Tables):
    return _annual(t)


PAIRED = """, mp AS (SELECT station_id, water_year, model, date, max(swe_mm) FILTER (source = 'S') AS sv, max(swe_mm) FILTER (source = model) AS mv
     FROM station, (VALUES ('I'), ('N')) m(model) WHERE source = 'S' OR source = model GROUP BY 1, 2, 3, 4)"""


def _station_events(name: str, sign: str, lo: str, hi: str) -> str:
    return f""", {name}_d AS (SELECT station_id, water_year, model, date, {sign} * (sv - lag(sv) OVER c) AS x, {sign} * (mv - lag(mv) OVER c) AS y FROM mp
       WHERE date BETWEEN {lo} - 1 AND {hi} WINDOW c AS (PARTITION BY station_id, water_year, model ORDER BY date)),
     {name}_e AS (SELECT * FROM {name}_d WHERE x IS NOT NULL AND y IS NOT NULL AND (x > 1 OR y > 1)),
     {name} AS (SELECT station_id, water_year, model, count(*) AS n, CASE WHEN count(*) >= 2 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS r, avg(y - x) AS b FROM {name}_e GROUP BY 1, 2, 3)"""


AGREEMENT = (PAIRED + _station_events("acc", "1", _START, _END)
             + _station_events("abl", "-1", "make_date(water_year, 4, 1)", "make_date(water_year, 6, 30)") + """,
   agree AS (SELECT m.station_id, m.water_year, m.model, mean_swe_bias, coalesce(acc.n, 0) AS accumulation_n, acc.r AS accumulation_pearson_r, acc.b AS accumulation_mean_bias,
     coalesce(abl.n, 0) AS ablation_n, abl.r AS ablation_pearson_r, abl.b AS ablation_mean_bias
     FROM (SELECT station_id, water_year, model, avg(mv - sv) AS mean_swe_bias FROM mp GROUP BY 1, 2, 3) m
     LEFT JOIN acc ON m.station_id = acc.station_id AND m.water_year = acc.water_year AND m.model = acc.model
     LEFT JOIN abl ON m.station_id = abl.station_id AND m.water_year = abl.water_year AND m.model = abl.model)""")


@query("q5_station_agreement", "station_id:i water_year:i model:s mean_swe_bias:f accumulation_n:i accumulation_pearson_r:f accumulation_mean_bias:f ablation_n:i ablation_pearson_r:f ablation_mean_bias:f",
       AGREEMENT + " SELECT * FROM agree", "station")
def _(t: Tables):
    return stations.event_agreement(t.station)


_WIDE = ("peak_value", "peak_date", "days_to_50", "precip_to_peak_mm", "f_swe_precip")
_VS = ("mean_swe_bias", "accumulation_n", "ablation_pearson_r")


@query("q5_station_table", "station_id:i water_year:i " + " ".join(f"{c}_{s}:{'d' if 'date' in c else 'i' if 'days' in c else 'f'}" for c in _WIDE for s in "SIN") + " "
       + " ".join(f"{c}_{m}_vs_S:{'i' if c.endswith('_n') else 'f'}" for c in _VS for m in "IN"),
       ANNUAL.replace(", dep_s AS", AGREEMENT + ", dep_s AS", 1) + """, wide AS (SELECT station_id, water_year, """ + ", ".join(
           f"""max({c}) FILTER (source = '{s}') AS "{c}_{s}" """ for c in _WIDE for s in "SIN") + """ FROM annual GROUP BY 1, 2),
       vs AS (SELECT station_id, water_year, """ + ", ".join(f"""max({c}) FILTER (model = '{m}') AS "{c}_{m}_vs_S" """ for c in _VS for m in "IN")
       + """ FROM agree GROUP BY 1, 2) SELECT * FROM wide LEFT JOIN vs USING (station_id, water_year)""", "station")
def _(t: Tables):
    return stations.annual_wide(t.station, swe_threshold=40.0, run_days=3)


DAYPAIRS = """, i AS (SELECT * FROM basin WHERE source = 'I'), n AS (SELECT * FROM basin WHERE source = 'N'),
   ep AS (SELECT i.water_year, i.date, i.swe_mm AS si, n.swe_mm AS sn, i.melt_mm AS mi, n.melt_mm AS mn, i.incoming_sw_energy_mj_m2 AS ei, n.incoming_sw_energy_mj_m2 AS en,
     i.absorbed_sw_energy_mj_m2 AS ai, n.absorbed_sw_energy_mj_m2 AS an, i.effective_albedo AS bi, n.effective_albedo AS bn FROM i JOIN n ON i.date = n.date
     WHERE i.date BETWEEN make_date(i.water_year, 4, 1) AND make_date(i.water_year, 6, 30)),
   el AS (SELECT *, (lag(sn) OVER w - sn) - (lag(si) OVER w - si) AS extra FROM ep WINDOW w AS (PARTITION BY water_year ORDER BY date)),
   ea AS (SELECT water_year, sum(ei) AS incoming_i, sum(en) AS incoming_n, sum(ai) AS absorbed_i, sum(an) AS absorbed_n, sum(-0.5 * (ei + en) * (bn - bi)) AS albedo_driven_term,
     sum(mi) AS melt_i, sum(mn) AS melt_n, avg(extra) FILTER (mi > 7.777 OR mn > 7.777) AS mean_extra_loss FROM el GROUP BY 1),
   energy AS (SELECT *, 1 - absorbed_i / nullif(incoming_i, 0) AS albedo_i, 1 - absorbed_n / nullif(incoming_n, 0) AS albedo_n, absorbed_n - absorbed_i AS delta_absorbed, incoming_n - incoming_i AS delta_incoming FROM ea)"""


def _energy(t: Tables):
    p = relate.pair_long(t.basin, ["water_year", "date"], list(energy.ENERGY_COLUMNS))
    return energy.annual(p, melt_threshold=7.777)


@query("q6_energy", "water_year:i incoming_I:f incoming_N:f absorbed_I:f absorbed_N:f albedo_driven_term:f melt_I:f melt_N:f mean_extra_loss:f effective_albedo_I:f effective_albedo_N:f delta_absorbed:f delta_incoming:f",
       DAYPAIRS + """ SELECT water_year, incoming_i AS "incoming_I", incoming_n AS "incoming_N", absorbed_i AS "absorbed_I", absorbed_n AS "absorbed_N", albedo_driven_term, melt_i AS "melt_I", melt_n AS "melt_N",
       mean_extra_loss, albedo_i AS "effective_albedo_I", albedo_n AS "effective_albedo_N", delta_absorbed, delta_incoming FROM energy""", "basin")
def _(t: Tables):
    return _energy(t)


def _half_sql(name: str, table: str, keys: str, value: str, last: str) -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ks = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f""", {name}_v AS (SELECT {keys}, date, sum({value}) OVER (PARTITION BY {keys} ORDER BY date) AS c FROM {table}
         WHERE {value} >= 0 AND date BETWEEN make_date(water_year, 3, 1) AND least(make_date(water_year, 9, 30), {last})),
       {name}_t AS (SELECT {keys}, max(c) AS tot FROM {name}_v GROUP BY {keys}),
       {name} AS (SELECT {ks}, min(a.date) AS half FROM {name}_v a JOIN {name}_t b ON {on} WHERE tot > 0 AND a.c >= 0.5 * tot GROUP BY {ks})"""


LINK = (_DEP + _half_sql("rel", "basin", "source, water_year", "release_mm", "DATE '2001-08-01'")
        + _half_sql("gau", "gauge", "water_year", "discharge_m3_day", "DATE '2001-08-01'") + """,
   lk AS (SELECT d.source, d.water_year, peak_date + CAST(days_to_50 AS INT) AS swe50, half AS release50 FROM dep d LEFT JOIN rel r ON d.source = r.source AND d.water_year = r.water_year),
   lw AS (SELECT water_year, max(swe50) FILTER (source = 'I') AS si, max(swe50) FILTER (source = 'N') AS sn, max(release50) FILTER (source = 'I') AS ri, max(release50) FILTER (source = 'N') AS rn FROM lk GROUP BY 1),
   link AS (SELECT lw.*, half AS gauge50 FROM lw LEFT JOIN gau ON lw.water_year = gau.water_year)""")


@query("q7_timing_linkage", "water_year:i swe50_I:d swe50_N:d release50_I:d release50_N:d gauge50:d release_lag_I_days:i release_lag_N_days:i delta_swe50_days:i delta_release50_days:i "
       "release50_I_minus_gauge50_days:i release50_N_minus_gauge50_days:i",
       LINK + """ SELECT water_year, si AS "swe50_I", sn AS "swe50_N", ri AS "release50_I", rn AS "release50_N", gauge50, ri - si AS "release_lag_I_days", rn - sn AS "release_lag_N_days",
       sn - si AS delta_swe50_days, rn - ri AS delta_release50_days, ri - gauge50 AS "release50_I_minus_gauge50_days", rn - gauge50 AS "release50_N_minus_gauge50_days" FROM link""", "basin gauge")
def _(t: Tables):
    return timing.linkage(t.basin, t.gauge, analysis_end="2001-08-01", threshold=THRESHOLD, run_days=RUN)


STREAM = """, a AS (SELECT date, water_year, release_mm * 1000 AS volume_i FROM basin WHERE source = 'I'), b AS (SELECT date, release_mm * 1000 AS volume_n FROM basin WHERE source = 'N'),
   m AS (SELECT date, a.water_year, volume_i, volume_n, discharge_m3_day FROM a FULL JOIN b USING (date) FULL JOIN gauge g USING (date)),
   r AS (SELECT *, avg(volume_i) OVER w AS ri, avg(volume_n) OVER w AS rn, avg(discharge_m3_day) OVER w AS rg FROM m WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
   stream AS (SELECT *, CASE WHEN water_year IS NOT NULL AND max(ri) OVER y > 0 THEN ri / max(ri) OVER y END AS ni, CASE WHEN water_year IS NOT NULL AND max(rn) OVER y > 0 THEN rn / max(rn) OVER y END AS nn,
     CASE WHEN water_year IS NOT NULL AND max(rg) OVER y > 0 THEN rg / max(rg) OVER y END AS ng FROM r WINDOW y AS (PARTITION BY water_year))"""


def _stream(t: Tables):
    i = t.basin_of("I").select("date", "water_year", (F.col("release_mm") * 1000).alias("volume_I"))
    n = t.basin_of("N").select("date", (F.col("release_mm") * 1000).alias("volume_N"))
    return timing.streamflow(i, n, t.gauge)


@query("q8_streamflow", "date:d water_year:i rolling_I:f4 rolling_N:f4 rolling_gauge:f3 normalized_I:f normalized_N:f normalized_gauge:f",
       STREAM + """ SELECT date, water_year, ri AS "rolling_I", rn AS "rolling_N", rg AS rolling_gauge, ni AS "normalized_I", nn AS "normalized_N", ng AS normalized_gauge FROM stream""", "basin gauge")
def _(t: Tables):
    return _stream(t)


_M0, _M1 = "make_date(water_year - 1, 10, 1)", "make_date(water_year, 3, 15)"
MULT = f""", ms AS (SELECT source, water_year, CASE WHEN count(*) FILTER (date = {_M0}) = 1 THEN max(swe_mm) FILTER (date = {_M0}) END AS s0, CASE WHEN count(*) FILTER (date = {_M1}) = 1 THEN max(swe_mm) FILTER (date = {_M1}) END AS s1,
     count(snowfall_mm) FILTER (date > {_M0} AND date <= {_M1}) AS nv, sum(snowfall_mm) FILTER (date > {_M0} AND date <= {_M1}) AS sf, max({_M1} - {_M0}) AS ne FROM basin GROUP BY 1, 2),
   mg AS (SELECT source, water_year, s0, s1, nv, ne, CASE WHEN nv = ne THEN sf END AS sf, s1 - s0 AS g FROM ms), mm AS (SELECT *, 1 - g / nullif(sf, 0) AS m FROM mg),
   mult AS (SELECT i.water_year, i.s0 AS i0, n.s0 AS n0, i.s1 AS i1, n.s1 AS n1, i.g AS gi, n.g AS gn, i.sf AS sfi, n.sf AS sfn, i.m AS mi, n.m AS mn, i.nv AS nvi, n.nv AS nvn, i.ne AS ne,
     n.g / nullif(i.g, 0) - 1 AS et, n.sf / nullif(i.sf, 0) - 1 AS ea, (i.m - n.m) / nullif(1 - i.m, 0) AS eb FROM mm i JOIN mm n ON i.water_year = n.water_year WHERE i.source = 'I' AND n.source = 'N')"""


@query("q9_multiplicative", "water_year:i gain_I:f gain_N:f snowfall_I:f snowfall_N:f m_I:f m_N:f epsilon_total:f epsilon_accumulation:f epsilon_ablation:f epsilon_reconstructed:f delta_start:f delta_end:f delta_gain:f "
       "snowfall_complete_I:b snowfall_complete_N:b valid_days_I:i expected_days_I:i m_I_outside:b m_N_outside:b",
       MULT + """ SELECT water_year, gi AS "gain_I", gn AS "gain_N", sfi AS "snowfall_I", sfn AS "snowfall_N", mi AS "m_I", mn AS "m_N", et AS epsilon_total, ea AS epsilon_accumulation, eb AS epsilon_ablation,
       (1 + ea) * (1 + eb) - 1 AS epsilon_reconstructed, n0 - i0 AS delta_start, n1 - i1 AS delta_end, gn - gi AS delta_gain, nvi = ne AS "snowfall_complete_I", nvn = ne AS "snowfall_complete_N", nvi AS "valid_days_I", ne AS "expected_days_I",
       coalesce(mi < 0 OR mi > 1, false) AS "m_I_outside", coalesce(mn < 0 OR mn > 1, false) AS "m_N_outside" FROM mult""", "basin")
def _(t: Tables):
    return accumulation.multiplicative(t.basin)


@query("q10_observation_qc", "obs_date:d variable:s hard_maximum_mm:f nodata_count:i raw_valid_count:i clipped_to_zero_count:i masked_negative_count:i masked_above_hard_max_count:i adjusted_count:i adjusted_percent:f "
       "inside_raw_valid_count:i inside_adjusted_count:i inside_adjusted_percent:f",
       FLAGGED + """ SELECT obs_date, variable, max(top) AS hard_maximum_mm, count(*) - count(raw_mm) AS nodata_count, count(raw_mm) AS raw_valid_count, count(*) FILTER (clipped_to_zero) AS clipped_to_zero_count,
       count(*) FILTER (masked_negative) AS masked_negative_count, count(*) FILTER (masked_above) AS masked_above_hard_max_count, count(*) FILTER (adjusted) AS adjusted_count, 100.0 * count(*) FILTER (adjusted) / nullif(count(raw_mm), 0) AS adjusted_percent,
       count(raw_mm) FILTER (inside) AS inside_raw_valid_count, count(*) FILTER (adjusted AND inside) AS inside_adjusted_count, 100.0 * count(*) FILTER (adjusted AND inside) / nullif(count(raw_mm) FILTER (inside), 0) AS inside_adjusted_percent
       FROM flagged GROUP BY 1, 2""", "raw_obs")
def _(t: Tables):
    return quality.summary(quality.apply_limits(t.raw_obs, tolerance=60.0), ["obs_date", "variable"])


@query("q11_density_diagnostics", "source:s water_year:i cell_count:i below_review_min_count:i above_review_max_count:i above_water_density_count:i density_p01:f density_p05:f density_p50:f density_p95:f density_p99:f",
       """, d AS (SELECT source, water_year, round(1000 * (swe_mm / depth), 12) AS v FROM (SELECT *, round(snow_depth_mm, 9) AS depth FROM cells) WHERE depth >= 100 AND cover >= 0.2)
       SELECT source, water_year, count(*) AS cell_count, count(*) FILTER (v < 290) AS below_review_min_count, count(*) FILTER (v > 310) AS above_review_max_count, count(*) FILTER (v > 330) AS above_water_density_count,
       quantile_cont(v, 0.01) AS density_p01, quantile_cont(v, 0.05) AS density_p05, quantile_cont(v, 0.5) AS density_p50, quantile_cont(v, 0.95) AS density_p95, quantile_cont(v, 0.99) AS density_p99 FROM d GROUP BY 1, 2""", "cells")
def _(t: Tables):
    both = t.cells.where(F.col("cover") >= 0.2).select("source", "water_year", F.col("swe_mm").alias("swe"), F.col("snow_depth_mm").alias("depth"))
    return quality.density_summary(both, ["source", "water_year"], 100.0, (290.0, 310.0), 330.0)


@query("q11_density_of_two_tables", "source:s water_year:i cell_count:i density_p50:f",
       """, d AS (SELECT source, water_year, round(1000 * (swe_mm / depth), 12) AS v FROM (SELECT *, round(snow_depth_mm, 9) AS depth FROM cells) WHERE depth >= 100 AND cover >= 0.2)
       SELECT source, water_year, count(*) AS cell_count, quantile_cont(v, 0.5) AS density_p50 FROM d GROUP BY 1, 2""", "cells")
def _(t: Tables):
    # the date joins the cell key, so that one water year is reported as a whole
    cell = F.struct("date", "row").alias("row")
    swe = t.cells.select("source", "water_year", cell, "col", F.col("swe_mm").alias("cleaned_mm"), (F.col("cover") >= 0.2).alias("inside"))
    depth = t.cells.select("source", "water_year", cell, "col", F.col("snow_depth_mm").alias("cleaned_mm"))
    return quality.density_diagnostics(swe, depth, ["source", "water_year"], 100.0, (290.0, 310.0), 330.0)


_OVERLAP = """, {name}_g AS (SELECT r AS "row", k AS col FROM (SELECT unnest(range(0, CAST((SELECT max("row") FROM {src}) AS BIGINT) + 2)) AS r), range(0, {width}) b(k)),
   {name}_o AS (SELECT obs_date, variable, g."row", g.col, value, (least((g.col + 1) * {dt}, (f.col + 1) * {ds}) - greatest(g.col * {dt}, f.col * {ds})) * (least((g."row" + 1) * {dt}, (f."row" + 1) * {ds}) - greatest(g."row" * {dt}, f."row" * {ds})) AS area
     FROM {src} f JOIN {name}_g g ON f.col * {ds} < (g.col + 1) * {dt} AND (f.col + 1) * {ds} > g.col * {dt} AND f."row" * {ds} < (g."row" + 1) * {dt} AND (f."row" + 1) * {ds} > g."row" * {dt}),
   {name} AS (SELECT obs_date, variable, "row", col, CASE WHEN coalesce(sum(area) FILTER (value IS NOT NULL), 0) / ({dt} * {dt}) >= 0.5 THEN sum(value * area) / sum(area) FILTER (value IS NOT NULL) END AS value FROM {name}_o GROUP BY 1, 2, 3, 4)"""
FIELDS = (_OVERLAP.format(name="oc", src="obs_fields", ds="10.0", dt="50.0", width=6) + _OVERLAP.format(name="ic", src="first_fields", ds="20.0", dt="50.0", width=6)
          + _OVERLAP.format(name="of", src="obs_fields", ds="10.0", dt="20.0", width=15) + """,
   fields AS (SELECT n.obs_date, n.variable, n."row", n.col, o.value AS o, i.value AS i, n.value AS n FROM second_fields n JOIN common_weights w ON n."row" = w."row" AND n.col = w.col AND w.weight > 0
     LEFT JOIN oc o ON n.obs_date = o.obs_date AND n.variable = o.variable AND n."row" = o."row" AND n.col = o.col
     LEFT JOIN ic i ON n.obs_date = i.obs_date AND n.variable = i.variable AND n."row" = i."row" AND n.col = i.col),
   native AS (SELECT f.obs_date, f.variable, f."row", f.col, f.value - o.value AS difference FROM first_fields f JOIN of o ON f.obs_date = o.obs_date AND f.variable = o.variable AND f."row" = o."row" AND f.col = o.col
     JOIN middle_weights w ON f."row" = w."row" AND f.col = w.col AND w.weight > 0),
   products AS (SELECT 'I - obs, common grid' AS product, 'common' AS lattice, obs_date, variable, "row", col, i - o AS v FROM fields UNION ALL SELECT 'N - obs, common grid', 'common', obs_date, variable, "row", col, n - o FROM fields
     UNION ALL SELECT 'I - obs, fine grid', 'fine', obs_date, variable, "row", col, difference FROM native),
   bands AS (SELECT * FROM (VALUES ('Lower', -1e9, 2896.0), ('Middle', 2896.0, 3353.0), ('Upper', 3353.0, 1e9), ('All', -1e9, 1e9)) b(band, lo, hi)),
   banded AS (SELECT product, obs_date, variable, band, v FROM products p JOIN elevations e ON p.lattice = e.lattice AND p."row" = e."row" AND p.col = e.col JOIN bands ON elev_m >= lo AND elev_m < hi WHERE v IS NOT NULL)""")
_FT = "obs_fields first_fields second_fields common_weights middle_weights elevations"


def _fields(t: Tables):
    return observations.common_fields(t.obs_fields, t.first_fields, t.second_fields, FINE, MIDDLE, COMMON, t.common_weights)


def _differences(t: Tables):
    native = observations.native_differences(t.obs_fields, t.first_fields, FINE, MIDDLE, t.middle_weights)
    return observations.difference_products(_fields(t), native)


_STATS = """count(v) AS cell_count, avg(v) AS mean_mm, quantile_cont(v, 0.5) AS median_mm, avg(abs(v)) AS mae_mm, sqrt(avg(v * v)) AS rmse_mm, stddev_pop(v) AS std_mm,
   quantile_cont(v, 0.05) AS p05_mm, quantile_cont(v, 0.95) AS p95_mm"""


@query("q12_band_statistics", "product:s obs_date:d variable:s band:s cell_count:i mean_mm:f median_mm:f mae_mm:f rmse_mm:f std_mm:f p05_mm:f p95_mm:f density_cell_count:i density_mean:f density_median:f",
       FIELDS + f""", sd AS (SELECT obs_date, "row", col, 1000 * max(o) FILTER (variable = 'SWE') / nullif(max(o) FILTER (variable = 'Snow depth'), 0) AS den FROM fields GROUP BY 1, 2, 3),
       db AS (SELECT obs_date, band, count(den) AS density_cell_count, avg(den) AS density_mean, quantile_cont(den, 0.5) AS density_median FROM sd JOIN elevations e ON e.lattice = 'common' AND sd."row" = e."row" AND sd.col = e.col
         JOIN bands ON elev_m >= lo AND elev_m < hi WHERE den IS NOT NULL GROUP BY 1, 2),
       bs AS (SELECT product, obs_date, variable, band, {_STATS} FROM banded GROUP BY 1, 2, 3, 4)
       SELECT bs.*, CASE WHEN product LIKE '%common grid' THEN density_cell_count END AS density_cell_count, CASE WHEN product LIKE '%common grid' THEN density_mean END AS density_mean,
       CASE WHEN product LIKE '%common grid' THEN density_median END AS density_median FROM bs LEFT JOIN db ON bs.obs_date = db.obs_date AND bs.band = db.band""", _FT)
def _(t: Tables):
    products = observations.lattice_products(t.obs_fields, t.first_fields, t.second_fields, FINE, MIDDLE, COMMON, t.lattice_cells)
    return observations.band_table(products, BANDS)


@query("q12_validation_rows", "product:s obs_date:d variable:s band:s cell_count:i mean_mm:f",
       FIELDS + " SELECT product, obs_date, variable, band, count(v) AS cell_count, avg(v) AS mean_mm FROM banded WHERE product LIKE '%common grid' GROUP BY 1, 2, 3, 4", _FT)
def _(t: Tables):
    return observations.validation_rows(observations.band_statistics(_differences(t), t.elevations, BANDS))


@query("q12_band_boxplots", "product:s obs_date:d variable:s band:s n:i whisker_low:f q1:f median:f q3:f whisker_high:f",
       FIELDS + """, q AS (SELECT product, obs_date, variable, band, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS q3 FROM banded GROUP BY 1, 2, 3, 4)
       SELECT b.product, b.obs_date, b.variable, b.band, count(*) AS n, least(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), max(q1)) AS whisker_low, max(q1) AS q1, max(m) AS "median", max(q3) AS q3,
       greatest(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), max(q3)) AS whisker_high FROM banded b JOIN q ON b.product = q.product AND b.obs_date = q.obs_date AND b.variable = q.variable AND b.band = q.band GROUP BY 1, 2, 3, 4""", _FT)
def _(t: Tables):
    lattice = F.when(F.col("product") == observations.NATIVE, "fine").otherwise("common")
    rows = relate.lattice_join(_differences(t).withColumn("lattice", lattice), t.elevations, ["lattice", "row", "col"])
    return quality.boxplot(spatial.join_bands(rows, "elev_m", BANDS), ["product", "obs_date", "variable", "band"], "difference")


@query("q12_density_rows", "product:s obs_date:d variable:s band:s density_cell_count:i density_mean:f density_median:f",
       FIELDS + """, sd AS (SELECT obs_date, "row", col, 1000 * max(o) FILTER (variable = 'SWE') / nullif(max(o) FILTER (variable = 'Snow depth'), 0) AS den FROM fields GROUP BY 1, 2, 3),
       db AS (SELECT obs_date, band, count(den) AS density_cell_count, avg(den) AS density_mean, quantile_cont(den, 0.5) AS density_median FROM sd JOIN elevations e ON e.lattice = 'common' AND sd."row" = e."row" AND sd.col = e.col
         JOIN bands ON elev_m >= lo AND elev_m < hi WHERE den IS NOT NULL GROUP BY 1, 2)
       SELECT DISTINCT product, b.obs_date, variable, b.band, density_cell_count, density_mean, density_median FROM banded b JOIN db ON b.obs_date = db.obs_date AND b.band = db.band WHERE product LIKE '%common grid'""", _FT)
def _(t: Tables):
    table = observations.band_statistics(_differences(t), t.elevations, BANDS)
    both = observations.with_density(table, observations.observed_density(_fields(t), t.elevations, BANDS))
    return observations.validation_rows(both).where("density_cell_count IS NOT NULL")


# -- separation --------------------------------------------------------------------------

def _wm(v: str, where: str = "true") -> str:
    return f"sum({v} * weight) FILTER ({v} IS NOT NULL AND {where}) / sum(weight) FILTER ({v} IS NOT NULL AND {where})"


def _pm(v: str, where: str = "true") -> str:
    both = f"{v}_i IS NOT NULL AND {v}_n IS NOT NULL AND {where}"
    return ", ".join(f"sum({v}_{s} * weight) FILTER ({both}) / sum(weight) FILTER ({both}) AS {{0}}_{s}" for s in "in")


_TW = "(SELECT sum(weight) FROM weights WHERE weight > 0)"
_INC, _ABS = "incoming_sw_energy_mj_m2", "absorbed_sw_energy_mj_m2"
SEPARATION = f""", sc AS (SELECT *, CASE WHEN date - lag(date) OVER w = 1 THEN lag(swe_mm_i) OVER w - swe_mm_i END AS loss_i, CASE WHEN date - lag(date) OVER w = 1 THEN lag(swe_mm_n) OVER w - swe_mm_n END AS loss_n,
     CASE WHEN swe_mm_i >= 10 AND snow_depth_mm_i > 0 THEN 1000 * swe_mm_i / snow_depth_mm_i END AS density_i, CASE WHEN swe_mm_n >= 10 AND snow_depth_mm_n > 0 THEN 1000 * swe_mm_n / snow_depth_mm_n END AS density_n,
     swe_mm_i >= 10 AS snow_i, swe_mm_n >= 10 AS snow_n FROM pairs WINDOW w AS (PARTITION BY water_year, "row", col ORDER BY date)),
   sb AS (SELECT water_year, date, {_pm('swe_mm').format('swe')}, {_pm('snow_depth_mm').format('snow_depth')}, {_pm('loss').format('loss')}, {_pm('melt_mm').format('melt')},
     {_pm('density').replace('{0}_i', 'density_i_pair').replace('{0}_n', 'density_n_pair')}, {_wm('density_i')} AS density_i_own, {_wm('density_n')} AS density_n_own, {_wm('release_mm_i')} AS release_i, {_wm('release_mm_n')} AS release_n,
     coalesce(sum(weight) FILTER (snow_i), 0) / {_TW} AS snow_area_i, coalesce(sum(weight) FILTER (snow_n), 0) / {_TW} AS snow_area_n,
     {_wm(_INC + '_i')} AS incoming_i, {_wm(_INC + '_n')} AS incoming_n, {_wm(_ABS + '_i')} AS absorbed_i, {_wm(_ABS + '_n')} AS absorbed_n,
     {_pm(_INC, 'snow_i AND snow_n').format('snow_incoming')}, {_pm(_ABS, 'snow_i AND snow_n').format('snow_absorbed')}, {_wm('cover_n')} AS cover_mean, {_wm('cover_n', 'snow_n')} AS cover_on_snow,
     coalesce(sum(weight) FILTER (density_i IS NOT NULL AND density_n IS NOT NULL), 0) / {_TW} AS density_pair_area, coalesce(sum(weight) FILTER (snow_i AND snow_n), 0) / {_TW} AS snow_pair_area,
     count(*) FILTER (loss_i > 1 AND loss_n IS NOT NULL OR loss_n > 1 AND loss_i IS NOT NULL) AS event_cells FROM sc c {_W} GROUP BY 1, 2),
   sa AS (SELECT *, CASE WHEN incoming_i > 0.05 THEN 1 - absorbed_i / incoming_i END AS albedo_i, CASE WHEN incoming_n > 0.05 THEN 1 - absorbed_n / incoming_n END AS albedo_n,
     CASE WHEN snow_incoming_i > 0.05 THEN 1 - snow_absorbed_i / snow_incoming_i END AS snow_albedo_i, CASE WHEN snow_incoming_n > 0.05 THEN 1 - snow_absorbed_n / snow_incoming_n END AS snow_albedo_n FROM sb),
   sep AS (SELECT *, swe_n - swe_i AS delta_swe, snow_depth_n - snow_depth_i AS delta_snow_depth, loss_n - loss_i AS delta_loss, absorbed_n - absorbed_i AS delta_absorbed, snow_absorbed_n - snow_absorbed_i AS delta_snow_absorbed,
     albedo_n - albedo_i AS delta_albedo, snow_albedo_n - snow_albedo_i AS delta_snow_albedo, density_n_pair - density_i_pair AS delta_density_pair,
     (swe_n - swe_i) - lag(swe_n - swe_i) OVER (PARTITION BY water_year ORDER BY date) AS delta_swe_change, date BETWEEN make_date(water_year, 2, 1) AND make_date(water_year, 4, 30) AS in_focus_window FROM sa)"""
_SEP_COLUMNS = ("water_year:i date:d " + " ".join(f"{c}:f" for c in (
    "swe_i", "swe_n", "snow_depth_i", "snow_depth_n", "loss_i", "loss_n", "melt_i", "melt_n", "density_i_pair", "density_n_pair", "density_i_own", "density_n_own", "release_i", "release_n",
    "snow_area_i", "snow_area_n")) + " " + " ".join(f"{c}:f8" for c in ("incoming_i", "incoming_n", "absorbed_i", "absorbed_n", "snow_incoming_i", "snow_incoming_n", "snow_absorbed_i", "snow_absorbed_n",
                                                                     "delta_absorbed", "delta_snow_absorbed")) + " "
    + " ".join(f"{c}:f" for c in ("cover_mean", "cover_on_snow", "density_pair_area", "snow_pair_area", "albedo_i", "albedo_n", "snow_albedo_i", "snow_albedo_n", "delta_swe", "delta_snow_depth", "delta_loss", "delta_albedo",
                                  "delta_snow_albedo", "delta_density_pair", "delta_swe_change")) + " event_cells:i in_focus_window:b")


def _separation(t: Tables):
    return separation.basin_daily(separation.cell_columns(t.pairs), t.weights)


@query("q13_separation_daily", _SEP_COLUMNS, SEPARATION + " SELECT * FROM sep", "pairs weights")
def _(t: Tables):
    return _separation(t)


_SUPPORTED = f", evw AS (SELECT c.* FROM ev c {_W})"


@query("q14_focus_summary", "water_year:i focus_start:d focus_end:d mean_delta_swe:f min_delta_swe:f mean_delta_snow_depth:f mean_delta_density:f mean_cover:f first_cover_below_90:d first_cover_below_75:d first_cover_below_50:d "
       "first_cover_below_50_dowy:i albedo_i:f albedo_n:f delta_albedo:f absorbed_i:f absorbed_n:f delta_absorbed:f snow_albedo_i:f snow_albedo_n:f snow_delta_absorbed:f melt_i:f melt_n:f release_i:f release_n:f event_n:i mean_extra_loss:f",
       SEPARATION + cell_loss_sql("OR", BIN5) + _SUPPORTED + BINNED.format(n=5, ev="evw") + """,
       en AS (SELECT water_year, sum(event_n) AS event_n, sum(mean_extra_loss * event_n) / nullif(sum(event_n) FILTER (event_n > 0), 0) AS mean_extra_loss FROM bins GROUP BY 1),
       fs AS (SELECT water_year, min(date) AS focus_start, max(date) AS focus_end, avg(delta_swe) AS mean_delta_swe, min(delta_swe) AS min_delta_swe, avg(delta_snow_depth) AS mean_delta_snow_depth, avg(delta_density_pair) AS mean_delta_density,
         avg(cover_mean) AS mean_cover, min(date) FILTER (cover_mean < 0.9) AS first_cover_below_90, min(date) FILTER (cover_mean < 0.75) AS first_cover_below_75, min(date) FILTER (cover_mean < 0.5) AS first_cover_below_50,
         sum(incoming_i) AS ii, sum(incoming_n) AS xn, sum(absorbed_i) AS absorbed_i, sum(absorbed_n) AS absorbed_n, sum(snow_incoming_i) AS sii, sum(snow_incoming_n) AS sxn, sum(snow_absorbed_i) AS sai, sum(snow_absorbed_n) AS san,
         sum(melt_i) AS melt_i, sum(melt_n) AS melt_n, sum(release_i) AS release_i, sum(release_n) AS release_n FROM sep WHERE in_focus_window GROUP BY 1)
       SELECT fs.*, first_cover_below_50 - make_date(fs.water_year - 1, 10, 1) + 1 AS first_cover_below_50_dowy, 1 - absorbed_i / ii AS albedo_i, 1 - absorbed_n / xn AS albedo_n, (1 - absorbed_n / xn) - (1 - absorbed_i / ii) AS delta_albedo,
       absorbed_n - absorbed_i AS delta_absorbed, 1 - sai / sii AS snow_albedo_i, 1 - san / sxn AS snow_albedo_n, san - sai AS snow_delta_absorbed, coalesce(en.event_n, 0) AS event_n, en.mean_extra_loss FROM fs LEFT JOIN en ON fs.water_year = en.water_year""",
       "pairs weights")
def _(t: Tables):
    cells = separation.cell_columns(t.pairs)
    return separation.focus_summary(separation.basin_daily(cells, t.weights), separation.event_summary(cells, t.weights, t.years))


@query("q15_cover_relationship", "water_year:i variable:s n:i pearson_r:f x_mean:f y_mean:f",
       SEPARATION + f""", rl AS (SELECT c.* FROM sc c {_W} WHERE cover_n > 0 AND date BETWEEN make_date(water_year, 2, 1) AND make_date(water_year, 4, 30)),
       lng AS (SELECT water_year, 'swe_mm_n' AS variable, swe_mm_n AS x, cover_n AS y FROM rl UNION ALL SELECT water_year, 'snow_depth_mm_n', snow_depth_mm_n, cover_n FROM rl UNION ALL SELECT water_year, 'density_n', density_n, cover_n FROM rl)
       SELECT water_year, variable, count(x) AS n, CASE WHEN count(x) >= 2 AND stddev_pop(x) > 0 AND stddev_pop(y) FILTER (x IS NOT NULL) > 0 THEN corr(x, y) END AS pearson_r, avg(x) AS x_mean, avg(y) FILTER (x IS NOT NULL) AS y_mean
       FROM lng GROUP BY 1, 2""", "pairs weights")
def _(t: Tables):
    return separation.cover_relationships(separation.cell_columns(t.pairs), t.weights)


# -- two years -------------------------------------------------------------------------------

SPATIAL = f""", spatial AS (SELECT *, area_fraction_marginal_1_10mm + area_fraction_shallow_10_25mm AS area_fraction_marginal_1_25mm, CASE WHEN snow_incoming_mj_m2 > 0.05 THEN 1 - snow_absorbed_mj_m2 / snow_incoming_mj_m2 END AS snow_albedo FROM (
   SELECT source, water_year, date, sum(weight) / {_TW} AS swe_valid_area_fraction, coalesce(sum(weight) FILTER (swe_mm > 1), 0) / sum(weight) AS sca_gt_1mm, coalesce(sum(weight) FILTER (swe_mm > 10), 0) / sum(weight) AS sca_gt_10mm,
   coalesce(sum(weight) FILTER (swe_mm > 25), 0) / sum(weight) AS sca_gt_25mm, coalesce(sum(weight) FILTER (swe_mm <= 1), 0) / sum(weight) AS area_fraction_snowfree_le_1mm,
   coalesce(sum(weight) FILTER (swe_mm > 1 AND swe_mm <= 10), 0) / sum(weight) AS area_fraction_marginal_1_10mm, coalesce(sum(weight) FILTER (swe_mm > 10 AND swe_mm <= 25), 0) / sum(weight) AS area_fraction_shallow_10_25mm,
   coalesce(sum(weight) FILTER (swe_mm > 25), 0) / sum(weight) AS area_fraction_substantial_gt_25mm, sum({_INC} * weight) FILTER (swe_mm > 10) / sum(weight) FILTER (swe_mm > 10) AS snow_incoming_mj_m2,
   sum({_ABS} * weight) FILTER (swe_mm > 10) / sum(weight) FILTER (swe_mm > 10) AS snow_absorbed_mj_m2, CASE WHEN sum(weight) FILTER (swe_mm > 10) > 0 THEN 1 ELSE 0 END AS snow_energy_valid_area_fraction FROM cells c {_W} GROUP BY 1, 2, 3))"""


@query("q16_spatial_daily", "source:s water_year:i date:d swe_valid_area_fraction:f sca_gt_1mm:f sca_gt_10mm:f sca_gt_25mm:f area_fraction_snowfree_le_1mm:f area_fraction_marginal_1_10mm:f area_fraction_shallow_10_25mm:f "
       "area_fraction_substantial_gt_25mm:f area_fraction_marginal_1_25mm:f snow_incoming_mj_m2:f8 snow_absorbed_mj_m2:f8 snow_albedo:f snow_energy_valid_area_fraction:f season_day:i",
       SPATIAL + " SELECT *, date - make_date(water_year - 1, 10, 1) AS season_day FROM spatial", "cells weights")
def _(t: Tables):
    return yearpair.spatial_daily(t.cells, t.weights)


COVERD = f""", coverd AS (SELECT source, water_year, date, {_wm('cover')} AS cover_mean, sum(weight) / {_TW} AS cover_valid_area_fraction, 0 AS out_of_range_cells, coalesce(sum(weight) FILTER (cover <= 1e-6), 0) / sum(weight) AS cover_fraction_snowfree_0,
   coalesce(sum(weight) FILTER (cover >= 0.1 AND cover < 0.9), 0) / sum(weight) AS cover_fraction_partial_0p1_0p9, coalesce(sum(weight) FILTER (cover >= 1 - 1e-6), 0) / sum(weight) AS cover_fraction_full_1 FROM cells c {_W} GROUP BY 1, 2, 3)"""


@query("q16_cover_daily", "source:s water_year:i date:d cover_mean:f cover_valid_area_fraction:f out_of_range_cells:i cover_fraction_snowfree_0:f cover_fraction_partial_0p1_0p9:f cover_fraction_full_1:f",
       COVERD + " SELECT * FROM coverd", "cells weights")
def _(t: Tables):
    return yearpair.cover_daily(t.cells, t.weights)


def _products(t: Tables):
    return yearpair.daily_products([t.basin_of("I"), t.basin_of("N")], yearpair.spatial_daily(t.cells, t.weights).drop("season_day"),
                                   yearpair.cover_daily(t.cells, t.weights))


PRODUCTS = SPATIAL + COVERD + """, prod AS (SELECT b.*, s.sca_gt_10mm, s.snow_albedo, s.snow_absorbed_mj_m2, c.cover_mean FROM basin b
     LEFT JOIN spatial s ON b.source = s.source AND b.water_year = s.water_year AND b.date = s.date LEFT JOIN coverd c ON b.source = 'N' AND c.source = 'N' AND b.water_year = c.water_year AND b.date = c.date)""" + DIAGNOSTICS.format(table="prod")
_PT = "basin cells weights"
SUMMARY = PRODUCTS + """, smx AS (SELECT *, max(swe_mm) OVER (PARTITION BY source, water_year) AS top, CASE WHEN count(swe_loss_mm_day) OVER r = 7 THEN sum(swe_loss_mm_day) OVER r END AS loss7 FROM diag
     WINDOW r AS (PARTITION BY source, water_year ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
   smp AS (SELECT source, water_year, min(date) AS pd FROM smx WHERE swe_mm = top GROUP BY 1, 2),
   summary AS (SELECT s.source, s.water_year, max(top) AS peak_swe_mm, max(pd) AS peak_date, min(date) FILTER (date >= pd AND swe_mm <= top * 0.75) - max(pd) AS days_peak_to_75pct, min(date) FILTER (date >= pd AND swe_mm <= top * 0.5) - max(pd) AS days_peak_to_50pct,
     max(swe_mm) FILTER (month(date) = 4 AND day(date) = 1) AS swe_apr01_mm, max(swe_mm) FILTER (month(date) = 6 AND day(date) = 30) AS swe_jun30_mm, sum(precip_mm) AS precip_mm, sum(snowfall_mm) AS snowfall_mm,
     sum(snowfall_mm) FILTER (month(date) IN (10, 11, 12, 1, 2, 3)) AS snowfall_oct_mar_mm, sum(melt_mm) AS melt_mm, max(retention_fraction) FILTER (month(date) = 3 AND day(date) = 31) AS retention_mar31,
     count(*) FILTER (dswe_mm_day > 1) AS accumulation_event_count, avg(dswe_mm_day) FILTER (dswe_mm_day > 1) AS mean_accumulation_event_mm_day, sum(swe_gain_mm_day) AS cumulative_gain_mm, count(*) FILTER (dswe_mm_day < -1) AS ablation_event_count,
     avg(swe_loss_mm_day) FILTER (dswe_mm_day < -1) AS mean_ablation_event_mm_day, sum(swe_loss_mm_day) AS cumulative_loss_mm, max(loss7) AS max_7day_loss_mm, avg(fractional_swe_loss) AS mean_fractional_loss,
     avg(effective_albedo) FILTER (month(date) IN (4, 5, 6)) AS spring_mean_albedo, sum(absorbed_sw_energy_mj_m2) FILTER (month(date) IN (4, 5, 6)) AS spring_absorbed_mj_m2, min(date) FILTER (date >= pd AND sca_gt_10mm <= 0.5) AS post_peak_area_below_50,
     min(date) FILTER (date >= pd AND cover_mean <= 0.5) AS post_peak_cover_below_50, avg(snow_albedo) FILTER (month(date) IN (4, 5, 6)) AS spring_snow_albedo, sum(snowfall_mm) / nullif(sum(precip_mm), 0) AS snowfall_fraction
     FROM smx s JOIN smp p ON s.source = p.source AND s.water_year = p.water_year GROUP BY 1, 2)"""


@query("q17_model_year_summary", "source:s water_year:i peak_swe_mm:f peak_date:d days_peak_to_75pct:i days_peak_to_50pct:i swe_apr01_mm:f swe_jun30_mm:f precip_mm:f snowfall_mm:f snowfall_oct_mar_mm:f melt_mm:f retention_mar31:f accumulation_event_count:i "
       "mean_accumulation_event_mm_day:f cumulative_gain_mm:f ablation_event_count:i mean_ablation_event_mm_day:f cumulative_loss_mm:f max_7day_loss_mm:f mean_fractional_loss:f spring_mean_albedo:f spring_absorbed_mj_m2:f post_peak_area_below_50:d "
       "post_peak_cover_below_50:d spring_snow_albedo:f snowfall_fraction:f", SUMMARY + " SELECT * FROM summary", _PT)
def _(t: Tables):
    return yearpair.model_year_summary(_products(t))


_METRICS = ("peak_swe_mm", "precip_mm", "snowfall_mm", "melt_mm", "accumulation_event_count", "spring_mean_albedo", "snowfall_fraction")


@query("q17_summary_anomalies", "metric:s anomaly_I:f anomaly_N:f double_difference:f",
       SUMMARY + ", lng AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, source, water_year, CAST({m} AS DOUBLE) AS v FROM summary" for m in _METRICS) + """),
       a AS (SELECT metric, source, max(v) FILTER (water_year = 2000) - max(v) FILTER (water_year = 1997) AS d FROM lng GROUP BY 1, 2)
       SELECT metric, max(d) FILTER (source = 'I') AS "anomaly_I", max(d) FILTER (source = 'N') AS "anomaly_N", max(d) FILTER (source = 'N') - max(d) FILTER (source = 'I') AS double_difference FROM a GROUP BY 1""", _PT)
def _(t: Tables):
    summary = yearpair.model_year_summary(_products(t)).select("source", "water_year", *_METRICS)
    return yearpair.summary_anomalies(summary, 1997, 2000)


@query("q18_daily_products", "source:s water_year:i date:d swe_mm:f sca_gt_10mm:f cover_mean:f snow_albedo:f dswe_mm_day:f cumulative_snowfall_mm:f retention_fraction:f season_day:i",
       PRODUCTS + " SELECT *, date - make_date(water_year - 1, 10, 1) AS season_day FROM diag", _PT)
def _(t: Tables):
    return _products(t)


@query("q19_daily_forcing", "date:d water_year:i month_day:s hour_count:i precip_mm_day:f temperature_mean_c:f incoming_sw_mean_w_m2:f incoming_sw_energy_mj_m2_day:f incoming_lw_mean_w_m2:f incoming_lw_energy_mj_m2_day:f precip_accum_oct1_mm:f",
       """, hw AS (SELECT h.* , weight FROM hours h JOIN hour_weights w ON h."row" = w."row" AND h.col = w.col AND weight > 0 WHERE source = 'N'),
       b AS (SELECT ts, count(*) = (SELECT count(*) FROM hour_weights WHERE weight > 0) AS ok, sum(rain_mm_s * weight) / sum(weight) AS r, sum(temp_k * weight) / sum(weight) AS k, sum(sw_w_m2 * weight) / sum(weight) AS s, sum(lw_w_m2 * weight) / sum(weight) AS l FROM hw GROUP BY 1),
       d AS (SELECT CAST(ts AS DATE) AS date, count(*) FILTER (ok) AS n, sum(greatest(r, 0)) * 3600 AS p, avg(k) - 273.15 AS t, avg(greatest(s, 0)) AS sw, sum(greatest(s, 0)) * 3600e-6 AS swe, avg(greatest(l, 0)) AS lw, sum(greatest(l, 0)) * 3600e-6 AS lwe FROM b GROUP BY 1),
       c AS (SELECT date, n, CASE WHEN n = 24 THEN p END AS p, CASE WHEN n = 24 THEN t END AS t, CASE WHEN n = 24 THEN sw END AS sw, CASE WHEN n = 24 THEN swe END AS swe, CASE WHEN n = 24 THEN lw END AS lw, CASE WHEN n = 24 THEN lwe END AS lwe FROM d)
       SELECT date, 2024 AS water_year, strftime(date, '%m-%d') AS month_day, n AS hour_count, p AS precip_mm_day, t AS temperature_mean_c, sw AS incoming_sw_mean_w_m2, swe AS incoming_sw_energy_mj_m2_day, lw AS incoming_lw_mean_w_m2,
       lwe AS incoming_lw_energy_mj_m2_day, CASE WHEN p IS NOT NULL THEN sum(p) OVER (ORDER BY date) END AS precip_accum_oct1_mm FROM c""", "hours hour_weights")
def _(t: Tables):
    cols = ["rain_mm_s", "temp_k", "sw_w_m2", "lw_w_m2"]
    hourly = areal.basin_means_strict(t.hours.where("source = 'N'"), t.hour_weights, ["ts"], cols, on_missing="null")
    return rollup.daily_forcing(hourly, [])


@query("q20_climatology_suite", "part:s variable:s kind:s value:f anomaly:f zscore:f",
       FORCING + WINDOWS + SPECIAL + CLIMATOLOGY + EXTREMES + """ SELECT 'special' AS part, metric AS variable, "window" AS kind, focus_value AS value, anomaly, zscore FROM special
       UNION ALL SELECT 'extreme', variable, extreme_type, focus_value, anomaly, zscore FROM ex WHERE k = 1""", "basin")
def _(t: Tables):
    daily = forcing_daily(t)
    special = climatology.specialness(climatology.window_metrics(daily, on_incomplete="flag"), 2000)
    extreme = climatology.extremes(climatology.calendar_day_anomalies(climatology.with_rolling(daily), 2000))
    return special.select(F.lit("special").alias("part"), F.col("metric").alias("variable"), F.col("window").alias("kind"), F.col("focus_value").alias("value"), "anomaly", "zscore").unionByName(
        extreme.select(F.lit("extreme").alias("part"), "variable", F.col("extreme_type").alias("kind"), F.col("focus_value").alias("value"), "anomaly", "zscore"))


_HB = """, hb AS (SELECT source, ts, sum(temp_k * weight) / sum(weight) AS k, sum(lw_w_m2 * weight) / sum(weight) AS l, sum(sqrt(wind_u * wind_u + wind_v * wind_v) * weight) / sum(weight) AS v, sum(rain_mm_s * weight) / sum(weight) AS r,
     sum(weight) / (SELECT sum(weight) FROM hour_weights WHERE weight > 0) AS f FROM hours h JOIN hour_weights w ON h."row" = w."row" AND h.col = w.col AND weight > 0 GROUP BY 1, 2)"""


@query("q21_additional_forcing", "source:s date:d water_year:i air_mean_c:f air_min_c:f air_max_c:f air_finite_hours:i wind_mean_m_s:f wind_max_m_s:f lw_mean_w_m2:f lw_energy_mj_m2:f minimum_hourly_valid_area_fraction:f sublimation_mm_day:f",
       _HB + """ SELECT source, CAST(ts AS DATE) AS date, 2024 AS water_year, avg(k) - 273.15 AS air_mean_c, min(k) - 273.15 AS air_min_c, max(k) - 273.15 AS air_max_c, count(k) AS air_finite_hours, avg(v) AS wind_mean_m_s, max(v) AS wind_max_m_s,
       avg(l) AS lw_mean_w_m2, CASE WHEN count(l) = 24 THEN sum(l) * 3600e-6 END AS lw_energy_mj_m2, min(f) AS minimum_hourly_valid_area_fraction, CASE WHEN count(r) = 24 THEN sum(r) * 3600 END AS sublimation_mm_day FROM hb GROUP BY 1, 2""", "hours hour_weights")
def _(t: Tables):
    cells = t.hours.withColumn("speed", physics.wind_speed("wind_u", "wind_v"))
    main = forcing.daily_forcing_by_source(cells, t.hour_weights, {
        "air": ("temp_k", "temperature", "K"), "wind": ("speed", "wind", "m s-1"), "lw": ("lw_w_m2", "radiation", "W/m2")})
    sub = forcing.accumulated_flux(cells, t.hour_weights, "rain_mm_s", "kg m-2 s-1", "sublimation").drop("minimum_hourly_valid_area_fraction")
    return forcing.combine(main, sub, ["source", "date", "water_year"])


@query("q21_coverage_mismatch", "row:i col:i ts:t side:s",
       """, k AS (SELECT "row", col, ts, count(*) FILTER (source = 'I') AS i, count(*) FILTER (source = 'N') AS n FROM hours GROUP BY 1, 2, 3)
       SELECT "row", col, ts, CASE WHEN n = 0 THEN 'left_only' ELSE 'right_only' END AS side FROM k WHERE i = 0 OR n = 0""", "hours")
def _(t: Tables):
    return forcing.coverage_mismatch(t.hours.where("source = 'I'"), t.hours.where("source = 'N'"), ["row", "col", "ts"])


@query("q22_net_longwave", "date:d water_year:i net_lw_i:f net_lw_n:f delta_net_lw:f",
       """, cw AS (SELECT "row" // 2 AS "row", col // 2 AS col, avg(weight) AS weight FROM hour_weights GROUP BY 1, 2), nw AS (SELECT count(*) AS n FROM cw WHERE weight > 0),
       a AS (SELECT CAST(ts AS DATE) AS date, "row", col, max_by(sw_w_m2 - lw_w_m2, ts) - CASE WHEN count(*) = 24 THEN avg(absorbed_w_m2) END AS v FROM hours WHERE source = 'N' GROUP BY 1, 2, 3),
       g AS (SELECT date, "row" // 2 AS "row", col // 2 AS col, CASE WHEN count(v) * 1e6 / 4e6 >= 0.2 THEN avg(v) END AS v FROM a GROUP BY 1, 2, 3),
       ba AS (SELECT date, CASE WHEN count(v) = (SELECT n FROM nw) THEN sum(v * weight) / sum(weight) END AS net_lw_i FROM g JOIN cw USING ("row", col) WHERE weight > 0 GROUP BY 1),
       h AS (SELECT ts, "row" // 2 AS "row", col // 2 AS col, avg(lw_w_m2) AS lw FROM hours GROUP BY 1, 2, 3), b AS (SELECT CAST(ts AS DATE) AS date, "row", col, CASE WHEN count(*) = 24 THEN -avg(lw) END AS v FROM h GROUP BY 1, 2, 3),
       bb AS (SELECT date, CASE WHEN count(v) = (SELECT n FROM nw) THEN sum(v * weight) / sum(weight) END AS net_lw_n FROM b JOIN cw USING ("row", col) WHERE weight > 0 GROUP BY 1)
       SELECT date, 2024 AS water_year, net_lw_i, net_lw_n, net_lw_n - net_lw_i AS delta_net_lw FROM ba JOIN bb USING (date)""", "hours hour_weights")
def _(t: Tables):
    half = [F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")]
    target = spatial.Grid("double", 0.0, 0.0, 2000.0, 2000.0, 3, None)
    first = t.hours.where("source = 'N'").select("ts", "row", "col", (F.col("sw_w_m2") - F.col("lw_w_m2")).alias("net_rad"), F.col("absorbed_w_m2").alias("net_solar"))
    second = t.hours.groupBy("ts", *half).agg(F.avg("lw_w_m2").alias("net_lw_up"))
    weights = t.hour_weights.groupBy("grid_id", *half).agg(F.avg("weight").alias("weight"))
    return forcing.net_longwave(first, second, CELLS, target, weights, minimum_coverage=0.2, on_missing="null")


@query("q23_focus_merge", "date:d water_year:i delta_swe:f delta_net_sw_w_m2:f precip_mm_day:f precip_event:b delta_net_lw:f",
       FORCING + """, s AS (SELECT i.date, i.water_year, n.swe_mm - i.swe_mm AS delta_swe, n.absorbed_sw_energy_mj_m2 - i.absorbed_sw_energy_mj_m2 AS delta_absorbed, n.melt_mm - i.melt_mm AS delta_net_lw
         FROM basin i JOIN basin n ON i.date = n.date WHERE i.source = 'I' AND n.source = 'N')
       SELECT s.date, s.water_year, delta_swe, delta_absorbed * 1e6 / 86400 AS delta_net_sw_w_m2, precip_mm_day, precip_mm_day >= 200.03 AS precip_event, delta_net_lw FROM s JOIN daily d ON s.date = d.date
       WHERE s.water_year IN (1997, 2000) AND s.date BETWEEN make_date(s.water_year, 2, 1) AND make_date(s.water_year, 4, 30)""", "basin")
def _(t: Tables):
    p = relate.pair_long(t.basin, ["date", "water_year"], ["swe_mm", "absorbed_sw_energy_mj_m2", "melt_mm"])
    sep = p.select("date", "water_year", (F.col("swe_mm_n") - F.col("swe_mm_i")).alias("delta_swe"),
                   (F.col("absorbed_sw_energy_mj_m2_n") - F.col("absorbed_sw_energy_mj_m2_i")).alias("delta_absorbed"))
    lw = p.select("date", "water_year", (F.col("melt_mm_n") - F.col("melt_mm_i")).alias("delta_net_lw"))
    return forcing.focus_merge(sep, forcing_daily(t), lw, [1997, 2000], event_threshold=200.03)


@query("q24_disappearance_error", "station_id:i water_year:i model:s error_days:i",
       ANNUAL + """ SELECT station_id, water_year, model, max(depth_disappearance_date) FILTER (source = model) - max(depth_disappearance_date) FILTER (source = 'S') AS error_days
       FROM annual, (VALUES ('I'), ('N')) m(model) GROUP BY 1, 2, 3""", "station")
def _(t: Tables):
    return stations.disappearance_error(_annual(t))


@query("q25_panel_statistics", "variable:s water_year:i n:i pearson_r:f mean_bias:f",
       """, p AS (SELECT i.water_year, i.swe_mm AS a, n.swe_mm AS b, i.snow_depth_mm AS c, n.snow_depth_mm AS d FROM basin i JOIN basin n ON i.date = n.date WHERE i.source = 'I' AND n.source = 'N'),
       l AS (SELECT 'swe_mm' AS variable, water_year, a AS x, b AS y FROM p UNION ALL SELECT 'snow_depth_mm', water_year, c, d FROM p)
       SELECT variable, water_year, count(*) AS n, CASE WHEN count(*) >= 2 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS pearson_r, avg(y - x) AS mean_bias FROM l GROUP BY 1, 2""", "basin")
def _(t: Tables):
    p = relate.pair_long(t.basin, ["date", "water_year"], ["swe_mm", "snow_depth_mm"])
    both = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"{v}_i").alias("x"), F.col(f"{v}_n").alias("y")) for v in ("swe_mm", "snow_depth_mm")])
    long = p.select("water_year", F.explode(both).alias("_v")).select("water_year", "_v.*")
    return events.agreement(long, ["variable", "water_year"], "x", "y")


@query("q26_energy_mechanism", "water_year:i albedo_energy_n:i albedo_energy_r:f mean_delta_absorbed:f energy_loss_n:i energy_loss_r:f mean_extra_loss:f",
       f""", w AS (SELECT * FROM pairs WHERE date BETWEEN make_date(water_year, 4, 1) - 1 AND make_date(water_year, 6, 30)),
       m AS (SELECT water_year, CASE WHEN {_INC}_n > 0.05 THEN 1 - {_ABS}_n / {_INC}_n END - CASE WHEN {_INC}_i > 0.05 THEN 1 - {_ABS}_i / {_INC}_i END AS da, {_ABS}_n - {_ABS}_i AS ds,
         (lag(swe_mm_n) OVER c - swe_mm_n) - (lag(swe_mm_i) OVER c - swe_mm_i) AS ex FROM w WINDOW c AS (PARTITION BY water_year, "row", col ORDER BY date))
       SELECT water_year, count(da + ds) AS albedo_energy_n, CASE WHEN count(da + ds) >= 2 THEN corr(da, ds) END AS albedo_energy_r, avg(ds) FILTER (da IS NOT NULL) AS mean_delta_absorbed, count(ds + ex) AS energy_loss_n,
       CASE WHEN count(ds + ex) >= 2 THEN corr(ds, ex) END AS energy_loss_r, avg(ex) AS mean_extra_loss FROM m GROUP BY 1""", "pairs")
def _(t: Tables):
    return energy.mechanism_summary(energy.mechanism_cells(t.pairs))


@query("q26_mechanism_density", "pair:s water_year:i bin_x:i bin_y:i pair_count:i",
       f""", w AS (SELECT * FROM pairs WHERE date BETWEEN make_date(water_year, 4, 1) - 1 AND make_date(water_year, 6, 30)),
       m AS (SELECT water_year, CASE WHEN {_INC}_n > 0.05 THEN 1 - {_ABS}_n / {_INC}_n END - CASE WHEN {_INC}_i > 0.05 THEN 1 - {_ABS}_i / {_INC}_i END AS da, {_ABS}_n - {_ABS}_i AS ds,
         (lag(swe_mm_n) OVER c - swe_mm_n) - (lag(swe_mm_i) OVER c - swe_mm_i) AS ex FROM w WINDOW c AS (PARTITION BY water_year, "row", col ORDER BY date)),
       v AS (SELECT 'albedo_energy' AS pair, water_year, round(da, 6) AS x, round(ds, 6) AS y FROM m UNION ALL SELECT 'energy_loss', water_year, round(ds, 6), round(ex, 6) FROM m),
       xy AS (SELECT * FROM v WHERE x IS NOT NULL AND y IS NOT NULL),
       l AS (SELECT pair, water_year, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM xy GROUP BY 1, 2)
       SELECT pair, water_year, least(CAST(floor((x - CASE WHEN x0 = x1 THEN x0 - 0.5 ELSE x0 END) / CASE WHEN x0 = x1 THEN 1 ELSE x1 - x0 END * 65) AS INT), 64) AS bin_x,
       least(CAST(floor((y - CASE WHEN y0 = y1 THEN y0 - 0.5 ELSE y0 END) / CASE WHEN y0 = y1 THEN 1 ELSE y1 - y0 END * 65) AS INT), 64) AS bin_y, count(*) AS pair_count
       FROM xy JOIN l USING (pair, water_year) GROUP BY 1, 2, 3, 4""", "pairs")
def _(t: Tables):
    return energy.mechanism_density(energy.mechanism_cells(t.pairs))


@query("q27_station_lookup", "station_id:i fine_row:i fine_col:i fine_distance_m:f coarse_row:i coarse_col:i coarse_distance_m:f envelope_cells:i",
       _LOOKUP + """ SELECT nf.station_id, nf."row" AS fine_row, nf.col AS fine_col, nf.d AS fine_distance_m, nc."row" AS coarse_row, nc.col AS coarse_col, nc.d AS coarse_distance_m,
       (SELECT count(*) FROM env WHERE env.station_id = nf.station_id) AS envelope_cells FROM nf JOIN nc ON nf.station_id = nc.station_id WHERE nf.n = 1 AND nc.n = 1""", "fine points common")
def _(t: Tables):
    return spatial.lookup_report(lookup(t), allow_empty=True)


_YEARS = """, d AS (SELECT source, water_year, date - make_date(water_year - 1, 10, 1) AS season_day, absorbed_sw_energy_mj_m2 AS v, effective_albedo AS e FROM basin),
   ya AS (SELECT x.source, x.season_day, y.v - x.v AS dv, y.e - x.e AS de FROM d x JOIN d y ON x.source = y.source AND x.season_day = y.season_day WHERE x.water_year = 1997 AND y.water_year = 2000)"""


@query("q28_anomaly_running_sum", "source:s season_day:i delta_effective_albedo_7day:f cumulative_delta_absorbed_sw_energy_mj_m2:f8",
       _YEARS + """ SELECT source, season_day, avg(de) OVER (PARTITION BY source ORDER BY season_day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS delta_effective_albedo_7day,
       sum(dv) OVER (PARTITION BY source ORDER BY season_day) AS cumulative_delta_absorbed_sw_energy_mj_m2 FROM ya""", "basin")
def _(t: Tables):
    b = t.basin.withColumn("season_day", cal.season_day("date", "water_year"))
    a = yearpair.year_anomalies(b, ["absorbed_sw_energy_mj_m2", "effective_albedo"], 1997, 2000)
    run = yearpair.anomaly_running_sum(a, "delta_absorbed_sw_energy_mj_m2")
    return a.select("source", "season_day", "delta_effective_albedo_7day").join(run, ["source", "season_day"])


@query("q28_feedback_sums", "water_year:i date:d cumulative_delta_absorbed:f8 cumulative_delta_snow_absorbed:f8",
       SEPARATION + """ SELECT water_year, date, CASE WHEN delta_absorbed IS NOT NULL THEN sum(delta_absorbed) OVER w END AS cumulative_delta_absorbed, sum(coalesce(delta_snow_absorbed, 0)) OVER w AS cumulative_delta_snow_absorbed FROM sep
       WINDOW w AS (PARTITION BY water_year ORDER BY date)""", "pairs weights")
def _(t: Tables):
    return separation.energy_running_sums(_separation(t))


@query("q29_station_comparison", "station_id:i water_year:i date:d station_value:f nearest_I:f nearest_N:f swe_mm_envelope_min:f swe_mm_envelope_max:f envelope_pixels:i",
       """, e AS (SELECT s.id AS station_id, water_year, date, min(swe_mm) AS lo, max(swe_mm) AS hi, count(*) AS k FROM cells c JOIN (SELECT DISTINCT station_id AS id FROM station) s ON c.col = s.id % 5 WHERE source = 'I' GROUP BY 1, 2, 3),
       w AS (SELECT station_id, water_year, date, max(swe_mm) FILTER (source = 'S') AS station_value, max(swe_mm) FILTER (source = 'I') AS ni, max(swe_mm) FILTER (source = 'N') AS nn FROM station GROUP BY 1, 2, 3)
       SELECT w.station_id, w.water_year, w.date, station_value, ni AS "nearest_I", nn AS "nearest_N", lo AS swe_mm_envelope_min, hi AS swe_mm_envelope_max, k AS envelope_pixels FROM w LEFT JOIN e ON w.station_id = e.station_id AND w.date = e.date""", "station cells")
def _(t: Tables):
    ids = t.station.select("station_id").distinct().withColumn("col", (F.col("station_id") % 5).cast("int"))
    roles = t.weights.select("row", "col").join(ids, "col").select("station_id", F.lit("envelope").alias("role"), "row", "col")
    envelope = areal.station_samples(t.cells.where("source = 'I'"), roles, ["water_year", "date"], ["swe_mm"]).drop("swe_mm_nearest")
    return stations.comparison_series(t.station, envelope)


@query("q30_station_annual_series", "source:s station_id:i water_year:i peak_dowy:i f_swe_precip:f", ANNUAL + " SELECT * FROM annual", "station")
def _(t: Tables):
    return _annual(t)


@query("q31_accumulated_precipitation", "source:s station_id:i water_year:i date:d swe_mm:f cumulative_precip_mm:f",
       "SELECT source, station_id, water_year, date, swe_mm, sum(precip_mm) OVER (PARTITION BY source, station_id, water_year ORDER BY date) AS cumulative_precip_mm FROM station", "station")
def _(t: Tables):
    return stations.accumulated(t.station)


@query("q32_field_matrix", "variable:s kind:s panel:s obs_date:d row:i col:i value:f class_code:i",
       FIELDS + """, l AS (SELECT obs_date, variable, "row", col, 'O' AS panel, 'state' AS kind, o AS v FROM fields UNION ALL SELECT obs_date, variable, "row", col, 'I', 'state', i FROM fields UNION ALL SELECT obs_date, variable, "row", col, 'N', 'state', n FROM fields
         UNION ALL SELECT obs_date, variable, "row", col, 'I-N', 'difference', i - n FROM fields UNION ALL SELECT obs_date, variable, "row", col, 'I-O', 'difference', i - o FROM fields UNION ALL SELECT obs_date, variable, "row", col, 'N-O', 'difference', n - o FROM fields),
       r AS (SELECT variable, kind, greatest(quantile_cont(CASE WHEN kind = 'state' THEN v ELSE abs(v) END, 0.99), 1) AS q FROM l GROUP BY 1, 2),
       b AS (SELECT variable, kind, ceil(q / pow(10, floor(log10(q))) * 2) / 2 * pow(10, floor(log10(q))) AS t FROM r)
       SELECT l.variable, l.kind, panel, obs_date, "row", col, v AS value, CASE WHEN l.kind = 'state' THEN greatest(0, least(4, (v >= 0)::INT + (v >= 0.1 * t)::INT + (v >= 0.25 * t)::INT + (v >= 0.5 * t)::INT + (v >= 0.75 * t)::INT + (v >= t)::INT - 1))
         ELSE greatest(0, least(9, (v >= -t)::INT + (v >= -0.75 * t)::INT + (v >= -0.5 * t)::INT + (v >= -0.25 * t)::INT + (v >= -0.1 * t)::INT + (v >= 0)::INT + (v >= 0.1 * t)::INT + (v >= 0.25 * t)::INT + (v >= 0.5 * t)::INT + (v >= 0.75 * t)::INT + (v >= t)::INT - 1)) END AS class_code
       FROM l JOIN b ON l.variable = b.variable AND l.kind = b.kind WHERE v IS NOT NULL""", _FT)
def _(t: Tables):
    return observations.field_matrix(_fields(t))


@query("q33_case_hydrographs", "case:s source:s water_year:i date:d swe_mm:f snow_depth_mm:f",
       DECOMP + CASES + """ SELECT "case", source, b.water_year, date, swe_mm, snow_depth_mm FROM basin b JOIN cases c ON b.water_year = c.water_year""", "basin")
def _(t: Tables):
    return accumulation.of_case_years(t.basin, _cases(t))


@query("q33_case_depletion", "case:s source:s station_id:i water_year:i days_since_peak:i fraction_of_peak:f",
       DECOMP + CASES + depletion_sql("station", "source, station_id, water_year", "swe_mm", 40, 3) + """ SELECT "case", s.source, s.station_id, s.water_year, date - peak_date AS days_since_peak, swe_mm / peak_value AS fraction_of_peak
       FROM station s JOIN cases c ON s.water_year = c.water_year JOIN dep d ON s.source = d.source AND s.station_id = d.station_id AND s.water_year = d.water_year WHERE date >= peak_date AND peak_value > 0""", "basin station")
def _(t: Tables):
    rows = accumulation.of_case_years(t.station, _cases(t))
    return series.normalized_curve(rows, ["case", "source", "station_id", "water_year"], "swe_mm")


@query("q34_signed_stack", "water_year:i component:s positive:f positive_bottom:f negative:f negative_bottom:f",
       DECOMP + """, l AS (SELECT water_year, 1 AS o, 'c_initial' AS component, coalesce(c_initial, 0) AS v FROM decomp UNION ALL SELECT water_year, 2, 'c_snowfall', coalesce(c_snowfall, 0) FROM decomp UNION ALL SELECT water_year, 3, 'c_retention', coalesce(c_retention, 0) FROM decomp)
       SELECT water_year, component, greatest(v, 0) AS positive, coalesce(sum(greatest(v, 0)) OVER w, 0) AS positive_bottom, least(v, 0) AS negative, coalesce(sum(least(v, 0)) OVER w, 0) AS negative_bottom FROM l
       WINDOW w AS (PARTITION BY water_year ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "basin")
def _(t: Tables):
    return accumulation.signed_stack(accumulation.decomposition(t.basin), ["c_initial", "c_snowfall", "c_retention"])


def _case_events(t: Tables):
    years = _cases(t).select("water_year").distinct().withColumn("case", F.lit("any"))
    window = events.event_window(accumulation.of_case_years(t.pairs, years), "11-01", "03-15")
    return events.change_events(window, ["water_year", "row", "col"], "swe_mm_i", "swe_mm_n", "accumulation", 1.0)


_CASE_EV = DECOMP + CASES + _agreement_sql("1", _START, _END)


@query("q35_case_cell_density", "water_year:i bin_x:i bin_y:i pair_count:i", _CASE_EV + ", xy AS (SELECT e.* FROM ev e JOIN (SELECT DISTINCT water_year FROM cases) c USING (water_year))" + HIST.format(xy="xy"), "basin pairs")
def _(t: Tables):
    return events.histogram2d(_case_events(t), ["water_year"], "change_x", "change_y")


CASES50 = """, wide50 AS (SELECT i.water_year, n.days_to_50 - i.days_to_50 AS m FROM dep i JOIN dep n ON i.water_year = n.water_year WHERE i.source = 'I' AND n.source = 'N'),
   c1 AS (SELECT 'largest' AS "case", water_year, m AS signed_value FROM wide50 WHERE m IS NOT NULL ORDER BY abs(m) DESC, water_year LIMIT 1),
   c2 AS (SELECT 'smallest' AS "case", water_year, m AS signed_value FROM wide50 WHERE m IS NOT NULL ORDER BY abs(m), water_year LIMIT 1),
   cases50 AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2)"""


def _cases50(t: Tables):
    return accumulation.case_year_rows(accumulation.case_years(timing.depletion_by_source(t.basin, THRESHOLD, RUN), "delta_t50_days"))


@query("q4_depletion_case_years", "case:s water_year:i signed_value:f", _DEP + CASES50 + " SELECT * FROM cases50", "basin")
def _(t: Tables):
    return _cases50(t)


@query("q35_case_cell_ablation", "water_year:i n:i pearson_r:f mean_bias:f",
       _DEP + CASES50 + _agreement_sql("-1", "make_date(water_year, 4, 1)", "make_date(water_year, 6, 30)")
       + ", ev2 AS (SELECT e.* FROM ev e JOIN (SELECT DISTINCT water_year FROM cases50) c USING (water_year))" + _AGREE.replace("FROM ev ", "FROM ev2 "), "basin pairs")
def _(t: Tables):
    years = _cases50(t).select("water_year").distinct().withColumn("case", F.lit("any"))
    return accumulation.cell_agreement(accumulation.of_case_years(t.pairs, years), "ablation", "04-01", "06-30")


@query("q35_case_station_events", "case:s station_id:i model:s accumulation_n:i accumulation_mean_bias:f ablation_n:i ablation_pearson_r:f",
       DECOMP + CASES + AGREEMENT + """ SELECT "case", station_id, model, accumulation_n, accumulation_mean_bias, ablation_n, ablation_pearson_r FROM agree a JOIN cases c ON a.water_year = c.water_year""", "basin station")
def _(t: Tables):
    return stations.event_agreement(t.station).join(F.broadcast(_cases(t).select("case", "water_year")), "water_year")


@query("q36_annual_energy_series", "water_year:i variable:s value:f",
       DAYPAIRS + " SELECT water_year, 'delta_absorbed' AS variable, delta_absorbed AS value FROM energy UNION ALL SELECT water_year, 'albedo_driven_term', albedo_driven_term FROM energy UNION ALL SELECT water_year, 'mean_extra_loss', mean_extra_loss FROM energy", "basin")
def _(t: Tables):
    return _energy(t).unpivot(["water_year"], ["delta_absorbed", "albedo_driven_term", "mean_extra_loss"], "variable", "value")


@query("q36_streamflow_panels", "water_year:i date:d normalized_I:f normalized_N:f normalized_gauge:f",
       STREAM + """ SELECT water_year, date, ni AS "normalized_I", nn AS "normalized_N", ng AS normalized_gauge FROM stream WHERE water_year IS NOT NULL""", "basin gauge")
def _(t: Tables):
    return _stream(t).where(F.col("water_year").isNotNull())
