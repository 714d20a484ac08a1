"""Where a difference in accumulated snow between two sources comes from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import stats
from ..operators import events


def _mean_of_present(a: Column, b: Column) -> Column:
    return F.coalesce((a + b) / 2.0, a, b)


def season_states(daily: DataFrame, start_md: str, end_md: str,
                  keys: Sequence[str] = ("source", "water_year")) -> DataFrame:
    """First/last state and window sums per series, in one aggregation."""
    start, end = cal.season_date("water_year", start_md), cal.season_date("water_year", end_md)
    inside = F.col("date").between(start, end)
    return daily.where(inside).groupBy(*keys).agg(
        stats.value_on("date", "swe_mm", start).alias("swe_start"),
        stats.value_on("date", "swe_mm", end).alias("swe_end"),
        F.sum("snowfall_mm").alias("snowfall"), F.sum("precip_mm").alias("precip"))


def side_by_side(df: DataFrame, keys: Sequence[str], columns: Sequence[str], source: str = "source",
                 labels: Sequence[str] = ("I", "N")) -> DataFrame:
    """Long per-source rows -> one row per key with ``<column>_<label>`` columns."""
    aggs = [F.max(F.when(F.col(source) == s, F.col(c))).alias(f"{c}_{s}") for c in columns for s in labels]
    return df.groupBy(*keys).agg(*aggs)


def decomposition(daily: DataFrame, start_md: str = "11-01", end_md: str = "03-15") -> DataFrame:
    """Initial-state, snowfall and retention contributions to the end-of-season difference.

    The three terms add up to the difference exactly; ``closure`` shows the round-off.
    """
    states = season_states(daily, start_md, end_md).withColumn(
        "eta", F.try_divide(F.col("swe_end") - F.col("swe_start"), F.col("snowfall")))
    w = side_by_side(states, ["water_year"], ["swe_start", "swe_end", "snowfall", "precip", "eta"])
    eta_bar = _mean_of_present(F.col("eta_I"), F.col("eta_N"))
    snow_bar = _mean_of_present(F.col("snowfall_I"), F.col("snowfall_N"))
    w = (w.withColumn("delta_end", F.col("swe_end_N") - F.col("swe_end_I"))
         .withColumn("c_initial", F.col("swe_start_N") - F.col("swe_start_I"))
         .withColumn("c_snowfall", eta_bar * (F.col("snowfall_N") - F.col("snowfall_I")))
         .withColumn("c_retention", snow_bar * (F.col("eta_N") - F.col("eta_I"))))
    parts = ["c_initial", "c_snowfall", "c_retention"]
    total = sum((F.coalesce(F.abs(c), F.lit(0.0)) for c in parts), F.lit(0.0))
    for c in parts:
        w = w.withColumn(c.replace("c_", "share_") + "_pct",
                         F.when(total > 0, 100.0 * F.try_divide(F.abs(c), total)))
    return w.withColumn("closure", F.col("delta_end")
                        - (F.col("c_initial") + F.col("c_snowfall") + F.col("c_retention")))


def multiplicative(daily: DataFrame, start_md: str = "10-01", end_md: str = "03-15") -> DataFrame:
    """Relative accumulation and ablation errors that multiply to the relative gain error.

    The state is taken on the first day, fluxes from the day after. Fluxes need
    every calendar day; years present in both sources only.
    """
    start, end = cal.season_date("water_year", start_md), cal.season_date("water_year", end_md)
    flux_start = F.date_add(start, 1)
    in_flux = F.col("date").between(flux_start, end)
    snow = F.when(in_flux, F.col("snowfall_mm"))
    expected = F.max(F.datediff(end, flux_start) + 1)
    per = daily.groupBy("source", "water_year").agg(
        stats.single_value_on("date", "swe_mm", start).alias("swe_start"),
        stats.single_value_on("date", "swe_mm", end).alias("swe_end"),
        stats.complete_sum(snow, expected).alias("snowfall"),
        F.count(snow).alias("valid_days"), expected.alias("expected_days"))
    per = per.withColumn("gain", F.col("swe_end") - F.col("swe_start")).withColumn(
        "m", 1.0 - F.try_divide(F.col("gain"), F.col("snowfall")))
    w = side_by_side(per.withColumn("n", F.lit(1)), ["water_year"],
                     ["swe_start", "swe_end", "gain", "snowfall", "valid_days", "expected_days", "m", "n"])
    w = w.where((F.col("n_I") == 1) & (F.col("n_N") == 1)).drop("n_I", "n_N")
    ratio = F.try_divide
    w = (w.withColumn("epsilon_total", ratio(F.col("gain_N"), F.col("gain_I")) - 1.0)
         .withColumn("epsilon_accumulation", ratio(F.col("snowfall_N"), F.col("snowfall_I")) - 1.0)
         .withColumn("epsilon_ablation", ratio(F.col("m_I") - F.col("m_N"), 1.0 - F.col("m_I")))
         .withColumn("epsilon_reconstructed",
                     (1.0 + F.col("epsilon_accumulation")) * (1.0 + F.col("epsilon_ablation")) - 1.0)
         .withColumn("delta_start", F.col("swe_start_N") - F.col("swe_start_I"))
         .withColumn("delta_end", F.col("swe_end_N") - F.col("swe_end_I"))
         .withColumn("delta_gain", F.col("gain_N") - F.col("gain_I")))
    outside = lambda c: F.coalesce((F.col(c) < 0) | (F.col(c) > 1), F.lit(False))
    return (w.withColumn("state_closure", F.col("delta_end") - (F.col("delta_start") + F.col("delta_gain")))
            .withColumn("multiplicative_closure", F.col("epsilon_total") - F.col("epsilon_reconstructed"))
            .withColumn("snowfall_complete_I", F.col("valid_days_I") == F.col("expected_days_I"))
            .withColumn("snowfall_complete_N", F.col("valid_days_N") == F.col("expected_days_N"))
            .withColumn("m_I_outside", outside("m_I")).withColumn("m_N_outside", outside("m_N")))


def case_years(table: DataFrame, metric: str, wy: str = "water_year") -> DataFrame:
    """Years of the largest and smallest magnitude of a metric, with its signed value.

    Ties go to the earliest year.
    """
    ok = F.col(metric).isNotNull()
    item = lambda y: F.when(ok, F.struct(F.abs(metric).alias("a"), y.alias("y"), F.col(metric).alias("v")))
    out = table.agg(F.max(item(-F.col(wy))).alias("_hi"), F.min(item(F.col(wy))).alias("_lo"))
    return out.select((-F.col("_hi.y")).alias("largest_year"), F.col("_hi.v").alias("largest_signed_value"),
                      F.col("_lo.y").alias("smallest_year"), F.col("_lo.v").alias("smallest_signed_value"))


def case_year_rows(cases: DataFrame) -> DataFrame:
    """Case years as rows ``case, water_year, signed_value``."""
    rows = F.array(F.struct(F.lit("largest").alias("case"), F.col("largest_year").alias("water_year"),
                            F.col("largest_signed_value").alias("signed_value")),
                   F.struct(F.lit("smallest").alias("case"), F.col("smallest_year").alias("water_year"),
                            F.col("smallest_signed_value").alias("signed_value")))
    return cases.select(F.explode(rows).alias("_r")).select("_r.*").where(F.col("water_year").isNotNull())


def of_case_years(df: DataFrame, case_rows: DataFrame) -> DataFrame:
    """Rows of the case years. The case table has at most two rows by construction."""
    return df.join(F.broadcast(case_rows.select("case", "water_year")), "water_year")


def signed_stack(table: DataFrame, components: Sequence[str], wy: str = "water_year") -> DataFrame:
    """Bottoms and tops of stacked bars: positive parts upward, negative parts downward."""
    out, up, down = table, F.lit(0.0), F.lit(0.0)
    fields = []
    for c in components:
        pos, neg = F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)), F.least(
            F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))
        fields.append(F.struct(F.lit(c).alias("component"), pos.alias("positive"), up.alias("positive_bottom"),
                               neg.alias("negative"), down.alias("negative_bottom")))
        up, down = up + pos, down + neg
    return out.select(wy, F.explode(F.array(*fields)).alias("_s")).select(wy, "_s.*")


def cell_agreement(pairs: DataFrame, mode: str, start_md: str, end_md: str, threshold: float = 1.0,
                   x: str = "swe_mm_i", y: str = "swe_mm_n", cell: Sequence[str] = ("water_year", "row", "col"),
                   ) -> DataFrame:
    """Agreement of paired cell-day events per water year.

    The difference is against the previous common date inside the window.
    """
    window = events.event_window(pairs, start_md, end_md)
    hits = events.change_events(window, list(cell), x, y, mode, threshold)
    return events.agreement(hits, ["water_year"])
