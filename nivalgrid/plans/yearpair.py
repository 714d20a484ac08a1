"""Two water years of two sources side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import physics, stats
from ..operators import series
from ..operators.areal import on_support
from ..operators.relate import difference_of_sources, same_day_years, stack_sources

KEYS = ("source", "water_year")


def spatial_daily(cells: DataFrame, weights: DataFrame, thresholds: Sequence[float] = (1.0, 10.0, 25.0),
                  energy_threshold: float = 10.0, minimum_incoming: float = 0.05) -> DataFrame:
    """Area fractions of SWE thresholds and states, and the energy albedo of snow-covered cells.

    One join with the weights and one aggregation per (source, date).
    """
    swe = F.col("swe_mm")
    valid = swe.isNotNull()
    inc, absd = "incoming_sw_energy_mj_m2", "absorbed_sw_energy_mj_m2"
    snow = valid & (swe > energy_threshold)
    energy = snow & F.col(inc).isNotNull() & F.col(absd).isNotNull()
    part = lambda cond: stats.fraction_of_valid(cond, valid, "weight")
    aggs = [stats.valid_fraction("swe_mm", "weight", F.max("total_weight")).alias("swe_valid_area_fraction")]
    aggs += [part(swe > t).alias(f"sca_gt_{t:g}mm") for t in thresholds]
    aggs += [part(c).alias(f"area_fraction_{n}") for n, c in physics.swe_state_classes("swe_mm").items()]
    ok_w = F.sum(F.when(energy, F.col("weight")))
    aggs += [part(swe > energy_threshold).alias("snow_area_fraction"),
             stats.weighted_mean_where(inc, "weight", energy).alias("snow_incoming_mj_m2"),
             stats.weighted_mean_where(absd, "weight", energy).alias("snow_absorbed_mj_m2"),
             F.when(ok_w > 0, F.lit(1.0)).otherwise(0.0).alias("snow_energy_valid_area_fraction")]
    out = on_support(cells, weights).groupBy(*KEYS, "date").agg(*aggs)
    return (out.withColumn("area_fraction_marginal_1_25mm",
                           F.col("area_fraction_marginal_1_10mm") + F.col("area_fraction_shallow_10_25mm"))
            .withColumn("snow_albedo", physics.effective_albedo("snow_incoming_mj_m2", "snow_absorbed_mj_m2", minimum_incoming))
            .withColumn("season_day", cal.season_day("date", "water_year")))


def cover_daily(cells: DataFrame, weights: DataFrame, cover: str = "cover") -> DataFrame:
    """Mean cover, area fractions of its classes and the number of masked out-of-range cells."""
    rows = on_support(cells, weights).withColumn("_bad", F.coalesce(physics.outside_unit_range(cover), F.lit(False)))
    rows = rows.withColumn("_v", physics.unit_range_qc(cover))
    valid = F.col("_v").isNotNull()
    aggs = [stats.weighted_mean("_v", "weight").alias("cover_mean"),
            stats.valid_fraction("_v", "weight", F.max("total_weight")).alias("cover_valid_area_fraction"),
            F.count_if("_bad").alias("out_of_range_cells")]
    aggs += [stats.fraction_of_valid(c, valid, "weight").alias(f"cover_fraction_{n}")
             for n, c in physics.cover_state_classes("_v").items()]
    return rows.groupBy(*KEYS, "date").agg(*aggs)


def daily_products(basins: Sequence[DataFrame], spatial: DataFrame, cover: DataFrame | None = None,
                   cover_source: str = "N", event_threshold: float = 1.0,
                   fractional_minimum: float = 10.0) -> DataFrame:
    """Union of the sources' basin tables, spatial columns, the cover of one source, season diagnostics."""
    keys = ["source", "water_year", "date"]
    out = stack_sources(list(basins)).join(spatial, keys, "left")
    if cover is not None:
        out = out.join(cover.where(F.col("source") == cover_source), keys, "left")
    out = out.withColumn("season_day", cal.season_day("date", "water_year"))
    return series.season_diagnostics(out, list(KEYS), event_threshold=event_threshold,
                                     fractional_minimum=fractional_minimum)


def year_anomalies(daily: DataFrame, columns: Sequence[str], first: int, second: int) -> DataFrame:
    """Second minus first year on the same season day, with its 7-row mean."""
    out = same_day_years(daily, ["source"], columns, first, second)
    return out.withColumns({
        "reference_date": cal.reference_date("season_day"),
        **{f"delta_{c}_7day": series.centered_mean(f"delta_{c}", ["source"], "season_day") for c in columns}})


def double_difference(anomalies: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How much more one source's year anomaly is than the other's, per season day."""
    return difference_of_sources(anomalies, ["season_day"], [f"delta_{c}" for c in columns])


def anomaly_running_sum(anomalies: DataFrame, column: str) -> DataFrame:
    return anomalies.select("source", "season_day", series.running_sum(
        column, ["source"], "season_day", "zero").alias(f"cumulative_{column}"))


def _on(month: int, day: int, value: str) -> Column:
    hit = (F.month("date") == month) & (F.dayofmonth("date") == day)
    return F.max(F.when(hit, F.col(value)))


def model_year_summary(daily: DataFrame, event_threshold: float = 1.0,
                       cover_levels: Sequence[float] = (0.90, 0.75, 0.50)) -> DataFrame:
    """One row per source and water year from :func:`daily_products` rows."""
    keys = list(KEYS)
    rows = series.with_peak(daily, keys, "swe_mm").withColumn(
        "_loss7", series.trailing_full_sum("swe_loss_mm_day", keys))
    c = F.col
    after, swe, top = c("date") >= c("peak_date"), c("swe_mm"), c("peak_value")
    hit = lambda f: F.min(F.when(after & (top > 0) & (swe <= top * f), c("date")))
    month = F.month("date")
    winter, spring = month.isin(10, 11, 12, 1, 2, 3), month.isin(4, 5, 6)
    gain, loss = c("dswe_mm_day") > event_threshold, c("dswe_mm_day") < -event_threshold
    aggs = [F.max(top).alias("peak_swe_mm"), F.max("peak_date").alias("peak_date")]
    aggs += [hit(f).alias(f"_hit{round(f * 100)}") for f in (0.75, 0.50, 0.25)]
    aggs += [_on(4, 1, "swe_mm").alias("swe_apr01_mm"), _on(5, 1, "swe_mm").alias("swe_may01_mm"),
             _on(6, 1, "swe_mm").alias("swe_jun01_mm"), _on(6, 30, "swe_mm").alias("swe_jun30_mm"),
             F.sum("precip_mm").alias("precip_mm"), F.sum("snowfall_mm").alias("snowfall_mm"),
             F.sum(F.when(winter, c("snowfall_mm"))).alias("snowfall_oct_mar_mm"), F.sum("melt_mm").alias("melt_mm"),
             _on(3, 31, "retention_fraction").alias("retention_mar31"),
             _on(6, 30, "retention_fraction").alias("retention_jun30"),
             F.count_if(gain).alias("accumulation_event_count"),
             F.avg(F.when(gain, c("dswe_mm_day"))).alias("mean_accumulation_event_mm_day"),
             F.sum("swe_gain_mm_day").alias("cumulative_gain_mm"), F.count_if(loss).alias("ablation_event_count"),
             F.avg(F.when(loss, c("swe_loss_mm_day"))).alias("mean_ablation_event_mm_day"),
             F.sum("swe_loss_mm_day").alias("cumulative_loss_mm"), F.max("_loss7").alias("max_7day_loss_mm"),
             F.avg("fractional_swe_loss").alias("mean_fractional_loss"),
             F.avg(F.when(spring, c("effective_albedo"))).alias("spring_mean_albedo"),
             F.sum(F.when(spring, c("incoming_sw_energy_mj_m2"))).alias("spring_incoming_mj_m2"),
             F.sum(F.when(spring, c("absorbed_sw_energy_mj_m2"))).alias("spring_absorbed_mj_m2")]
    if "sca_gt_10mm" in daily.columns:
        aggs += [F.min(F.when(after & (c("sca_gt_10mm") <= p), c("date"))).alias(f"post_peak_area_below_{round(p * 100)}")
                 for p in cover_levels]
    if "cover_mean" in daily.columns:
        aggs += [F.min(F.when(after & (c("cover_mean") <= p), c("date"))).alias(f"post_peak_cover_below_{round(p * 100)}")
                 for p in cover_levels]
    if "snow_albedo" in daily.columns:
        aggs += [F.avg(F.when(spring, c("snow_albedo"))).alias("spring_snow_albedo"),
                 F.sum(F.when(spring, c("snow_absorbed_mj_m2"))).alias("spring_snow_absorbed_mj_m2")]
    out = rows.groupBy(*keys).agg(*aggs)
    for f in (75, 50, 25):
        out = out.withColumn(f"days_peak_to_{f}pct", F.datediff(f"_hit{f}", "peak_date")).drop(f"_hit{f}")
    return out.withColumn("snowfall_fraction", F.when(c("precip_mm") > 0, F.try_divide(c("snowfall_mm"), c("precip_mm"))))


def summary_anomalies(summary: DataFrame, first: int, second: int) -> DataFrame:
    """Numeric summary columns: second minus first year per source, and the source difference of that."""
    from pyspark.sql import types as T

    numeric = [f.name for f in summary.schema.fields
               if isinstance(f.dataType, T.NumericType) and f.name != "water_year"]
    long = (summary.select("source", "water_year", *[F.col(c).cast("double").alias(c) for c in numeric])
            .unpivot(["source", "water_year"], numeric, "metric", "value"))
    year = lambda y: F.max(F.when(F.col("water_year") == y, F.col("value")))
    per = long.groupBy("metric", "source").agg((year(second) - year(first)).alias("year_anomaly"))
    side = lambda s: F.max(F.when(F.col("source") == s, F.col("year_anomaly")))
    return per.groupBy("metric").agg(side("I").alias("anomaly_I"), side("N").alias("anomaly_N"),
                                     (side("N") - side("I")).alias("double_difference"))


