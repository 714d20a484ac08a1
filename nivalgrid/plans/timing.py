"""Timing of melt-out, release and streamflow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import series
from ..operators.relate import join_three
from ..operators.scale import centered_row_means
from .accumulation import side_by_side


def depletion_by_source(daily: DataFrame, threshold: float = 10.0, run_days: int = 7) -> DataFrame:
    """Depletion metrics of both sources per water year, side by side, with the change in t50."""
    dep = series.depletion(daily, ["source", "water_year"], "swe_mm", threshold=threshold, run_days=run_days)
    cols = [c for c in dep.columns if c not in ("source", "water_year")]
    wide = side_by_side(dep, ["water_year"], cols)
    return wide.withColumn("delta_t50_days", F.col("days_to_50_N") - F.col("days_to_50_I"))


def linkage(daily: DataFrame, gauge: DataFrame, release: str = "release_mm", start_md: str = "03-01",
            end_md: str = "09-30", analysis_end: str | None = None, threshold: float = 10.0,
            run_days: int = 7) -> DataFrame:
    """Dates of half melt-out, half release and half streamflow, and their lags."""
    dep = series.depletion(daily, ["source", "water_year"], "swe_mm", threshold=threshold, run_days=run_days)
    swe50 = dep.select("source", "water_year",
                       F.date_add("peak_date", F.col("days_to_50")).alias("swe50"))
    start, end = cal.season_date("water_year", start_md), cal.season_date("water_year", end_md)
    if analysis_end is not None:
        end = F.least(end, F.lit(analysis_end).cast("date"))
    inside = F.col("date").between(start, end)
    half = series.half_dates(daily.where(inside), ["source", "water_year"], {"release50": release})
    both = swe50.join(half, ["source", "water_year"], "left")
    wide = side_by_side(both, ["water_year"], ["swe50", "release50"])
    flow = series.half_dates(gauge.where(inside), ["water_year"], {"gauge50": "discharge_m3_day"})
    out = wide.join(flow, "water_year", "left")
    lag = lambda a, b: F.datediff(F.col(a), F.col(b))
    return (out.withColumn("release_lag_I_days", lag("release50_I", "swe50_I"))
            .withColumn("release_lag_N_days", lag("release50_N", "swe50_N"))
            .withColumn("delta_swe50_days", lag("swe50_N", "swe50_I"))
            .withColumn("delta_release50_days", lag("release50_N", "release50_I"))
            .withColumn("release50_I_minus_gauge50_days", lag("release50_I", "gauge50"))
            .withColumn("release50_N_minus_gauge50_days", lag("release50_N", "gauge50")))


def streamflow(first: DataFrame, second: DataFrame, gauge: DataFrame, rolling_days: int = 7,
               derive_wy: bool = False) -> DataFrame:
    """Release of two sources and gauge flow: outer join, centred rolling mean, share of the yearly maximum.

    The water year comes from the first source, so a date that only the others
    have carries none and is never normalised, unless ``derive_wy`` is set.
    """
    columns = {"rolling_I": "volume_I", "rolling_N": "volume_N", "rolling_gauge": "discharge_m3_day"}
    merged = join_three(first.select("date", "water_year", "volume_I"), second.select("date", "volume_N"),
                        gauge.select("date", "discharge_m3_day"))
    if derive_wy:
        merged = merged.withColumn("water_year", F.coalesce("water_year", cal.water_year("date")))
    rolled = centered_row_means(merged, "date", F.trunc("date", "month"), columns, half=rolling_days // 2)
    for c in columns:
        share = series.share_of_maximum(c, ["water_year"])
        rolled = rolled.withColumn(c.replace("rolling_", "normalized_"),
                                   F.when(F.col("water_year").isNotNull(), share))
    return rolled
