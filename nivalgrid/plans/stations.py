"""Station series against the two gridded sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import stats
from ..operators import events, series
from .accumulation import side_by_side

SERIES = ["source", "station_id", "water_year"]
SOURCES = ("S", "I", "N")


def annual_by_source(station_day: DataFrame, start_md: str = "11-01", end_md: str = "03-15",
                     swe_threshold: float = 10.0, depth_threshold: float = 25.0, run_days: int = 7,
                     depth_run_days: int | None = None) -> DataFrame:
    """Window precipitation, SWE and depth depletion, and peak SWE over precipitation to the own peak.

    The precipitation needs every calendar day from 1 October to the peak. All
    of it comes from one shuffle on the series keys.
    """
    depth_run = depth_run_days or run_days
    rows = series.mark_depletion(station_day, SERIES, "swe_mm", threshold=swe_threshold, run_days=run_days)
    rows = series.mark_depletion(rows, SERIES, "snow_depth_mm", threshold=depth_threshold, run_days=depth_run,
                                 prefix="depth_")
    precip = F.when(F.col("date") <= F.col("peak_date"), F.col("precip_mm"))
    days = F.max(F.datediff("peak_date", cal.wy_start("water_year")) + 1)
    out = rows.groupBy(*SERIES).agg(
        F.sum(F.when(cal.in_season("date", "water_year", start_md, end_md), F.col("precip_mm"))).alias("window_precip_mm"),
        stats.complete_sum(precip, days).alias("precip_to_peak_mm"),
        F.coalesce(F.count(precip) == days, F.lit(False)).alias("precip_complete_to_peak"),
        *series.depletion_aggregates("swe_mm", run_days=run_days),
        *series.depletion_aggregates("snow_depth_mm", run_days=depth_run, fractions=(), prefix="depth_"))
    ratio = F.when(F.col("precip_to_peak_mm") > 0, F.try_divide(F.col("peak_value"), F.col("precip_to_peak_mm")))
    wy = F.col("water_year")
    return out.drop("depth_peak_value", "depth_peak_date").withColumns({
        "f_swe_precip": ratio, "peak_dowy": cal.day_of_water_year("peak_date", wy),
        "disappearance_dowy": cal.day_of_water_year("disappearance_date", wy)})


def pairs_with_station(station_day: DataFrame, value: str = "swe_mm") -> DataFrame:
    """Outer pairs (station value, model value) for each model, one row per date that either has."""
    has = lambda s: F.max(F.when(F.col("source") == s, 1).otherwise(0))
    val = lambda s: F.max(F.when(F.col("source") == s, F.col(value)))
    wide = station_day.repartition("station_id", "water_year").groupBy("station_id", "water_year", "date").agg(
        *[has(s).alias(f"_has{s}") for s in SOURCES], *[val(s).alias(f"_v{s}") for s in SOURCES])
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"_has{m}").alias("has"), F.col(f"_v{m}").alias("model_value"))
                       for m in ("I", "N")])
    return (wide.withColumn("_m", F.explode(models))
            .where((F.col("_hasS") == 1) | (F.col("_m.has") == 1))
            .select("station_id", "water_year", "date", F.col("_m.model").alias("model"),
                    F.col("_vS").alias("station_value"), F.col("_m.model_value").alias("model_value")))


def event_agreement(station_day: DataFrame, accumulation: tuple[str, str] = ("11-01", "03-15"),
                    ablation: tuple[str, str] = ("04-01", "06-30"), threshold_accumulation: float = 1.0,
                    threshold_ablation: float = 1.0) -> DataFrame:
    """Mean SWE bias and event agreement of each model with the station, per water year."""
    keys = ["station_id", "water_year", "model"]
    pairs = pairs_with_station(station_day)
    out = pairs.groupBy(*keys).agg(stats.mean_bias("station_value", "model_value").alias("mean_swe_bias"))
    for mode, (lo, hi), limit in (("accumulation", accumulation, threshold_accumulation),
                                  ("ablation", ablation, threshold_ablation)):
        window = events.event_window(pairs, lo, hi)
        hits = events.change_events(window, keys, "station_value", "model_value", mode, limit)
        stat = events.agreement(hits, keys, prefix=f"{mode}_")
        out = out.join(stat, keys, "left").withColumn(f"{mode}_n", F.coalesce(f"{mode}_n", F.lit(0)))
    return out


def annual_wide(station_day: DataFrame, **options) -> DataFrame:
    """One row per station and water year: both of the above, sources as columns."""
    long = annual_by_source(station_day, **options)
    cols = [c for c in long.columns if c not in SERIES]
    wide = side_by_side(long, ["station_id", "water_year"], cols, labels=SOURCES)
    agree = event_agreement(station_day)
    measures = [c for c in agree.columns if c not in ("station_id", "water_year", "model")]
    vs = side_by_side(agree, ["station_id", "water_year"], measures, source="model")
    return wide.join(vs.withColumnsRenamed({f"{c}_{m}": f"{c}_{m}_vs_S" for c in measures for m in ("I", "N")}),
                     ["station_id", "water_year"], "left")


def disappearance_error(annual: DataFrame) -> DataFrame:
    """Model minus station disappearance date of the snow depth, in days."""
    wide = side_by_side(annual, ["station_id", "water_year"], ["depth_disappearance_date"], labels=SOURCES)
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.datediff(
        f"depth_disappearance_date_{m}", "depth_disappearance_date_S").alias("error_days")) for m in ("I", "N")])
    return wide.select("station_id", "water_year", F.explode(models).alias("_m")).select(
        "station_id", "water_year", "_m.model", "_m.error_days")


def comparison_series(station_day: DataFrame, envelope: DataFrame, value: str = "swe_mm") -> DataFrame:
    """Station and nearest model values with the fine-grid envelope, by date."""
    has = F.col("source")
    wide = station_day.groupBy("station_id", "water_year", "date").agg(
        F.max(F.when(has == "S", F.col(value))).alias("station_value"),
        F.max(F.when(has == "I", F.col(value))).alias("nearest_I"),
        F.max(F.when(has == "N", F.col(value))).alias("nearest_N"))
    return wide.join(envelope, ["station_id", "water_year", "date"], "left")


def accumulated(station_day: DataFrame) -> DataFrame:
    """SWE next to precipitation accumulated since 1 October, for every source."""
    return station_day.select(*SERIES, "date", "swe_mm",
                              series.running_sum("precip_mm", SERIES).alias("cumulative_precip_mm"))
