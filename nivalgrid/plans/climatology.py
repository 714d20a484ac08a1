"""A focus year against the years before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar as cal
from ..operators import series

# Reported metrics (label, unit, whether a percentage makes sense).
SPECIAL_METRICS = {
    "precip_total_mm": ("Accumulated precipitation", "mm", True),
    "temperature_mean_c": ("Average daily temperature", "degC", False),
    "incoming_sw_energy_mj_m2": ("Incoming shortwave energy", "MJ/m2", True),
    "incoming_lw_energy_mj_m2": ("Incoming longwave energy", "MJ/m2", True),
}
ROLLED = ("temperature_mean_c", "incoming_sw_mean_w_m2", "incoming_lw_mean_w_m2", "precip_mm_day")
CLIMATOLOGY_COLUMNS = ("precip_accum_oct1_mm", "precip_mm_day_7day", "temperature_mean_c_7day",
                       "incoming_sw_mean_w_m2_7day", "incoming_lw_mean_w_m2_7day")


def window_metrics(daily: DataFrame, windows: dict[str, tuple[str, str]] | None = None, drop_feb29: bool = False,
                   on_incomplete: str = "error") -> DataFrame:
    """Totals and means per water year and window, with the expected day count checked.

    A day falls into every window that covers it: the few windows are literals,
    so the rows expand in place instead of a range join. ``on_incomplete``:
    ``error`` fails, ``flag`` only reports.
    """
    windows = windows or cal.NAMED_WINDOWS
    rows = daily.where(~cal.is_feb29("date")) if drop_feb29 else daily
    inside = F.array_compact(F.array(*[
        F.when(cal.in_season("date", "water_year", lo, hi), F.struct(
            F.lit(name).alias("window"), cal.season_date("water_year", lo).alias("start_date"),
            cal.season_date("water_year", hi).alias("end_date")))
        for name, (lo, hi) in windows.items()]))
    long = rows.withColumn("_w", F.explode(inside)).select("*", "_w.*")
    leap = cal.season_date("water_year", "03-01")
    has_feb29 = ((F.dayofmonth(F.date_sub(leap, 1)) == 29)
                 & F.date_sub(leap, 1).between(F.col("start_date"), F.col("end_date")))
    expected = F.datediff("end_date", "start_date") + 1
    if drop_feb29:
        expected = expected - F.when(has_feb29, 1).otherwise(0)
    out = (long.withColumn("expected_days", expected)
           .groupBy("water_year", "window", "start_date", "end_date", "expected_days").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("precip_mm_day").alias("precip_total_mm"),
        F.avg("temperature_mean_c").alias("temperature_mean_c"),
        F.avg("incoming_sw_mean_w_m2").alias("incoming_sw_mean_w_m2"),
        F.sum("incoming_sw_energy_mj_m2_day").alias("incoming_sw_energy_mj_m2"),
        F.avg("incoming_lw_mean_w_m2").alias("incoming_lw_mean_w_m2"),
        F.sum("incoming_lw_energy_mj_m2_day").alias("incoming_lw_energy_mj_m2")))
    if on_incomplete == "error":
        wrong = F.raise_error(F.concat(F.lit("incomplete window "), F.col("window"), F.lit(" in water year "),
                                       F.col("water_year").cast("string"))).cast("bigint")
        return out.withColumn("n_days", F.when(F.col("n_days") == F.col("expected_days"), F.col("n_days")).otherwise(wrong))
    return out.withColumn("complete", F.col("n_days") == F.col("expected_days"))


def specialness(metrics: DataFrame, focus_wy: int, columns: Sequence[str] = tuple(SPECIAL_METRICS)) -> DataFrame:
    """Anomaly, percentage, z-score and rank of the focus year per window and metric."""
    long = metrics.select("water_year", "window", *columns).unpivot(
        ["water_year", "window"], list(columns), "metric", "value").where(F.col("value").isNotNull())
    order = Window.partitionBy("window", "metric").orderBy(F.col("value").desc(), "water_year")
    ranked = long.withColumn("_rank", F.row_number().over(order))
    focus, hist = F.col("water_year") == focus_wy, F.col("water_year") < focus_wy
    h = F.when(hist, F.col("value"))
    out = ranked.groupBy("window", "metric").agg(
        F.max(F.when(focus, F.col("value"))).alias("focus_value"), F.avg(h).alias("historical_mean"),
        F.percentile(h, 0.5).alias("historical_median"),
        F.when(F.count(h) >= 2, F.stddev_samp(h)).alias("historical_std"),
        F.max(F.when(focus, F.col("_rank"))).alias("rank_highest_1"), F.count(F.lit(1)).alias("rank_n_years"))
    anomaly = F.col("focus_value") - F.col("historical_mean")
    percent = F.col("metric").isin(*[m for m in columns if SPECIAL_METRICS.get(m, ("", "", True))[2]])
    return (out.where(F.col("focus_value").isNotNull()).withColumn("anomaly", anomaly)
            .withColumn("percent_anomaly", F.when(percent, F.try_divide(anomaly, F.col("historical_mean")) * 100.0))
            .withColumn("zscore", F.when(F.col("historical_std") > 0,
                                         F.try_divide(anomaly, F.col("historical_std")))))


def with_rolling(daily: DataFrame, columns: Sequence[str] = ROLLED, keys: Sequence[str] = ("water_year",)) -> DataFrame:
    """Centred 7-row means inside each water year, from at least 4 values."""
    out = daily
    for c in columns:
        out = out.withColumn(f"{c}_7day", series.centered_mean(c, list(keys), min_periods=4))
    return out


def calendar_day_anomalies(daily: DataFrame, focus_wy: int, columns: Sequence[str] = CLIMATOLOGY_COLUMNS) -> DataFrame:
    """Focus-year values against the same calendar day of earlier years.

    History and focus are reduced together in one aggregation on
    (month_day, variable); a group holds one value per year.
    """
    long = daily.where(F.col("water_year") <= focus_wy).unpivot(
        ["date", "water_year", "month_day"], list(columns), "variable", "value")
    hist, focus = F.col("water_year") < focus_wy, F.col("water_year") == focus_wy
    h = F.when(hist, F.col("value"))
    out = long.groupBy("month_day", "variable").agg(
        F.max(F.when(focus, F.struct("date", "water_year", "value"))).alias("_f"),
        F.avg(h).alias("hist_mean"), F.percentile(h, 0.5).alias("hist_median"), F.min(h).alias("hist_min"),
        F.max(h).alias("hist_max"), F.percentile(h, 0.1).alias("hist_p10"), F.percentile(h, 0.9).alias("hist_p90"),
        F.when(F.count(h) >= 2, F.stddev_samp(h)).alias("hist_std"), F.count(h).alias("hist_n"))
    out = out.where(F.col("_f").isNotNull()).select(
        F.col("_f.date").alias("date"), F.col("_f.water_year").alias("water_year"), "month_day", "variable",
        F.col("_f.value").alias("focus_value"), "hist_mean", "hist_median", "hist_min", "hist_max", "hist_p10",
        "hist_p90", "hist_std", "hist_n")
    anomaly = F.col("focus_value") - F.col("hist_mean")
    return out.withColumn("anomaly", anomaly).withColumn(
        "zscore", F.when(F.col("hist_std") > 0, F.try_divide(anomaly, F.col("hist_std"))))


def extremes(anomalies: DataFrame) -> DataFrame:
    """Largest positive and negative anomaly and largest |z| per variable; ties go to the earliest date."""
    day = cal.day_number("date")
    row = [F.col("date"), F.col("focus_value"), F.col("hist_mean"), F.col("anomaly"), F.col("zscore")]
    up = F.when(F.col("anomaly").isNotNull(), F.struct(F.col("anomaly").alias("k"), (-day).alias("d"), *row))
    down = F.when(F.col("anomaly").isNotNull(), F.struct(F.col("anomaly").alias("k"), day.alias("d"), *row))
    far = F.when(F.col("zscore").isNotNull(), F.struct(F.abs("zscore").alias("k"), (-day).alias("d"), *row))
    found = anomalies.groupBy("variable").agg(F.max(up).alias("a"), F.min(down).alias("b"), F.max(far).alias("c"))
    items = F.array(*[F.struct(F.lit(t).alias("extreme_type"), F.col(k).alias("r")) for t, k in (
        ("largest_positive_anomaly", "a"), ("largest_negative_anomaly", "b"), ("largest_absolute_zscore", "c"))])
    return (found.select("variable", F.explode(items).alias("_x")).where(F.col("_x.r").isNotNull())
            .select("variable", "_x.extreme_type", *[F.col(f"_x.r.{c}").alias(c) for c in
                                                     ("date", "focus_value", "hist_mean", "anomaly", "zscore")]))
