"""Daily series: differences, running sums, rolling means, peaks and crossings.

``keys`` name one series each (source, water year, station, cell ...). A window
partition therefore holds one row per day of one series, which the calendar
bounds; many series spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar as cal
from ..functions import stats


def ordered(keys: Sequence[str], date: str = "date"):
    return Window.partitionBy(*keys).orderBy(date)


def previous(value, keys, date="date") -> Column:
    return F.lag(value).over(ordered(keys, date))


def row_difference(value: str, keys, date="date") -> Column:
    """Change since the previous row, whatever the gap in days."""
    return F.col(value) - previous(value, keys, date)


def start_state(value: str, keys, date="date") -> Column:
    """Value on the day before; NULL when that day is absent."""
    gap = F.datediff(F.col(date), previous(date, keys, date))
    return F.when(gap == 1, previous(value, keys, date))


def signed_loss(value: str, keys, date="date") -> Column:
    """Day-before minus today; positive is loss, NULL across a calendar gap."""
    return start_state(value, keys, date) - F.col(value)


def running_sum(value: str, keys, date="date", missing: str = "skip") -> Column:
    """Cumulative sum within a series.

    ``skip``: NULL on missing rows, the sum continues after them.
    ``zero``: missing counts as zero on every row.
    """
    w = ordered(keys, date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if missing == "zero":
        return F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w)
    if missing == "skip":
        return F.when(F.col(value).isNotNull(), F.sum(value).over(w))
    raise ValueError("missing must be 'skip' or 'zero'")


def centered_mean(value: str, keys, date="date", half: int = 3, min_periods: int = 1) -> Column:
    """Centred row-based rolling mean inside a series."""
    w = ordered(keys, date).rowsBetween(-half, half)
    return F.when(F.count(value).over(w) >= min_periods, F.avg(value).over(w))


def trailing_full_sum(value: str, keys, date="date", length: int = 7) -> Column:
    """Trailing sum that needs a value on all ``length`` rows."""
    w = ordered(keys, date).rowsBetween(-(length - 1), 0)
    return F.when(F.count(value).over(w) == length, F.sum(value).over(w))


def share_of_maximum(value: str, keys) -> Column:
    top = F.max(value).over(Window.partitionBy(*keys))
    return F.when(top > 0, F.try_divide(F.col(value), top))


def with_peak(df: DataFrame, keys, value: str, date: str = "date") -> DataFrame:
    """Add ``peak_value`` and ``peak_date`` (earliest on a tie) to every row."""
    top = stats.peak(value, date).over(Window.partitionBy(*keys))
    return (df.withColumn("_peak", top)
            .withColumn("peak_value", F.col("_peak.v"))
            .withColumn("peak_date", stats.peak_date("_peak"))
            .drop("_peak"))


def mark_depletion(df: DataFrame, keys: Sequence[str], value: str, date: str = "date",
                   threshold: float = 10.0, run_days: int = 7, prefix: str = "") -> DataFrame:
    """Add the own peak of each series and the count of below-threshold days ending on each row."""
    day = cal.day_number(date)
    top = stats.peak(value, date).over(Window.partitionBy(*keys))
    rows = df.withColumn("_peak", top).withColumns({
        f"{prefix}peak_value": F.col("_peak.v"), f"{prefix}peak_date": stats.peak_date("_peak")}).drop("_peak")
    run = Window.partitionBy(*keys).orderBy(day).rangeBetween(-(run_days - 1), 0)
    below = (F.col(date) > F.col(f"{prefix}peak_date")) & (F.col(value) < F.lit(float(threshold)))
    return rows.withColumn(f"_{prefix}run", F.count(F.when(below, 1)).over(run))


def depletion_aggregates(value: str, date: str = "date", run_days: int = 7,
                         fractions: Sequence[float] = (0.75, 0.50, 0.25), prefix: str = "") -> list[Column]:
    """Aggregates that finish :func:`mark_depletion` per series."""
    top, when = F.col(f"{prefix}peak_value"), F.col(f"{prefix}peak_date")
    share = F.when(top > 0, F.try_divide(F.col(value), top))
    out = [F.max(top).alias(f"{prefix}peak_value"), F.max(when).alias(f"{prefix}peak_date"),
           F.min(F.when(F.col(f"_{prefix}run") >= run_days, F.date_sub(date, run_days - 1)))
           .alias(f"{prefix}disappearance_date")]
    out += [F.datediff(F.min(F.when((F.col(date) >= when) & (share <= f), F.col(date))), F.max(when))
            .alias(f"{prefix}days_to_{round(f * 100):d}") for f in fractions]
    return out


def depletion(df: DataFrame, keys: Sequence[str], value: str, date: str = "date",
              threshold: float = 10.0, run_days: int = 7,
              fractions: Sequence[float] = (0.75, 0.50, 0.25)) -> DataFrame:
    """Peak, days from the peak to fractions of it, and disappearance per series.

    Days to a fraction use present days only. Disappearance is the first day of
    ``run_days`` consecutive calendar days strictly below the threshold after
    the peak; a missing day breaks the run. One shuffle on ``keys``. A series
    without any value is absent.
    """
    keys = list(keys)
    rows = mark_depletion(df.select(*keys, date, value), keys, value, date, threshold, run_days)
    agg = rows.groupBy(*keys).agg(*depletion_aggregates(value, date, run_days, fractions))
    wy = cal.water_year("peak_date")
    return agg.where(F.col("peak_value").isNotNull()).withColumns({
        "peak_dowy": cal.day_of_water_year("peak_date", wy),
        "disappearance_dowy": cal.day_of_water_year("disappearance_date", wy)})


def half_dates(df: DataFrame, keys: Sequence[str], columns: dict[str, str],
               date: str = "date") -> DataFrame:
    """First date on which the running sum reaches half of the total.

    Missing and negative values are dropped; a total of zero gives NULL.
    ``columns`` maps an output date to its input column.
    """
    keys = list(keys)
    rows = df
    w = ordered(keys, date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    for i, source in enumerate(columns.values()):
        ok = F.col(source) >= 0
        rows = rows.withColumn(f"_run{i}", F.when(ok, F.sum(F.when(ok, F.col(source))).over(w)))
    for i in range(len(columns)):
        rows = rows.withColumn(f"_all{i}", F.max(f"_run{i}").over(whole))
    return rows.groupBy(*keys).agg(*[
        F.min(F.when((F.col(f"_all{i}") > 0) & (F.col(f"_run{i}") >= 0.5 * F.col(f"_all{i}")),
                     F.col(date))).alias(out)
        for i, out in enumerate(columns)])


def first_date_where(condition: Column, date="date") -> Column:
    """Aggregate: earliest date fulfilling a condition."""
    return F.min(F.when(condition, F.col(date)))


def normalized_curve(df: DataFrame, keys, value: str, date: str = "date") -> DataFrame:
    """Share of the own peak by days since it, from the peak onward."""
    rows = with_peak(df.where(F.col(value).isNotNull()), keys, value, date)
    return (rows.where((F.col("peak_value") > 0) & (F.col(date) >= F.col("peak_date")))
            .select(*keys, date, F.datediff(date, "peak_date").alias("days_since_peak"),
                    F.try_divide(F.col(value), F.col("peak_value")).alias("fraction_of_peak")))


def cumulative_fraction_curve(df: DataFrame, keys, value: str, date: str = "date",
                              wy: str = "water_year", start_md: str = "03-01") -> DataFrame:
    """Running share of the seasonal total by days since the season start."""
    start = cal.season_date(wy, start_md)
    rows = (df.where(F.col(date) >= start)
            .withColumn("_v", F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0))))
    total = F.sum("_v").over(Window.partitionBy(*keys))
    run = running_sum("_v", keys, date, "zero")
    return rows.select(*keys, date, F.datediff(date, start).alias("days_since_start"),
                       F.when(total > 0, F.try_divide(run, total)).alias("cumulative_fraction"))


def post_peak_chain(df: DataFrame, keys, swe: str, columns: Sequence[str], date="date") -> DataFrame:
    """State share and companion variables by days after the own peak."""
    rows = with_peak(df, keys, swe, date).where(F.col(date) >= F.col("peak_date"))
    return rows.select(*keys, date, F.datediff(date, "peak_date").alias("days_after_peak"),
                       F.when(F.col("peak_value") > 0,
                              F.try_divide(F.col(swe), F.col("peak_value"))).alias("swe_fraction"), *columns)


def season_diagnostics(df: DataFrame, keys: Sequence[str], date: str = "date",
                       event_threshold: float = 1.0, fractional_minimum: float = 10.0) -> DataFrame:
    """Gains, losses, event flags, season-to-date sums and retention per series.

    Needs ``swe_mm, precip_mm, snowfall_mm, melt_mm``. All windows share one
    partitioning and one sort.
    """
    keys = list(keys)
    w = ordered(keys, date)
    d = row_difference("swe_mm", keys, date)
    c, change = F.col, F.col("dswe_mm_day")
    out = df.withColumns({"previous_swe_mm": previous("swe_mm", keys, date), "dswe_mm_day": d})
    out = out.withColumns({
        "swe_gain_mm_day": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))),
        "swe_loss_mm_day": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))),
        "is_accumulation_event": F.coalesce(change > event_threshold, F.lit(False)),
        "is_ablation_event": F.coalesce(change < -event_threshold, F.lit(False))})
    out = out.withColumns({
        "fractional_swe_loss": F.when(c("is_ablation_event") & (c("previous_swe_mm") >= fractional_minimum),
                                      F.try_divide(c("swe_loss_mm_day"), c("previous_swe_mm"))),
        **{f"cumulative_{x}": running_sum(x, keys, date, "zero")
           for x in ("precip_mm", "snowfall_mm", "melt_mm", "swe_gain_mm_day", "swe_loss_mm_day")}})
    initial = F.coalesce(F.first("swe_mm").over(w), F.lit(0.0))
    snow, precip = c("cumulative_snowfall_mm"), c("cumulative_precip_mm")
    return out.withColumns({
        "cumulative_snowfall_fraction": F.when(precip > 0, F.try_divide(snow, precip)),
        "retention_fraction": F.when(snow > 1.0, F.try_divide(c("swe_mm") - initial, snow)),
        "swe_normalized_by_own_peak": share_of_maximum("swe_mm", keys),
        "dswe_7day_mean_mm_day": centered_mean("dswe_mm_day", keys, date)})
