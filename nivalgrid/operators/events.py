"""Paired daily change events of two sources, on cells or stations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import physics, stats
from . import series
from .scale import counts_cdf, exact_percentiles


def event_window(df: DataFrame, start_md: str, end_md: str, date: str = "date", wy: str = "water_year",
                 lead_days: int = 1) -> DataFrame:
    """Season window with the preceding day, so that its first change exists."""
    return df.where(cal.in_season(date, wy, start_md, end_md, lead_days))


def change_events(df: DataFrame, keys: Sequence[str], x: str, y: str, mode: str, threshold: float = 1.0,
                  rule: str = "either", consecutive: bool = False, date: str = "date") -> DataFrame:
    """Rows whose daily change exceeds the threshold on either / both sides.

    ``mode`` is ``accumulation`` (gain) or ``ablation`` (loss). ``consecutive``
    asks for calendar neighbours; otherwise the previous row counts. Adds
    ``change_x`` and ``change_y``.
    """
    if mode not in ("accumulation", "ablation") or rule not in ("either", "both"):
        raise ValueError("mode is accumulation/ablation, rule is either/both")
    sign = -1.0 if mode == "ablation" else 1.0

    def change(c: str) -> Column:
        if consecutive:
            return series.signed_loss(c, keys, date) * (-sign)
        return series.row_difference(c, keys, date) * sign

    out = df.withColumn("change_x", change(x)).withColumn("change_y", change(y))
    a, b = F.col("change_x") > threshold, F.col("change_y") > threshold
    both_present = F.col("change_x").isNotNull() & F.col("change_y").isNotNull()
    return out.where(both_present & ((a | b) if rule == "either" else (a & b)))


def agreement(df: DataFrame, keys: Sequence[str], x: str = "change_x", y: str = "change_y",
              prefix: str = "") -> DataFrame:
    """Count, correlation and mean bias (y minus x) of complete pairs."""
    return df.groupBy(*keys).agg(stats.pair_count(x, y).alias(f"{prefix}n"),
                                 stats.pearson(x, y).alias(f"{prefix}pearson_r"),
                                 stats.mean_bias(x, y).alias(f"{prefix}mean_bias"))


def cell_events_by_bin(pairs: DataFrame, swe_i: str, swe_n: str, cover: str, bin_of, start_md: str,
                       end_md: str, threshold: float = 1.0, rule: str = "either",
                       cell: Sequence[str] = ("water_year", "row", "col")) -> DataFrame:
    """Ablation events with the class of the cover at the start of the interval."""
    rows = (pairs.withColumn("loss_i", series.signed_loss(swe_i, cell))
            .withColumn("loss_n", series.signed_loss(swe_n, cell))
            .withColumn("bin_code", bin_of(series.start_state(cover, cell))))
    a, b = F.col("loss_i") > threshold, F.col("loss_n") > threshold
    keep = (a | b) if rule == "either" else (a & b)
    return (rows.where(cal.in_season("date", "water_year", start_md, end_md)
                       & F.col("loss_i").isNotNull() & F.col("loss_n").isNotNull() & keep
                       & F.col("bin_code").isNotNull())
            .withColumn("extra_loss", F.col("loss_n") - F.col("loss_i")))


def bin_scaffold(years: DataFrame, bins: int) -> DataFrame:
    """Every (water year, bin), so that empty bins stay in the result.

    ``years`` is any table with a ``water_year`` column; a small one saves a pass
    over the cells.
    """
    return years.select("water_year").distinct().withColumn(
        "bin_code", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))


def summarize_bins(events: DataFrame, years: DataFrame, bins: int) -> DataFrame:
    """Event statistics per water year and bin, including empty bins.

    A bin may hold any number of cell-days: moments combine on the map side and
    quantiles come from the exact distributed routine.
    """
    keys = ["water_year", "bin_code"]
    moments = events.groupBy(*keys).agg(
        F.count("extra_loss").alias("event_n"), F.avg("loss_i").alias("mean_loss_i"),
        F.avg("loss_n").alias("mean_loss_n"), F.avg("extra_loss").alias("mean_extra_loss"),
        F.avg(F.when(F.col("extra_loss") > 0, 1.0).otherwise(0.0)).alias("fraction_extra_positive"),
        stats.pearson("loss_i", "loss_n").alias("pearson_r"))
    quantiles = exact_percentiles(events, keys, "extra_loss", {
        "q25_extra_loss": 0.25, "median_extra_loss": 0.5, "q75_extra_loss": 0.75})
    return (bin_scaffold(years, bins).join(moments, keys, "left").join(quantiles, keys, "left")
            .withColumn("event_n", F.coalesce("event_n", F.lit(0))))


def focus_vs_baseline(year_bins: DataFrame, focus_wy: int, first_wy: int, last_wy: int) -> DataFrame:
    """Per bin: the focus year next to mean and quartiles of the baseline years."""
    focus = F.col("water_year") == focus_wy
    base = F.col("water_year").between(first_wy, last_wy)
    mean_b, count_b = F.when(base, F.col("mean_extra_loss")), F.when(base, F.col("event_n").cast("double"))

    def of_focus(c: str) -> Column:
        return F.max(F.when(focus, F.col(c)))

    return year_bins.groupBy("bin_code").agg(
        of_focus("mean_extra_loss").alias("focus_mean"), of_focus("q25_extra_loss").alias("focus_q25"),
        of_focus("q75_extra_loss").alias("focus_q75"), of_focus("event_n").alias("focus_events"),
        F.avg(mean_b).alias("baseline_mean_of_means"),
        F.percentile(mean_b, 0.25).alias("baseline_q25_of_means"),
        F.percentile(mean_b, 0.75).alias("baseline_q75_of_means"),
        F.avg(count_b).alias("baseline_mean_events"), F.percentile(count_b, 0.25).alias("baseline_q25_events"),
        F.percentile(count_b, 0.75).alias("baseline_q75_events"),
        F.count(mean_b).alias("baseline_years_with_mean"), F.count(count_b).alias("baseline_years_with_count"))


def histogram2d(df: DataFrame, keys: Sequence[str], x: str, y: str, bins: int = 65) -> DataFrame:
    """Counts on a bins x bins lattice between the group extremes (last edge closed)."""
    keys = list(keys)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    lims = rows.groupBy(*keys).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"),
                                   F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    joined = rows.join(lims, keys)

    def place(v: str, lo: str, hi: str) -> Column:
        flat = F.col(lo) == F.col(hi)
        a = F.when(flat, F.col(lo) - 0.5).otherwise(F.col(lo))
        span = F.when(flat, F.lit(1.0)).otherwise(F.col(hi) - F.col(lo))
        return F.least(F.floor((F.col(v) - a) / span * bins).cast("int"), F.lit(bins - 1))

    return (joined.withColumn("bin_x", place(x, "_x0", "_x1")).withColumn("bin_y", place(y, "_y0", "_y1"))
            .groupBy(*keys, "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("pair_count")))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks; NULL below 3 pairs or 2 distinct values.

    Equal pairs are collapsed first. Both columns then go into one long table of tagged
    values that is ranked in one pass over sampled ranges, and the ranks are joined once to the
    long pairs, so no group is sorted in one task and a value held by many pairs is
    still one row of the ranking.
    """
    keys = list(keys)
    # groups without a key are in no result; said here, ranks and pairs read one exchange
    whole = [F.col(c).isNotNull() for c in (*keys, x, y)]
    pairs = (df.where(reduce(and_, whole))
             .groupBy(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count(F.lit(1)).alias("_copies")))
    tagged = F.array(F.struct(F.lit(0).alias("_tag"), F.col("_x").alias("_v")), F.struct(F.lit(1).alias("_tag"), F.col("_y").alias("_v")))
    long = pairs.select(*keys, "_x", "_y", "_copies", F.explode(tagged).alias("_t")).select(*keys, "_x", "_y", "_copies", "_t._tag", "_t._v")
    counts = long.groupBy(*keys, "_tag", "_v").agg(F.sum("_copies").alias("cnt"))
    ranks = counts_cdf(counts, [*keys, "_tag"], "_v").select(
        *keys, "_tag", "_v", (F.col("before") + (F.col("cnt") + 1) / 2.0).alias("_r"))
    side = lambda tag: F.max(F.when(F.col("_tag") == tag, F.col("_r")))
    joined = long.join(ranks, [*keys, "_tag", "_v"]).groupBy(*keys, "_x", "_y").agg(
        side(0).alias("_rx"), side(1).alias("_ry"), F.max("_copies").alias("_copies"))
    w = F.col("_copies").cast("double")
    n, sx, sy = F.sum(w), F.sum(w * F.col("_rx")), F.sum(w * F.col("_ry"))
    sums = joined.groupBy(*keys).agg(
        n.alias("n"), F.sum(w * F.col("_rx") * F.col("_ry")).alias("_xy"),
        F.sum(w * F.col("_rx") * F.col("_rx")).alias("_xx"), F.sum(w * F.col("_ry") * F.col("_ry")).alias("_yy"),
        sx.alias("_sx"), sy.alias("_sy"))
    vx = F.col("_xx") - F.col("_sx") * F.col("_sx") / F.col("n")
    vy = F.col("_yy") - F.col("_sy") * F.col("_sy") / F.col("n")
    cov = F.col("_xy") - F.col("_sx") * F.col("_sy") / F.col("n")
    rho = F.when((F.col("n") >= 3) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    return sums.select(*keys, F.col("n").cast("bigint").alias("n"), rho.alias("spearman_rho"))


def relationship_by_variable(df: DataFrame, keys: Sequence[str], target: str, variables: Sequence[str],
                             condition: Column) -> DataFrame:
    """Correlation of a target with each of several variables, from one unpivot."""
    rows = df.where(condition & F.col(target).isNotNull()).select(*keys, target, *variables)
    long = rows.unpivot([*keys, target], list(variables), "variable", "x")
    return long.groupBy(*keys, "variable").agg(
        stats.pair_count("x", target).alias("n"), stats.pearson("x", target).alias("pearson_r"),
        F.avg(stats.paired("x", target)[0]).alias("x_mean"), F.avg(stats.paired("x", target)[1]).alias("y_mean"))


COVER_BINS = {5: physics.cover_bin5, 10: physics.cover_bin10}
