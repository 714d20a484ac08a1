"""Daily separation of two sources on their common cells.

All basin columns come from one aggregation per date with conditional sums; the
cell-level differences share one partitioning by (water_year, row, col).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import physics, stats
from ..operators import events, series
from ..operators.areal import on_support

CELL = ("water_year", "row", "col")
FOCUS = ("02-01", "04-30")


def cell_columns(pairs: DataFrame, snow_threshold: float = 10.0, event_threshold: float = 1.0) -> DataFrame:
    """Derived cell-day table: densities, snow masks, signed losses, starting cover and its bin."""
    c = F.col
    new: dict[str, Column] = {"cover_start": series.start_state("cover_n", CELL)}
    for s in ("i", "n"):
        new[f"density_{s}"] = physics.bulk_density(f"swe_mm_{s}", f"snow_depth_mm_{s}", snow_threshold)
        new[f"snow_{s}"] = F.coalesce(c(f"swe_mm_{s}") >= snow_threshold, F.lit(False))
        new[f"loss_{s}"] = series.signed_loss(f"swe_mm_{s}", CELL)
    out = pairs.withColumns(new)
    event = (c("loss_i").isNotNull() & c("loss_n").isNotNull()
             & ((c("loss_i") > event_threshold) | (c("loss_n") > event_threshold)))
    return out.withColumns({
        "cover_bin": physics.cover_bin5("cover_start"), "snow_pair": c("snow_i") & c("snow_n"), "event": event,
        "density_pair": c("density_i").isNotNull() & c("density_n").isNotNull()})


def basin_daily(cells: DataFrame, weights: DataFrame, minimum_incoming: float = 0.05,
                focus: tuple[str, str] = FOCUS) -> DataFrame:
    """Basin columns per date from :func:`cell_columns`."""
    c = F.col

    def mean(v: str, where: Column | None = None) -> Column:
        return stats.weighted_mean(v, "weight") if where is None else stats.weighted_mean_where(v, "weight", where)

    def both(a: str, b: str, where: Column | None = None) -> Column:
        ok = c(a).isNotNull() & c(b).isNotNull()
        return ok if where is None else ok & where

    total = F.max("total_weight")
    aggs: dict[str, Column] = {}
    for name, col in (("swe", "swe_mm"), ("snow_depth", "snow_depth_mm"), ("loss", "loss"), ("melt", "melt_mm")):
        ok = both(f"{col}_i", f"{col}_n")
        aggs[f"{name}_i"], aggs[f"{name}_n"] = mean(f"{col}_i", ok), mean(f"{col}_n", ok)
    ok = both("density_i", "density_n", c("density_pair"))
    for s in ("i", "n"):
        aggs[f"density_{s}_pair"] = mean(f"density_{s}", ok)
        aggs[f"density_{s}_own"] = mean(f"density_{s}")
        aggs[f"release_{s}"] = mean(f"release_mm_{s}")
        aggs[f"snow_area_{s}"] = stats.fraction_of_all(c(f"snow_{s}"), "weight", total)
        for kind in ("incoming", "absorbed"):
            e = f"{kind}_sw_energy_mj_m2"
            aggs[f"{kind}_{s}"] = mean(f"{e}_{s}")
            aggs[f"snow_{kind}_{s}"] = mean(f"{e}_{s}", both(f"{e}_i", f"{e}_n", c("snow_pair")))
    aggs["cover_mean"] = mean("cover_n")
    aggs["cover_on_snow"] = mean("cover_n", c("snow_n"))
    aggs["density_pair_area"] = stats.fraction_of_all(c("density_pair"), "weight", total)
    aggs["snow_pair_area"] = stats.fraction_of_all(c("snow_pair"), "weight", total)
    aggs["event_cells"] = F.count_if(c("event"))
    day = on_support(cells, weights).groupBy("water_year", "date").agg(*[v.alias(k) for k, v in aggs.items()])

    day = day.withColumns({
        f"{p}albedo_{s}": physics.effective_albedo(f"{p}incoming_{s}", f"{p}absorbed_{s}", minimum_incoming)
        for p in ("", "snow_") for s in ("i", "n")})
    deltas = {f"delta_{a}": c(f"{a}_n") - c(f"{a}_i") for a in (
        "swe", "snow_depth", "loss", "absorbed", "snow_absorbed", "albedo", "snow_albedo")}
    deltas["delta_density_pair"] = c("density_n_pair") - c("density_i_pair")
    deltas["in_focus_window"] = cal.in_season("date", "water_year", *focus)
    return day.withColumns(deltas).withColumn("delta_swe_change", series.row_difference("delta_swe", ["water_year"]))


def density_counts(cells: DataFrame) -> DataFrame:
    """Valid, paired and above-water density cell-days with maxima, per water year."""
    return cells.groupBy("water_year").agg(
        F.count("density_i").alias("density_i_valid"), F.count("density_n").alias("density_n_valid"),
        F.count_if("density_pair").alias("density_pairs"),
        F.count_if(F.col("density_i") > 1000.0).alias("density_i_above_water"),
        F.count_if(F.col("density_n") > 1000.0).alias("density_n_above_water"),
        F.max("density_i").alias("density_i_max"), F.max("density_n").alias("density_n_max"))


def binned_events(cells: DataFrame, weights: DataFrame, focus: tuple[str, str] = FOCUS) -> DataFrame:
    """Events of the focus window on the support, with their cover class."""
    rows = on_support(cells, weights)
    return (rows.where(F.col("event") & F.col("cover_bin").isNotNull() & cal.in_season("date", "water_year", *focus))
            .withColumn("bin_code", F.col("cover_bin")).withColumn("extra_loss", F.col("loss_n") - F.col("loss_i")))


def event_summary(cells: DataFrame, weights: DataFrame, years: DataFrame,
                  focus: tuple[str, str] = FOCUS) -> DataFrame:
    """Event statistics per year and cover class; ``years`` lists the water years to report."""
    return events.summarize_bins(binned_events(cells, weights, focus), years, 5)


def cover_relationships(cells: DataFrame, weights: DataFrame, focus: tuple[str, str] = FOCUS) -> DataFrame:
    """Correlation of the cover with SWE, depth and density where some cover exists."""
    rows = on_support(cells, weights).where(cal.in_season("date", "water_year", *focus))
    return events.relationship_by_variable(rows, ["water_year"], "cover_n",
                                           ["swe_mm_n", "snow_depth_mm_n", "density_n"], F.col("cover_n") > 0)


def focus_summary(daily: DataFrame, bins: DataFrame, minimum_incoming: float = 0.05,
                  thresholds: Sequence[float] = (0.90, 0.75, 0.50)) -> DataFrame:
    """Annual summary of the focus window, with first dates of low mean cover and seasonal albedos."""
    c = F.col
    first = [F.min(F.when(c("cover_mean") < t, c("date"))).alias(f"first_cover_below_{round(t * 100)}") for t in thresholds]
    sums = [F.sum(x).alias(x) for x in ("incoming_i", "incoming_n", "absorbed_i", "absorbed_n", "snow_incoming_i",
                                        "snow_incoming_n", "snow_absorbed_i", "snow_absorbed_n", "melt_i", "melt_n",
                                        "release_i", "release_n")]
    out = daily.where("in_focus_window").groupBy("water_year").agg(
        F.min("date").alias("focus_start"), F.max("date").alias("focus_end"),
        F.avg("delta_swe").alias("mean_delta_swe"), F.min("delta_swe").alias("min_delta_swe"),
        F.avg("delta_snow_depth").alias("mean_delta_snow_depth"), F.avg("delta_density_pair").alias("mean_delta_density"),
        F.avg("cover_mean").alias("mean_cover"), *first, *sums)
    out = out.withColumns({
        f"{p}albedo_{s}": physics.effective_albedo(f"{p}incoming_{s}", f"{p}absorbed_{s}", minimum_incoming)
        for p in ("", "snow_") for s in ("i", "n")})
    names = [f"first_cover_below_{round(t * 100)}" for t in thresholds]
    out = out.withColumns({
        "delta_albedo": c("albedo_n") - c("albedo_i"), "delta_absorbed": c("absorbed_n") - c("absorbed_i"),
        "snow_delta_absorbed": c("snow_absorbed_n") - c("snow_absorbed_i"),
        **{f"{n}_dowy": cal.day_of_water_year(n, "water_year") for n in names}})
    ev = bins.groupBy("water_year").agg(F.sum("event_n").alias("event_n"),
                                        stats.group_weighted_mean("mean_extra_loss", "event_n").alias("mean_extra_loss"))
    return out.join(ev, "water_year", "left").withColumn("event_n", F.coalesce("event_n", F.lit(0)))


def energy_running_sums(daily: DataFrame) -> DataFrame:
    """Running absorbed-energy difference: whole basin (gaps propagate per row) and paired snow (gaps as zero)."""
    return daily.select("water_year", "date",
                        series.running_sum("delta_absorbed", ["water_year"]).alias("cumulative_delta_absorbed"),
                        series.running_sum("delta_snow_absorbed", ["water_year"], missing="zero")
                        .alias("cumulative_delta_snow_absorbed"))
