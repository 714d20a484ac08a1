"""Additional forcing and diagnostics by source, and net longwave of two sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import stats, units
from ..operators.areal import basin_means_strict, on_support
from ..operators.relate import key_difference, one_to_one
from ..operators.rollup import daily_by_kind
from ..operators.spatial import Grid, regrid_area_average


def hourly_basin(cells: DataFrame, weights: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("source", "ts"),
                 ) -> DataFrame:
    """Hourly basin means with the smallest valid-area fraction over the columns.

    Derived cell quantities such as wind speed must be columns already: they do
    not commute with the areal mean.
    """
    aggs = [stats.weighted_mean(c, "weight").alias(c) for c in columns]
    fractions = [stats.valid_fraction(c, "weight", F.max("total_weight")) for c in columns]
    smallest = F.least(*fractions) if len(fractions) > 1 else fractions[0]
    return on_support(cells, weights).groupBy(*keys).agg(*aggs, smallest.alias("valid_area_fraction"))


def daily_forcing_by_source(cells: DataFrame, weights: DataFrame, kinds: dict[str, tuple[str, str, str]],
                            step_seconds: float = 3600.0, hours: int = 24) -> DataFrame:
    """Temperature / wind / radiation / depth statistics per source and day."""
    columns = sorted({c for c, _, _ in kinds.values()})
    hourly = hourly_basin(cells, weights, columns)
    return daily_by_kind(hourly, ["source"], kinds, step_seconds=step_seconds, hours=hours,
                         valid_area="valid_area_fraction")


def accumulated_flux(cells: DataFrame, weights: DataFrame, column: str, unit: str, prefix: str,
                     step_seconds: float = 3600.0) -> DataFrame | None:
    """Daily total of a flux whose unit decides how it accumulates; None when the unit is unknown."""
    u = " ".join(unit.strip().lower().replace("**", "^").split())
    if u in units.DEPTH_UNITS + units.DEPTH_RATE_UNITS + units.MASS_RATE_UNITS:
        kind = "depth"
    elif u in units.RADIATION_UNITS:
        kind = "radiation"
    else:
        return None
    return daily_by_kind(hourly_basin(cells, weights, [column]), ["source"], {prefix: (column, kind, unit)},
                         step_seconds=step_seconds)


def combine(forcing: DataFrame, diagnostics: DataFrame, keys: Sequence[str] = ("date", "water_year")) -> DataFrame:
    """One-to-one join of forcing and diagnostics of the same days."""
    extra = [c for c in diagnostics.columns if c not in forcing.columns or c in keys]
    return one_to_one(forcing, diagnostics.select(*extra), list(keys), "left", "forcing and diagnostics")


def coverage_mismatch(forcing: DataFrame, diagnostics: DataFrame, keys: Sequence[str] = ("date", "water_year")) -> DataFrame:
    return key_difference(forcing, diagnostics, list(keys))


def net_longwave(first_hours: DataFrame, second_hours: DataFrame, source_grid: Grid, target_grid: Grid,
                 weights: DataFrame, minimum_coverage: float = 0.5, on_missing: str = "error",
                 hours: int = 24) -> DataFrame:
    """Daily net surface longwave of two sources and their difference (second minus first).

    First source: last net radiation of the day minus the mean net shortwave, on
    its own lattice, then regridded. Second source: minus the mean upward net
    longwave, already on the target lattice. Both need full basin support.
    """
    day = F.to_date("ts").alias("date")
    a = first_hours.groupBy(day, "row", "col").agg(
        F.max_by("net_rad", "ts").alias("_rad"), stats.strict_mean("net_solar", hours).alias("_sw"))
    a = a.select("date", "row", "col", (F.col("_rad") - F.col("_sw")).alias("net_lw_i"))
    a = regrid_area_average(a, source_grid, target_grid, ["date"], ["net_lw_i"], minimum_coverage)
    b = second_hours.groupBy(day, "row", "col").agg((-stats.strict_mean("net_lw_up", hours)).alias("net_lw_n"))
    basin_a = basin_means_strict(a, weights, ["date"], ["net_lw_i"], on_missing)
    basin_b = basin_means_strict(b, weights, ["date"], ["net_lw_n"], on_missing)
    out = basin_b.join(basin_a, "date")
    return (out.withColumn("water_year", cal.water_year("date"))
            .withColumn("delta_net_lw", F.col("net_lw_n") - F.col("net_lw_i")))


def focus_merge(separation: DataFrame, forcing: DataFrame, net_lw: DataFrame, years: Sequence[int],
                window: tuple[str, str] = ("02-01", "04-30"), event_threshold: float = 1.0) -> DataFrame:
    """Daily products of the focus windows of selected years, with a precipitation-event flag."""
    inside = F.col("water_year").isin(*years) & cal.in_season("date", "water_year", *window)
    keys = ["date", "water_year"]
    sep = separation.where(inside).withColumn("delta_net_sw_w_m2", units.daily_energy_to_power("delta_absorbed"))
    frc = forcing.where(inside).withColumn("precip_event", F.col("precip_mm_day") >= event_threshold)
    out = one_to_one(sep, frc, keys, context="separation and forcing")
    return one_to_one(out, net_lw.where(inside), keys, context="daily products and longwave")
