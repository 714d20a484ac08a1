"""Shortwave energy, albedo and melt between two sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import physics, stats
from ..operators import events, series

ENERGY_COLUMNS = ("swe_mm", "melt_mm", "incoming_sw_energy_mj_m2", "absorbed_sw_energy_mj_m2", "effective_albedo")


def annual(pairs: DataFrame, start_md: str = "04-01", end_md: str = "06-30", melt_threshold: float = 0.1) -> DataFrame:
    """Seasonal energies, effective albedos, albedo-driven term and extra loss on melt days.

    ``pairs`` is one row per date with ``_i`` / ``_n`` columns of :data:`ENERGY_COLUMNS`.
    """
    rows = events.event_window(pairs, start_md, end_md, lead_days=0)
    rows = (rows.withColumn("_li", -series.row_difference("swe_mm_i", ["water_year"]))
            .withColumn("_ln", -series.row_difference("swe_mm_n", ["water_year"])))
    c = F.col
    ei, en = c("incoming_sw_energy_mj_m2_i"), c("incoming_sw_energy_mj_m2_n")
    ai, an = c("absorbed_sw_energy_mj_m2_i"), c("absorbed_sw_energy_mj_m2_n")
    melt_day = F.coalesce(c("melt_mm_i") > melt_threshold, F.lit(False)) | F.coalesce(
        c("melt_mm_n") > melt_threshold, F.lit(False))
    out = rows.groupBy("water_year").agg(
        F.sum(ei).alias("incoming_I"), F.sum(en).alias("incoming_N"),
        F.sum(ai).alias("absorbed_I"), F.sum(an).alias("absorbed_N"),
        F.sum(-0.5 * (ei + en) * (c("effective_albedo_n") - c("effective_albedo_i"))).alias("albedo_driven_term"),
        F.sum("melt_mm_i").alias("melt_I"), F.sum("melt_mm_n").alias("melt_N"),
        F.avg(F.when(melt_day, c("_ln") - c("_li"))).alias("mean_extra_loss"))
    return (out.withColumn("effective_albedo_I", physics.effective_albedo("incoming_I", "absorbed_I", 0.0))
            .withColumn("effective_albedo_N", physics.effective_albedo("incoming_N", "absorbed_N", 0.0))
            .withColumn("delta_absorbed", c("absorbed_N") - c("absorbed_I"))
            .withColumn("delta_incoming", c("incoming_N") - c("incoming_I")))


def mechanism_cells(pairs: DataFrame, start_md: str = "04-01", end_md: str = "06-30", minimum_incoming: float = 0.05,
                    cell: Sequence[str] = ("water_year", "row", "col")) -> DataFrame:
    """Cell-days with the albedo, absorbed-energy and loss differences of two sources."""
    rows = events.event_window(pairs, start_md, end_md)
    alb = lambda s: physics.effective_albedo(f"incoming_sw_energy_mj_m2_{s}",
                                             f"absorbed_sw_energy_mj_m2_{s}", minimum_incoming)
    loss = lambda s: -series.row_difference(f"swe_mm_{s}", list(cell))
    return (rows.withColumn("delta_albedo", alb("n") - alb("i"))
            .withColumn("delta_absorbed", F.col("absorbed_sw_energy_mj_m2_n") - F.col("absorbed_sw_energy_mj_m2_i"))
            .withColumn("extra_loss", loss("n") - loss("i")))


def mechanism_summary(cells: DataFrame) -> DataFrame:
    """Association of albedo with energy and of energy with extra loss, per water year."""
    return cells.groupBy("water_year").agg(
        stats.pair_count("delta_albedo", "delta_absorbed").alias("albedo_energy_n"),
        stats.pearson("delta_albedo", "delta_absorbed").alias("albedo_energy_r"),
        F.avg(stats.paired("delta_albedo", "delta_absorbed")[1]).alias("mean_delta_absorbed"),
        stats.pair_count("delta_absorbed", "extra_loss").alias("energy_loss_n"),
        stats.pearson("delta_absorbed", "extra_loss").alias("energy_loss_r"),
        F.avg(stats.paired("delta_absorbed", "extra_loss")[1]).alias("mean_extra_loss"))


def mechanism_density(cells: DataFrame, bins: int = 65, digits: int = 6) -> DataFrame:
    """2-D densities of both mechanism pairs per water year.

    ``pair`` names the pair: ``albedo_energy`` (albedo, absorbed energy) or ``energy_loss``
    (absorbed energy, extra loss). Values are rounded before binning, so that a value on a
    bin edge does not depend on the order of a sum.
    """
    both = F.array(*[F.struct(F.lit(name).alias("pair"), F.round(x, digits).alias("x"), F.round(y, digits).alias("y")) for name, x, y in (
        ("albedo_energy", "delta_albedo", "delta_absorbed"), ("energy_loss", "delta_absorbed", "extra_loss"))])
    long = cells.select("water_year", F.explode(both).alias("p")).select("water_year", "p.*")
    return events.histogram2d(long, ["pair", "water_year"], "x", "y", bins)
