"""Weighted areal statistics of cell tables.

``cell_weight(grid_id, row, col, weight)`` holds the share of each cell inside
the polygon. A cell that is absent from the data counts as missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics, stats


def support(weights: DataFrame) -> DataFrame:
    """Positive weights with the total weight and cell count of their grid."""
    positive = weights.where(F.col("weight") > 0)
    totals = positive.groupBy("grid_id").agg(F.sum("weight").alias("total_weight"),
                                             F.count(F.lit(1)).alias("support_cells"))
    return positive.join(totals, "grid_id")


def require_support(weights: DataFrame) -> DataFrame:
    """Per grid: number of positive cells, total weight; an error without any."""
    summary = weights.groupBy("grid_id").agg(
        F.count_if(F.col("weight") > 0).alias("support_cells"),
        F.sum(F.when(F.col("weight") > 0, F.col("weight"))).alias("total_weight"))
    cells = F.col("support_cells")
    return summary.withColumn("support_cells", F.when(cells > 0, cells).otherwise(
        F.raise_error(F.concat(F.lit("no positive weight on grid "), F.col("grid_id"))).cast("bigint")))


def support_bounds(weights: DataFrame) -> DataFrame:
    """Bounding box of the positive weights, half-open as row/col slices."""
    return weights.where(F.col("weight") > 0).groupBy("grid_id").agg(
        F.min("row").alias("row_start"), (F.max("row") + 1).alias("row_stop"),
        F.min("col").alias("col_start"), (F.max("col") + 1).alias("col_stop"))


def on_support(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """Cells joined to their weight; cells without weight are dropped.

    The weight table is one row per cell of one grid; whether it is broadcast is left to
    Spark's own threshold and to adaptive execution.
    """
    w = support(weights).drop("grid_id")
    return cells.join(w, ["row", "col"])


def basin_means(cells: DataFrame, weights: DataFrame, keys: Sequence[str], columns: Sequence[str],
                fractions: bool = True) -> DataFrame:
    """Weighted mean and valid-area fraction of each column per key."""
    aggs = []
    total = F.max("total_weight")
    for c in columns:
        aggs.append(stats.weighted_mean(c, "weight").alias(c))
        if fractions:
            aggs.append(stats.valid_fraction(c, "weight", total).alias(f"{c}_valid_area_fraction"))
    return on_support(cells, weights).groupBy(*keys).agg(*aggs)


def basin_means_strict(cells: DataFrame, weights: DataFrame, keys: Sequence[str], columns: Sequence[str],
                       on_missing: str = "error") -> DataFrame:
    """Weighted mean that requires a value in every support cell.

    ``on_missing``: ``error`` fails, ``null`` gives NULL.
    """
    if on_missing not in ("error", "null"):
        raise ValueError("on_missing must be 'error' or 'null'")
    aggs = [stats.weighted_mean(c, "weight").alias(c) for c in columns]
    counts = [F.count(c).alias(f"_n_{c}") for c in columns]
    out = on_support(cells, weights).groupBy(*keys).agg(
        *aggs, *counts, F.max("support_cells").alias("_cells"))
    for c in columns:
        lacking = F.lit(None).cast("double") if on_missing == "null" else F.raise_error(
            F.concat(F.lit(f"{c}: missing values in "), (F.col("_cells") - F.col(f"_n_{c}")).cast("string"),
                     F.lit(" support cells"))).cast("double")
        out = out.withColumn(c, F.when(F.col(f"_n_{c}") == F.col("_cells"), F.col(c)).otherwise(lacking))
    return out.select(*keys, *columns)


def basin_volume(cells: DataFrame, weights: DataFrame, keys: Sequence[str], column: str,
                 cell_area_m2: float, name: str = "volume_m3") -> DataFrame:
    """Sum of depth (mm) x weight x cell area as m3."""
    volume = F.sum(F.col(column) * 1.0e-3 * F.col("weight") * F.lit(float(cell_area_m2)))
    return on_support(cells, weights).groupBy(*keys).agg(F.coalesce(volume, F.lit(0.0)).alias(name))


def area_fractions(cells: DataFrame, weights: DataFrame, keys: Sequence[str],
                   conditions: dict[str, Column], valid: Column | None = None) -> DataFrame:
    """Weighted area fraction of each condition.

    Without ``valid`` the denominator is the whole support; with it, the valid cells.
    """
    if valid is None:
        aggs = [stats.fraction_of_all(c, "weight", F.max("total_weight")).alias(n)
                for n, c in conditions.items()]
    else:
        aggs = [stats.fraction_of_valid(c, valid, "weight").alias(n) for n, c in conditions.items()]
    return on_support(cells, weights).groupBy(*keys).agg(*aggs)


def energy_albedo(cells: DataFrame, weights: DataFrame, keys: Sequence[str], selection: Column,
                  incoming: str, absorbed: str, minimum_incoming: float = 0.05) -> DataFrame:
    """Mean energies over selected cells with both energies, and their albedo."""
    ok = selection & F.col(incoming).isNotNull() & F.col(absorbed).isNotNull()
    out = on_support(cells, weights).groupBy(*keys).agg(
        stats.weighted_mean_where(incoming, "weight", ok).alias("incoming_mj_m2"),
        stats.weighted_mean_where(absorbed, "weight", ok).alias("absorbed_mj_m2"),
        F.try_divide(F.sum(F.when(ok, F.col("weight"))), F.max("total_weight")).alias("energy_area_fraction"))
    return out.withColumn("effective_albedo",
                          physics.effective_albedo("incoming_mj_m2", "absorbed_mj_m2", minimum_incoming))


def weight_area(weights: DataFrame, grids: DataFrame) -> DataFrame:
    """Mapped area of each grid's weights: total weight x cell area."""
    totals = weights.where(F.col("weight") > 0).groupBy("grid_id").agg(F.sum("weight").alias("total_weight"))
    return totals.join(grids.select("grid_id", "cell_area_m2"), "grid_id").select(
        "grid_id", (F.col("total_weight") * F.col("cell_area_m2")).alias("area_m2"))


def relative_area_difference(areas: DataFrame, first: str, second: str) -> DataFrame:
    """|A - B| over their mean, for two grids that map the same polygon."""
    a = F.max(F.when(F.col("grid_id") == first, F.col("area_m2")))
    b = F.max(F.when(F.col("grid_id") == second, F.col("area_m2")))
    return areas.agg(a.alias("area_first_m2"), b.alias("area_second_m2"),
                     F.try_divide(F.abs(a - b), (a + b) / 2.0).alias("relative_area_difference"))


def station_samples(cells: DataFrame, station_cells: DataFrame, keys: Sequence[str],
                    columns: Sequence[str]) -> DataFrame:
    """Nearest value, envelope min/max and envelope pixel count per station.

    One join serves both roles. A cell may be the nearest and inside the envelope.
    """
    joined = cells.join(station_cells, ["row", "col"])
    near, env = F.col("role") == "nearest", F.col("role") == "envelope"
    aggs = []
    for c in columns:
        aggs += [F.max(F.when(near, F.col(c))).alias(f"{c}_nearest"),
                 F.min(F.when(env, F.col(c))).alias(f"{c}_envelope_min"),
                 F.max(F.when(env, F.col(c))).alias(f"{c}_envelope_max")]
    return joined.groupBy("station_id", *keys).agg(*aggs, F.count_if(env).alias("envelope_pixels"))
