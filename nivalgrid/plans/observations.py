"""Gridded models against gridded observations by elevation band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import physics
from ..operators.relate import attach_where, lattice_join
from ..operators.scale import exact_percentiles
from ..operators.spatial import Grid, _checked, join_bands, overlaps, own_cell, regrid_area_average

# Names of the three difference products.
NATIVE, FIRST_COMMON, SECOND_COMMON = "I - obs, fine grid", "I - obs, common grid", "N - obs, common grid"
COMMON_PRODUCTS = (FIRST_COMMON, SECOND_COMMON)


def _inside(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """Cells with positive weight, and their weight; weights are one row per lattice cell."""
    return lattice_join(cells, weights.where(F.col("weight") > 0).select("row", "col", "weight"), ["row", "col"])


def common_fields(obs: DataFrame, first: DataFrame, second: DataFrame, obs_grid: Grid, first_grid: Grid,
                  common: Grid, weights: DataFrame, minimum_coverage: float = 0.5) -> DataFrame:
    """Observation, both models and their differences on the common lattice, inside the polygon.

    Each input has ``obs_date, variable, row, col, value``.
    """
    keys = ["obs_date", "variable"]
    o = regrid_area_average(obs, obs_grid, common, keys, ["value"], minimum_coverage)
    i = regrid_area_average(first, first_grid, common, keys, ["value"], minimum_coverage)
    cell = [*keys, "row", "col"]
    inside = _inside(second.select(*cell, F.col("value").alias("n")), weights)
    for df, name in ((o, "o"), (i, "i")):
        inside = lattice_join(inside, df.select(*cell, F.col("value").alias(name)), cell, "left")
    return (inside.withColumn("i_minus_n", F.col("i") - F.col("n")).withColumn("i_minus_o", F.col("i") - F.col("o"))
            .withColumn("n_minus_o", F.col("n") - F.col("o")))


def native_differences(obs: DataFrame, first: DataFrame, obs_grid: Grid, first_grid: Grid, weights: DataFrame,
                       minimum_coverage: float = 0.5) -> DataFrame:
    """First model minus observation on the model's own lattice."""
    keys = ["obs_date", "variable"]
    cell = [*keys, "row", "col"]
    o = regrid_area_average(obs, obs_grid, first_grid, keys, ["value"], minimum_coverage)
    both = lattice_join(_inside(first, weights), o.select(*cell, F.col("value").alias("o")), cell)
    return both.select(*cell, (F.col("value") - F.col("o")).alias("difference"))


def difference_products(fields: DataFrame, native: DataFrame | None = None) -> DataFrame:
    """Long table ``product, obs_date, variable, row, col, difference``."""
    cell = ["obs_date", "variable", "row", "col"]
    out = (fields.select(*cell, F.explode(F.array(
        F.struct(F.lit(FIRST_COMMON).alias("product"), F.col("i_minus_o").alias("difference")),
        F.struct(F.lit(SECOND_COMMON).alias("product"), F.col("n_minus_o").alias("difference")))).alias("_p"))
        .select("_p.product", *cell, "_p.difference"))
    if native is not None:
        out = out.unionByName(native.select(F.lit(NATIVE).alias("product"), *cell, "difference"))
    return out.where(F.col("difference").isNotNull())


def band_statistics(differences: DataFrame, elevations: DataFrame, bands: dict | None = None) -> DataFrame:
    """Distribution statistics of the differences per product, date, variable and band.

    ``elevations(lattice, row, col, elev_m)`` names the lattice of a product:
    ``fine`` for the native one, ``common`` otherwise.
    """
    keys = ["product", "obs_date", "variable", "band"]
    lattice = F.when(F.col("product") == NATIVE, "fine").otherwise("common")
    rows = lattice_join(differences.withColumn("lattice", lattice), elevations, ["lattice", "row", "col"])
    rows = join_bands(rows, "elev_m", bands)
    return exact_percentiles(
        rows, keys, "difference",
        {"median_mm": 0.5, "p05_mm": 0.05, "p25_mm": 0.25, "p75_mm": 0.75, "p95_mm": 0.95},
        {"cell_count": "count", "mean_mm": "mean", "mae_mm": "mean_abs", "rmse_mm": "rms", "std_mm": "std_pop"})


def observed_density(fields: DataFrame, elevations: DataFrame, bands: dict | None = None) -> DataFrame:
    """Mean and median bulk density of the observations per date and band."""
    keys = ["obs_date", "band"]
    cells = fields.groupBy("obs_date", "row", "col").agg(
        F.max(F.when(F.col("variable") == "SWE", F.col("o"))).alias("swe"),
        F.max(F.when(F.col("variable") == "Snow depth", F.col("o"))).alias("depth"))
    cells = cells.withColumn("density", physics.bulk_density("swe", "depth")).where(F.col("density").isNotNull())
    rows = join_bands(lattice_join(cells, elevations.where(F.col("lattice") == "common"), ["row", "col"]), "elev_m", bands)
    return exact_percentiles(rows, keys, "density", {"density_median": 0.5},
                             {"density_cell_count": "count", "density_mean": "mean"})


DENSITY = "observed density"


def lattice_products(obs: DataFrame, first: DataFrame, second: DataFrame, obs_grid: Grid, first_grid: Grid,
                     common: Grid, cells: DataFrame, minimum_coverage: float = 0.5) -> DataFrame:
    """All difference products and the observed density from one aggregation: ``product, obs_date, variable, row, col, elev_m, value``.

    Every input cell is expanded once to the cells it touches on the common lattice and on the first
    model's own one; observation, models and variables then meet in one group per target cell instead of
    joins. ``cells(lattice, row, col, weight, elev_m)`` describes both lattices (``fine`` is the first
    model's); cells without positive weight are left out. Each input is read once.
    """
    def spread(df: DataFrame, grid: Grid, what: str, targets: Column) -> DataFrame:
        return (_checked(df, grid).select("obs_date", "variable", "value", F.lit(what).alias("what"), F.explode(targets).alias("_t"))
                .select("obs_date", "variable", "value", "what", "_t.lattice", "_t.row", "_t.col", "_t.area"))

    long = (spread(obs, obs_grid, "o", F.concat(overlaps(obs_grid, common, "common"), overlaps(obs_grid, first_grid, "fine")))
            .unionByName(spread(first, first_grid, "i", F.concat(overlaps(first_grid, common, "common"), own_cell(first_grid, "fine"))))
            .unionByName(spread(second, common, "n", own_cell(common, "common"))))
    size = F.when(F.col("lattice") == "common", F.lit(common.cell_area_m2)).otherwise(F.lit(first_grid.cell_area_m2))
    aggs = []
    for v, name in (("swe", "SWE"), ("depth", "Snow depth")):
        for w in ("o", "i", "n"):
            mine = (F.col("what") == w) & (F.col("variable") == name)
            area = F.sum(F.when(mine & F.col("value").isNotNull(), F.col("area")))
            mean = F.try_divide(F.sum(F.when(mine, F.col("value") * F.col("area"))), area)
            aggs += [F.when(area / F.max(size) >= minimum_coverage, mean).alias(f"{w}_{v}"), (F.count_if(mine) > 0).alias(f"has_{w}_{v}")]
    cell = ["lattice", "obs_date", "row", "col"]
    support = cells.where(F.col("weight") > 0).select("lattice", "row", "col", "elev_m")
    wide = lattice_join(long.groupBy(*cell).agg(*aggs), support, ["lattice", "row", "col"])
    on_common = F.col("lattice") == "common"
    items = []
    for v, name in (("swe", "SWE"), ("depth", "Snow depth")):
        second_there = on_common & F.col(f"has_n_{v}")
        for product, there, difference in ((NATIVE, ~on_common, F.col(f"i_{v}") - F.col(f"o_{v}")),
                                           (FIRST_COMMON, second_there, F.col(f"i_{v}") - F.col(f"o_{v}")),
                                           (SECOND_COMMON, second_there, F.col(f"n_{v}") - F.col(f"o_{v}"))):
            items.append(F.struct(F.lit(product).alias("product"), F.lit(name).alias("variable"), F.when(there, difference).alias("value")))
    seen = lambda v: F.when(F.col(f"has_n_{v}"), F.col(f"o_{v}"))
    density = physics.bulk_density(seen("swe"), seen("depth"))
    items.append(F.struct(F.lit(DENSITY).alias("product"), F.lit("density").alias("variable"), F.when(on_common, density).alias("value")))
    return (wide.select("obs_date", "row", "col", "elev_m", F.explode(F.array(*items)).alias("_p"))
            .select("_p.product", "obs_date", "_p.variable", "row", "col", "elev_m", "_p.value").where(F.col("value").isNotNull()))


def band_table(products: DataFrame, bands: dict | None = None) -> DataFrame:
    """Statistics of :func:`lattice_products` per product, date, variable and band, from one quantile pass.

    The density summary of a date and band is handed to the rows of the common-grid products.
    """
    keys = ["product", "obs_date", "variable", "band"]
    table = exact_percentiles(
        join_bands(products, "elev_m", bands), keys, "value",
        {"median_mm": 0.5, "p05_mm": 0.05, "p25_mm": 0.25, "p75_mm": 0.75, "p95_mm": 0.95},
        {"cell_count": "count", "mean_mm": "mean", "mae_mm": "mean_abs", "rmse_mm": "rms", "std_mm": "std_pop"})
    # a few rows per date and band
    here = Window.partitionBy("obs_date", "band")
    common = F.col("product").isin(*COMMON_PRODUCTS)
    for name, source in (("density_cell_count", "cell_count"), ("density_mean", "mean_mm"), ("density_median", "median_mm")):
        table = table.withColumn(name, F.when(common, F.max(F.when(F.col("product") == DENSITY, F.col(source))).over(here)))
    return table.where(F.col("product") != DENSITY)


def with_density(table: DataFrame, density: DataFrame) -> DataFrame:
    """Attach the density summary to the common-grid products only."""
    return attach_where(table, density, ["obs_date", "band"], F.col("product").isin(*COMMON_PRODUCTS))


def validation_rows(table: DataFrame) -> DataFrame:
    return table.where(F.col("product").isin(*COMMON_PRODUCTS))


def field_matrix(fields: DataFrame, percentile: float = 0.99, state_breaks: Sequence[float] | None = None,
                 difference_breaks: Sequence[float] | None = None) -> DataFrame:
    """Six map panels per cell with a shared class scale for states and one for differences, per variable."""
    cell = ["obs_date", "variable", "row", "col"]
    panels = F.array(*[F.struct(F.lit(p).alias("panel"), F.lit(k).alias("kind"), F.col(c).alias("value"))
                       for p, k, c in (("O", "state", "o"), ("I", "state", "i"), ("N", "state", "n"),
                                       ("I-N", "difference", "i_minus_n"), ("I-O", "difference", "i_minus_o"),
                                       ("N-O", "difference", "n_minus_o"))])
    long = fields.select(*cell, F.explode(panels).alias("_p")).select(*cell, "_p.*").where(F.col("value").isNotNull())
    size = long.withColumn("_size", F.when(F.col("kind") == "difference", F.abs("value")).otherwise(F.col("value")))
    robust = exact_percentiles(size, ["variable", "kind"], "_size", {"robust": percentile})
    supplied = {"state": state_breaks, "difference": difference_breaks}
    breaks = {}
    for kind in ("state", "difference"):
        if supplied[kind] is None:
            breaks[kind] = physics.nice_breaks("robust", kind == "difference")
        else:
            breaks[kind] = F.array(*[F.lit(b) for b in physics.check_breaks(supplied[kind], kind == "difference")])
    scale = robust.select("variable", "kind", F.when(F.col("kind") == "difference", breaks["difference"])
                          .otherwise(breaks["state"]).alias("breaks"))
    return (long.join(scale, ["variable", "kind"])
            .withColumn("class_code", physics.class_code("value", "breaks")))
