"""Grids, polygons and point/cell relations on regular lattices.

All relations use index arithmetic and equi-joins; nothing compares every cell
with every polygon edge, station or other cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



@dataclass(frozen=True)
class Grid:
    """A regular lattice: outer corner (x0, y0) of cell (0, 0), steps and shape.

    ``height`` (or ``width``) None leaves the lattice open upwards: it is as tall as its data.
    """

    grid_id: str
    x0: float
    y0: float
    dx: float
    dy: float
    width: int | None
    height: int | None

    @property
    def cell_area_m2(self) -> float:
        return abs(self.dx * self.dy)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """Left, bottom, right and top edge; an open lattice has none until ``covering`` closes it."""
        if self.width is None or self.height is None:
            raise ValueError(f"lattice {self.grid_id} is open; close it with covering(cells)")
        xs = (self.x0, self.x0 + self.dx * self.width)
        ys = (self.y0, self.y0 + self.dy * self.height)
        return min(xs), min(ys), max(xs), max(ys)

    def covering(self, cells: DataFrame) -> "Grid":
        """The lattice with open dimensions closed at the largest cell of the data (one row reaches the driver)."""
        if self.width is not None and self.height is not None:
            return self
        top = cells.agg(F.max("row"), F.max("col")).first()
        return replace(self, height=self.height if self.height is not None else (top[0] or 0) + 1,
                       width=self.width if self.width is not None else (top[1] or 0) + 1)

    def holds(self, row="row", col="col") -> Column:
        """Whether a cell index lies on the lattice."""
        inside = (_c(row) >= 0) & (_c(col) >= 0)
        for index, count in ((row, self.height), (col, self.width)):
            inside = inside & (_c(index) < count) if count is not None else inside
        return inside

    def center_x(self, col="col") -> Column:
        return F.lit(self.x0) + (_c(col) + 0.5) * F.lit(self.dx)

    def center_y(self, row="row") -> Column:
        return F.lit(self.y0) + (_c(row) + 0.5) * F.lit(self.dy)

    def u(self, x="x") -> Column:
        """Fractional column index of a coordinate."""
        return (_c(x) - F.lit(self.x0)) / F.lit(self.dx)

    def v(self, y="y") -> Column:
        return (_c(y) - F.lit(self.y0)) / F.lit(self.dy)


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def with_centers(cells: DataFrame, grid: Grid) -> DataFrame:
    return cells.withColumn("x", grid.center_x()).withColumn("y", grid.center_y())


def _upto(index: Column, count: int | None) -> Column:
    """An index clipped to the last cell of a dimension, if that is known."""
    return index if count is None else F.least(index, F.lit(count - 1))


def footprints(cells: DataFrame, grid: Grid) -> DataFrame:
    """Box of each cell."""
    xa, xb = F.lit(grid.x0) + F.col("col") * grid.dx, F.lit(grid.x0) + (F.col("col") + 1) * grid.dx
    ya, yb = F.lit(grid.y0) + F.col("row") * grid.dy, F.lit(grid.y0) + (F.col("row") + 1) * grid.dy
    return (cells.withColumn("x_min", F.least(xa, xb)).withColumn("x_max", F.greatest(xa, xb))
            .withColumn("y_min", F.least(ya, yb)).withColumn("y_max", F.greatest(ya, yb)))


def grid_extent(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounds, cell count and covered area of cell footprints per grid."""
    area = (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))
    return boxes.groupBy(*keys).agg(
        F.min("x_min").alias("left"), F.min("y_min").alias("bottom"), F.max("x_max").alias("right"),
        F.max("y_max").alias("top"), F.count(F.lit(1)).alias("cell_count"), F.sum(area).alias("area_m2"))


def axis_regularity(cells: DataFrame, axis: str, coordinate: str) -> DataFrame:
    """Median spacing of a coordinate axis and the largest deviation from it.

    The axis has one row per grid column or row, i.e. the square root of the cell
    count at most; it is reduced to that before any ordering.
    """
    line = cells.groupBy(axis).agg(F.min(coordinate).alias("_x"), F.max(coordinate).alias("_x2"))
    block = F.floor(F.col(axis) / 1024)
    from .scale import chunked_lag
    gaps = chunked_lag(line, [], axis, block, ["_x"]).withColumn("gap", F.col("_x") - F.col("prev__x"))
    counted = gaps.groupBy("gap").agg(F.count("gap").alias("n"), F.max(F.col("_x2") - F.col("_x")).alias("skew"))
    stats = counted.agg(F.expr("percentile(gap, 0.5, n)").alias("spacing"), F.min("gap").alias("_lo"),
                        F.max("gap").alias("_hi"), F.max("skew").alias("spread_m"))
    worst = F.greatest(F.col("_hi") - F.col("spacing"), F.col("spacing") - F.col("_lo"))
    tolerance = F.greatest(F.abs("spacing"), F.lit(1.0)) * 1e-5
    return stats.select(F.lit(coordinate).alias("axis"), "spacing", worst.alias("max_deviation"),
                        (worst <= tolerance).alias("regular"), "spread_m")


# -- lambert conformal conic on a sphere -------------------------------------------------

EARTH_RADIUS_M = 6370000.0  # fixed value of the projection


def lambert_forward(lat, lon, lat1: float, lat2: float, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Projected (x, y) of geographic coordinates in degrees."""
    p1, p2, p0 = (math.radians(v) for v in (lat1, lat2, lat0))
    if abs(p1 - p2) < 1e-12:
        n = math.sin(p1)
    else:
        n = math.log(math.cos(p1) / math.cos(p2)) / math.log(
            math.tan(math.pi / 4 + p2 / 2) / math.tan(math.pi / 4 + p1 / 2))
    f = math.cos(p1) * math.tan(math.pi / 4 + p1 / 2) ** n / n
    rho0 = EARTH_RADIUS_M * f / math.tan(math.pi / 4 + p0 / 2) ** n
    phi, theta = F.radians(_c(lat)), F.radians(_c(lon) - F.lit(lon0)) * n
    rho = F.lit(EARTH_RADIUS_M * f) / F.pow(F.tan(F.lit(math.pi / 4) + phi / 2), F.lit(n))
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def lattice_residual(cells: DataFrame, dx: float, dy: float, x: str = "x", y: str = "y",
                     by: str = "grid_id") -> DataFrame:
    """Largest and median distance of projected centres to the ideal lattice.

    The lattice starts at the centre of cell (0, 0) of the same ``by`` group; ``by``
    names the lattice, so there is one origin row per lattice.
    """
    from .scale import exact_percentiles

    origin = cells.where((F.col("row") == 0) & (F.col("col") == 0)).groupBy(by).agg(
        F.min(x).alias("_ox"), F.min(y).alias("_oy"))
    res = cells.join(origin, by).withColumn("residual_m", F.hypot(
        F.col(x) - (F.col("_ox") + F.col("col") * dx), F.col(y) - (F.col("_oy") + F.col("row") * dy)))
    return exact_percentiles(res, [by], "residual_m", {"median_center_residual_m": 0.5},
                             {"maximum_center_residual_m": "max", "cell_count": "count"})


# -- points and cells --------------------------------------------------------------------

#: Cells per side of a base tile and children per side of a tile, as powers of two.
TILE_BITS, STEP_BITS = 3, 3


def _pyramid(cells: DataFrame, steps: int) -> list[DataFrame]:
    """Tiles of each level, finest first: ``_pr, _pc, _n`` and the box of their valid cells."""
    box = [F.min("_r0").alias("_r0"), F.max("_r1").alias("_r1"), F.min("_c0").alias("_c0"), F.max("_c1").alias("_c1")]
    base = cells.select(F.shiftright("row", TILE_BITS).alias("_pr"), F.shiftright("col", TILE_BITS).alias("_pc"), F.lit(1).alias("_n"),
                        F.col("row").alias("_r0"), F.col("row").alias("_r1"), F.col("col").alias("_c0"), F.col("col").alias("_c1"))
    levels = [base.groupBy("_pr", "_pc").agg(F.sum("_n").alias("_n"), *box)]
    for _ in range(steps - 1):
        up = levels[-1].withColumns({"_pr": F.shiftright("_pr", STEP_BITS), "_pc": F.shiftright("_pc", STEP_BITS)})
        levels.append(up.groupBy("_pr", "_pc").agg(F.sum("_n").alias("_n"), *box))
    return levels


def nearest_tiles(stations: DataFrame, cells: DataFrame, grid: Grid, k: int = 1, station_id: str = "station_id") -> DataFrame:
    """Base tiles that may hold one of the ``k`` nearest cells of a station: ``station_id, _sx, _sy, _pr, _pc``.

    Two descents of a pyramid of tile boxes. The first follows at every level only the tiles that come
    first by distance until they hold ``k`` cells, and ends with real cells, whose k-th distance is a
    bound. The second keeps the tiles whose box comes within that bound. Boxes reach from the
    outermost valid cell centres, so also a far station keeps a few tiles per level.
    """
    grid = grid.covering(cells)
    steps = 1
    while (1 << (TILE_BITS + STEP_BITS * (steps - 1))) < max(grid.width, grid.height, 1):
        steps += 1
    levels = _pyramid(cells, steps)
    start = stations.select(station_id, F.col("x").alias("_sx"), F.col("y").alias("_sy")).where(
        F.col("_sx").isNotNull() & F.col("_sy").isNotNull())
    ends = lambda lo, hi, centre: (F.least(centre(lo), centre(hi)), F.greatest(centre(lo), centre(hi)))
    left, right = ends("_c0", "_c1", grid.center_x)
    bottom, top = ends("_r0", "_r1", grid.center_y)
    gap = lambda v, lo, hi: F.greatest(lo - v, v - hi, F.lit(0.0))
    distance = F.hypot(gap(F.col("_sx"), left, right), gap(F.col("_sy"), bottom, top))

    def children(front: DataFrame, level: DataFrame) -> DataFrame:
        below = level.withColumns({"_up_r": F.shiftright("_pr", STEP_BITS), "_up_c": F.shiftright("_pc", STEP_BITS)})
        return (front.withColumnsRenamed({"_pr": "_up_r", "_pc": "_up_c"}).join(below, ["_up_r", "_up_c"])
                .withColumn("_low", distance))

    tile = [station_id, "_sx", "_sy", "_pr", "_pc"]
    front = start.withColumns({"_pr": F.lit(0), "_pc": F.lit(0)})
    first = Window.partitionBy(station_id).orderBy("_low", "_pr", "_pc").rowsBetween(Window.unboundedPreceding, -1)
    # the single tile above the coarsest level is the start of both descents
    for level in reversed(levels):
        front = (children(front, level).withColumn("_held", F.coalesce(F.sum("_n").over(first), F.lit(0)))
                 .where(F.col("_held") < k).select(*tile))
    order = Window.partitionBy(station_id).orderBy("distance_m", "row", "col")
    bound = (_tile_cells(front, cells, grid, station_id).withColumn("_k", F.row_number().over(order)).where(F.col("_k") == k)
             .select(station_id, F.col("distance_m").alias("_bound")))
    reach = F.coalesce(F.col("_bound") * (1 + 1e-12), F.lit(float("inf")))
    carried = start.join(bound, station_id, "left").withColumns({"_pr": F.lit(0), "_pc": F.lit(0), "_reach": reach}).drop("_bound")
    for level in reversed(levels):
        carried = children(carried, level).where(F.col("_low") <= F.col("_reach")).select(*tile, "_reach")
    return carried.select(*tile)


def _tile_cells(tiles: DataFrame, cells: DataFrame, grid: Grid, station_id: str) -> DataFrame:
    tiled = cells.select("row", "col", F.shiftright("row", TILE_BITS).alias("_pr"), F.shiftright("col", TILE_BITS).alias("_pc"))
    dist = F.hypot(F.col("_sx") - grid.center_x(), F.col("_sy") - grid.center_y())
    return tiled.join(tiles, ["_pr", "_pc"]).select(station_id, "row", "col", dist.alias("distance_m"))


def nearest_cells(stations: DataFrame, cells: DataFrame, grid: Grid, k: int = 1,
                  station_id: str = "station_id") -> DataFrame:
    """The ``k`` nearest cells of each station with their distance (ties: row, col).

    ``stations(station_id, x, y)``, ``cells(row, col)`` with only valid cells. Candidates
    come from :func:`nearest_tiles` by an equi-join on 8x8 tiles. Exact for gaps in the valid mask
    and for stations outside the grid, however far.
    """
    tiles = nearest_tiles(stations, cells, grid, k, station_id)
    order = Window.partitionBy(station_id).orderBy("distance_m", "row", "col")
    return (_tile_cells(tiles, cells, grid, station_id).withColumn("neighbour", F.row_number().over(order))
            .where(F.col("neighbour") <= k))


def centers_in_cells(points: DataFrame, coarse: Grid, row: str = "coarse_row", col: str = "coarse_col") -> DataFrame:
    """Coarse cell(s) that cover each point; a point on an edge belongs to both sides."""
    def candidates(index: Column) -> Column:
        return F.array_distinct(F.array(F.floor(index).cast("int"), (F.ceil(index) - 1).cast("int")))

    out = (points.withColumn(col, F.explode(candidates(coarse.u("x"))))
           .withColumn(row, F.explode(candidates(coarse.v("y")))))
    xa, ya = F.lit(coarse.x0) + F.col(col) * coarse.dx, F.lit(coarse.y0) + F.col(row) * coarse.dy
    xb, yb = F.lit(coarse.x0) + (F.col(col) + 1) * coarse.dx, F.lit(coarse.y0) + (F.col(row) + 1) * coarse.dy
    return out.where(coarse.holds(row, col)
                     & F.col("x").between(F.least(xa, xb), F.greatest(xa, xb))
                     & F.col("y").between(F.least(ya, yb), F.greatest(ya, yb)))


def station_lookup(stations: DataFrame, fine_valid: DataFrame, fine: Grid, coarse: Grid,
                   coarse_cells: DataFrame) -> DataFrame:
    """``station_cell`` rows: nearest fine cell, nearest coarse cell and its envelope of fine cells."""
    near_f = nearest_cells(stations, fine_valid, fine).select(
        "station_id", F.lit("nearest").alias("role"), "row", "col", "distance_m")
    near_c = nearest_cells(stations, coarse_cells, coarse)
    inside = centers_in_cells(with_centers(fine_valid.select("row", "col"), fine), coarse)
    envelope = inside.join(
        near_c.select("station_id", F.col("row").alias("coarse_row"), F.col("col").alias("coarse_col")),
        ["coarse_row", "coarse_col"]).select(
        "station_id", F.lit("envelope").alias("role"), "row", "col", F.lit(None).cast("double").alias("distance_m"))
    coarse_rows = near_c.select("station_id", F.lit("coarse").alias("role"), "row", "col", "distance_m")
    return near_f.unionByName(coarse_rows).unionByName(envelope)


def lookup_report(station_cells: DataFrame, allow_empty: bool = False) -> DataFrame:
    """One row per station; an empty envelope is an error unless allowed."""
    near, coarse = F.col("role") == "nearest", F.col("role") == "coarse"
    out = station_cells.groupBy("station_id").agg(
        F.max(F.when(near, F.col("row"))).alias("fine_row"), F.max(F.when(near, F.col("col"))).alias("fine_col"),
        F.max(F.when(near, F.col("distance_m"))).alias("fine_distance_m"),
        F.max(F.when(coarse, F.col("row"))).alias("coarse_row"), F.max(F.when(coarse, F.col("col"))).alias("coarse_col"),
        F.max(F.when(coarse, F.col("distance_m"))).alias("coarse_distance_m"),
        F.count_if(F.col("role") == "envelope").alias("envelope_cells"))
    if allow_empty:
        return out
    n = F.col("envelope_cells")
    return out.withColumn("envelope_cells", F.when(n > 0, n).otherwise(F.raise_error(F.concat(
        F.lit("no valid cell centre inside the nearest coarse cell of station "),
        F.col("station_id").cast("string"))).cast("bigint")))


# -- conservative regridding -------------------------------------------------------------

def _axis_overlap(index: str, s0: float, ds: float, t0: float, dt: float, count: int | None) -> Column:
    """Target indices that a source index touches along one axis, with the common length."""
    a = (F.lit(s0) + F.col(index) * ds - t0) / dt
    b = (F.lit(s0) + (F.col(index) + 1) * ds - t0) / dt
    lo, hi = F.least(a, b), F.greatest(a, b)
    first = F.greatest(F.floor(lo).cast("int"), F.lit(0))
    last = _upto((F.ceil(hi) - 1).cast("int"), count)
    touched = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(touched, lambda t: F.struct(
        t.alias("i"), ((F.least(hi, (t + 1).cast("double")) - F.greatest(lo, t.cast("double")))
                       * F.lit(abs(dt))).alias("length")))


def _checked(cells: DataFrame, grid: Grid) -> DataFrame:
    """A cell outside a bounded lattice is an error."""
    outside = F.raise_error(F.concat(F.lit(f"cell outside lattice {grid.grid_id}: "), F.to_json(F.struct("row", "col"))))
    return cells.withColumn("row", F.when(grid.holds(), F.col("row")).otherwise(outside.cast("int")))


def overlaps(source: Grid, target: Grid, lattice: str) -> Column:
    """Cells of ``target`` that the cell (row, col) of ``source`` touches: array of ``lattice, row, col, area``."""
    rows = _axis_overlap("row", source.y0, source.dy, target.y0, target.dy, target.height)
    cols = _axis_overlap("col", source.x0, source.dx, target.x0, target.dx, target.width)
    cells = F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(
        F.lit(lattice).alias("lattice"), r.getField("i").alias("row"), c.getField("i").alias("col"),
        (r.getField("length") * c.getField("length")).alias("area")))))
    return F.filter(cells, lambda x: x.getField("area") > 0)


def own_cell(grid: Grid, lattice: str) -> Column:
    """The cell itself in the form of :func:`overlaps`."""
    return F.array(F.struct(F.lit(lattice).alias("lattice"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
                            F.lit(grid.cell_area_m2).alias("area")))


def regrid_area_average(cells: DataFrame, source: Grid, target: Grid, keys: Sequence[str],
                        columns: Sequence[str], minimum_coverage: float = 0.5) -> DataFrame:
    """Area-weighted average on to another lattice, with the valid coverage.

    Each source cell expands to the target cells it touches (a few rows), and one
    map-side combined aggregation finishes the work; no join is involved. A value
    below the minimum coverage is NULL. A source cell outside a bounded lattice is an error.
    """
    on_lattice = _checked(cells, source)
    spread = (on_lattice.select(*keys, *columns,
                           F.explode(_axis_overlap("col", source.x0, source.dx, target.x0, target.dx, target.width)).alias("_cx"),
                           F.col("row"))
              .select(*keys, *columns, "_cx",
                      F.explode(_axis_overlap("row", source.y0, source.dy, target.y0, target.dy, target.height)).alias("_cy"))
              .withColumn("_area", F.col("_cx.length") * F.col("_cy.length")).where(F.col("_area") > 0))
    aggs = []
    for c in columns:
        valid = F.sum(F.when(F.col(c).isNotNull(), F.col("_area")))
        coverage = F.coalesce(valid, F.lit(0.0)) / F.lit(target.cell_area_m2)
        mean = F.try_divide(F.sum(F.col(c) * F.col("_area")), valid)
        aggs += [F.when(coverage >= minimum_coverage, mean).alias(c), coverage.alias(f"{c}_coverage")]
    return spread.groupBy(*keys, F.col("_cy.i").alias("row"), F.col("_cx.i").alias("col")).agg(*aggs)


# -- polygons ----------------------------------------------------------------------------

def polygon_edges(polygons: DataFrame, grid: Grid, name: str = "name") -> DataFrame:
    """Directed edges in index space, with a sign that makes shells positive and holes negative.

    ``polygons(name, ring ARRAY<STRUCT<x,y>>[, hole BOOLEAN])``, one row per ring. A ring with
    fewer than three points encloses nothing and has no edges here.
    """
    polygons = polygons.where(F.size("ring") >= 3)
    ring = F.transform("ring", lambda p: F.struct(
        ((p.getField("x") - grid.x0) / grid.dx).alias("u"), ((p.getField("y") - grid.y0) / grid.dy).alias("v")))
    hole = F.col("hole") if "hole" in polygons.columns else F.lit(False)
    indexed = polygons.select(name, hole.alias("_hole"), ring.alias("_ring"))
    n = F.size("_ring")
    corners = F.when(n >= 3, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    edge = F.transform(corners, lambda i: F.struct(
        F.element_at("_ring", i).getField("u").alias("u0"), F.element_at("_ring", i).getField("v").alias("v0"),
        F.element_at("_ring", i % n + 1).getField("u").alias("u1"),
        F.element_at("_ring", i % n + 1).getField("v").alias("v1")))
    doubled = F.aggregate("_edges", F.lit(0.0), lambda acc, e: acc + (
        e.getField("u0") * e.getField("v1") - e.getField("u1") * e.getField("v0")))
    sign = F.signum(doubled) * F.when(F.col("_hole"), -1.0).otherwise(1.0)
    return (indexed.withColumn("_edges", edge).withColumn("_sign", sign)
            .select(name, "_sign", F.explode("_edges").alias("_e")).select(name, "_sign", "_e.*"))


def join_runs(points: DataFrame, runs: DataFrame, at: str, keys: Sequence[str], first: str = "_first", last: str = "_last") -> DataFrame:
    """Points joined to the runs ``first .. last`` (integers) that hold their ``at``, on equal ``keys``.

    A run lies in one or two tiles of the smallest power of two that is no shorter than it; a point
    looks into its tile of each size that occurs. Long runs are never expanded.
    """
    bits = F.length(F.bin((F.col(last) - F.col(first)).cast("bigint")))
    sized = runs.where(F.col(first) <= F.col(last)).withColumn("_bits", F.when(F.col(first) == F.col(last), 0).otherwise(bits))
    tiled = sized.withColumn("_tile", F.explode(F.expr(
        f"array_distinct(array(shiftright(CAST({first} AS BIGINT), _bits), shiftright(CAST({last} AS BIGINT), _bits)))")))
    sizes = sized.agg(F.collect_set("_bits")).scalar()
    looking = points.withColumn("_bits", F.explode(sizes)).withColumn("_tile", F.expr(f"shiftright(CAST({at} AS BIGINT), _bits)"))
    return (looking.join(tiled, [*keys, "_bits", "_tile"]).where(F.col(at).between(F.col(first), F.col(last)))
            .drop("_bits", "_tile", first, last))


def _column_pieces(polygons: DataFrame, grid: Grid, name: str) -> DataFrame:
    """Edges cut at grid columns: ``name, col``, heights ``_va, _vb`` at both ends and the signed width ``_w``."""
    edges = polygon_edges(polygons, grid, name).where(F.col("u0") != F.col("u1"))
    lo, hi = F.least("u0", "u1"), F.greatest("u0", "u1")
    first = F.greatest(F.floor(lo).cast("int"), F.lit(0))
    last = _upto((F.ceil(hi) - 1).cast("int"), grid.width)
    slope = (F.col("v1") - F.col("v0")) / (F.col("u1") - F.col("u0"))
    return (edges.where(first <= last)
            .withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_slope", slope)
            .withColumn("_dir", F.when(F.col("u1") > F.col("u0"), 1.0).otherwise(-1.0))
            .withColumn("col", F.explode(F.sequence(first, last)))
            .withColumn("_ua", F.greatest("_lo", F.col("col").cast("double")))
            .withColumn("_ub", F.least("_hi", (F.col("col") + 1).cast("double")))
            .withColumn("_va", F.col("v0") + F.col("_slope") * (F.col("_ua") - F.col("u0")))
            .withColumn("_vb", F.col("v0") + F.col("_slope") * (F.col("_ub") - F.col("u0")))
            .withColumn("_w", -F.col("_sign") * F.col("_dir") * (F.col("_ub") - F.col("_ua"))))


def _piece_share() -> Column:
    """Share of a cell's height (at ``row``) below a piece from ``_va`` to ``_vb``."""
    def below(v: Column) -> Column:
        t = v - F.col("row")
        return F.when(t <= 0, 0.0).when(t >= 1, t - 0.5).otherwise(t * t / 2.0)

    flat = F.abs(F.col("_vb") - F.col("_va")) < 1e-9
    middle = F.least(F.greatest((F.col("_va") + F.col("_vb")) / 2.0 - F.col("row"), F.lit(0.0)), F.lit(1.0))
    return F.when(flat, middle).otherwise(F.try_divide(below(F.col("_vb")) - below(F.col("_va")),
                                                       F.col("_vb") - F.col("_va")))


def _within(weights: DataFrame) -> DataFrame:
    return (weights.withColumn("weight", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("weight"))))
            .where(F.col("weight") > 1e-12))


def polygon_weights(polygons: DataFrame, grid: Grid, name: str = "name", cells: DataFrame | None = None) -> DataFrame:
    """Exact overlap fraction of every cell with each polygon; cells without overlap are absent.

    Each edge is cut at grid columns. In the rows it passes it contributes the
    area below it, and in all rows further down its whole width. A running sum
    down each column turns that into cell fractions, and gaps between touched
    rows are filled by a sequence. Work follows edges x crossed cells plus output.
    With ``cells(row, col)`` only these cells are returned and no row is generated: see :func:`_weights_of_cells`.
    """
    pieces = _column_pieces(polygons, grid, name)
    if cells is not None:
        return _weights_of_cells(pieces, grid, name, cells)
    # rows are clamped to the lattice: what lies above it is one row (index height), what lies below one (-1)
    vmin, vmax = F.least("_va", "_vb"), F.greatest("_va", "_vb")
    clamp = lambda r: _upto(F.greatest(r, F.lit(-1)), None if grid.height is None else grid.height + 1)
    low_row = clamp(F.floor(vmin)).cast("int")
    high_row = F.greatest(low_row, clamp(F.ceil(vmax) - 1).cast("int"))
    rows = pieces.withColumn("_low", low_row).withColumn("row", F.explode(F.sequence(low_row, high_row)))
    partial = F.when(F.col("row") >= F.col("_low"), F.col("_w") * _piece_share()).otherwise(0.0)
    full = F.when(F.col("row") == F.col("_low"), F.col("_w")).otherwise(0.0)
    touched = rows.groupBy(name, "col", "row").agg(F.sum(partial).alias("_part"), F.sum(full).alias("_full"))
    down = Window.partitionBy(name, "col").orderBy(F.col("row").desc())
    state = (touched
             .withColumn("_above", F.sum("_full").over(down) - F.col("_full"))
             .withColumn("_next", F.coalesce(F.lead("row").over(down), F.lit(-1))))
    own = state.select(name, "row", "col", (F.col("_part") + F.col("_above")).alias("weight"))
    gap_first = F.greatest(F.col("_next") + 1, F.lit(0))
    gap_last = _upto(F.col("row") - 1, grid.height)
    gap = (state.withColumn("weight", F.col("_above") + F.col("_full"))
           .where((gap_first <= gap_last) & (F.abs("weight") > 1e-12))
           .select(name, F.explode(F.sequence(gap_first, gap_last)).alias("row"), "col", "weight"))
    return _within(own.unionByName(gap).where(grid.holds()))


def _weights_of_cells(pieces: DataFrame, grid: Grid, name: str, cells: DataFrame) -> DataFrame:
    """Weights of existing cells only, from runs of rows.

    A piece is a run over the rows it passes. Below it its whole width counts: a running sum over the pieces' lowest
    rows makes that a run of constant width between two of them. A cell adds up the runs that hold
    its row, found by :func:`join_runs`, so a polygon may be as tall as it likes.
    """
    low = F.floor(F.least("_va", "_vb")).cast("bigint")
    high = F.greatest(low, (F.ceil(F.greatest("_va", "_vb")) - 1).cast("bigint"))
    passed = pieces.select(name, "col", low.alias("_first"), high.alias("_last"), "_w", "_va", "_vb")
    down = Window.partitionBy(name, "col").orderBy(F.desc("_first"))
    under = (passed.groupBy(name, "col", "_first").agg(F.sum("_w").alias("_w"))
             .select(name, "col", (F.col("_first") - 1).alias("_last"), F.coalesce(F.lead("_first").over(down), F.lit(0)).alias("_first"),
                     F.sum("_w").over(down).alias("_w"))
             .where(F.abs("_w") > 1e-12))
    nothing = F.lit(None).cast("double")
    runs = passed.unionByName(under.withColumns({"_va": nothing, "_vb": nothing}).select(*passed.columns))
    share = F.when(F.col("_va").isNull(), 1.0).otherwise(_piece_share())
    held = join_runs(cells.select("row", "col").where(grid.holds()).distinct(), runs, "row", ["col"])
    return _within(held.groupBy(name, "row", "col").agg(F.sum(F.col("_w") * share).alias("weight")))


def center_mask(polygons: DataFrame, grid: Grid, name: str = "name", cells: DataFrame | None = None) -> DataFrame:
    """Cells whose centre lies inside each polygon (even-odd rule).

    Edges meet row centre lines; sorted crossings pair up into spans of columns. With ``cells(row, col)``
    only these cells are returned, and edges meet only rows that have a cell.
    """
    edges = polygon_edges(polygons, grid, name).where(F.col("v0") != F.col("v1"))
    lo, hi = F.least("v0", "v1"), F.greatest("v0", "v1")
    first = F.greatest(F.ceil(lo - 0.5).cast("int"), F.lit(0))
    last = _upto((F.ceil(hi - 0.5) - 1).cast("int"), grid.height)
    edges = edges.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    if cells is None:
        met = edges.withColumn("row", F.explode(F.sequence("_first", "_last")))
    else:
        cells = cells.select("row", "col").where(grid.holds()).distinct()
        met = join_runs(cells.select("row").distinct(), edges, "row", [])
    cross = met.withColumn("_u", F.col("u0") + (F.col("row") + 0.5 - F.col("v0"))
                           / (F.col("v1") - F.col("v0")) * (F.col("u1") - F.col("u0")))
    line = Window.partitionBy(name, "row").orderBy("_u")
    spans = (cross.withColumn("_k", F.row_number().over(line)).withColumn("_end", F.lead("_u").over(line))
             .where((F.col("_k") % 2 == 1) & F.col("_end").isNotNull()))
    c0 = F.greatest(F.ceil(F.col("_u") - 0.5).cast("int"), F.lit(0))
    c1 = _upto((F.ceil(F.col("_end") - 0.5) - 1).cast("int"), grid.width)
    spans = spans.select(name, "row", c0.alias("_first"), c1.alias("_last")).where("_first <= _last")
    if cells is None:
        return spans.select(name, "row", F.explode(F.sequence("_first", "_last")).alias("col"))
    return join_runs(cells, spans, "col", ["row"]).select(name, "row", "col")


def select_feature(features: DataFrame, name: str, wanted: str) -> DataFrame:
    """The unique case-insensitive exact match of a name, else the unique partial match."""
    n = F.lower(F.trim(F.col(name)))
    target = wanted.strip().lower()
    exact, part = n == target, n.contains(target)
    row = F.struct(*features.columns)
    found = features.agg(
        F.count_if(exact).alias("_ne"), F.any_value(F.when(exact, row), True).alias("_e"),
        F.count_if(part).alias("_np"), F.any_value(F.when(part, row), True).alias("_p"),
        F.min(F.when(part, F.col(name))).alias("_lo"), F.max(F.when(part, F.col(name))).alias("_hi"))
    problem = F.raise_error(F.concat(
        F.lit(f"expected exactly one feature matching '{wanted}', found "), F.col("_np").cast("string"),
        F.lit(" between "), F.coalesce("_lo", F.lit("-")), F.lit(" and "), F.coalesce("_hi", F.lit("-"))))
    chosen = (F.when(F.col("_ne") == 1, F.col("_e")).when(F.col("_np") == 1, F.col("_p"))
              .otherwise(problem.cast(found.schema["_p"].dataType)))
    return found.select(chosen.alias("_f")).select("_f.*")


def grid_alignment(first: DataFrame, second: DataFrame, key: Sequence[str] = ("row", "col")) -> DataFrame:
    """Cells on one side only and the largest coordinate differences."""
    a = first.select(*key, F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = second.select(*key, F.col("x").alias("xb"), F.col("y").alias("yb"))
    return a.join(b, list(key), "full").agg(
        F.count_if(F.col("xa").isNotNull() & F.col("xb").isNotNull()).alias("common_cells"),
        F.count_if(F.col("xb").isNull()).alias("first_only"), F.count_if(F.col("xa").isNull()).alias("second_only"),
        F.max(F.abs(F.col("xa") - F.col("xb"))).alias("max_dx"),
        F.max(F.abs(F.col("ya") - F.col("yb"))).alias("max_dy"))


def require_alignment(report: DataFrame, tolerance: float = 1.0e-6) -> DataFrame:
    """Turn a mismatch found by :func:`grid_alignment` into an error."""
    bad = ((F.col("first_only") > 0) | (F.col("second_only") > 0)
           | (F.greatest(F.coalesce("max_dx", F.lit(0.0)), F.coalesce("max_dy", F.lit(0.0))) > tolerance))
    common = F.col("common_cells")
    return report.withColumn("common_cells", F.when(bad, F.raise_error(
        F.concat(F.lit("stored cells do not match the grid: "), F.to_json(F.struct(*report.columns)))).cast("bigint"))
        .otherwise(common))


def join_bands(cells: DataFrame, elevation: str = "elev_m", bands: dict | None = None) -> DataFrame:
    """One row per cell and elevation band it belongs to (bands overlap)."""
    from ..functions.physics import band_names

    return cells.withColumn("band", F.explode(band_names(elevation, bands)))


