from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nivalgrid.operators import areal, spatial
from nivalgrid.operators.spatial import Grid

POLY = "name string, ring array<struct<x: double, y: double>>, hole boolean"


def lattice(spark, grid):
    return spark.range(grid.width * grid.height).select(
        F.floor(F.col("id") / grid.width).cast("int").alias("row"), (F.col("id") % grid.width).cast("int").alias("col"))


def test_envelope(spark):
    fine, coarse = Grid("f", 0, 0, 1, 1, 4, 4), Grid("c", 0, 0, 2, 2, 2, 2)
    inside = spatial.centers_in_cells(spatial.with_centers(lattice(spark, fine), fine), coarse).where("coarse_row = 0 AND coarse_col = 0")
    assert sorted((r.row, r.col) for r in inside.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_point_on_an_edge_belongs_to_both_cells(spark):
    pts = spark.createDataFrame([(2.0, 1.0)], "x double, y double")
    got = spatial.centers_in_cells(pts, Grid("c", 0, 0, 2, 2, 2, 2)).collect()
    assert sorted((r.coarse_row, r.coarse_col) for r in got) == [(0, 0), (0, 1)]


def clip_area(ring, x0, y0, x1, y1):
    """Area of a polygon inside a box, by half-plane clipping."""
    def cut(pts, axis, limit, keep_less):
        out = []
        for (a, b) in zip(pts, pts[1:] + pts[:1]):
            ina, inb = (a[axis] <= limit) == keep_less or a[axis] == limit, (b[axis] <= limit) == keep_less or b[axis] == limit
            if ina:
                out.append(a)
            if ina != inb:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        return out
    pts = list(ring)
    for axis, limit, less in ((0, x0, False), (0, x1, True), (1, y0, False), (1, y1, True)):
        pts = cut(pts, axis, limit, less)
        if len(pts) < 3:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1]))) / 2


SHAPES = {"rect": [(1.25, 0.5), (6.5, 0.5), (6.5, 4.75), (1.25, 4.75)],
          "tri": [(0.3, 0.2), (7.9, 1.1), (2.2, 5.6)],
          "clockwise": [(2.2, 5.6), (7.9, 1.1), (0.3, 0.2)],
          "outside": [(-3.0, -2.0), (4.2, 1.0), (5.0, 12.0), (-1.0, 3.0)],
          "aligned": [(2.0, 1.0), (5.0, 1.0), (5.0, 4.0), (2.0, 4.0)]}


@pytest.mark.parametrize("grid", [Grid("up", 0, 0, 1, 1, 8, 6), Grid("down", 0, 6, 1, -1, 8, 6), Grid("wide", -1, -1, 1.5, 0.7, 6, 10)])
def test_polygon_weights(spark, grid):
    rows = [(n, [(float(x), float(y)) for x, y in ring], False) for n, ring in SHAPES.items()]
    got = {(r.name, r.row, r.col): r.weight for r in spatial.polygon_weights(spark.createDataFrame(rows, POLY), grid).collect()}
    for name, ring in SHAPES.items():
        for r in range(grid.height):
            for c in range(grid.width):
                xs = sorted((grid.x0 + c * grid.dx, grid.x0 + (c + 1) * grid.dx))
                ys = sorted((grid.y0 + r * grid.dy, grid.y0 + (r + 1) * grid.dy))
                want = clip_area(ring, xs[0], ys[0], xs[1], ys[1]) / grid.cell_area_m2
                assert got.get((name, r, c), 0.0) == pytest.approx(want, abs=1e-9), (name, r, c)


def test_polygon_with_hole_and_mask(spark):
    grid = Grid("g", 0, 0, 1, 1, 12, 12)
    rows = [("p", [(1.0, 1.0), (11.0, 1.0), (11.0, 11.0), (1.0, 11.0)], False), ("p", [(4.0, 4.0), (4.0, 8.0), (8.0, 8.0), (8.0, 4.0)], True)]
    df = spark.createDataFrame(rows, POLY)
    w = spatial.polygon_weights(df, grid).toPandas()
    assert w.weight.sum() == pytest.approx(100 - 16) and len(w) == 84
    m = spatial.center_mask(df, grid).toPandas()
    assert set(zip(m.row, m.col)) == set(zip(w.row, w.col))


def test_concave_polygon_area_is_conserved(spark):
    grid = Grid("g", 0, 0, 1, 1, 30, 30)
    ring = [(15 + (6 + 6 * (i % 2)) * math.cos(2 * math.pi * i / 14), 15 + (6 + 6 * (i % 2)) * math.sin(2 * math.pi * i / 14)) for i in range(14)]
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2
    w = spatial.polygon_weights(spark.createDataFrame([("star", ring, False)], POLY), grid).toPandas()
    assert w.weight.sum() == pytest.approx(area) and w.weight.between(0, 1).all()


@pytest.mark.parametrize("keep", [0.9, 0.02])
def test_nearest_cells_with_sparse_mask(spark, keep):
    grid = Grid("g", 100.0, 900.0, 10.0, -5.0, 70, 90)
    rng = np.random.default_rng(4)
    cells = lattice(spark, grid).toPandas()
    cells = cells[rng.random(len(cells)) < keep]
    pts = pd.DataFrame({"station_id": range(25), "x": rng.uniform(-400, 1300, 25), "y": rng.uniform(200, 1200, 25)})
    got = spatial.nearest_cells(spark.createDataFrame(pts), spark.createDataFrame(cells), grid, k=3).toPandas()
    cx, cy = grid.x0 + (cells.col + 0.5) * grid.dx, grid.y0 + (cells.row + 0.5) * grid.dy
    for p in pts.itertuples():
        want = np.sort(np.hypot(p.x - cx, p.y - cy))[:3]
        np.testing.assert_allclose(got[got.station_id == p.station_id].sort_values("neighbour").distance_m, want)


def test_open_lattices_have_no_top(spark):
    src, dst = Grid("s", 0, 0, 1, 1, 4, None), Grid("d", 0, 0, 2, 2, 2, None)
    cells = spark.createDataFrame([(99_999, 0, 1.0), (260_000, 1, 2.0)], "row int, col int, v double")
    got = spatial.regrid_area_average(cells, src, dst, [], ["v"], 0.0).collect()
    assert {(r.row, r.col): r.v for r in got} == {(49_999, 0): 1.0, (130_000, 0): 2.0}
    inside = spatial.centers_in_cells(spatial.with_centers(cells, src), dst).collect()
    assert {(r.coarse_row, r.coarse_col) for r in inside} == {(49_999, 0), (130_000, 0)}
    near = spatial.nearest_cells(spark.createDataFrame([(1, 1.5, 260_001.0)], "station_id int, x double, y double"), cells, src).first()
    assert (near.row, near.col) == (260_000, 1)
    ring = [("p", [(0.0, 260_000.0), (2.0, 260_000.0), (2.0, 260_001.0), (0.0, 260_001.0)], False)]
    polygons = spark.createDataFrame(ring, POLY)
    assert {(r.row, r.col) for r in spatial.polygon_weights(polygons, src).collect()} == {(260_000, 0), (260_000, 1)}
    assert {(r.row, r.col) for r in spatial.center_mask(polygons, src).collect()} == {(260_000, 0), (260_000, 1)}
    with pytest.raises(Exception, match="outside lattice"):
        spatial.regrid_area_average(cells, Grid("s", 0, 0, 1, 1, 4, 100_000), dst, [], ["v"], 0.0).collect()


def test_tall_polygon_and_empty_rings(spark):
    grid = Grid("g", 0, 0, 1, 1, 4, 4)
    tall = spark.createDataFrame([("t", [(0.0, -2.0e6), (4.0, -2.0e6), (2.0, 3.0e6)], False), ("e", [], False), ("l", [(0.0, 0.0), (1.0, 1.0)], False)], POLY)
    got = {(r.name, r.row, r.col): r.weight for r in spatial.polygon_weights(tall, grid).collect()}
    assert {k[0] for k in got} == {"t"} and len(got) == 16
    for (_, r, c), w in got.items():
        assert w == pytest.approx(clip_area([(0.0, -2.0e6), (4.0, -2.0e6), (2.0, 3.0e6)], c, r, c + 1, r + 1), abs=1e-6)
    assert {r.name for r in spatial.center_mask(tall, grid).collect()} == {"t"}


def test_nearest_with_fewer_cells_than_k(spark):
    grid = Grid("g", 0, 0, 1, 1, 20, 20)
    got = spatial.nearest_cells(spark.createDataFrame([(1, 3.0, 3.0)], "station_id int, x double, y double"),
                                spark.createDataFrame([(19, 19), (0, 7)], "row int, col int"), grid, k=5).collect()
    assert [(r.row, r.col) for r in sorted(got, key=lambda r: r.neighbour)] == [(0, 7), (19, 19)]


def test_regrid_conserves_and_masks(spark):
    src, dst = Grid("s", 0, 0, 3, 2, 8, 9), Grid("d", 0, 18, 5, -4.5, 5, 4)
    rng = np.random.default_rng(6)
    cells = lattice(spark, src).toPandas().assign(k=1)
    cells["v"] = rng.uniform(0, 9, len(cells))
    out = spatial.regrid_area_average(spark.createDataFrame(cells), src, dst, ["k"], ["v"], 0.0).toPandas()
    mapped = (out.v * out.v_coverage).sum() * dst.cell_area_m2
    assert mapped == pytest.approx(cells.v.sum() * src.cell_area_m2)
    half = spark.createDataFrame(cells[["row", "col", "k", "v"]]).withColumn("v", F.when(F.col("col") != 0, F.col("v")))
    r = spatial.regrid_area_average(half, Grid("s", 0, 0, 1, 1, 8, 9), Grid("d", 0, 0, 2, 1, 4, 9), ["k"], ["v"], 0.5).where("row = 0 AND col = 0").first()
    assert r.v_coverage == 0.5 and r.v is not None  # coverage exactly at the minimum is kept
    r = spatial.regrid_area_average(half, Grid("s", 0, 0, 1, 1, 8, 9), Grid("d", 0, 0, 2, 1, 4, 9), ["k"], ["v"], 0.51).where("row = 0 AND col = 0").first()
    assert r.v is None


def test_feature_selection(spark):
    df = spark.createDataFrame([("East Fork", 1), ("east fork upper", 2), ("West", 3)], "name string, id int")
    assert spatial.select_feature(df, "name", " EAST fork ").first().id == 1
    assert spatial.select_feature(df, "name", "upper").first().id == 2
    with pytest.raises(Exception, match="expected exactly one feature"):
        spatial.select_feature(df, "name", "e").collect()


def test_strict_mean_and_support(spark):
    w = spark.createDataFrame([("g", 0, 0, 0.5), ("g", 0, 1, 1.0), ("g", 0, 2, 0.0)], "grid_id string, row int, col int, weight double")
    c = spark.createDataFrame([(1, 0, 0, 4.0), (1, 0, 1, 1.0), (2, 0, 0, 4.0), (2, 0, 2, 9.0)], "d int, row int, col int, v double")
    got = {r.d: (r.v, r.v_valid_area_fraction) for r in areal.basin_means(c, w, ["d"], ["v"]).collect()}
    assert got[1] == (pytest.approx(2.0), pytest.approx(1.0)) and got[2] == (4.0, pytest.approx(1 / 3))
    assert {r.d: r.v for r in areal.basin_means_strict(c, w, ["d"], ["v"], "null").collect()} == {1: pytest.approx(2.0), 2: None}
    with pytest.raises(Exception, match="missing values in 1 support cells"):
        areal.basin_means_strict(c, w, ["d"], ["v"]).collect()
    with pytest.raises(Exception, match="no positive weight"):
        areal.require_support(w.withColumn("weight", F.lit(0.0))).collect()
    assert areal.basin_volume(c, w, ["d"], "v", 1e6).where("d = 1").first().volume_m3 == pytest.approx(3000.0)


def test_empty_envelope_is_an_error(spark):
    roles = spark.createDataFrame([(1, "nearest", 0, 0, 1.0), (1, "coarse", 0, 0, 2.0)], "station_id bigint, role string, row int, col int, distance_m double")
    assert spatial.lookup_report(roles, allow_empty=True).first().envelope_cells == 0
    with pytest.raises(Exception, match="no valid cell centre"):
        spatial.lookup_report(roles).collect()


def test_lambert_origin_and_symmetry(spark):
    x, y = spatial.lambert_forward("lat", "lon", 30.0, 50.0, 39.0, -107.0)
    r = spark.createDataFrame([(39.0, -107.0), (39.5, -106.0), (39.5, -108.0)], "lat double, lon double").select(x, y).collect()
    assert r[0][0] == pytest.approx(0, abs=1e-6) and r[0][1] == pytest.approx(0, abs=1e-6)
    assert r[1][0] == pytest.approx(-r[2][0]) and r[1][1] == pytest.approx(r[2][1])
    tangent = spatial.lambert_forward("lat", "lon", 39.0, 39.0, 39.0, -107.0)
    t = spark.createDataFrame([(39.01, -107.0)], "lat double, lon double").select(*tangent).first()
    assert t[1] == pytest.approx(6370000 * math.radians(0.01), rel=1e-6)


@pytest.mark.parametrize("grid", [Grid("up", 0, 0, 1, 1, 8, 6), Grid("down", 0, 6, 1, -1, 8, 6), Grid("open", -1, -1, 1.5, 0.7, None, None)])
def test_weights_and_mask_of_existing_cells(spark, grid):
    """The same values as over the whole lattice, for the cells that exist; holes and repeated cells too."""
    shapes = [(n, [(float(x), float(y)) for x, y in ring], False) for n, ring in SHAPES.items()]
    shapes += [("ring", [(0.5, 0.5), (7.5, 0.5), (7.5, 5.5), (0.5, 5.5)], False), ("ring", [(2.2, 2.1), (4.0, 2.1), (4.0, 4.4)], True)]
    polygons = spark.createDataFrame(shapes, POLY)
    some = [(r, c) for r in range(9) for c in range(9) if (r * 7 + c * 3) % 4]
    cells = spark.createDataFrame([*some, *some[:5]], "row int, col int")
    want = {(r.name, r.row, r.col): r.weight for r in spatial.polygon_weights(polygons, grid).collect() if (r.row, r.col) in some}
    got = {(r.name, r.row, r.col): r.weight for r in spatial.polygon_weights(polygons, grid, cells=cells).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    mask = lambda df: sorted((r.name, r.row, r.col) for r in df.collect() if (r.row, r.col) in some)
    assert mask(spatial.center_mask(polygons, grid, cells=cells)) == mask(spatial.center_mask(polygons, grid))


def test_tall_polygon_over_few_cells(spark):
    """A triangle of a million rows over an open lattice of 16 cells: 16 rows out, none generated between."""
    ring = [(0.0, 0.0), (4.0, 0.0), (2.0, 1.0e6)]
    tall = spark.createDataFrame([("t", ring, False)], POLY)
    grid = Grid("open", 0, 0, 1, 1, None, None)
    rows = [0, 3, 500_000, 999_999]
    cells = spark.createDataFrame([(r, c) for r in rows for c in range(4)], "row int, col int")
    out = spatial.polygon_weights(tall, grid, cells=cells)
    got = {(r.row, r.col): r.weight for r in out.collect()}
    for r in rows:
        for c in range(4):
            assert got.get((r, c), 0.0) == pytest.approx(clip_area(ring, c, r, c + 1, r + 1), abs=1e-9), (r, c)
    wide = spark.createDataFrame([("w", [(-1.0, -1.0), (5.0, -1.0), (5.0, 1.0e6 + 5), (-1.0, 1.0e6 + 5)], False)], POLY)
    assert spatial.polygon_weights(wide, grid, cells=cells).count() == 16 == spatial.center_mask(wide, grid, cells=cells).count()
    assert not [x for df in (out, spatial.center_mask(tall, grid, cells=cells)) for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n")
                if "explode(sequence(" in x and "_first" in x]


def test_join_runs(spark):
    rng = np.random.default_rng(12)
    runs = [(int(k), int(a), int(a + n)) for k, a, n in zip(rng.integers(0, 3, 60), rng.integers(-1000, 1000, 60), rng.integers(-2, 900, 60))]
    points = [(int(k), int(p)) for k, p in zip(rng.integers(0, 3, 80), rng.integers(-1100, 1900, 80))]
    got = spatial.join_runs(spark.createDataFrame([(*p, i) for i, p in enumerate(points)], "k int, at int, i int"),
                            spark.createDataFrame([(*r, j) for j, r in enumerate(runs)], "k int, _first int, _last int, j int"), "at", ["k"])
    want = sorted((i, j) for i, (k, p) in enumerate(points) for j, (q, a, z) in enumerate(runs) if k == q and a <= p <= z)
    assert sorted((r.i, r.j) for r in got.collect()) == want


def test_far_station_reads_few_tiles(spark):
    """1,000 km outside a lattice of a million by a million cells of one metre."""
    grid = Grid("wide", 0, 0, 1, 1, 1_000_000, 1_000_000)
    edge = spark.range(1_000_000).select(F.col("id").cast("int").alias("row"), F.lit(0).alias("col"))
    rest = spark.range(200_000).select((F.col("id") * 48_271 % 1_000_000).cast("int").alias("row"), (F.col("id") * 69_621 % 999_983 + 1).cast("int").alias("col"))
    cells = edge.unionByName(rest)
    stations = spark.createDataFrame([(1, -1.0e6, 400_000.5), (2, 2.0e6, 2.0e6), (3, 500_000.0, 500_000.0), (4, -1.0e6, -1.0e6)], "station_id int, x double, y double")
    tiles = {r.station_id: r["count"] for r in spatial.nearest_tiles(stations, cells, grid, k=2).groupBy("station_id").count().collect()}
    assert set(tiles) == {1, 2, 3, 4} and max(tiles.values()) <= 40
    got = spatial.nearest_cells(stations, cells, grid, k=2).toPandas()
    pdf = cells.toPandas()
    for s in stations.collect():
        d = np.sort(np.hypot(pdf.col + 0.5 - s.x, pdf.row + 0.5 - s.y))[:2]
        np.testing.assert_allclose(got[got.station_id == s.station_id].sort_values("neighbour").distance_m, d)


def test_nearest_odd_inputs(spark):
    grid = Grid("g", 0, 0, 1, 1, None, None)
    none = spark.createDataFrame([], "row int, col int")
    at = spark.createDataFrame([(1, 3.0, 3.0), (2, None, 1.0)], "station_id int, x double, y double")
    assert spatial.nearest_cells(at, none, grid).collect() == []
    one = spark.createDataFrame([(5, 5)], "row int, col int")
    assert [(r.station_id, r.row) for r in spatial.nearest_cells(at, one, grid, k=3).collect()] == [(1, 5)]
    with pytest.raises(ValueError, match="open"):
        grid.bounds
