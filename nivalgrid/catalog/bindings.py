"""Binding of the driver tables to the roles the operators expect.

The tables are retail-shaped; here line items play daily snow series of two
gridded sources (I, N) and of stations (S), events play hourly records, orders
the gauge, customers / parts / suppliers the cells of three lattices. Every
frame is derived from the full tables and grows with them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import physics
from ..operators.spatial import Grid

#: Measures of one group of line items, as SQL both engines read.
MEASURES = {
    "swe_mm": "sum(l_quantity)",
    "snow_depth_mm": "sum(l_quantity * (3 + 10 * l_tax))",
    "precip_mm": "sum(l_quantity * (1 + l_tax))",
    "snowfall_mm": "sum(l_quantity * (1 - l_discount))",
    "melt_mm": "sum(l_quantity * l_discount)",
    "release_mm": "sum(l_quantity * l_tax)",
    "incoming_sw_energy_mj_m2": "sum(l_extendedprice) / 10000",
    "absorbed_sw_energy_mj_m2": "sum(l_extendedprice * (0.2 + 5 * l_discount)) / 10000",
    "cover": "round(avg(l_discount) * 10, 9)",
}

#: Measures of one hour of events in a cell.
HOUR_MEASURES = {
    "rain_mm_s": "sum(value) / 36000",
    "temp_k": "260 + avg(value) / 10",
    "sw_w_m2": "sum(value)",
    "absorbed_w_m2": "sum(value) * 0.6 - max(value) * 0.3",
    "lw_w_m2": "200 + avg(value)",
    "wind_u": "min(value) / 10",
    "wind_v": "max(value) / 10",
    "precip_mm": "sum(value) / 100",
    "snow_fraction": "least(1.0, avg(value) / 100)",
    "depth_m": "max(value) / 100",
    "cover": "least(1.0, max(value) / 150)",
}

FINE = Grid("fine", 0.0, 0.0, 10.0, 10.0, 30, None)       # customers
MIDDLE = Grid("middle", 0.0, 0.0, 20.0, 20.0, 15, None)   # parts
COMMON = Grid("common", 0.0, 0.0, 50.0, 50.0, 6, None)    # suppliers
UNEVEN = Grid("uneven", -7.0, -3.0, 24.0, 36.0, 13, None)  # not nested in FINE
CELLS = Grid("cells", 0.0, 0.0, 1000.0, 1000.0, 5, None)  # line items

SOURCE_SQL = "CASE l_returnflag WHEN 'A' THEN 'I' WHEN 'R' THEN 'N' ELSE 'S' END"


class Tables:
    """Driver tables and the frames derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @staticmethod
    def _grid(name: str, key: str):
        """Lattice name of the rows that have a cell key."""
        return F.when(F.col(key).isNotNull(), F.lit(name)).alias("grid_id")

    # -- line items as daily series ------------------------------------------------------

    def _items(self) -> DataFrame:
        cell = F.floor(F.col("l_suppkey") / 10).cast("int")
        return (self.read("lineitem").withColumn("source", F.expr(SOURCE_SQL))
                .withColumn("date", F.to_date("l_shipdate")).withColumn("water_year", cal.water_year("date"))
                .withColumn("station_id", F.col("l_linenumber").cast("bigint"))
                .withColumn("row", F.floor(cell / 5).cast("int")).withColumn("col", (cell % 5).cast("int")))

    def _daily(self, *keys: str, sources=("I", "N")) -> DataFrame:
        rows = self._items().where(F.col("source").isin(*sources))
        return rows.groupBy("source", *keys, "water_year", "date").agg(
            *[F.expr(sql).alias(name) for name, sql in MEASURES.items()])

    @cached_property
    def basin(self) -> DataFrame:
        return self._daily().withColumn("effective_albedo", physics.effective_albedo(
            "incoming_sw_energy_mj_m2", "absorbed_sw_energy_mj_m2", 0.05))

    @cached_property
    def years(self) -> DataFrame:
        return self._items().where("source <> 'S'").select("water_year").distinct()

    def basin_of(self, source: str) -> DataFrame:
        return self.basin.where(F.col("source") == source)

    @cached_property
    def station(self) -> DataFrame:
        return self._daily("station_id", sources=("S", "I", "N"))

    @cached_property
    def cells(self) -> DataFrame:
        return self._daily("row", "col")

    @cached_property
    def pairs(self) -> DataFrame:
        """Cell-days of both sources, from one aggregation clustered by cell and water year."""
        from ..operators.relate import pair_long
        return pair_long(self.cells, ["water_year", "row", "col", "date"], list(MEASURES),
                         cluster_by=["water_year", "row", "col"])

    @cached_property
    def weights(self) -> DataFrame:
        cell = F.floor(F.col("s_suppkey") / 10).cast("int")
        w = F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), (F.avg("s_acctbal") - 3000) / 4000)))
        return (self.read("supplier").withColumn("row", F.floor(cell / 5).cast("int"))
                .withColumn("col", (cell % 5).cast("int")).groupBy(self._grid("cells", "s_suppkey"), "row", "col").agg(w.alias("weight")))

    # -- orders as the gauge -------------------------------------------------------------

    @cached_property
    def gauge(self) -> DataFrame:
        from ..functions.units import cfs_to_m3_day
        date = F.to_date("o_orderdate").alias("date")
        return (self.read("orders").groupBy(date).agg((F.sum("o_totalprice") / 1e6).alias("discharge_cfs"))
                .withColumn("discharge_m3_day", cfs_to_m3_day("discharge_cfs"))
                .withColumn("water_year", cal.water_year("date")))

    # -- events as hourly records --------------------------------------------------------

    @cached_property
    def hours(self) -> DataFrame:
        return self._hours(self.read("events"))

    def hours_of(self, start: str, end: str, rows: int | None = None) -> DataFrame:
        """Hourly records of a period (and of the first rows): bounds of the raw time and key reach the scan."""
        e = self.read("events")
        kind = e.schema["ts"].dataType
        raw = e.where((F.col("ts") >= F.lit(start).cast(kind)) & (F.col("ts") < F.lit(end).cast(kind) + F.expr("INTERVAL 1 HOUR")))
        return self._hours(raw if rows is None else raw.where(F.col("user_id") < rows * 5 * 75))

    @staticmethod
    def _hours(events: DataFrame) -> DataFrame:
        cell = F.floor(F.col("user_id") / 75).cast("int")
        hour = F.to_date("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour("ts"))
        return (events
                .withColumn("source", F.when(F.col("event_type").isin("click", "view"), "I").otherwise("N"))
                .withColumn("row", F.floor(cell / 5).cast("int")).withColumn("col", (cell % 5).cast("int"))
                .withColumn("ts", hour).groupBy("source", "row", "col", "ts")
                .agg(*[F.expr(sql).alias(name) for name, sql in HOUR_MEASURES.items()]))

    @cached_property
    def basin_hours(self) -> DataFrame:
        hour = F.to_date("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour("ts"))
        return (self.read("events").withColumn("ts", hour).groupBy("ts")
                .agg(*[F.expr(sql).alias(name) for name, sql in HOUR_MEASURES.items()]))

    @cached_property
    def hour_weights(self) -> DataFrame:
        cell = F.floor(F.col("user_id") / 75).cast("int")
        return (self.read("events").withColumn("row", F.floor(cell / 5).cast("int"))
                .withColumn("col", (cell % 5).cast("int")).groupBy(self._grid("hours", "user_id"), "row", "col")
                .agg(F.least(F.lit(1.0), F.avg("value") / 100).alias("weight")))

    # -- lattices ------------------------------------------------------------------------

    def lattice(self, table: str, key: str, grid: Grid) -> DataFrame:
        k = F.col(key)
        return (self.read(table).withColumn("row", F.floor(k / grid.width).cast("int"))
                .withColumn("col", (k % grid.width).cast("int")))

    @cached_property
    def fine(self) -> DataFrame:
        return self.lattice("customer", "c_custkey", FINE)

    @cached_property
    def middle(self) -> DataFrame:
        return self.lattice("part", "p_partkey", MIDDLE)

    @cached_property
    def common(self) -> DataFrame:
        return self.lattice("supplier", "s_suppkey", COMMON)

    @cached_property
    def points(self) -> DataFrame:
        """Stations along all rows of the fine lattice; some lie outside it."""
        k = F.col("s_suppkey")
        return self.read("supplier").select(k.alias("station_id"), (k * 37 % 331 - 10.5).alias("x"),
                                            (k * 5 + k * 53 % 97 + 0.25).alias("y"))

    @cached_property
    def polygons(self) -> DataFrame:
        k = F.col("s_suppkey")
        cx, cy = k * 37 % 300 + 0.5, k * 5 + k * 53 % 97 + 0.5
        pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
        ring = F.array(pt(cx + (k * 7 % 41 + 15.3), cy), pt(cx, cy + (k * 11 % 53 + 12.7)),
                       pt(cx - (k * 13 % 29 + 18.1), cy), pt(cx, cy - (k * 17 % 47 + 14.9)))
        return self.read("supplier").select(F.col("s_name").alias("name"), ring.alias("ring"))

    @cached_property
    def raw_obs(self) -> DataFrame:
        """Observation cells with values outside the physical limits."""
        kinds = F.array(F.struct(F.lit("SWE").alias("variable"), (F.col("c_acctbal") * 0.55).alias("raw_mm")),
                        F.struct(F.lit("Snow depth").alias("variable"), (F.col("c_acctbal") * 1.6).alias("raw_mm")))
        return (self.fine.withColumn("inside", F.col("c_mktsegment") != "FURNITURE")
                .withColumn("obs_date", F.date_add(F.lit("2018-03-01").cast("date"), F.col("c_nationkey") % 4))
                .withColumn("_k", F.explode(kinds))
                .select("obs_date", "_k.variable", "row", "col",
                        F.when(~F.col("c_acctbal").between(4000, 4400), F.col("_k.raw_mm")).alias("raw_mm"), "inside"))

    def _fields(self, cells: DataFrame, value) -> DataFrame:
        dates = F.array(F.struct(F.lit("2018-03-31").cast("date").alias("obs_date"), F.lit(1.0).alias("f")),
                        F.struct(F.lit("2019-04-07").cast("date").alias("obs_date"), F.lit(0.7).alias("f")))
        kinds = F.array(F.struct(F.lit("SWE").alias("variable"), F.lit(1.0).alias("g")),
                        F.struct(F.lit("Snow depth").alias("variable"), F.lit(3.0).alias("g")))
        return (cells.withColumn("_v", value).withColumn("_d", F.explode(dates)).withColumn("_k", F.explode(kinds))
                .select("_d.obs_date", "_k.variable", "row", "col",
                        (F.col("_v") * F.col("_d.f") * F.col("_k.g")).alias("value")))

    @cached_property
    def obs_fields(self) -> DataFrame:
        return self._fields(self.fine, F.sqrt(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))) * 7)

    @cached_property
    def first_fields(self) -> DataFrame:
        return self._fields(self.middle, F.sqrt("p_retailprice") * 10 + F.col("p_size"))

    @cached_property
    def second_fields(self) -> DataFrame:
        return self._fields(self.common, F.sqrt(F.abs("s_acctbal")) * 6)

    @cached_property
    def common_weights(self) -> DataFrame:
        return self.common.select(self._grid("common", "s_suppkey"), "row", "col",
                                  ((F.col("s_nationkey") % 5) / 4).alias("weight"))

    @cached_property
    def middle_weights(self) -> DataFrame:
        return self.middle.select(self._grid("middle", "p_partkey"), "row", "col",
                                  ((F.col("p_size") % 4) / 3).alias("weight"))

    @cached_property
    def elevations(self) -> DataFrame:
        common = self.common.select(F.lit("common").alias("lattice"), "row", "col",
                                    (F.col("s_suppkey") * 37 % 1200 + 2500.0).alias("elev_m"))
        fine = self.middle.select(F.lit("fine").alias("lattice"), "row", "col",
                                  (F.col("p_partkey") * 53 % 1200 + 2500.0).alias("elev_m"))
        return common.unionByName(fine)

    @cached_property
    def lattice_cells(self) -> DataFrame:
        """Weight and elevation of both lattices, each table read once."""
        common = self.common.select(F.lit("common").alias("lattice"), "row", "col", ((F.col("s_nationkey") % 5) / 4).alias("weight"),
                                    (F.col("s_suppkey") * 37 % 1200 + 2500.0).alias("elev_m"))
        fine = self.middle.select(F.lit("fine").alias("lattice"), "row", "col", ((F.col("p_size") % 4) / 3).alias("weight"),
                                  (F.col("p_partkey") * 53 % 1200 + 2500.0).alias("elev_m"))
        return common.unionByName(fine)


# -- the same bindings as SQL ------------------------------------------------------------

_M = ", ".join(f"{sql} AS {name}" for name, sql in MEASURES.items())
_H = ", ".join(f"{sql} AS {name}" for name, sql in HOUR_MEASURES.items())
_PAIR = ", ".join(f"i.{m} AS {m}_i, n.{m} AS {m}_n" for m in MEASURES)
_WY = "(year({d}) + CASE WHEN month({d}) >= 10 THEN 1 ELSE 0 END)"


def wy(d: str) -> str:
    """Water year of a date, as SQL text."""
    return _WY.format(d=d)


BOUND_SQL = {
    "items": f"""items AS (SELECT *, {SOURCE_SQL} AS source, CAST(l_shipdate AS DATE) AS date,
        {wy('l_shipdate')} AS water_year, l_linenumber AS station_id,
        (l_suppkey // 10) // 5 AS "row", (l_suppkey // 10) % 5 AS col FROM lineitem)""",
    "basin": f"""basin AS (SELECT *, CASE WHEN incoming_sw_energy_mj_m2 > 0.05
        THEN 1 - absorbed_sw_energy_mj_m2 / incoming_sw_energy_mj_m2 END AS effective_albedo
        FROM (SELECT source, water_year, date, {_M} FROM items WHERE source <> 'S' GROUP BY 1, 2, 3))""",
    "station": f"""station AS (SELECT source, station_id, water_year, date, {_M} FROM items GROUP BY 1, 2, 3, 4)""",
    "cells": f"""cells AS (SELECT source, "row", col, water_year, date, {_M} FROM items WHERE source <> 'S'
        GROUP BY 1, 2, 3, 4, 5)""",
    "pairs": f"""pairs AS (SELECT i.water_year, i."row", i.col, i.date, {_PAIR} FROM cells i JOIN cells n
        ON i."row" = n."row" AND i.col = n.col AND i.date = n.date WHERE i.source = 'I' AND n.source = 'N')""",
    "weights": """weights AS (SELECT (s_suppkey // 10) // 5 AS "row", (s_suppkey // 10) % 5 AS col,
        least(1.0, sqrt(greatest(0.0, (avg(s_acctbal) - 3000) / 4000))) AS weight FROM supplier GROUP BY 1, 2)""",
    "gauge": f"""gauge AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) / 1e6 AS discharge_cfs,
        sum(o_totalprice) / 1e6 * (0.028316846592 * 86400.0) AS discharge_m3_day,
        {wy('CAST(o_orderdate AS DATE)')} AS water_year FROM orders GROUP BY CAST(o_orderdate AS DATE))""",
    "hours": f"""hours AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'I' ELSE 'N' END AS source,
        (user_id // 75) // 5 AS "row", (user_id // 75) % 5 AS col, date_trunc('hour', ts) AS ts, {_H}
        FROM events GROUP BY 1, 2, 3, 4)""",
    "basin_hours": f"""basin_hours AS (SELECT date_trunc('hour', ts) AS ts, {_H} FROM events
        GROUP BY date_trunc('hour', ts))""",
    "hour_weights": """hour_weights AS (SELECT (user_id // 75) // 5 AS "row", (user_id // 75) % 5 AS col,
        least(1.0, avg(value) / 100) AS weight FROM events GROUP BY 1, 2)""",
    "fine": """fine AS (SELECT *, CAST(c_custkey // 30 AS INT) AS "row", CAST(c_custkey % 30 AS INT) AS col FROM customer)""",
    "middle": """middle AS (SELECT *, CAST(p_partkey // 15 AS INT) AS "row", CAST(p_partkey % 15 AS INT) AS col FROM part)""",
    "common": """common AS (SELECT *, CAST(s_suppkey // 6 AS INT) AS "row", CAST(s_suppkey % 6 AS INT) AS col FROM supplier)""",
    "points": """points AS (SELECT s_suppkey AS station_id, s_suppkey * 37 % 331 - 10.5::DOUBLE AS x,
        s_suppkey * 5 + s_suppkey * 53 % 97 + 0.25::DOUBLE AS y FROM supplier)""",
    "edges": """edges AS (
        WITH c AS (SELECT s_name AS name, s_suppkey AS k, (s_suppkey * 37 % 300 + 0.5::DOUBLE) AS cx,
                   (s_suppkey * 5 + s_suppkey * 53 % 97 + 0.5::DOUBLE) AS cy FROM supplier),
        p AS (SELECT name, 1 AS i, cx + (k * 7 % 41 + 15.3::DOUBLE) AS x, cy AS y FROM c
              UNION ALL SELECT name, 2, cx, cy + (k * 11 % 53 + 12.7::DOUBLE) FROM c
              UNION ALL SELECT name, 3, cx - (k * 13 % 29 + 18.1::DOUBLE), cy FROM c
              UNION ALL SELECT name, 4, cx, cy - (k * 17 % 47 + 14.9::DOUBLE) FROM c)
        SELECT a.name, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM p a JOIN p b
        ON a.name = b.name AND b.i = a.i % 4 + 1)""",
    "raw_obs": """raw_obs AS (SELECT DATE '2018-03-01' + CAST(c_nationkey % 4 AS INT) AS obs_date, v.variable,
        "row", col, CASE WHEN NOT c_acctbal BETWEEN 4000 AND 4400 THEN c_acctbal * v.f END AS raw_mm, c_mktsegment <> 'FURNITURE' AS inside
        FROM fine, (VALUES ('SWE', 0.55::DOUBLE), ('Snow depth', 1.6::DOUBLE)) v(variable, f))""",
    "field_factors": """field_factors AS (SELECT * FROM (VALUES (DATE '2018-03-31', 1.0::DOUBLE), (DATE '2019-04-07', 0.7::DOUBLE)) d(obs_date, f),
        (VALUES ('SWE', 1.0::DOUBLE), ('Snow depth', 3.0::DOUBLE)) k(variable, g))""",
    "obs_fields": """obs_fields AS (SELECT obs_date, variable, "row", col,
        (sqrt(CASE WHEN c_acctbal >= 0 THEN c_acctbal END) * 7) * f * g AS value FROM fine, field_factors)""",
    "first_fields": """first_fields AS (SELECT obs_date, variable, "row", col,
        (sqrt(p_retailprice) * 10 + p_size) * f * g AS value FROM middle, field_factors)""",
    "second_fields": """second_fields AS (SELECT obs_date, variable, "row", col,
        (sqrt(abs(s_acctbal)) * 6) * f * g AS value FROM common, field_factors)""",
    "common_weights": """common_weights AS (SELECT "row", col, (s_nationkey % 5) / 4::DOUBLE AS weight FROM common)""",
    "middle_weights": """middle_weights AS (SELECT "row", col, (p_size % 4) / 3::DOUBLE AS weight FROM middle)""",
    "elevations": """elevations AS (SELECT 'common' AS lattice, "row", col, s_suppkey * 37 % 1200 + 2500.0::DOUBLE AS elev_m FROM common
        UNION ALL SELECT 'fine', "row", col, p_partkey * 53 % 1200 + 2500.0::DOUBLE FROM middle)""",
}

_NEEDS = {
    "basin": "items", "station": "items", "cells": "items", "pairs": "cells", "raw_obs": "fine",
    "obs_fields": "fine field_factors", "first_fields": "middle field_factors", "second_fields": "common field_factors",
    "common_weights": "common", "middle_weights": "middle", "elevations": "common middle",
}


def with_tables(names: str, sql: str) -> str:
    """Prefix a statement with the bound tables it names. ``sql`` may go on with ``, more AS (...)``."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, "").split():
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    body = sql.strip()
    if not order:
        return ("WITH " + body[1:]) if body.startswith(",") else body
    return "WITH " + ",\n".join(BOUND_SQL[n] for n in order) + "\n" + body
