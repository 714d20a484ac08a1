"""Schemas of the long tables the operators take."""

from __future__ import annotations

from pyspark.sql import types as T

CELL_HOUR = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType())])

CELL_DAY_VALUES = ("swe_mm", "snow_depth_mm", "precip_mm", "snowfall_mm", "melt_mm", "release_mm",
                   "incoming_sw_energy_mj_m2", "absorbed_sw_energy_mj_m2", "cover")

CELL_DAY = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("water_year", T.IntegerType()),
    T.StructField("date", T.DateType()), T.StructField("row", T.IntegerType()),
    T.StructField("col", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in CELL_DAY_VALUES]])

CELL_WEIGHT = T.StructType([
    T.StructField("grid_id", T.StringType()), T.StructField("row", T.IntegerType()),
    T.StructField("col", T.IntegerType()), T.StructField("weight", T.DoubleType())])

POLYGON = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("ring", T.ArrayType(T.StructType([
        T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))])

STATION = T.StructType([
    T.StructField("station_id", T.LongType()), T.StructField("station_name", T.StringType()),
    T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

STATION_CELL = T.StructType([
    T.StructField("station_id", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()),
    T.StructField("distance_m", T.DoubleType())])

GAUGE_DAY = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("discharge_cfs", T.DoubleType()),
    T.StructField("discharge_m3_day", T.DoubleType())])


def with_units(df, units: dict[str, str]):
    """Attach unit texts to columns as field metadata."""
    from pyspark.sql import functions as F

    for name, unit in units.items():
        df = df.withColumn(name, F.col(name).alias(name, metadata={"units": unit}))
    return df


def units_of(df, name: str) -> str:
    return df.schema[name].metadata.get("units", "")
