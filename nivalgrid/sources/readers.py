"""Readers for the long tables, station and gauge files, and observation cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar as cal
from ..functions import physics, units
from ..operators.relate import last_by, require_coverage
from ..operators.scale import unique_rows
from ..operators.timeaxis import axis_report

# Column names of the landed station file.
STATION_COLUMNS = {"Date": "date", "ID": "station_id",
                   "Precipitation Increment (mm)": "precip_observed_mm",
                   "Snow Water Equivalent (mm)": "swe_mm", "Snow Depth (mm)": "snow_depth_mm"}

GAUGE_JSON_SCHEMA = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
    T.StructField("properties", T.StructType([
        T.StructField("parameter_code", T.StringType()), T.StructField("time", T.StringType()),
        T.StructField("value", T.StringType())]))])))])


def require_columns(df: DataFrame, columns: Sequence[str], context: str = "table") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{context} is missing required columns {missing}; available: {df.columns}")
    return df


def null_nan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN and infinity become NULL in the floating columns (all of them by default)."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: physics.finite(c) for c in names}) if names else df


def in_period(df: DataFrame, start: str, end: str, ts: str = "ts") -> Column:
    """Whether a time lies in ``start .. end`` (both inclusive), with bounds in the column's own type so that they reach a scan.

    Dates are compared by day; text is parsed, and then nothing reaches the scan.
    """
    kind = df.schema[ts].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        lo, hi = (F.lit(x).cast("timestamp_ntz").cast(kind) if isinstance(kind, T.DateType) else F.lit(x).cast(kind) for x in (start, end))
        return F.col(ts).between(lo, hi)
    return F.col(ts).try_cast("timestamp_ntz").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def hourly_grid(cells: DataFrame, variables: Sequence[str], start: str, end: str, ts: str = "ts",
                keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Selected variables of a period.

    Columns and time range reach the scan when ``cells`` is a stored table; for derived hours,
    filter the raw times before they are aggregated.
    """
    require_columns(cells, [ts, *keys, *variables], "hourly grid")
    return null_nan(cells.select(ts, *keys, *variables).where(in_period(cells, start, end, ts)), variables)


def grid_subset(cells: DataFrame, variables: Sequence[str], rows: tuple[int, int], cols: tuple[int, int],
                start: str, end: str, ts: str = "ts") -> DataFrame:
    """Half-open row/column box of a period (what a bounding-box slice of a cube returns)."""
    inside = F.col("row").between(rows[0], rows[1] - 1) & F.col("col").between(cols[0], cols[1] - 1)
    return hourly_grid(cells.where(inside), variables, start, end, ts)


def daily_folders(df: DataFrame, expected_days: DataFrame, policy: str = "error") -> DataFrame:
    """Rows of the expected days; a missing day is an error or is skipped."""
    return require_coverage(expected_days, df, ["date"], policy)


def list_archive(spark: SparkSession, path: str) -> DataFrame:
    """File paths below a folder. File contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path"))


def station_csv(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
                columns: dict[str, str] | None = None) -> DataFrame:
    """Station file: fixed header, numeric coercion (bad text -> NULL), date window."""
    names = columns or STATION_COLUMNS
    raw = require_columns(spark.read.option("header", True).csv(path), list(names), "station file")
    df = raw.select(*[F.col(f"`{src}`").alias(dst) for src, dst in names.items()])
    df = df.withColumn("date", F.col("date").try_cast("date")).withColumn(
        "station_id", F.col("station_id").try_cast("double").try_cast("bigint"))
    for c in df.columns:
        if c not in ("date", "station_id"):
            df = df.withColumn(c, physics.finite(F.col(c).try_cast("double")))
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df.withColumn("water_year", cal.water_year("date"))


def _gauge(date: Column, cfs: Column, df: DataFrame) -> DataFrame:
    out = df.select(date.alias("date"), physics.finite(cfs).alias("discharge_cfs")).where(F.col("date").isNotNull())
    return (out.withColumn("discharge_m3_day", units.cfs_to_m3_day("discharge_cfs"))
            .withColumn("water_year", cal.water_year("date")))


def gauge_text(spark: SparkSession, path: str, parameter: str = "00060", statistic: str = "00003") -> DataFrame:
    """Tab-delimited gauge file: ``#`` comments, value column named by its codes."""
    df = spark.read.option("sep", "\t").option("comment", "#").option("header", True).csv(path)
    token = f"{parameter}_{statistic}"
    found = [c for c in df.columns if token in c and not c.endswith("_cd")]
    if len(found) != 1:
        raise ValueError(f"could not identify the discharge column uniquely: {found}")
    return _gauge(F.col("datetime").try_cast("date"), F.col(f"`{found[0]}`").try_cast("double"), df)


def gauge_json(spark: SparkSession, path: str, parameter: str = "00060", multi_line: bool = True) -> DataFrame:
    """Landed JSON pages of daily values; the last record of a date wins.

    Pages are ordered by file name, then by place in the file (pages of one line
    each with ``multi_line=False``), then by feature position.
    """
    pages = spark.read.schema(GAUGE_JSON_SCHEMA).option("multiLine", multi_line).json(path)
    place = F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                     F.monotonically_increasing_id().alias("i"))
    flat = (pages.select(place.alias("_file"), "features")
            .select("_file", F.posexplode("features").alias("_pos", "_f")).select("_file", "_pos", "_f.properties.*"))
    rows = (flat.where(F.col("parameter_code") == parameter)
            .select("_file", "_pos", F.col("time").try_cast("date").alias("date"),
                    F.col("value").try_cast("double").alias("value")).where(F.col("date").isNotNull()))
    latest = last_by(rows, ["date"], ["_file", "_pos"])
    return _gauge(F.col("date"), F.col("value"), latest)


def static_grid(cells: DataFrame, elevation: str = "elev_m") -> DataFrame:
    """Grid cells with a validity flag from their elevation."""
    z = physics.finite(elevation)
    return cells.withColumn(elevation, z).withColumn("valid", z.isNotNull())


def observation_cells(obs: DataFrame, unit: str = "units", value: str = "value", cleaned: bool = False,
                      nodata: float = -9999.0) -> DataFrame:
    """Observation cells in millimetres.

    Raw products must declare metres and are scaled; cleaned copies must declare
    millimetres. The nodata value and NaN become NULL.
    """
    v = physics.finite(value)
    v = F.when(v != F.lit(float(nodata)), v)
    u = F.lower(F.coalesce(F.col(unit), F.lit("")))
    if cleaned:
        gate = F.trim(u).isin(*units.MILLIMETRE_UNITS)
        mm = v
    else:
        gate = u.contains("[m]") | u.contains(" meter") | u.contains(" metre")
        mm = units.metres_to_mm(v)
    wrong = F.raise_error(F.concat(F.lit("observation does not declare its length unit: "), u)).cast("boolean")
    return obs.where(F.when(gate, True).otherwise(wrong)).withColumn("raw_mm", mm)


def processed_daily(df: DataFrame, required: Sequence[str], keys: Sequence[str] = ("date",)) -> DataFrame:
    """Reload a processed daily table: parse dates and numbers, derive the water year, enforce unique keys."""
    require_columns(df, ["date", *required], "daily table")
    parsed = F.col("date").cast("string").try_cast("timestamp_ntz").cast("date")
    bad = F.raise_error(F.concat(F.lit("unparseable date: "), F.coalesce(F.col("date").cast("string"), F.lit("NULL"))))
    out = df.withColumn("date", F.when(parsed.isNotNull(), parsed).otherwise(bad.cast("date")))
    for c in required:
        out = out.withColumn(c, physics.finite(F.col(c).cast("string").try_cast("double")))
    if "water_year" in df.columns:
        out = out.withColumn("water_year", F.col("water_year").cast("string").try_cast("int"))
    else:
        out = out.withColumn("water_year", cal.water_year("date"))
    return unique_rows(out, list(keys), "daily table")


def input_report(df: DataFrame, keys: Sequence[str], time: str, identity: str | None = None) -> DataFrame:
    """Row count, first and last time and the number of distinct ids per key."""
    aggs = [F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time")]
    if identity is not None:
        return (df.groupBy(*keys, identity).agg(*aggs).groupBy(*keys)
                .agg(F.sum("rows").alias("rows"), F.min("first_time").alias("first_time"),
                     F.max("last_time").alias("last_time"), F.count(identity).alias("id_count")))
    return df.groupBy(*keys).agg(*aggs)


def axis_input_report(df: DataFrame, keys: Sequence[str], time: str, identity: Sequence[str], expected_hours: float = 1.0) -> DataFrame:
    """Input report with the checks of the time axis: each series (``identity``) is checked on its own and summed up per key.

    ``regular`` says that no series has a missing time, a time twice or a step other than ``expected_hours``. Series
    without any time are not counted.
    """
    per = axis_report(df, [*keys, *identity], time, expected_hours)
    flaws = [F.sum(c).alias(c) for c in ("null_count", "duplicate_count", "unexpected_gap_count")]
    out = per.groupBy(*keys).agg(
        F.sum(F.col("record_count") + F.col("null_count")).alias("rows"), F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"), F.count(F.lit(1)).alias("id_count"), *flaws)
    return out.withColumn("regular", (F.col("null_count") + F.col("duplicate_count") + F.col("unexpected_gap_count")) == 0)


def unit_consistency(df: DataFrame, variable: str, unit: str) -> DataFrame:
    """Normalised unit spellings per variable; more than one is inconsistent."""
    spellings = df.select(variable, units.normalize_units(unit).alias("unit")).distinct()
    return spellings.groupBy(variable).agg(
        F.array_join(F.sort_array(F.collect_set("unit")), "|").alias("units"),
        (F.count("unit") == 1).alias("consistent"))
