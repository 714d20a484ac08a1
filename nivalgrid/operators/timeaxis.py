"""Checks and scaffolds on hourly and daily time axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from .scale import chunked_lag


def day_scaffold(years: DataFrame, start_md: str = "10-01", end_md: str = "06-30",
                 drop_feb29: bool = False) -> DataFrame:
    """Every calendar day of a seasonal window for each ``water_year``."""
    days = (years.select("water_year").distinct()
            .select("water_year", F.explode(F.sequence(
                cal.season_date("water_year", start_md), cal.season_date("water_year", end_md),
                F.expr("interval 1 day"))).alias("date")))
    return days.where(~cal.is_feb29("date")) if drop_feb29 else days


def hour_scaffold(days: DataFrame) -> DataFrame:
    """Hours 00-23 of every day."""
    return days.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))


def with_gaps(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Add ``prev_ts`` and ``gap_seconds`` along the time axis of each key."""
    lagged = chunked_lag(df, keys, ts, F.trunc(F.to_date(ts), "month"), [ts])
    gap = F.col(ts) - F.col(f"prev_{ts}")
    seconds = gap.cast("interval second").cast("decimal(18,6)").cast("double")
    return lagged.withColumn("gap_seconds", seconds)


def time_step_seconds(df: DataFrame, keys: Sequence[str], ts: str = "ts",
                      expected_hours: float = 1.0) -> DataFrame:
    """Median gap between consecutive records, or the expected step without any gap.

    Distinct gap lengths are few, so the median is taken on their counts.
    """
    keys = list(keys)
    gaps = with_gaps(df.select(*keys, ts).distinct(), keys, ts)
    counts = gaps.groupBy(*keys, "gap_seconds").agg(F.count(F.lit(1)).alias("n"))
    median = F.expr("percentile(gap_seconds, 0.5, n)")
    return counts.groupBy(*keys).agg(
        F.coalesce(median, F.lit(float(expected_hours) * 3600.0)).alias("step_seconds"))


def axis_report(df: DataFrame, keys: Sequence[str], ts: str = "ts", expected_hours: float = 1.0) -> DataFrame:
    """Record count, first/last time, NULLs, duplicates and unexpected gaps per key."""
    keys = list(keys)
    per_ts = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_copies"))
    steps = with_gaps(per_ts.where(F.col(ts).isNotNull()), keys, ts)
    expected = float(expected_hours) * 3600.0
    present = steps.groupBy(*keys).agg(
        F.sum("_copies").alias("record_count"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time"),
        F.sum(F.col("_copies") - 1).alias("duplicate_count"),
        F.count_if(F.abs(F.col("gap_seconds") - expected) > 1.0).alias("unexpected_gap_count"))
    missing = (per_ts.groupBy(*keys)
               .agg(F.coalesce(F.sum(F.when(F.col(ts).isNull(), F.col("_copies"))), F.lit(0)).alias("null_count")))
    return present.join(missing, keys)


def enforce_axis(report: DataFrame, expected_count: int | None = None, first: str | None = None,
                 last: str | None = None) -> DataFrame:
    """Turn a bad :func:`axis_report` into an error when it is evaluated."""
    problems = [(F.col("null_count") > 0, "time axis contains missing values"),
                (F.col("duplicate_count") > 0, "time axis contains duplicates")]
    if expected_count is not None:
        problems.append((F.col("record_count") != expected_count, f"record count differs from {expected_count}"))
    if first is not None:
        problems.append((F.col("first_time") != F.lit(first).cast("timestamp_ntz"), f"first time is not {first}"))
    if last is not None:
        problems.append((F.col("last_time") != F.lit(last).cast("timestamp_ntz"), f"last time is not {last}"))
    count = F.col("record_count")
    for bad, text in problems:
        count = F.when(bad, F.raise_error(F.lit(text)).cast("bigint")).otherwise(count)
    return report.withColumn("record_count", count)


def check_index_steps(df: DataFrame, keys: Sequence[str], index: str, block: int = 100_000) -> DataFrame:
    """Count of record indices that do not follow their predecessor by exactly 1."""
    keys = list(keys)
    lagged = chunked_lag(df.select(*keys, index), keys, index, F.floor(F.col(index) / block), [index])
    step = F.col(index) - F.col(f"prev_{index}")
    return lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(F.abs(step - 1) > 1e-9).alias("bad_increment_count"),
        F.min(index).alias("first_index"), F.max(index).alias("last_index"))


def require_unit_steps(df: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    report = check_index_steps(df, keys, index)
    bad = F.col("bad_increment_count")
    return report.withColumn("bad_increment_count", F.when(bad > 0, F.raise_error(
        F.concat(F.lit("time index is expected to increment by 1; unexpected increments: "), bad.cast("string")))
        .cast("bigint")).otherwise(bad))


def daily_completeness(df: DataFrame, keys: Sequence[str], ts: str = "ts", state_hour: int = 23,
                       expected_hours: int = 24) -> DataFrame:
    """Hours found per day, whether they are exactly 00-23, and the state hour.

    Distinct hours are kept as bits of one integer, so a single map-side combined
    aggregation is enough.
    """
    hour = F.hour(ts)
    seen = F.bit_count(F.bit_or(F.pow(F.lit(2.0), hour).cast("int")))
    n = F.count(F.lit(1))
    return df.groupBy(*keys, F.to_date(ts).alias("date")).agg(
        n.alias("hour_count"), ((n == expected_hours) & (seen == expected_hours)).alias("complete_00_23"),
        (F.count_if(hour == state_hour) == 1).alias("has_state_hour"))


def apply_incomplete_policy(completeness: DataFrame, policy: str = "error") -> DataFrame:
    """``error`` fails on an incomplete day, ``warn``/``allow`` drop it."""
    ok = F.col("complete_00_23") & F.col("has_state_hour")
    if policy == "error":
        return completeness.withColumn("hour_count", F.when(ok, F.col("hour_count")).otherwise(
            F.raise_error(F.concat(F.lit("incomplete day "), F.col("date").cast("string"))).cast("bigint")))
    if policy in ("warn", "allow"):
        return completeness.where(ok)
    raise ValueError("policy must be 'error', 'warn' or 'allow'")


def archive_inventory(files: DataFrame, scaffold_hours: DataFrame, path: str = "path",
                      suffix: str = r"[A-Za-z0-9_.]+") -> tuple[DataFrame, DataFrame]:
    """Inventory of files (or folders of one file) named ``YYYYMMDDHH.SUFFIX`` against the expected hours.

    Returns (per-day report, timestamps claimed by several files). Names that do
    not match, or lie outside the expected hours, are ignored.
    """
    stamped = (files.select(path, F.regexp_extract(path, rf"(?:^|[/=])(\d{{10}})\.{suffix}(?:/[^/]*)?$", 1).alias("_stamp"))
               .where(F.col("_stamp") != "")
               .withColumn("ts", F.regexp_replace(
                   "_stamp", r"^(\d{4})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:00:00").try_cast("timestamp_ntz"))
               .where(F.col("ts").isNotNull())
               .groupBy("ts").agg(F.count(F.lit(1)).alias("file_count"),
                                  F.min(path).alias("first_path"), F.max(path).alias("last_path"))
               .withColumn("date", F.to_date("ts")).withColumn("hour", F.hour("ts")))
    found = scaffold_hours.join(stamped, ["date", "hour"], "left")
    duplicates = (found.where(F.col("file_count") > 1)
                  .select("ts", "file_count", "first_path", "last_path"))
    missing = F.when(F.col("ts").isNull(), F.lpad(F.col("hour").cast("string"), 2, "0"))
    report = found.groupBy("water_year", "date").agg(
        F.count(F.lit(1)).alias("expected_hour_count"), F.count("ts").alias("found_hour_count"),
        (F.count("ts") == F.count(F.lit(1))).alias("complete_00_23"),
        F.array_join(F.sort_array(F.collect_list(missing)), ",").alias("missing_hours"))
    return report, duplicates


def require_single_files(duplicates: DataFrame) -> DataFrame:
    """Turn a timestamp claimed by several files, found by :func:`archive_inventory`, into an error."""
    problem = F.raise_error(F.concat(F.lit("several files for "), F.col("ts").cast("string"), F.lit(": "), F.col("first_path"),
                                     F.lit(" and "), F.col("last_path")))
    return duplicates.withColumn("file_count", F.when(F.col("file_count") > 1, problem.cast("bigint")).otherwise(F.col("file_count")))


def checked_inventory(files: DataFrame, scaffold_hours: DataFrame, path: str = "path", suffix: str = r"[A-Za-z0-9_.]+",
                      on_duplicate: str = "error") -> DataFrame:
    """Per-day report of :func:`archive_inventory`; duplicate files are fatal (``error``) or counted (``report``).

    Adds ``duplicate_hour_count``: hours of the day that several files claim.
    """
    if on_duplicate not in ("error", "report"):
        raise ValueError("on_duplicate must be 'error' or 'report'")
    report, duplicates = archive_inventory(files, scaffold_hours, path, suffix)
    if on_duplicate == "error":
        duplicates = require_single_files(duplicates)
    per_day = duplicates.groupBy(F.to_date("ts").alias("date")).agg(
        F.count("ts").alias("duplicate_hour_count"), F.sum("file_count").alias("_files"))
    # the file counts are asked for, so that the check above is carried out
    return (report.join(per_day, "date", "left")
            .withColumn("duplicate_hour_count", F.when(F.col("_files").isNull(), F.lit(0)).otherwise(F.col("duplicate_hour_count")).cast("bigint")).drop("_files"))
