"""Hourly cell records -> daily cell or basin records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import physics, stats, units


def analysis_window(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Keep records inside the closed analysis period (pushed down to the scan)."""
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def spinup_report(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Records before, inside and after the analysis period."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    t = F.col(ts)
    return df.agg(F.count_if(t < lo).alias("spinup_record_count"),
                  F.count_if(t.between(lo, hi)).alias("analysis_record_count"),
                  F.count_if(t > hi).alias("trailing_record_count"),
                  ((F.min(t) <= lo) & (F.max(t) >= hi)).alias("window_inside_axis"))


def daily_flux(df: DataFrame, keys: Sequence[str], columns: dict[str, tuple[str, str]],
               ts: str = "ts", step_seconds: float = 3600.0, hours: int = 24) -> DataFrame:
    """Strict daily totals: ``{output: (input, unit)}``; one missing hour makes the day NULL."""
    aggs = [stats.strict_sum(F.col(src) * units.depth_factor(F.lit(unit), step_seconds), hours).alias(out)
            for out, (src, unit) in columns.items()]
    return df.groupBy(*keys, F.to_date(ts).alias("date")).agg(*aggs)


def daily_state(df: DataFrame, keys: Sequence[str], columns: dict[str, float], ts: str = "ts",
                hour: int | None = None) -> DataFrame:
    """Daily state: the last record of the day, or the one at a fixed hour.

    ``columns`` maps a state column to its multiplier (1000 for metres -> mm).
    With a fixed hour a second record in that hour is an error.
    """
    day = F.to_date(ts).alias("date")
    names = list(columns)
    packed = F.struct(*[(F.col(c) * F.lit(float(m))).alias(c) for c, m in columns.items()])
    if hour is None:
        out = df.groupBy(*keys, day).agg(F.max_by(packed, F.col(ts)).alias("_s"))
    else:
        picked = df.where(F.hour(ts) == hour).groupBy(*keys, day).agg(
            F.count(F.lit(1)).alias("_n"), F.any_value(packed).alias("_v"))
        checked = F.when(F.col("_n") == 1, F.col("_v")).otherwise(
            F.raise_error(F.concat(F.lit(f"expected exactly one state at hour {hour:02d} on "),
                                   F.col("date").cast("string"))).cast(picked.schema["_v"].dataType))
        out = picked.withColumn("_s", checked)
    return out.select(*keys, "date", *[F.col("_s").getField(c).alias(c) for c in names])


def hour_of_day_state(df: DataFrame, keys: Sequence[str], value: str, hour: int = 23,
                      ts: str = "ts") -> DataFrame:
    """State at an hour with the number of records found there (1 is valid)."""
    return (df.where(F.hour(ts) == hour).groupBy(*keys, F.to_date(ts).alias("date"))
            .agg(F.count(F.lit(1)).alias("state_count"),
                 F.when(F.count(F.lit(1)) == 1, F.max(value)).alias(value)))


def daily_shortwave(df: DataFrame, keys: Sequence[str], incoming: str, absorbed: str, ts: str = "ts",
                    step_seconds: float = 3600.0, hours: int = 24, minimum_incoming: float = 0.0) -> DataFrame:
    """Strict mean power, strict energy and the albedo of the integrated energies."""
    day = df.groupBy(*keys, F.to_date(ts).alias("date")).agg(
        stats.strict_mean(incoming, hours).alias("incoming_sw_w_m2"),
        stats.strict_mean(absorbed, hours).alias("absorbed_sw_w_m2"),
        stats.strict_sum(units.power_to_energy(incoming, step_seconds), hours).alias("incoming_sw_energy_mj_m2"),
        stats.strict_sum(units.power_to_energy(absorbed, step_seconds), hours).alias("absorbed_sw_energy_mj_m2"))
    return day.withColumn("effective_albedo", physics.effective_albedo(
        "incoming_sw_energy_mj_m2", "absorbed_sw_energy_mj_m2", minimum_incoming))


def fraction_scale(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Divisor that turns a mixed percent/fraction column into fractions, per group.

    Up to 1.5 the group holds fractions, up to 100.5 percent; anything larger, or
    below -1e-6, is an error. Computed from a map-side combined min/max.
    """
    out = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scale = (F.when(F.col("_lo") < -1e-6, F.raise_error(F.lit("fraction column has negative values")).cast("double"))
             .when(F.col("_hi").isNull() | (F.col("_hi") <= 1.5), F.lit(1.0))
             .when(F.col("_hi") <= 100.5, F.lit(100.0))
             .otherwise(F.raise_error(F.lit("fraction column exceeds 100 percent")).cast("double")))
    return out.select(*keys, scale.alias("fraction_divisor"))


def daily_snowfall(df: DataFrame, keys: Sequence[str], precip: str, fraction: str, ts: str = "ts",
                   hours: int = 24) -> DataFrame:
    """Strict daily precipitation and snowfall; the fraction is scaled per source day.

    The scale depends on the whole day of a source, so the day's min/max is first
    reduced per cell together with both candidate sums: one pass over the hours.
    """
    day = F.to_date(ts).alias("date")
    cell = df.groupBy(*keys, day).agg(
        stats.strict_sum(precip, hours).alias("precip_mm"),
        F.when((F.count(precip) == hours) & (F.count(fraction) == hours),
               F.sum(F.col(precip) * F.col(fraction))).alias("_weighted"),
        F.min(fraction).alias("_lo"), F.max(fraction).alias("_hi"))
    group = [k for k in keys if k not in ("row", "col")] + ["date"]
    reduced = cell.groupBy(*group).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    scale = (F.when(F.col("_lo") < -1e-6, F.raise_error(F.lit("fraction column has negative values")).cast("double"))
             .when(F.col("_hi").isNull() | (F.col("_hi") <= 1.5), F.lit(1.0))
             .when(F.col("_hi") <= 100.5, F.lit(100.0))
             .otherwise(F.raise_error(F.lit("fraction column exceeds 100 percent")).cast("double")))
    scaled = reduced.select(*group, scale.alias("_scale"))
    return (cell.drop("_lo", "_hi").join(scaled, group)
            .select(*keys, "date", "precip_mm", (F.col("_weighted") / F.col("_scale")).alias("snowfall_mm"),
                    F.when(F.col("_scale") == 1.0, "fraction").otherwise("percent").alias("fraction_scale")))


def daily_by_kind(df: DataFrame, keys: Sequence[str], kinds: dict[str, tuple[str, str, str]],
                  ts: str = "ts", step_seconds: float = 3600.0, hours: int = 24,
                  valid_area: str | None = None) -> DataFrame:
    """Hourly basin values -> daily statistics by the kind of quantity.

    ``kinds`` maps a prefix to ``(column, kind, unit)``. Temperature and wind give
    lenient mean / extremes, radiation a lenient mean with a strict energy, depth
    a strict total. ``hours`` is the number of records that makes a day complete.
    """
    aggs = []
    for prefix, (column, kind, unit) in kinds.items():
        v = F.col(column)
        if kind == "temperature":
            c = units.temperature_to_c(v, F.lit(unit))
            aggs += [F.avg(c).alias(f"{prefix}_mean_c"), F.min(c).alias(f"{prefix}_min_c"),
                     F.max(c).alias(f"{prefix}_max_c")]
        elif kind == "wind":
            aggs += [F.avg(v).alias(f"{prefix}_mean_m_s"), F.max(v).alias(f"{prefix}_max_m_s")]
        elif kind == "radiation":
            aggs += [F.avg(v).alias(f"{prefix}_mean_w_m2"),
                     stats.strict_sum(units.power_to_energy(v, step_seconds), hours)
                     .alias(f"{prefix}_energy_mj_m2")]
        elif kind == "depth":
            aggs += [stats.strict_sum(v * units.depth_factor(F.lit(unit), step_seconds), hours)
                     .alias(f"{prefix}_mm_day")]
        else:
            raise ValueError(f"unknown kind {kind!r}")
        aggs.append(F.count(v).alias(f"{prefix}_finite_hours"))
    if valid_area is not None:
        aggs.append(F.min(valid_area).alias("minimum_hourly_valid_area_fraction"))
    out = df.groupBy(*keys, F.to_date(ts).alias("date")).agg(*aggs)
    return out.withColumn("water_year", cal.water_year("date"))


def hourly_physics_violations(df: DataFrame, rain: str, shortwave: str, longwave: str, temperature_k: str,
                              ) -> DataFrame:
    """Rows with negative rain or radiation, or a temperature outside 150-350 K."""
    v = {"negative_rain": F.col(rain) < -1.0e-12,
         "negative_shortwave": F.col(shortwave) < -1.0e-6,
         "negative_longwave": F.col(longwave) < -1.0e-6,
         "implausible_temperature": ~F.col(temperature_k).between(150.0, 350.0)}
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in v.items()]))
    return df.withColumn("violations", reasons).where(F.size("violations") > 0)


def require_hourly_physics(df: DataFrame, rain: str, shortwave: str, longwave: str, temperature_k: str) -> DataFrame:
    """Pass hourly values through; an impossible one is an error when it is read."""
    bad = ((F.col(rain) < -1.0e-12) | (F.col(shortwave) < -1.0e-6) | (F.col(longwave) < -1.0e-6)
           | ~F.col(temperature_k).between(150.0, 350.0))
    text = F.concat(F.lit("implausible hourly forcing: "), F.to_json(F.struct(rain, shortwave, longwave, temperature_k)))
    return df.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(text).cast("boolean")).otherwise(True))


def daily_forcing(hourly: DataFrame, keys: Sequence[str], rain: str = "rain_mm_s", temperature_k: str = "temp_k",
                  shortwave: str = "sw_w_m2", longwave: str = "lw_w_m2", ts: str = "ts",
                  hours: int = 24) -> DataFrame:
    """Hourly basin means -> daily forcing table with a running precipitation total.

    Every value needs all hours of the day; negative rain and radiation are
    floored at zero after the physics check.
    """
    from .series import running_sum

    floor = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.0)))
    day = hourly.groupBy(*keys, F.to_date(ts).alias("date")).agg(
        F.count(rain).alias("hour_count"),
        stats.strict_sum(floor(rain) * units.SECONDS_PER_HOUR, hours).alias("precip_mm_day"),
        (stats.strict_mean(temperature_k, hours) - units.KELVIN_OFFSET).alias("temperature_mean_c"),
        stats.strict_mean(floor(shortwave), hours).alias("incoming_sw_mean_w_m2"),
        stats.strict_sum(units.power_to_energy(floor(shortwave)), hours).alias("incoming_sw_energy_mj_m2_day"),
        stats.strict_mean(floor(longwave), hours).alias("incoming_lw_mean_w_m2"),
        stats.strict_sum(units.power_to_energy(floor(longwave)), hours).alias("incoming_lw_energy_mj_m2_day"))
    day = (day.withColumn("water_year", cal.water_year("date"))
           .withColumn("month_day", cal.month_day("date")))
    return day.withColumn("precip_accum_oct1_mm",
                          running_sum("precip_mm_day", [*keys, "water_year"], "date"))
