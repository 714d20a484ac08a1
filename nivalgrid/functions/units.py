"""Unit texts and unit conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants and accepted unit spellings.
SECONDS_PER_DAY = 86400.0
SECONDS_PER_HOUR = 3600.0
CFS_TO_M3_S = 0.028316846592
MJ_PER_J = 1.0e-6
KELVIN_OFFSET = 273.15
DEPTH_UNITS = ("mm/timestep", "mm / timestep", "mm", "kg m-2", "kg m^-2")
DEPTH_RATE_UNITS = ("mm/s", "mm s-1", "mm s^-1", "mm s^(-1)", "mm sec-1", "mm second-1")
MASS_RATE_UNITS = ("kg m-2 s-1", "kg m^-2 s^-1", "kg/m2/s")
RADIATION_UNITS = ("w/m2", "w/m^2", "w m-2", "w m^-2", "w m^(-2)",
                   "watt/m2", "watt/m^2", "watt m-2", "watt m^-2")
WIND_UNITS = ("m/s", "m s-1", "m s^-1", "meter/s", "meters/s", "metre/s", "metres/s")
CELSIUS_UNITS = ("c", "degc", "degree_celsius", "degrees_celsius", "degree celsius",
                 "degrees celsius", "celsius", "°c")
KELVIN_UNITS = ("k", "kelvin", "degree_kelvin", "degrees_kelvin")
MILLIMETRE_UNITS = ("mm", "millimeter", "millimeters", "millimetre", "millimetres")


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def normalize_units(text) -> Column:
    """Lower case, ``**`` -> ``^``, single spaces."""
    lowered = F.replace(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("**"), F.lit("^"))
    return F.trim(F.regexp_replace(lowered, r"\s+", " "))


def require_units(text, accepted, context: str) -> Column:
    """The normalised unit, or an error when it is not an accepted spelling."""
    unit = normalize_units(text)
    return F.when(unit.isin(*accepted), unit).otherwise(
        F.raise_error(F.concat(F.lit(f"Unexpected units for {context}: "), F.coalesce(_c(text), F.lit("NULL"))))
        .cast("string"))


def temperature_to_c(value, unit) -> Column:
    """K or degC -> degC; any other unit is an error."""
    u, v = normalize_units(unit), _c(value)
    return (F.when(u.isin(*CELSIUS_UNITS) | u.contains("celsius"), v)
            .when(u.isin(*KELVIN_UNITS) | u.contains("kelvin"), v - KELVIN_OFFSET)
            .otherwise(F.raise_error(F.concat(F.lit("Unrecognized temperature units: "), u)).cast("double")))


def depth_factor(unit, step_seconds) -> Column:
    """Multiplier that turns one record into millimetres: 1 for depths, the step for rates."""
    u = normalize_units(unit)
    step = step_seconds if isinstance(step_seconds, Column) else F.lit(float(step_seconds))
    return (F.when(u.isin(*DEPTH_UNITS), F.lit(1.0))
            .when(u.isin(*DEPTH_RATE_UNITS, *MASS_RATE_UNITS), step.cast("double"))
            .otherwise(F.raise_error(F.concat(F.lit("Unexpected depth units: "), u)).cast("double")))


def quantity_kind(unit) -> Column:
    """How a flux of this unit is accumulated: ``depth``, ``radiation`` or ``unsupported``."""
    u = normalize_units(unit)
    return (F.when(u.isin(*DEPTH_UNITS, *DEPTH_RATE_UNITS, *MASS_RATE_UNITS), F.lit("depth"))
            .when(u.isin(*RADIATION_UNITS), F.lit("radiation"))
            .otherwise(F.lit("unsupported")))


def power_to_energy(w_m2, step_seconds: float = SECONDS_PER_HOUR) -> Column:
    """W/m2 held for one step -> MJ/m2."""
    return _c(w_m2) * F.lit(float(step_seconds) * MJ_PER_J)


def daily_energy_to_power(mj_m2_day) -> Column:
    """MJ/m2/day -> mean W/m2."""
    return _c(mj_m2_day) * F.lit(1.0e6 / SECONDS_PER_DAY)


def cfs_to_m3_day(cfs) -> Column:
    return _c(cfs) * F.lit(CFS_TO_M3_S * SECONDS_PER_DAY)


def metres_to_mm(value) -> Column:
    return _c(value) * F.lit(1000.0)
