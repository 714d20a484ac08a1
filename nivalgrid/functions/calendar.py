"""Water-year calendar expressions.

A water year runs from 1 October to 30 September and is named after the year in
which it ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Named seasonal windows of a water year, as (first MM-DD, last MM-DD).
NAMED_WINDOWS = {
    "oct1_jun30": ("10-01", "06-30"),
    "nov1_mar15": ("11-01", "03-15"),
    "apr1_jun30": ("04-01", "06-30"),
}


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def parse_month_day(month_day: str) -> tuple[int, int]:
    """Validate an ``MM-DD`` text and return ``(month, day)``."""
    parts = str(month_day).split("-")
    if len(parts) != 2 or not all(p.isdigit() for p in parts):
        raise ValueError(f"expected MM-DD, got {month_day!r}")
    month, day = int(parts[0]), int(parts[1])
    longest = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    if not 1 <= month <= 12 or not 1 <= day <= longest[month - 1]:
        raise ValueError(f"not a calendar day: {month_day!r}")
    return month, day


def water_year(date) -> Column:
    d = _c(date)
    return F.year(d) + F.when(F.month(d) >= 10, 1).otherwise(0)


def wy_start(wy) -> Column:
    return F.make_date(_c(wy) - 1, F.lit(10), F.lit(1))


def wy_end(wy) -> Column:
    return F.make_date(_c(wy), F.lit(9), F.lit(30))


def season_date(wy, month_day: str) -> Column:
    """The date of ``MM-DD`` inside water year ``wy``."""
    month, day = parse_month_day(month_day)
    year = _c(wy) - 1 if month >= 10 else _c(wy)
    return F.make_date(year, F.lit(month), F.lit(day))


def in_season(date, wy, start_md: str, end_md: str, lead_days: int = 0) -> Column:
    """True inside the window; ``lead_days`` keeps earlier days for differences."""
    d = _c(date)
    first = F.date_sub(season_date(wy, start_md), lead_days)
    return d.between(first, season_date(wy, end_md))


def day_of_water_year(date, wy=None) -> Column:
    d = _c(date)
    return F.datediff(d, wy_start(water_year(d) if wy is None else wy)) + 1


def season_day(date, wy=None) -> Column:
    """Days since 1 October (0-based)."""
    return day_of_water_year(date, wy) - 1


def reference_date(day) -> Column:
    """Common plotting date of a season day (2000-10-01 + n)."""
    return F.date_add(F.make_date(F.lit(2000), F.lit(10), F.lit(1)), _c(day).cast("int"))


def day_number(date) -> Column:
    """Days since 1970-01-01, an integer axis for range frames."""
    return F.unix_date(_c(date))


def month_day(date) -> Column:
    return F.date_format(_c(date), "MM-dd")


def focus_date(month_day_col, focus_wy: int) -> Column:
    """Map ``MM-dd`` on to the focus water year; NULL when the day does not exist."""
    md = _c(month_day_col)
    year = F.when(F.substring(md, 1, 2).cast("int") >= 10, focus_wy - 1).otherwise(focus_wy)
    return F.try_to_date(F.concat_ws("-", year.cast("string"), md), "yyyy-MM-dd")


def is_feb29(date) -> Column:
    d = _c(date)
    return (F.month(d) == 2) & (F.dayofmonth(d) == 29)


def index_to_timestamp(index, base: str, step_hours: float = 1.0) -> Column:
    """Record index -> timestamp without time zone: ``base + index * step``."""
    if base in (None, ""):
        raise ValueError("an output start datetime (the time of index 0) is required")
    if step_hours <= 0:
        raise ValueError("the time step must be positive")
    seconds = F.round(_c(index) * F.lit(float(step_hours) * 3600.0), 3)
    return F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def text_to_timestamp(text) -> Column:
    """``YYYY-MM-DD[_ T]HH:MM:SS`` somewhere inside a padded text; NULL otherwise."""
    cleaned = F.translate(_c(text), "\x00", "")
    found = F.regexp_extract(cleaned, r"(\d{4}-\d{2}-\d{2})[_ T](\d{2}:\d{2}:\d{2})", 0)
    return F.translate(found, "_T", "  ").try_cast("timestamp_ntz")


def require_timestamp(text) -> Column:
    """As :func:`text_to_timestamp`, but an unparseable text is an error."""
    parsed = text_to_timestamp(text)
    return F.when(parsed.isNotNull(), parsed).otherwise(
        F.raise_error(F.concat(F.lit("No parseable time coordinate: "), F.coalesce(_c(text), F.lit("NULL"))))
        .cast("timestamp_ntz")
    )


def season_windows(years: DataFrame, windows: dict[str, tuple[str, str]] | None = None,
                   clip: tuple[str, str] | None = None) -> DataFrame:
    """``season_window`` table for the distinct ``water_year`` values of ``years``.

    Each window is intersected with the water year and, when given, with the
    analysis period ``clip = (first date, last date)``.
    """
    windows = windows or NAMED_WINDOWS
    entries = F.array(*[
        F.struct(F.lit(name).alias("window"), season_date("water_year", lo).alias("lo"),
                 season_date("water_year", hi).alias("hi"))
        for name, (lo, hi) in windows.items()
    ])
    start, end = F.greatest("w.lo", wy_start("water_year")), F.least("w.hi", wy_end("water_year"))
    if clip is not None:
        start = F.greatest(start, F.lit(clip[0]).cast("date"))
        end = F.least(end, F.lit(clip[1]).cast("date"))
    return (years.select("water_year").distinct()
            .select("water_year", F.explode(entries).alias("w"))
            .select("water_year", F.col("w.window").alias("window"),
                    start.alias("start_date"), end.alias("end_date"))
            .where(F.col("start_date") <= F.col("end_date")))
