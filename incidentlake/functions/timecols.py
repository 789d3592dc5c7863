"""Calendar columns. Everything works on ``timestamp_ntz`` without the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlake import fixed_values as V

CLOCK = r"([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?"
DAY_FIRST = r"\d{1,2}([./-])\d{1,2}\1(\d{4}|\d{2})" + CLOCK
ISO = r"\d{4}-\d{1,2}-\d{1,2}" + CLOCK
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def parse_strict(text: Column, fmt: str) -> Column:
    """Parse with one pattern; anything else is null."""
    return F.try_to_timestamp(F.trim(text), F.lit(fmt)).cast("timestamp_ntz")


def parse_lenient(text: Column) -> Column:
    """Day-first forms, then ISO; an ISO date is never read day-first.

    Days, months and hours may have one digit, seconds and their fractions may lack, the parts of a
    day-first date stand between equal marks (``.``, ``/`` or ``-``), and of two-digit years 69 to 99
    belong to the last century. A day-first cell is turned into ISO order and everything goes
    through one cast, which needs no exception for a bad cell.
    """
    cell = F.trim(text)
    iso = F.regexp_replace(cell, r"^(\d{1,2})([./-])(\d{1,2})\2(\d{4})(?=$|[ T])", "$4-$3-$1")
    iso = F.regexp_replace(iso, r"^(\d{1,2})([./-])(\d{1,2})\2([0-5]\d|6[0-8])(?=$|[ T])", "20$4-$3-$1")
    iso = F.regexp_replace(iso, r"^(\d{1,2})([./-])(\d{1,2})\2(69|[7-9]\d)(?=$|[ T])", "19$4-$3-$1")
    return F.when(cell.rlike(f"^(?:{DAY_FIRST}|{ISO})$"), iso.try_cast("timestamp_ntz"))


def season(month: Column) -> Column:
    turn = F.floor(F.pmod(month, F.lit(12)) / 3).cast("int") + 1
    return F.element_at(F.array(*[F.lit(s) for s in V.SEASONS]), turn)


def time_of_day(hour: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in V.TIMES_OF_DAY]), F.floor(hour / 6).cast("int") + 1)


def day_period(hour: Column) -> Column:
    return F.element_at(
        F.array(*[F.lit(p) for p in ("night", "morning", "day", "evening")]), F.floor(hour / 6).cast("int") + 1
    )


def time_window(hour: Column) -> Column:
    """Six-hour bucket label."""
    start = F.floor(hour / 6).cast("int") * 6
    return F.format_string("%02d:00-%02d:00", start, start + 6)


def iso_weekday(ts: Column) -> Column:
    return F.weekday(ts) + 1


def year_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def hour_index(ts: Column) -> Column:
    """Whole hours since 1970; the integer form of the hour floor."""
    return F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")) * 24 + F.hour(ts)


def index_to_hour(index: Column) -> Column:
    return F.expr(EPOCH) + F.make_dt_interval(hours=index.cast("int"))


def hour_floor(ts: Column) -> Column:
    return index_to_hour(hour_index(ts))


def derive_time_columns(df: DataFrame) -> DataFrame:
    """hour, month, season, time_of_day, day_of_week; null dates give 0 / 1 / winter / night / 1."""
    hour = F.coalesce(F.hour("regional_time"), F.lit(0))
    month = F.coalesce(F.month("incident_date"), F.lit(1))
    return df.withColumns(
        {
            "hour": hour,
            "month": month,
            "season": season(month),
            "time_of_day": time_of_day(hour),
            "day_of_week": F.coalesce(iso_weekday(F.col("incident_date")), F.lit(1)),
        }
    )


def calendar_features(df: DataFrame, ts: str = "time_hour") -> DataFrame:
    hour, weekday, month = F.hour(ts), F.weekday(ts), F.month(ts)
    return df.withColumns(
        {
            "hour": hour,
            "dayofweek": weekday,
            "month": month,
            "quarter": F.quarter(ts),
            "is_weekend": (weekday >= 5).cast("int"),
            "is_working_hours": hour.between(*V.WORKING_HOURS).cast("int"),
            "is_peak_hours": hour.isin(*V.PEAK_HOURS).cast("int"),
            "season": season(month),
            "day_period": day_period(hour),
        }
    )


def regional_clock(utc: Column, region: Column) -> Column:
    """Wall clock of a region code: Moscow time plus the region's offset."""
    offset = lookup(region, V.CLOCK_OFFSET_HOURS, F.lit(0))
    return utc + F.make_dt_interval(hours=F.lit(V.CLOCK_BASE_HOURS) + offset)


def lookup(key: Column, table: dict, default: Column) -> Column:
    """Constant map lookup with a default for unknown and null keys."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), default)
