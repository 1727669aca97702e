"""Calendar parts and time-of-day categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_time(c: Column, pattern: str | None = None) -> Column:
    """Timestamp from text, or missing; `pattern` is e.g. dd-MM-yyyy HH:mm."""
    return F.try_to_timestamp(c, F.lit(pattern)) if pattern else F.try_to_timestamp(c)


def calendar_parts(ts: Column, prefix: str, weekday_name: str = "dow") -> dict[str, Column]:
    """Year, month, day, Monday-based weekday and quarter."""
    return {
        f"{prefix}_year": F.year(ts),
        f"{prefix}_month": F.month(ts),
        f"{prefix}_day": F.dayofmonth(ts),
        f"{prefix}_{weekday_name}": F.weekday(ts),
        f"{prefix}_quarter": F.quarter(ts),
    }


def extended_parts(ts: Column, prefix: str) -> dict[str, Column]:
    """Calendar parts plus weekend flag, day of year, ISO week and clock parts."""
    return {
        **calendar_parts(ts, prefix, "day_of_week"),
        f"{prefix}_is_weekend": F.coalesce((F.weekday(ts) >= 5).cast("int"), F.lit(0)),
        f"{prefix}_day_of_year": F.dayofyear(ts),
        f"{prefix}_week_of_year": F.weekofyear(ts),
        f"{prefix}_hour": F.hour(ts),
        f"{prefix}_minute": F.minute(ts),
        f"{prefix}_second": F.second(ts),
    }


def names(ts: Column, prefix: str) -> dict[str, Column]:
    return {
        f"{prefix}_date": F.to_date(ts),
        f"{prefix}_month_name": F.date_format(ts, "MMMM"),
        f"{prefix}_day_name": F.date_format(ts, "EEEE"),
        f"{prefix}_missing": ts.isNull().cast("int"),
    }


# Hours of the day and their names.
DAY_PERIODS = [(5, 11, "Morning"), (12, 16, "Afternoon"), (17, 20, "Evening"), (21, 23, "Night"), (0, 4, "Late Night")]
MORNING_PEAK, EVENING_PEAK = (7, 10), (17, 20)


def day_period(hour: Column) -> dict[str, Column]:
    name = F.lit("Unknown")
    for low, high, label in reversed(DAY_PERIODS):
        name = F.when(hour.between(low, high), label).otherwise(name)
    morning = F.coalesce(hour.between(*MORNING_PEAK), F.lit(False))
    evening = F.coalesce(hour.between(*EVENING_PEAK), F.lit(False))
    return {
        "time_period": name,
        "is_morning_peak": morning.cast("int"),
        "is_evening_peak": evening.cast("int"),
        "is_peak_hour": (morning | evening).cast("int"),
        "is_off_peak_hour": (~(morning | evening)).cast("int"),
    }
