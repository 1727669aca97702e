"""Features over ordered year columns of a wide table. Everything is per row: no shuffle."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.core import col


def year_of(name: str) -> int:
    return int(re.search(r"(19|20)\d{2}", name).group())


def year_columns(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if re.search(r"(19|20)\d{2}", c)), key=year_of)


def _present(cols: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[col(c).cast("double") for c in cols]))


def coverage(cols: Sequence[str]) -> dict[str, Column]:
    missing = reduce(lambda a, b: a + b, [col(c).isNull().cast("int") for c in cols])
    return {"available_years": F.lit(len(cols)) - missing, "missing_years": missing, "missing_percent": missing / F.lit(len(cols)) * 100}


def statistics(cols: Sequence[str]) -> dict[str, Column]:
    """Row mean, median, min, max, sample std and range over the present years."""
    values = _present(cols)
    n = F.size(values)

    def grow(s: Column, v: Column) -> Column:
        """Running count, mean and squared deviation, so one pass serves mean and std."""
        count = s["n"] + 1
        mean = s["mean"] + (v - s["mean"]) / count
        return F.struct(count.alias("n"), mean.alias("mean"), (s["m2"] + (v - s["mean"]) * (v - mean)).alias("m2"))

    moments = F.aggregate(values, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")), grow)
    ranked = F.array_sort(values)
    mid = F.when(n > 0, (F.element_at(ranked, F.floor((n + 1) / 2).cast("int")) + F.element_at(ranked, F.floor((n + 2) / 2).cast("int"))) / 2)
    low, high = F.array_min(values), F.array_max(values)
    std = F.when(n > 1, F.sqrt(moments["m2"] / (n - 1)))
    return {"mean": F.when(n > 0, moments["mean"]), "median": mid, "min": low, "max": high, "std": std, "range": high - low}


def _percent(change: Column, base: Column) -> Column:
    return F.when(base != 0, change / F.abs(base) * 100)


def first_to_latest(cols: Sequence[str]) -> dict[str, Column]:
    first, last = col(cols[0]), col(cols[-1])
    return {"first_value": first, "latest_value": last, "absolute_change": last - first, "percent_change": _percent(last - first, first)}


def latest_change(cols: Sequence[str]) -> dict[str, Column]:
    before, last = col(cols[-2]), col(cols[-1])
    return {"previous_value": before, "latest_change": last - before, "latest_change_percent": _percent(last - before, before)}


def cagr(cols: Sequence[str]) -> Column:
    """Compound yearly growth percent; missing unless both ends are positive."""
    first, last = col(cols[0]), col(cols[-1])
    years = year_of(cols[-1]) - year_of(cols[0])
    return F.when((first > 0) & (last > 0), (F.pow(last / first, F.lit(1.0 / years)) - 1) * 100)


def slope(cols: Sequence[str]) -> Column:
    """Least-squares slope per year over present years; missing under two points.

    Years are centred on their middle, which keeps the sums small and leaves the slope as is.
    """
    centre = (year_of(cols[0]) + year_of(cols[-1])) / 2
    terms = [(F.lit(year_of(c) - centre), col(c).cast("double")) for c in cols]

    def total(parts):
        return reduce(lambda a, b: a + b, parts)

    n = total([v.isNotNull().cast("int") for _, v in terms])
    x = total([F.when(v.isNotNull(), t).otherwise(0.0) for t, v in terms])
    y = total([F.coalesce(v, F.lit(0.0)) for _, v in terms])
    xy = total([F.coalesce(t * v, F.lit(0.0)) for t, v in terms])
    xx = total([F.when(v.isNotNull(), t * t).otherwise(0.0) for t, v in terms])
    return F.when(n >= 2, (n * xy - x * y) / (n * xx - x * x))


def direction(slope_value: Column, default: str = "No Trend") -> Column:
    return F.when(slope_value > 0, "Increasing").when(slope_value < 0, "Decreasing").when(slope_value == 0, "Stable").otherwise(default)


def sign_status(value: Column) -> Column:
    return F.when(value > 0, "Positive").when(value < 0, "Negative").when(value == 0, "Zero").otherwise("Missing")


def log_or_missing(value: Column) -> Column:
    return F.when(value >= 0, F.log1p(value.cast("double")))


def melt_years(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(ids, year, value) rows for the present cells."""
    cells = F.array(*[F.struct(F.lit(year_of(c)).alias("year"), col(c).cast("double").alias("value")) for c in cols])
    return df.select(*ids, F.inline(cells)).where("value is not null")


def selected_trend(df: DataFrame, key: str, wanted: str, series: str, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Long-form trend of the first k series (by name) of one key, ordered by year."""
    rows = df.where(F.lower(F.trim(col(key))) == wanted.strip().lower())
    names = rows.select(series).distinct().orderBy(series).limit(k)
    return melt_years(rows.join(names, series, "left_semi"), [key, series], cols).orderBy(series, "year")
