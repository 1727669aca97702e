"""Domain feature jobs: economic indicators, market series, public works, papers, traffic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.core import attach, col, replace_columns
from quern.functions import dates, lists, numeric, text
from quern.operators import features, shape, wide, windows


def _codes(df: DataFrame, columns: Sequence[str], source: DataFrame) -> DataFrame:
    """`<column>_id`: sorted code per level, -1 for a missing value."""
    out = df
    for c in columns:
        codes = features.level_codes(source, c).select(F.col("level").alias(c), F.col("code").cast("long").alias(f"{c}_id"))
        out = attach(out, codes, [c]).withColumn(f"{c}_id", F.coalesce(f"{c}_id", F.lit(-1)))
    return out


def _year_features(df: DataFrame, years: Sequence[str], no_trend: str) -> DataFrame:
    made = {**wide.coverage(years), **wide.statistics(years), **wide.first_to_latest(years)}
    if len(years) >= 2:
        slope = wide.slope(years)
        made.update({**wide.latest_change(years), "cagr_percent": wide.cagr(years), "trend_slope": slope, "trend_direction": wide.direction(slope, no_trend)})
    made.update({"latest_status": wide.sign_status(col(years[-1])), "latest_log": wide.log_or_missing(col(years[-1]))})
    out = df.withColumns(made)
    return out.withColumn("mean_log", wide.log_or_missing(F.col("mean")))


def economic_features(df: DataFrame, country: str, indicator: str, unit: str | None = None, scale: str | None = None) -> DataFrame:
    """Year features, category codes, record counts, outlier flags and completeness per row."""
    years, given = wide.year_columns(df), df.columns
    rows = _year_features(df, years, "No Trend")
    groups = [c for c in (country, indicator, unit, scale) if c]
    out = _codes(rows, groups, df)
    for c in (x for x in (country, indicator, unit) if x):
        out = windows.group_broadcast(out, [c], c, ["count"], f"{c}_records", df)
    out = windows.group_broadcast(out, [country, indicator], indicator, ["count"], "pair_records", df)
    out = features.mark_outliers(out, ["latest_value", "mean"], source=rows.select("latest_value", "mean"))
    return shape.row_completeness(out, given)


def market_features(df: DataFrame) -> DataFrame:
    """Year features of market series, whose year columns carry the year inside their names."""
    return _year_features(df, wide.year_columns(df), "Insufficient Data")


def works_features(df: DataFrame, state: str, district: str, workers: str, expenditure: str, wage: str) -> DataFrame:
    """Logs, missing flags, state totals and shares, efficiency ratios, median categories,
    outlier flags and distance from the state median."""
    given = df.columns
    measures = {"workers": workers, "expenditure": expenditure, "wage": wage}
    out = windows.group_broadcast(df, [state], district, ["nunique"], "state_district", df)
    logs = {f"{n}_log": wide.log_or_missing(col(c)) for n, c in measures.items()}
    gaps = {f"{n}_missing": col(c).isNull().cast("int") for n, c in measures.items()}
    out = out.withColumns({**logs, **gaps})
    for n in ("workers", "expenditure"):
        out = windows.group_broadcast(out, [state], measures[n], ["sum", "mean"], f"state_{n}", df)
        out = out.withColumn(f"{n}_share", F.when(F.col(f"state_{n}_sum") != 0, col(measures[n]) / F.col(f"state_{n}_sum") * 100))
    w, e, p = col(workers), col(expenditure), col(wage)
    out = out.withColumns({
        "expenditure_per_worker_lakhs": numeric.safe_ratio(e, w),
        "expenditure_per_worker_rs": numeric.safe_ratio(e, w, 100_000),
        "workers_per_lakh": numeric.safe_ratio(w, e),
        "worker_wage_ratio": numeric.safe_ratio(w, p),
        "expenditure_wage_ratio": numeric.safe_ratio(e, p),
    })
    for n, c in measures.items():
        label = n.capitalize()
        out = numeric.median_category(out, c, f"Below Median {label}", f"At or Above Median {label}", f"{n}_category", df)
        out = windows.group_deviation(out, [state], c, "median", f"{n}_vs_state_median", df)
    out = replace_columns(out, {f"{n}_outlier": f.cast("int") for n, f in zip(measures, features.iqr_flags(df, list(measures.values())).values())})
    return shape.row_completeness(out, given)


def paper_features(df: DataFrame, title: str, summary: str, terms: str) -> DataFrame:
    """Title, summary and topic-list features of research papers."""
    t, s = col(title), col(summary)
    items = lists.parse_list(col(terms))
    title_words, summary_words = text.regex_words(t), text.regex_words(s)
    return df.withColumns({
        "title_characters": F.length(F.coalesce(t, F.lit(""))),
        "title_words": title_words,
        "title_question": text.contains_any(t, "?"),
        "title_hyphen": text.contains_any(t, "-"),
        "summary_characters": F.length(F.coalesce(s, F.lit(""))),
        "summary_words": summary_words,
        "summary_sentences": text.sentence_marks(s),
        "summary_word_length": F.coalesce(text.mean_word_length(s), F.lit(0.0)),
        "summary_problem": text.contains_any(s, "problem", "challenge", "issue", "limitation"),
        "summary_method": text.contains_any(s, "method", "approach", "algorithm", "model", "technique"),
        "summary_result": text.contains_any(s, "result", "performance", "accuracy", "evaluation", "experiment"),
        "title_summary_ratio": F.when(summary_words > 0, title_words / summary_words).otherwise(0.0),
        **lists.list_features(items),
    })


def traffic_features(df: DataFrame, timestamp: str, vehicles: str, speed: str, occupancy: str, categories: Sequence[str] = (), pattern: str = "dd-MM-yyyy HH:mm") -> DataFrame:
    """Clock features, logs, categories, density ratios, congestion risk, codes and road averages."""
    given = df.columns
    out = replace_columns(df, {timestamp: dates.to_time(col(timestamp), pattern)}) if dict(df.dtypes)[timestamp] == "string" else df
    out = shape.clear_infinite(shape.coerce_numeric(out, [vehicles, speed, occupancy], messy=True), [vehicles, speed, occupancy])
    clean = out.select(vehicles, speed, occupancy, *categories)
    ts, v, s, o = col(timestamp), col(vehicles), col(speed), col(occupancy)
    out = out.withColumns({
        **dates.extended_parts(ts, "time"),
        **dates.day_period(F.hour(ts)),
        "vehicles_log": wide.log_or_missing(v),
        "speed_log": wide.log_or_missing(s),
        "occupancy_log": wide.log_or_missing(o),
        "speed_category": numeric.threshold_category(s, *numeric.SPEED_EDGES),
        "occupancy_category": numeric.threshold_category(o, *numeric.OCCUPANCY_EDGES),
        "vehicles_per_occupancy": numeric.safe_ratio(v, o),
        "occupancy_per_vehicle": numeric.safe_ratio(o, v),
    })
    out = numeric.median_category(out, vehicles, "Below Median", "At or Above Median", "vehicles_category", clean)
    risk = numeric.joint_risk(out, vehicles, speed, clean)
    out = risk.withColumnsRenamed({"high_flag": "high_traffic", "low_flag": "low_speed", "risk_flag": "congestion_risk"})
    out = _codes(out, categories, clean)
    for c in categories:
        out = windows.group_deviation(out, [c], vehicles, "mean", f"vehicles_vs_{c}_mean", clean)
    out = features.mark_outliers(out, [vehicles, speed, occupancy], source=clean)
    return shape.row_completeness(out, given)
