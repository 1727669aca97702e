"""Categories, ratios, flags and numbers found in messy text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.core import col
from quern.operators.quantiles import quantiles

# Upper edges and labels; a value on an edge belongs to the first label that holds it.
SPEED_EDGES = ([20, 40, 60], ["Very Slow", "Slow", "Moderate", "Fast"])
OCCUPANCY_EDGES = ([25, 50, 75], ["Low Occupancy", "Moderate Occupancy", "High Occupancy", "Very High Occupancy"])


def threshold_category(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The first label is below its edge, the next ones include theirs, the last is above all."""
    out = F.when(value < edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        out = out.when(value <= edge, label)
    return out.when(value > edges[-1], labels[-1]).otherwise("Missing")


def median_category(df: DataFrame, column: str, below: str, above: str, out: str, source: DataFrame | None = None) -> DataFrame:
    median = quantiles(df if source is None else source, [column], [0.5])[column][0]
    return df.withColumn(out, F.when(col(column) < median, below).when(col(column) >= median, above).otherwise("Missing"))


def safe_ratio(top: Column, bottom: Column, scale: float = 1.0, positive: bool = True) -> Column:
    """top/bottom·scale where the denominator is positive (or just not zero), else missing."""
    return F.when(bottom > 0 if positive else bottom != 0, top / bottom * scale)


def joint_risk(df: DataFrame, high: str, low: str, source: DataFrame | None = None) -> DataFrame:
    """Flags: `high` at or above its median, `low` below its median, and both together."""
    found = quantiles(df if source is None else source, [high, low], [0.5])
    up = F.coalesce(col(high) >= found[high][0], F.lit(False))
    down = F.coalesce(col(low) < found[low][0], F.lit(False))
    return df.withColumns({"high_flag": up.cast("int"), "low_flag": down.cast("int"), "risk_flag": (up & down).cast("int")})


# Texts that mean "no number", the shape of a number, metric spellings.
NO_NUMBER = ["nan", "none", "null", "na", "n/a"]
NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"
METRIC_NAMES = {
    "R2": ["r2", "r_2", "r_squared", "r2_score"],
    "MAE": ["mae", "mean_absolute_error"],
    "RMSE": ["rmse", "root_mean_squared_error"],
    "Accuracy": ["accuracy", "accuracy_score", "accuracy_percent"],
    "Precision": ["precision", "precision_score"],
    "Recall": ["recall", "recall_score"],
    "F1_Score": ["f1", "f1_score", "f1_macro", "macro_f1", "macro_f1_score"],
}


def number_in_text(c: Column) -> Column:
    """First number of a messy text; missing for null words and texts without one."""
    text = F.trim(c.cast("string"))
    plain = F.regexp_replace(text, "[,%]", "")
    return F.when(~F.lower(text).isin(NO_NUMBER), F.nullif(F.regexp_extract(plain, NUMBER, 0), F.lit("")).try_cast("double"))


def normal_key(c: Column) -> Column:
    """Lower case, percent sign spelled out, runs of other characters as one underscore."""
    text = F.replace(F.lower(F.trim(c)), F.lit("%"), F.lit("percent"))
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def metric_name(c: Column) -> Column:
    """Canonical metric name of a column or metric label; missing when it is no metric."""
    known = {s: name for name, spellings in METRIC_NAMES.items() for s in spellings}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), normal_key(c))


# Patterns per metric in log text, tried in order.
_VALUE = r"\s*[:=]\s*([-+]?\d*\.?\d+)"
LOG_PATTERNS = {
    "R2": [r"\br2(?:_score)?\b", r"\br_squared\b"],
    "MAE": [r"\bmae\b", r"mean_absolute_error"],
    "RMSE": [r"\brmse\b", r"root_mean_squared_error"],
    "Accuracy": [r"\baccuracy(?:_score)?\b"],
    "Precision": [r"\bprecision(?:_score)?\b"],
    "Recall": [r"\brecall(?:_score)?\b"],
    "F1_Score": [r"\bf1(?:_score|_macro)?\b", r"\bmacro_f1(?:_score)?\b"],
}


def metrics_in_log(c: Column) -> dict[str, Column]:
    """First match per metric among its patterns in a whole log text."""
    low = F.lower(c)
    out = {}
    for name, labels in LOG_PATTERNS.items():
        found = [F.nullif(F.regexp_extract(low, p + _VALUE, 1), F.lit("")) for p in labels]
        out[name] = F.coalesce(*found).try_cast("double")
    return out


# Dataset keywords in order of precedence with their labels, and result-file words.
DATASET_TAGS = {
    "smart_city": ("Smart City Intelligence", "Classification"),
    "research_intelligence": ("Research Intelligence", "Classification"),
    "public_program": ("Public Program Evaluation", "Regression"),
    "economic_trend": ("Economic Trend", "Regression"),
    "market_analysis": ("Market Analysis", "Regression"),
}
RESULT_WORDS = ["evaluation", "metric", "metrics", "performance", "result", "report", "score", "classification", "regression", "validation"]


def dataset_tag(path: Column) -> dict[str, Column]:
    """Dataset and task named by a file path; missing when no keyword occurs."""
    key = normal_key(path)
    dataset, task = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, (name, kind) in reversed(DATASET_TAGS.items()):
        hit = F.contains(key, F.lit(word))
        dataset, task = F.when(hit, name).otherwise(dataset), F.when(hit, kind).otherwise(task)
    return {"dataset": dataset, "task": task}


def is_result_file(path: Column) -> Column:
    """Whether the file name (without its folders) looks like an evaluation result."""
    name = normal_key(F.substring_index(path, "/", -1))
    flag = F.lit(False)
    for word in RESULT_WORDS:
        flag = flag | F.contains(name, F.lit(word))
    return flag


def metrics_from_pairs(df: DataFrame, keys: Sequence[str], metric: str, value: str, order: str) -> DataFrame:
    """Metric/value rows: the last usable value per canonical metric wins."""
    # A cell of its own: a filter on plain columns would have both computed twice.
    cell = F.struct(metric_name(col(metric)).alias("metric"), number_in_text(col(value)).alias("value"))
    rows = df.select(*keys, col(order).alias("_at"), F.inline(F.array(cell)))
    usable = rows.where("metric is not null and value is not null")
    return usable.groupBy(*keys, "metric").agg(F.max_by("value", "_at").alias("value"))


def metrics_from_columns(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One column per metric: the first usable value of each column that names a metric."""
    cells = [F.struct(metric_name(F.lit(c)).alias("metric"), number_in_text(col(c)).alias("value")) for c in df.columns if c not in (*keys, order)]
    rows = df.select(*keys, col(order).alias("_at"), F.inline(F.array(*cells))).where("metric is not null and value is not null")
    return rows.groupBy(*keys, "metric").agg(F.min_by("value", "_at").alias("value"))
