"""Group statistics, profiles, correlations, chart data and summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.core import attach, bounded_levels, col, describe_rows, explode_rows, is_numeric, materialize, numeric_columns, one_row, per_column, string_columns
from quern.operators import ordered
from quern.operators.quality import duplicate_counts
from quern.operators.quantiles import group_quantiles, quantiles


def group_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.sum(value).alias("total"), F.count(value).alias("rows"))


def value_counts(df: DataFrame, column: str, keep_missing: bool = False) -> DataFrame:
    """Counts per value, most frequent first, with the share of the counted rows."""
    counted = df if keep_missing else df.where(col(column).isNotNull())
    counts = counted.groupBy(col(column).alias("value")).agg(F.count("*").alias("rows"))
    total = counted.count()
    return counts.select("value", "rows", (F.col("rows") / F.lit(total)).alias("share")).orderBy(F.desc("rows"), "value")


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct present values per column; the approximate form keeps a fixed-size sketch each.

    The exact form reads each column by itself: its distinct values are found in the map tasks, shuffled once and
    counted. Counting several columns in one aggregate would make Spark repeat every row for every column.
    """
    cols = list(columns or df.columns)
    if approximate:
        return per_column(df, cols, {"distinct": lambda c: F.approx_count_distinct(col(c))})
    parts = [df.select(col(c).alias("v")).where("v is not null").distinct().agg(F.count("*").alias("distinct")).select(F.lit(c).alias("column"), "distinct") for c in cols]
    return reduce(DataFrame.unionAll, parts)


def corrected_skew(c: Column) -> Column:
    """Bias-corrected skewness; missing for fewer than three values."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def describe_numbers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per numeric column."""
    cols = list(columns or numeric_columns(df))
    base = per_column(
        df,
        cols,
        {
            "count": lambda c: F.count(col(c)),
            "mean": lambda c: F.avg(col(c)),
            "std": lambda c: F.stddev_samp(col(c)),
            "min": lambda c: F.min(col(c)).cast("double"),
            "max": lambda c: F.max(col(c)).cast("double"),
            "skewness": lambda c: corrected_skew(col(c)),
        },
    )
    found = quantiles(df, cols, [0.25, 0.5, 0.75])
    rows = [(c, *q) for c, q in found.items()]
    return base.join(describe_rows(df.sparkSession, rows, "column string, q25 double, q50 double, q75 double"), "column")


def describe_texts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, distinct values, most frequent value and its frequency per text column."""
    out = []
    for c in columns or string_columns(df):
        counts = df.where(col(c).isNotNull()).groupBy(col(c).cast("string").alias("v")).agg(F.count("*").alias("n"))
        most = F.max(F.col("n")).alias("freq")
        first = F.min_by("v", F.struct(-F.col("n"), "v")).alias("top")
        out.append(counts.agg(F.sum("n").alias("count"), F.count("*").alias("unique"), first, most).select(F.lit(c).alias("column"), "*"))
    return reduce(DataFrame.unionByName, out)


def quick_profile(df: DataFrame) -> DataFrame:
    """Rows, missing values and type per column."""
    types = dict(df.dtypes)
    stats = per_column(df, df.columns, {"rows": lambda c: F.count("*"), "missing": lambda c: F.count_if(col(c).isNull())})
    names = F.create_map(*[F.lit(x) for c in df.columns for x in (c, types[c])])
    return stats.withColumn("dtype", names[F.col("column")])


def full_profile(df: DataFrame) -> DataFrame:
    """Per column: missing, distinct, numeric statistics to four digits, corrected skew."""
    base = per_column(
        df,
        df.columns,
        {
            "missing": lambda c: F.count_if(col(c).isNull()),
            "missing_percent": lambda c: F.round(F.try_divide(F.count_if(col(c).isNull()) * 100.0, F.count("*")), 2),
        },
    ).join(distinct_counts(df), "column")
    stats = describe_numbers(df).drop("count")
    digits = [c for c in stats.columns if c != "column"]
    return base.join(stats.withColumns({c: F.round(c, 4) for c in digits}), "column", "left")


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """Most frequent values per column, ranked."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]))).where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("rows"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("rows"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def profile_warnings(df: DataFrame) -> DataFrame:
    """Warnings: many missing cells, high skew, constant, many distinct texts, many duplicates."""
    profile = full_profile(df).withColumn("is_text", F.col("column").isin(string_columns(df)))
    picks = F.array_compact(F.array(
        F.when(F.abs("skewness") > 1, F.struct("column", F.lit("high skewness").alias("warning"), F.col("skewness").alias("amount"))),
        F.when(F.col("std") == 0, F.struct("column", F.lit("constant").alias("warning"), F.lit(0.0).alias("amount"))),
        F.when(F.col("is_text") & (F.col("distinct") > 50), F.struct("column", F.lit("high cardinality").alias("warning"), F.col("distinct").cast("double").alias("amount"))),
    ))
    by_column = profile.select(F.inline(picks))
    width = len(df.columns)
    cells = per_column(df, df.columns, {"missing": lambda c: F.count_if(col(c).isNull()), "rows": lambda c: F.count("*")})
    share = cells.agg((F.try_divide(F.sum("missing"), F.max("rows") * width) * 100).alias("amount")).where("amount > 20")
    copies = duplicate_counts(df).select(F.try_divide(F.col("duplicate_rows") * 100.0, F.col("total_rows")).alias("amount")).where("amount > 10")
    table = lambda part, text: part.select(F.lit("(table)").alias("column"), F.lit(text).alias("warning"), F.round("amount", 2).alias("amount"))
    return by_column.unionByName(table(share, "high missing ratio")).unionByName(table(copies, "high duplicate ratio"))


def pearson(a: Column, b: Column) -> Column:
    """Correlation over the rows where both are present; missing when either is constant there.

    Spark's own `corr` divides by zero on a constant column under ANSI mode.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


MOMENTS = ("n", "mx", "my", "vx", "vy", "cov")


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts, means and sums of squares and products about the means, of two sets of rows together."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    f = a[0] * share
    return np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * f, a[4] + b[4] + dy * dy * f, a[5] + b[5] + dx * dy * f])


def _batch_moments(raw: np.ndarray) -> np.ndarray:
    """MOMENTS of every pair of columns over the rows where both are present, about the pair's own means."""
    i, j = np.triu_indices(raw.shape[1], 1)
    seen = ~np.isnan(raw)
    m = seen.astype(np.float64)
    centre = np.where(seen, raw, 0.0).sum(0) / np.maximum(m.sum(0), 1)
    d = np.where(seen, raw - centre, 0.0)
    n, s, q = m.T @ m, d.T @ m, (d * d).T @ m
    mean = s / np.maximum(n, 1)
    v, c = q - s * mean, d.T @ d - s * mean.T
    out = np.stack([n[i, j], (centre[:, None] + mean)[i, j], (centre[:, None] + mean)[j, i], v[i, j], v[j, i], c[i, j]])
    # Where the pair's rows lie far from a column's mean, the difference of large sums is not good enough.
    weak = (n > 0) & (v < 1e-3 * q)
    for p in np.flatnonzero(weak[i, j] | weak[j, i]):
        rows = seen[:, i[p]] & seen[:, j[p]]
        x, y = raw[rows, i[p]], raw[rows, j[p]]
        mx, my = x.mean(), y.mean()
        out[:, p] = len(x), mx, my, ((x - mx) ** 2).sum(), ((y - my) ** 2).sum(), ((x - mx) * (y - my)).sum()
    return out


def _pair_moments(width: int):
    """Task function: MOMENTS of every pair over the rows of one partition."""

    def run(batches):
        total = None
        for batch in batches:
            part = _batch_moments(np.stack(batch["v"].to_numpy()).astype(np.float64))
            total = part if total is None else _merged(total, part)
        if total is not None:
            i, j = np.triu_indices(width, 1)
            yield pd.DataFrame({"i": i, "j": j, **dict(zip(MOMENTS, total))})

    return run


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair: (left, right, r), by one formula at any number of columns.

    Missing values (and NaN) are left out per pair, means are taken over the pair's own rows. A column whose values
    over these rows differ by no more than rounding (1e-14 of their mean) is constant: r is missing.
    """
    cols = list(columns or numeric_columns(df))
    values = F.array(*[F.coalesce(col(c).cast("double"), F.lit(float("nan"))) for c in cols])
    schema = "i int, j int, " + ", ".join(f"{m} double" for m in MOMENTS)
    parts = df.select(values.alias("v")).mapInPandas(_pair_moments(len(cols)), schema)
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col("n") * F.col(c)), F.sum("n")), F.lit(0.0))
    parts = materialize(parts, "moments")
    whole = parts.groupBy("i", "j").agg(mean("mx").alias("ax"), mean("my").alias("ay"))
    dx, dy = F.col("mx") - F.col("ax"), F.col("my") - F.col("ay")
    sums = parts.join(whole, ["i", "j"]).groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.first("ax").alias("ax"), F.first("ay").alias("ay"),
        F.sum(F.col("vx") + F.col("n") * dx * dx).alias("vx"), F.sum(F.col("vy") + F.col("n") * dy * dy).alias("vy"), F.sum(F.col("cov") + F.col("n") * dx * dy).alias("cov"),
    )
    varies = lambda v, a: F.col(v) > F.col("n") * F.pow(F.abs(a) * 1e-14, 2)
    r = F.when(varies("vx", "ax") & varies("vy", "ay"), F.col("cov") / F.sqrt(F.col("vx")) / F.sqrt(F.col("vy")))
    names = F.array(*[F.lit(c) for c in cols])
    return sums.select(names[F.col("i")].alias("left"), names[F.col("j")].alias("right"), r.alias("r"))


def target_correlations(df: DataFrame, target: str, columns: Sequence[str] | None = None, k: int = 15) -> DataFrame:
    cols = [c for c in (columns or numeric_columns(df)) if c != target]
    stats = per_column(df, cols, {"r": lambda c: F.abs(pearson(col(c), col(target)))})
    return stats.orderBy(F.desc_nulls_last("r"), "column").limit(k)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width counts (bin, low, high, rows); the last bin includes its upper edge."""
    low, high = one_row(df, F.min(col(column)).cast("double"), F.max(col(column)).cast("double"))
    if low is None:
        return describe_rows(df.sparkSession, [], "bin int, low double, high double, rows bigint")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    value = col(column).cast("double")
    index = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(value.isNotNull()).groupBy(index.alias("bin")).agg(F.count("*").alias("rows"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edges = grid.select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"), (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"))
    return edges.join(counts, "bin", "left").fillna(0, subset=["rows"])


def box_stats(df: DataFrame, key: str, value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers inside the fences and outlier count per category."""
    q = group_quantiles(df, [key], [value], [0.25, 0.5, 0.75]).toDF(key, "q1", "median", "q3")
    iqr = F.col("q3") - F.col("q1")
    inside = col(value).between(F.col("q1") - reach * iqr, F.col("q3") + reach * iqr)
    return (
        attach(df.select(key, value), q, [key])
        .groupBy(key)
        .agg(
            F.first("q1").alias("q1"),
            F.first("median").alias("median"),
            F.first("q3").alias("q3"),
            F.min(F.when(inside, col(value))).alias("whisker_low"),
            F.max(F.when(inside, col(value))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


# Most levels that become columns of a pivot.
PIVOT_LEVELS = 500


def pivot_wide(df: DataFrame, index: str, category: str, value: str, levels: Sequence | None = None) -> DataFrame:
    """Index × category table; the category levels are listed or checked to be few (`pivot_long` takes any number)."""
    levels = list(levels) if levels is not None else bounded_levels(df, category, PIVOT_LEVELS)
    return df.groupBy(index).pivot(category, levels).agg(F.first(value, ignorenulls=True))


def pivot_long(df: DataFrame, index: str, category: str, value: str, how: Callable[[Column], Column] = F.first) -> DataFrame:
    """The filled cells of the index × category table as rows, for any number of levels.

    `how` makes one value of a cell's rows; totals made before would hold every cell in several tables of a task.
    """
    filled = df.where(col(category).isNotNull() & col(value).isNotNull())
    return filled.groupBy(index, category).agg(how(col(value)).alias(value))


def category_shares(df: DataFrame, key: str, value: str) -> DataFrame:
    """Percent of the total and mean per category."""
    totals = df.groupBy(key).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"))
    whole = one_row(df, F.sum(value))[0]
    return totals.select(key, "mean", F.try_divide(F.col("total") * 100, F.lit(whole)).alias("percent"))


def summarize(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """mean, min, max and population std to six digits; zeros when there is nothing."""
    v = col(value).cast("double")
    parts = {"mean": F.avg(v), "min": F.min(v), "max": F.max(v), "std": F.stddev_pop(v)}
    return df.groupBy(*keys).agg(*[F.round(F.coalesce(e, F.lit(0.0)), 6).alias(n) for n, e in parts.items()])


# Two-sided normal quantiles.
Z_VALUES = {0.95: 1.96, 0.99: 2.576}
Z_OTHER = 1.645


def confidence_interval(df: DataFrame, keys: Sequence[str], value: str, confidence: float = 0.95) -> DataFrame:
    z = Z_VALUES.get(confidence, Z_OTHER)
    half = F.coalesce(F.lit(z) * F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.avg(value) - half).alias("lower"), (F.avg(value) + half).alias("upper"))


def consolidate(df: DataFrame, keys: Sequence[str], order: str, labels: Sequence[str], metrics: Sequence[str], source: str | None = None) -> DataFrame:
    """Per group: labels of the first row, first present value of each metric, and the distinct sources joined.

    The joined text holds one entry per source of the group. Where a group may have very many sources leave `source`
    out and take `source_rows`.
    """
    first = df.groupBy(*keys).agg(
        *[F.min_by(col(c), col(order)).alias(c) for c in labels],
        *[F.min_by(col(c), F.when(col(c).isNotNull(), col(order))).alias(c) for c in metrics],
    )
    if source is None:
        return first
    sources = df.select(*keys, source).distinct().groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(source)), "; ").alias("sources"))
    return attach(first, sources, keys)


def source_rows(df: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """The distinct sources of every group as rows (keys, source, position), for groups of any size."""
    known = df.select(*keys, source).where(col(source).isNotNull()).distinct()
    return ordered.position(known, list(keys), [source], "position")


def best_rows(df: DataFrame, task: str, name: str, higher: Sequence[str], lower: Sequence[str]) -> DataFrame:
    """Best row per task and metric: largest for `higher`, smallest for `lower`."""
    aggs, cells = [], []
    for m in [*higher, *lower]:
        pick = F.max_by if m in higher else F.min_by
        aggs += [pick(F.struct(col(m).alias("value"), col(name).alias("name")), F.when(col(m).isNotNull(), col(m))).alias(m)]
        cells += [F.struct(F.lit(m).alias("metric"), F.col(f"{m}.name").alias("best"), F.col(f"{m}.value").cast("double").alias("value"))]
    return df.groupBy(task).agg(*aggs).select(task, F.inline(F.array(*cells))).where("best is not null")


def exploded_counts(df: DataFrame, labels: Column, k: int | None = None) -> DataFrame:
    """Counts of the labels inside a list column, most frequent first."""
    counts = explode_rows(df, [], labels, "label").groupBy("label").agg(F.count("*").alias("rows"))
    ordered = counts.orderBy(F.desc("rows"), "label")
    return ordered.limit(k) if k else ordered


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Count and share per class and whether a stratified split is possible."""
    counts = df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("class")).agg(F.count("*").alias("rows"))
    rows, classes, least = one_row(counts, F.sum("rows"), F.count("*"), F.min("rows"))
    return counts.select("class", "rows", (F.col("rows") / F.lit(rows)).alias("share"), F.lit(classes >= 2 and least >= 2).alias("can_stratify"))


def detect_task_type(df: DataFrame, target: str) -> str:
    """'classification' or 'regression' from the target's type, spread and distinct values."""
    kind = df.schema[target].dataType
    if isinstance(kind, (T.StringType, T.BooleanType)) or not is_numeric(kind):
        return "classification"
    c = col(target)
    whole = F.avg((c.cast("double") == F.floor(c.cast("double"))).cast("int"))
    distinct, rows, low, high, integer_like = one_row(df, F.count_distinct(c), F.count("*"), F.min(c), F.max(c), whole)
    if distinct <= 2:
        return "classification"
    if isinstance(kind, T.IntegralType) and (distinct <= 20 or (high - low <= 100 and distinct <= 50)):
        return "classification"
    if distinct / rows > 0.1:
        return "regression"
    if not isinstance(kind, T.IntegralType) and integer_like > 0.8 and distinct <= 50:
        return "classification"
    return "regression"


def grouped_importance(features: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Importance summed back from encoded features to their source column, ranked with percent.

    A feature belongs to the longest source name it starts with.
    """
    by_length = sorted(sources, key=len, reverse=True)
    owner = F.coalesce(*[F.when((F.col("feature") == s) | F.startswith("feature", F.lit(s + "_")), F.lit(s)) for s in by_length], F.col("feature"))
    total = features.groupBy(owner.alias("source")).agg(F.sum("importance").alias("importance"))
    whole = one_row(total, F.sum("importance"))[0]
    # One row per source column, so ranking them in one place is bounded by the table's width.
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "source"))
    return total.select("source", "importance", F.try_divide(F.col("importance") * 100, F.lit(whole)).alias("percent"), rank.alias("rank"))


def text_lengths(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """min, median and max characters per text column; missing counts as 0."""
    cols = list(columns or string_columns(df))
    lengths = df.select(*[F.length(F.coalesce(col(c), F.lit(""))).alias(c) for c in cols])
    base = per_column(lengths, cols, {"min_chars": lambda c: F.min(col(c)), "max_chars": lambda c: F.max(col(c))})
    rows = [(c, q[0]) for c, q in quantiles(lengths, cols, [0.5]).items()]
    return base.join(describe_rows(df.sparkSession, rows, "column string, median_chars double"), "column")
