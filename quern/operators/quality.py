"""Duplicates and missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.core import col, is_numeric, numeric_columns, one_row, per_column, replace_columns
from quern.operators import ordered
from quern.operators.quantiles import quantiles


def remove_duplicates(df: DataFrame, subset: Sequence[str] | None = None, keep: str = "first", order: Sequence[str] = ()) -> DataFrame:
    """Drop duplicate rows over all columns, or over `subset` keeping the first or last row in
    `order`, or none of the copies.

    Keeping one row per key is a limit of one per window group: Spark prunes each map task to
    one row per key before the shuffle, so a hot key does not pile up in one task.
    """
    keys = list(subset) if subset else df.columns
    if keep == "none":
        counts = df.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("_n"))
        single = counts.where("_n = 1").select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        on = [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        return df.join(single, on, "left_semi")
    if not subset:
        return df.dropDuplicates()
    if not order:
        raise ValueError("keeping the first or last row needs an order column")
    sort = [col(c).asc() if keep == "first" else col(c).desc() for c in order]
    rank = F.row_number().over(Window.partitionBy(*[col(k) for k in keys]).orderBy(*sort))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def duplicate_counts(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, distinct rows and duplicate rows (every copy after the first)."""
    keys = list(subset) if subset else df.columns
    groups = df.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def mode_value(df: DataFrame, column: str):
    """Smallest of the most frequent present values: a distributed count and a top-1."""
    top = df.where(col(column).isNotNull()).groupBy(col(column)).count().orderBy(F.desc("count"), col(column).asc()).limit(1).collect()
    return top[0][0] if top else None


def fill_values(df: DataFrame, columns: Sequence[str], strategy: str, fallback: bool = False) -> dict[str, object]:
    """Fitted fill value per column that has missing values.

    mean and median apply to numeric columns; with `fallback` other columns take their mode,
    then the word "unknown".
    """
    rows, *present = one_row(df, F.count("*"), *[F.count(col(c)) for c in columns])
    sizes = dict(zip(columns, present))
    open_cols = [c for c in columns if sizes[c] < rows]
    numbers = [c for c in open_cols if is_numeric(df.schema[c].dataType)]
    values: dict[str, object] = {}
    if strategy == "mean" and numbers:
        values.update(zip(numbers, one_row(df, *[F.avg(col(c)) for c in numbers])))
    elif strategy == "median":
        values.update({c: q[0] for c, q in quantiles(df, numbers, [0.5], sizes=[sizes[c] for c in numbers]).items()})
    by_mode = open_cols if strategy == "mode" else [c for c in open_cols if c not in numbers and fallback]
    for c in by_mode:
        found = mode_value(df, c)
        values[c] = "unknown" if found is None and strategy != "mode" else found
    return {c: v for c, v in values.items() if v is not None}


def apply_fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    def filled(c: str, v: object) -> Column:
        kind = df.schema[c].dataType
        # A fractional fill value widens an integer column instead of being cut.
        if is_numeric(kind) and isinstance(v, float):
            return F.coalesce(col(c).cast("double"), F.lit(v))
        return F.coalesce(col(c), F.lit(v).cast(kind))

    return replace_columns(df, {c: filled(c, v) for c, v in values.items() if c in df.columns})


def impute(df: DataFrame, strategy: str = "median", columns: Sequence[str] | None = None, fill_value=None, fallback: bool = True) -> DataFrame:
    """Drop rows with missing values or fill by mean, median, mode or a constant.

    `fallback=True` is the data-service form (mode, then "unknown", for text columns under
    mean or median); `fallback=False` leaves those columns alone.
    """
    cols = [c for c in (columns if columns is not None else df.columns) if c in df.columns]
    if strategy == "drop":
        return df.dropna(subset=cols)
    if strategy in ("constant", "fill"):
        if fill_value is None:
            raise ValueError("a constant fill needs fill_value")
        wanted = [c for c in cols if is_numeric(df.schema[c].dataType) == isinstance(fill_value, (int, float))]
        return apply_fill(df, {c: fill_value for c in wanted})
    if strategy not in ("mean", "median", "mode"):
        raise ValueError(f"unknown strategy '{strategy}'")
    return apply_fill(df, fill_values(df, cols, strategy, fallback))


def impute_numeric(df: DataFrame, strategy: str = "drop", fill_value=None, columns: Sequence[str] | None = None) -> DataFrame:
    """Quick form: drop, fill, or mean/median on numeric columns only."""
    cols = list(columns) if columns else df.columns
    if strategy in ("mean", "median"):
        cols = [c for c in cols if c in numeric_columns(df)]
    return impute(df, strategy, cols, fill_value, fallback=False)


def fill_along(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], direction: str = "ffill", block_rows: int | None = None) -> DataFrame:
    """Carry the last (ffill) or next (bfill) present value along an explicit order per key."""
    if direction not in ("ffill", "bfill"):
        raise ValueError("direction is 'ffill' or 'bfill'")
    return ordered.fill(df, keys, order, columns, direction == "bfill", block_rows)


def fit_impute(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict[str, object]:
    """Training medians and most frequent values, to be applied to any other split."""
    values: dict[str, object] = {c: q[0] for c, q in quantiles(train, numeric, [0.5]).items()}
    values.update({c: mode_value(train, c) for c in categorical})
    return values


def missing_report(df: DataFrame) -> DataFrame:
    """Per column: missing count and percent, and its share of all missing cells' table."""
    stats = per_column(df, df.columns, {"missing": lambda c: F.count_if(col(c).isNull()), "rows": lambda c: F.count("*")})
    cells = F.col("rows") * len(df.columns)
    return stats.select(
        "column",
        "missing",
        F.try_divide(F.col("missing") * 100.0, F.col("rows")).alias("missing_percent"),
        F.try_divide(F.col("missing") * 100.0, cells).alias("cell_percent"),
    )
