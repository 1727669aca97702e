"""Group broadcasts, shares, growth, chronological splits, forecasts, budgets and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.core import attach, col, explode_rows, hash_unit, materialize
from quern.operators import ordered
from quern.operators.quantiles import group_quantiles


def group_broadcast(df: DataFrame, keys: Sequence[str], value: str, stats: Sequence[str] = ("count", "sum", "mean"), prefix: str = "group", source: DataFrame | None = None) -> DataFrame:
    """Group statistics on every row, by aggregate and join so that a hot key is combined
    map-side instead of gathered in one window partition. Rows with a missing key get missing.

    `source` is the table to aggregate when `df` already carries joined columns: aggregating
    such a `df` would repeat its joins, and a chain of them would double the plan at each step.
    """
    simple = {
        "count": F.count(col(value)),
        "sum": F.sum(col(value)),
        "mean": F.avg(col(value)),
        "nunique": F.count_distinct(col(value)),
    }
    out, source = df, df if source is None else source
    plain = [s for s in stats if s in simple]
    if plain:
        agg = source.groupBy(*keys).agg(*[simple[s].alias(f"{prefix}_{s}") for s in plain])
        out = attach(out, agg, keys)
    if "median" in stats:
        med = group_quantiles(source, keys, [value], [0.5]).withColumnRenamed(f"{value}_q0", f"{prefix}_median")
        out = attach(out, med, keys)
    return out


def group_share(df: DataFrame, keys: Sequence[str], value: str, out: str = "share") -> DataFrame:
    """Percent of the group total; missing where the total is zero."""
    total = df.groupBy(*keys).agg(F.sum(col(value)).alias("_total"))
    share = F.when(F.col("_total") != 0, col(value) / F.col("_total") * 100)
    return attach(df, total, keys).withColumn(out, share).drop("_total")


def group_deviation(df: DataFrame, keys: Sequence[str], value: str, around: str = "mean", out: str = "deviation", source: DataFrame | None = None) -> DataFrame:
    marked = group_broadcast(df, keys, value, [around], "_g", source)
    return marked.withColumn(out, col(value) - F.col(f"_g_{around}")).drop(f"_g_{around}")


def growth_rate(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, block_rows: int | None = None) -> DataFrame:
    """Percent change against the row before; zero base gives missing, first rows are dropped."""
    marked = ordered.previous(df, keys, order, {"_before": value, "_seen": order[0]}, block_rows)
    rate = F.when(F.col("_before") != 0, (col(value) - F.col("_before")) / F.col("_before") * 100)
    return marked.where("_seen is not null").withColumn("growth_percent", rate).drop("_before", "_seen")


def time_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], test_size: float = 0.2, block_rows: int | None = None) -> DataFrame:
    """Chronological split per key: the first int(n·(1-test)) rows are `train`, the rest `test`."""
    marked = ordered.position(df, keys, order, "_pos", block_rows=block_rows)
    if keys:
        sized = attach(marked, df.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    else:
        sized = marked.withColumn("_n", F.lit(df.count()))
    part = F.when(F.col("_pos") <= F.floor(F.col("_n") * F.lit(1 - test_size)), "train").otherwise("test")
    return sized.withColumn("split", part).drop("_pos", "_n")


def tail_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, k: int) -> DataFrame:
    """The last k values per key in time order, as a short array."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(*[col(c).desc() for c in order]))
    last = df.withColumn("_age", newest).where(F.col("_age") <= k)
    packed = F.array_sort(F.collect_list(F.struct((-F.col("_age")).alias("at"), col(value).cast("double").alias("v"))))
    return last.groupBy(*keys).agg(F.transform(packed, lambda s: s["v"]).alias("tail"))


def moving_average_forecast(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, window: int = 3, steps: int = 1) -> DataFrame:
    """Recursive forecast: each step averages the last `window` values, earlier forecasts included."""
    tail = tail_values(df, keys, order, value, window)

    def extend(acc: Column, _: Column) -> Column:
        recent = F.slice(acc, F.greatest(F.size(acc) - window + 1, F.lit(1)), F.lit(window))
        mean = F.aggregate(recent, F.lit(0.0), lambda s, v: s + v) / F.size(recent)
        return F.concat(acc, F.array(mean))

    full = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("tail"), extend)
    points = explode_rows(tail, keys, F.slice(full, -steps, steps), "forecast", "step")
    return points.withColumn("step", F.col("step") + 1)


def autoregressive_forecast(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, steps: int = 5, block_rows: int | None = None) -> DataFrame:
    """AR(1) on first differences per key, fitted by least squares, run forward `steps` times.

    A stand-in for an ARIMA(1,1,1) maximum-likelihood fit, not the same estimator. Keys with a
    constant difference repeat it; keys with fewer than three differences are left out.
    """
    # Cut and stored once, with the differences, for both steps back.
    work, rows, cut = ordered.blocked(df.select(*dict.fromkeys([*keys, *order, value])), order, block_rows, keys)
    first = ordered.lagged(work, keys, rows, {"_before": value}, cut).withColumn("_diff", col(value) - F.col("_before")).drop("_before")
    second = ordered.lagged(materialize(first, "differences") if cut else first, keys, rows, {"_diff_before": "_diff"}, cut)
    latest = F.struct(*[col(c) for c in order])
    pair = F.col("_diff").isNotNull() & F.col("_diff_before").isNotNull()
    y, x = F.when(pair, F.col("_diff")), F.when(pair, F.col("_diff_before"))
    fit = second.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.avg(y).alias("mean_diff"),
        F.count(y).alias("pairs"),
        F.max_by(col(value), latest).alias("last"),
        F.max_by("_diff", latest).alias("last_diff"),
    ).where("pairs >= 2")
    phi, base = F.coalesce("slope", F.lit(0.0)), F.coalesce("intercept", "mean_diff")

    def step(acc: Column, _: Column) -> Column:
        tip = F.element_at(acc, -1)
        diff = base + phi * tip["diff"]
        return F.concat(acc, F.array(F.struct((tip["level"] + diff).alias("level"), diff.alias("diff"))))

    start = F.array(F.struct(F.col("last").cast("double").alias("level"), F.col("last_diff").cast("double").alias("diff")))
    path = F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step), 2, steps)
    return explode_rows(fit, keys, path, "point", "step").select(*keys, (F.col("step") + 1).alias("step"), F.col("point.level").alias("forecast"))


def ranked(df: DataFrame, score: str, name: str, k: int | None = None) -> DataFrame:
    """1-based rank by score on a short report; with k the top rows are cut before ranking."""
    top = df.orderBy(F.desc(score), name).limit(k) if k else df
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(score), name)))


def length_budget(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, limit: int, least: int, separator_free: bool = True) -> DataFrame:
    """Keep texts until their total length passes the limit; cut the crossing one if more than
    `least` characters remain. Adds `kept_text`; rows past the budget are dropped."""
    size = F.length(col(text)).cast("long")
    run = ordered.running_sum(df.withColumn("_len", size), keys, order, {"_upto": F.col("_len")})
    before = F.col("_upto") - F.col("_len")
    room = F.lit(limit) - before
    fits = F.col("_upto") <= limit
    crosses = (before <= limit) & ~fits & (room > least)
    kept = F.when(fits, col(text)).when(crosses, F.concat(F.expr(f"substring(`{text}`, 1, int({limit} - (_upto - _len)))"), F.lit("...")))
    return run.withColumn("kept_text", kept).where("kept_text is not null").drop("_len", "_upto")


def edge_values(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """First, previous and latest value per key along `order` (unique per key)."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(col(order).desc()))
    last_two = df.withColumn("_age", newest).where("_age <= 2").groupBy(*keys).agg(
        F.max(F.when(F.col("_age") == 1, col(value))).alias("latest"), F.max(F.when(F.col("_age") == 2, col(value))).alias("previous")
    )
    first = df.groupBy(*keys).agg(F.min_by(col(value), col(order)).alias("first"))
    return attach(first, last_two, keys)


def fold_of(*key: Column, folds: int = 5, seed: int = 42) -> Column:
    """Fold number 0..folds-1 from a seeded hash of the row key: no shuffle, same on every run."""
    return F.floor(hash_unit(*key, seed=seed) * folds).cast("int")
