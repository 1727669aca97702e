"""Exact linear-interpolation quantiles that never hold a large group in one task.

`percentile` keeps every distinct value of a group in one buffer, so it is used only for
groups whose row count was checked. In a larger group each wanted rank starts with the
bracket from the smallest to the largest value. The rows of a bracket are counted in equal
steps (summed in the map tasks), and the step that holds the rank is the next bracket,
until the bracket is one value or its rows fit the same bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.core import attach, col, materialize, one_row

GROUP_LIMIT = 1_000_000
ACCURACY = 256  # equal steps in which the rows of a bracket are counted
LARGEST = 1.7976931348623157e308  # stands for infinity (and NaN) while values are compared


def _hits(rank: str = "rank"):
    """Whether the rows up to `upto`, `rows` of them new, hold the rank."""
    return (F.col("upto") >= F.col(rank)) & (F.col("upto") - F.col("rows") < F.col(rank))


def _long_quantiles(df: DataFrame, keys: list[str], cols: Sequence[str], probs: Sequence[float], limit: int) -> DataFrame:
    """Quantiles in long form (keys, series, which, value): two ranks each, found by narrowing brackets."""
    series = F.explode(F.array(*[F.struct(F.lit(i).alias("series"), col(c).cast("double").alias("value")) for i, c in enumerate(cols)]))
    finite = F.when(F.isnan("s.value"), F.lit(LARGEST)).otherwise(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.col("s.value"))))
    long = df.select(*keys, series.alias("s")).where("s.value is not null").select(*keys, "s.series", finite.alias("value"))
    long = materialize(long, "values")
    group = [*keys, "series"]
    bracket = [*group, "lo", "hi", "below"]
    h = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array(*[
        F.struct(F.lit(j).alias("which"), F.lit(side).alias("side"), h(p).alias("h"), F.least(F.floor(h(p)) + 1 + side, F.col("n")).alias("rank"))
        for j, p in enumerate(probs)
        for side in (0, 1)
    ])
    whole = long.groupBy(*group).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    state = whole.select(*group, "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("rows"), F.inline(ranks))
    state = materialize(state, "brackets")
    wide = (F.col("lo") < F.col("hi")) & (F.col("rows") > limit)
    quarter = lambda c: F.col(c) / 4  # noqa: E731  (so that no difference of finite values overflows)
    step = F.least(F.lit(ACCURACY - 1), F.floor((quarter("value") - quarter("lo")) / (quarter("hi") - quarter("lo")) * ACCURACY))
    within = lambda marks: attach(long, marks.select(*bracket).distinct(), group, "inner").where(F.col("value").between(F.col("lo"), F.col("hi")))
    while not state.where(wide).isEmpty():
        open_ = state.where(wide)
        counts = within(open_).groupBy(*bracket, step.alias("step")).agg(F.count("*").alias("rows"), F.min("value").alias("least"), F.max("value").alias("most"))
        upto = F.sum("rows").over(Window.partitionBy(*bracket).orderBy("step")) + F.col("below")
        narrowed = open_.drop("rows").join(counts.withColumn("upto", upto), bracket).where(_hits())
        narrowed = narrowed.select(*group, F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("upto") - F.col("rows")).alias("below"), "rows", "which", "side", "h", "rank")
        state = materialize(narrowed.unionByName(state.where(~wide)), "brackets")
    few = state.where("lo < hi")
    counted = within(few).groupBy(*bracket, "value").agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy(*bracket).orderBy("value")) + F.col("below")
    picked = few.drop("rows").join(counted.withColumn("upto", upto), bracket).where(_hits()).select(*group, "which", "side", "h", "value")
    every = picked.unionByName(state.where("lo >= hi").select(*group, "which", "side", "h", F.col("lo").alias("value")))
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("value")))
    ends = every.groupBy(*group, "which").agg(side(0).alias("a"), side(1).alias("b"), F.first("h").alias("h"))
    infinite = lambda c: F.when(F.col(c) >= LARGEST, F.lit(float("inf"))).when(F.col(c) <= -LARGEST, F.lit(float("-inf"))).otherwise(F.col(c))
    between = F.when(F.col("a") == F.col("b"), infinite("a")).otherwise(infinite("a") + (infinite("b") - infinite("a")) * (F.col("h") - F.floor("h")))
    return ends.select(*group, "which", between.alias("value"))


def _wide(long: DataFrame, keys: list[str], cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    cells = [
        F.max(F.when((F.col("series") == i) & (F.col("which") == j), F.col("value"))).alias(f"{c}_q{j}")
        for i, c in enumerate(cols)
        for j in range(len(probs))
    ]
    return long.groupBy(*keys).agg(*cells)


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], limit: int = GROUP_LIMIT, sizes: Sequence[int] | None = None) -> dict[str, list[float | None]]:
    """Whole-table quantiles per column, on the driver; `sizes` spares counting the values again."""
    if not cols:
        return {}
    if sizes is None:
        sizes = one_row(df, *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(cols)])
    if max(sizes) <= limit:
        grid = F.array(*[F.lit(float(p)) for p in probs])
        row = one_row(df, *[F.percentile(col(c).cast("double"), grid).alias(f"q{i}") for i, c in enumerate(cols)])
        return {c: list(row[i]) if row[i] is not None else [None] * len(probs) for i, c in enumerate(cols)}
    found = {(r["series"], r["which"]): r["value"] for r in _long_quantiles(df, [], cols, probs, limit).collect()}
    return {c: [found.get((i, j)) for j in range(len(probs))] for i, c in enumerate(cols)}


def group_quantiles(df: DataFrame, keys: Sequence[str], cols: Sequence[str], probs: Sequence[float], limit: int = GROUP_LIMIT) -> DataFrame:
    """Per-group quantiles as columns `<col>_q<i>`; large groups take the narrowing way."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("group_rows"))
    largest = one_row(sizes, F.max("group_rows"))[0] or 0
    grid = F.array(*[F.lit(float(p)) for p in probs])

    def direct(part: DataFrame) -> DataFrame:
        packed = part.groupBy(*keys).agg(*[F.percentile(col(c).cast("double"), grid).alias(f"{c}_q") for c in cols])
        return packed.select(*keys, *[F.element_at(f"{c}_q", j + 1).alias(f"{c}_q{j}") for c in cols for j in range(len(probs))])

    if largest <= limit:
        return direct(df)
    big = sizes.where(F.col("group_rows") > limit).select(*keys)
    return direct(df.join(big, keys, "left_anti")).unionByName(
        _wide(_long_quantiles(df.join(big, keys, "left_semi"), keys, cols, probs, limit), keys, cols, probs)
    )
