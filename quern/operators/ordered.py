"""Ordered per-key work (positions, running sums, previous value, fills) without one task per key.

A key may hold a third of all rows, so a key's timeline is cut into blocks by the whole
order tuple, ended by a row number: text, null and tied orders are cut like any other. Each
block is a window partition of its own; the little that must cross a block edge (a count, a
sum, a last value) is aggregated per block, chained over the blocks and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.core import col, materialize, one_row

BLOCK_ROWS = 1_000_000
# Cuts held by the driver and every task, and sampled rows per cut.
MAX_CUTS = 16_384
SAMPLED = 20
ROW = "_row_number"


def cut_tree(value: Column, cuts: Sequence[float], low: int = 0) -> Column:
    """Index of the block holding `value`, as a balanced tree of comparisons."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(value < F.lit(cuts[mid]), cut_tree(value, cuts[:mid], low)).otherwise(cut_tree(value, cuts[mid + 1:], low + mid + 1))


def _sortable(df: DataFrame, name: str) -> Column:
    """An order column in a form that travels to the driver and back unchanged."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col(name).cast("timestamp"))
    return col(name)


def blocked(df: DataFrame, order: Sequence[str], block_rows: int | None = None, keys: Sequence[str] = ()) -> tuple[DataFrame, list[str], bool]:
    """The rows with `_block`, the order that makes them unique, and whether there is more than one block.

    Nothing is cut while no key has more than `block_rows` rows: the keys are blocks enough. Else a table of more than `block_rows` rows is stored once with a number for each row, so every later pass sees the same
    blocks. The cuts are every SAMPLED-th of a sorted sample of (order, row number); a row's block is the number of
    cuts that are not above it, found by halving.
    """
    block_rows = block_rows or BLOCK_ROWS
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total, largest = one_row(sizes, F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0)))
    if largest <= block_rows:
        return df.withColumn("_block", F.lit(0)), list(order), False
    stored = materialize(df.withColumn(ROW, F.monotonically_increasing_id()), "ordered")
    cuts = min(-(-total // block_rows), MAX_CUTS)
    share = min(1.0, SAMPLED * cuts / total)
    place = F.struct(*[_sortable(stored, c).alias(f"o{i}") for i, c in enumerate(order)], F.col(ROW).alias("row"))
    sample = stored.where(F.pmod(F.xxhash64(ROW), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(place.alias("p"))
    taken = [r["p"] for r in sample.orderBy("p").collect()]
    step = max(1, len(taken) // cuts)
    edges = taken[step::step]
    if not edges:
        return stored.withColumn("_block", F.lit(0)), [*order, ROW], False
    schema = T.StructType([T.StructField("_cuts", T.ArrayType(sample.schema["p"].dataType, False))])
    table = df.sparkSession.createDataFrame([(edges,)], schema)
    halves = [1 << p for p in reversed(range(len(edges).bit_length()))]
    found = F.aggregate(
        F.array(*[F.lit(h) for h in halves]), F.lit(0), lambda at, h: F.when((at + h <= len(edges)) & (F.get("_cuts", at + h - 1) <= F.col("_place")), at + h).otherwise(at)
    )
    # One row of cuts, of a bounded number, meets every row.
    marked = stored.withColumn("_place", place).crossJoin(F.broadcast(table)).withColumn("_block", found).drop("_cuts", "_place")
    return marked, [*order, ROW], True


def _chain(df: DataFrame, keys: Sequence[str], carry: DataFrame) -> DataFrame:
    """Join per-block carries on null-safe keys."""
    names = [*keys, "_block"]
    right = carry.select(*[col(k).alias(f"_r{i}") for i, k in enumerate(names)], *[c for c in carry.columns if c not in names])
    on = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(names)])
    return df.join(right, on, "left").drop(*[f"_r{i}" for i in range(len(names))])


def _sorts(order: Sequence[str], descending: bool) -> list[Column]:
    return [col(c).desc() if descending else col(c).asc() for c in order]


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    descending: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Inclusive running sums per key in `order`; rows that tie follow each other in some order."""
    work, order, cut = blocked(df, order, block_rows, keys)
    window = Window.partitionBy(*keys, "_block").orderBy(*_sorts(order, descending)).rowsBetween(Window.unboundedPreceding, 0)
    out = work.select("*", *[F.sum(e).over(window).alias(n) for n, e in sums.items()])
    if not cut:
        return out.select(*df.columns, *sums)
    totals = work.groupBy(*keys, "_block").agg(*[F.sum(e).alias(f"_t{i}") for i, e in enumerate(sums.values())])
    edge = F.col("_block").desc() if descending else F.col("_block").asc()
    before = Window.partitionBy(*keys).orderBy(edge).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_block", *[F.sum(f"_t{i}").over(before).alias(f"_c{i}") for i in range(len(sums))])
    joined = _chain(out, keys, carry)
    fixed = {n: F.coalesce(F.col(f"_c{i}"), F.lit(0)) + F.col(n) for i, n in enumerate(sums)}
    return joined.withColumns(fixed).select(*df.columns, *sums)


def position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "position",
    descending: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Exact 1-based position of each row within its key."""
    return running_sum(df, keys, order, {out: F.lit(1).cast("long")}, descending, block_rows)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, str],
    block_rows: int | None = None,
) -> DataFrame:
    """Value of the row before, per key: `values` maps output name to input column."""
    work, order, cut = blocked(df, order, block_rows, keys)
    return lagged(work, keys, order, values, cut).select(*df.columns, *values)


def lagged(work: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str], cut: bool) -> DataFrame:
    """`previous` on rows that `blocked` has cut, so that several steps share one stored and cut table."""
    window = Window.partitionBy(*keys, "_block").orderBy(*_sorts(order, False))
    out = work.select("*", *[F.lag(col(c)).over(window).alias(n) for n, c in values.items()], F.row_number().over(window).alias("_pos"))
    if not cut:
        return out.drop("_pos")
    last = F.max_by(F.struct(*[col(c).alias(f"_l{i}") for i, c in enumerate(values.values())]), F.struct(*[col(c) for c in order]))
    ends = work.groupBy(*keys, "_block").agg(last.alias("_last"))
    chain = Window.partitionBy(*keys).orderBy("_block")
    carry = ends.select(*keys, "_block", F.lag("_last").over(chain).alias("_carry"))
    joined = _chain(out, keys, carry)
    fixed = {n: F.when(F.col("_pos") == 1, F.col(f"_carry._l{i}")).otherwise(F.col(n)) for i, n in enumerate(values)}
    return joined.withColumns(fixed).drop("_pos", "_carry")


def fill(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    backward: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Forward (or backward) fill of missing values per key in `order`."""
    work, order, cut = blocked(df, order, block_rows, keys)
    window = Window.partitionBy(*keys, "_block").orderBy(*_sorts(order, backward)).rowsBetween(Window.unboundedPreceding, 0)
    out = work.withColumns({f"_f{i}": F.last(col(c), ignorenulls=True).over(window) for i, c in enumerate(cols)})
    if cut:
        at = F.struct(*[col(c) for c in order])
        pick = F.min_by if backward else F.max_by
        ends = work.groupBy(*keys, "_block").agg(*[pick(F.when(col(c).isNotNull(), col(c)), F.when(col(c).isNotNull(), at)).alias(f"_e{i}") for i, c in enumerate(cols)])
        edge = F.col("_block").desc() if backward else F.col("_block").asc()
        before = Window.partitionBy(*keys).orderBy(edge).rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.select(*keys, "_block", *[F.last(f"_e{i}", ignorenulls=True).over(before).alias(f"_c{i}") for i in range(len(cols))])
        out = _chain(out, keys, carry).withColumns({f"_f{i}": F.coalesce(F.col(f"_f{i}"), F.col(f"_c{i}")) for i in range(len(cols))})
    filled = dict(zip(cols, range(len(cols))))
    return out.select(*[F.col(f"_f{filled[c]}").alias(c) if c in filled else col(c) for c in df.columns])
