"""Collapse of logged conversation snapshots, then rendering.

A log often holds every state of a growing conversation. Rolling hashes of the turns name each prefix; a
conversation whose whole equals a proper prefix of another is dropped by an anti-join, exact repeats leave one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.core import col, materialize
from quern.operators import ordered

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _named(c: Column) -> Column:
    """Text that tells a null from every value."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def rolling_prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int | None = None) -> DataFrame:
    """(conv, k, r1, r2): two exact sums of 64-bit hashes of the first k turns and their places.

    Turns are ordered by number (null first), then role and text. Long tables are cut into blocks by turn, so one
    endless conversation does not end in one task.
    """
    rows = turns.select(col(conv).alias("conv"), col(turn).cast("long").alias("turn"), _named(col(role)).alias("role"), _named(col(text)).alias("text"))
    rows = rows.select("conv", "turn", *[F.xxhash64(F.lit(s), "role", "text").alias(f"h{s}") for s in (1, 2)], "role", F.xxhash64("text").alias("tie"))
    placed = materialize(ordered.position(materialize(rows, "turns"), ["conv"], ["turn", "role", "tie", "h1"], out="k", block_rows=block_rows).select("conv", "k", "h1", "h2"), "turns")
    place = {f"r{s}": F.xxhash64(f"h{s}", "k").cast("decimal(20,0)") for s in (1, 2)}
    return ordered.running_sum(placed, ["conv"], ["k"], place, block_rows=block_rows).select("conv", "k", "r1", "r2")


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv, n_turns, copies): conversations that no longer one extends; of equal ones the smallest id, with their number."""
    key = ["k", "r1", "r2"]
    ends = prefixes.groupBy("conv").agg(F.max(F.struct(*key)).alias("end")).select("conv", "end.*")
    whole = ends.groupBy(*key).agg(F.min(F.struct(F.col("conv").isNull().alias("none"), "conv")).alias("first"), F.count("*").alias("copies"))
    seen = prefixes.groupBy(*key).agg(F.count("*").alias("seen"))
    longer = seen.join(whole.select(*key, "copies"), key, "left").where(F.col("seen") > F.coalesce("copies", F.lit(0)))
    return whole.join(longer.select(*key), key, "left_anti").select(F.col("first.conv").alias("conv"), F.col("k").alias("n_turns"), "copies")


def render(turns: DataFrame, kept: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, copies, rendered): one text per kept conversation, each turn between its marks.

    A null role reads `unknown`, a null text is empty. A conversation is one value, so it must fit one row.
    """
    part = F.concat(F.lit(OPEN), F.coalesce(col(role), F.lit("unknown")), F.lit("\n"), F.coalesce(col(text), F.lit("")), F.lit(CLOSE + "\n"))
    rows = turns.select(_named(col(conv)).alias("at"), F.struct(col(turn).cast("long").alias("turn"), _named(col(role)).alias("role"), F.xxhash64(_named(col(text))).alias("tie"), part.alias("part")).alias("t"))
    keep = kept.select(F.col("conv").alias(conv), _named(F.col("conv")).alias("at"), "n_turns", "copies")
    parts = rows.join(keep.select("at"), "at", "left_semi").groupBy("at").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda x: x["part"]), "").alias("rendered"))
    return keep.join(parts, "at").drop("at")


def collapse(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Maximal conversations of a log of turns, rendered. Null ids are one conversation; an empty table gives none."""
    kept = materialize(maximal(materialize(rolling_prefixes(turns, conv, turn, role, text), "prefixes")), "kept")
    return render(turns, kept, conv, turn, role, text)
