"""Mixing sources to target sizes by Pareto order sampling.

Each source has a target size. Every document gets as many whole copies as fit into the target for the whole source;
the rest is a sample of fixed size without replacement. Its inclusion probabilities are in proportion to relative odds,
at most 1, and such that the expected size is the rest. Documents of probability 1 come first, the others are ranked
by random odds over inclusion odds, and all are taken in that order until the rest is filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.core import col, materialize
from quern.llm.batches import without

DIGITS = 50  # binary digits of the rank
LEVELS = (38, 26)  # digits cut off in the two histograms


def rank_key(key: Column, chance: Column, seed: int = 42) -> Column:
    """Whole number that orders documents like u / (1 - u) over p / (1 - p), p their inclusion probability.

    The random number u comes from the md5 of the document's key, so reruns agree. Smaller ranks are taken first;
    certain documents have rank 0.
    """
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"|{seed}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)
    q = F.try_divide(u / (F.lit(1.0) - u), F.try_divide(chance, F.lit(1.0) - chance))
    last = F.lit((1 << DIGITS) - 1)
    return F.when(chance >= 1, F.lit(0)).otherwise(F.coalesce(F.floor(q / (q + 1.0) * float(1 << DIGITS)), last)).cast("long")


def targets(sizes: DataFrame, weights: list[int], factor: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from one row per source with its `source_size`.

    Sources in code point order (null last) have the weights in turn. They share `factor` times the whole size; none
    gets more than `most` times its own, and what it cannot use is shared by the others by weight. The level at
    which this ends is read off the sources in the order in which they fill up.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((nth - 1) % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    fill = Window.orderBy("own", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = rows.withColumn("own", F.col("cap") / F.col("w")).select(
        "*",
        F.row_number().over(fill).alias("k"),
        (F.sum("source_size").over(everything) * float(factor)).alias("all"),
        F.sum("cap").over(fill).alias("capped"),
        F.sum("w").over(fill).alias("closed"),
        F.sum("w").over(everything).alias("weight"),
        F.lead("own").over(fill).alias("next"),
    )
    level = F.when(F.col("weight") > F.col("closed"), (F.col("all") - F.col("capped")) / (F.col("weight") - F.col("closed")))
    even = F.col("all") / F.col("weight")  # nothing is capped
    rows = rows.withColumn("level", level)
    after = F.min(F.when(F.col("level") <= F.col("next"), F.struct("k", "level"))).over(everything)["level"]
    found = F.when(even <= F.min("own").over(everything), even).otherwise(F.coalesce(after, F.lit(float("inf"))))
    return rows.select("source", "source_size", F.least("cap", found * F.col("w")).alias("target"))


def _limit(rows: DataFrame, bins: Column, names: tuple[str, str]) -> DataFrame:
    """Per source the first bin in which the running size passes the rest, and the size before it."""
    held = rows.groupBy("source", bins.alias("bin")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bin")) + F.col("before")
    over = held.select("source", "bin", "rest", upto.alias("upto"), (upto - F.col("n")).alias("start")).where(F.col("upto") > F.col("rest"))
    found = over.groupBy("source").agg(F.min(F.struct("bin", "start")).alias("m"))
    return found.select(F.col("source").alias("_s"), F.col("m.bin").alias(names[0]), F.col("m.start").alias(names[1]))


def _match(rows: DataFrame, table: DataFrame, how: str = "left") -> DataFrame:
    return rows.join(table, rows["source"].eqNullSafe(table["_s"]), how).drop("_s")


def _order(key: str) -> Column:
    """What orders documents within a source: rank, then key (null last), then size."""
    return F.struct(F.col("rank").alias("r"), F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("size").alias("n"))


def copies(goal: DataFrame) -> DataFrame:
    """(_s, source_size, target, whole, rest) per source: whole copies of every document, and what is left to sample."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    base = goal.select(F.col("source").alias("_s"), "source_size", "target", whole.cast("long").alias("whole"))
    return base.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))


def inclusion(sized: DataFrame, base: DataFrame) -> DataFrame:
    """(_s, factor) per source: sum over documents of min(1, factor * odds) * size is the rest.

    Relative odds have few different values. From the largest on, the documents of one value after the other are
    certain, until the factor that fills what is then left of the rest makes no further one certain.
    """
    held = _match(sized.select("source", "size", "odds"), base.select("_s", "rest"), "inner")
    steps = held.groupBy("source", "odds").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    larger = Window.partitionBy("source").orderBy(F.desc("odds")).rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy("source").orderBy("odds").rowsBetween(Window.unboundedPreceding, 0)
    certain = F.coalesce(F.sum("n").over(larger), F.lit(0))
    factor = F.try_divide(F.col("rest") - certain, F.sum(F.col("odds") * F.col("n")).over(smaller))
    found = steps.select("source", "odds", factor.alias("factor")).where(F.col("factor") * F.col("odds") <= 1)
    return found.groupBy(F.col("source").alias("_s")).agg(F.max_by("factor", "odds").alias("factor"))


def plan(sized: DataFrame, base: DataFrame) -> DataFrame:
    """Per source: whole copies, the rest, and where the sample ends. `sized` has source, size, rank, key (stored).

    The end is found by two histograms of the rank (4,096 bins each per source, summed in the map tasks); the rows of
    the last bin, about one in 2^24 of a source and rows of equal rank, are then taken in order while that brings the
    sum nearer to the rest.
    """
    rows = _match(sized, base.select("_s", "rest"), "inner").withColumn("before", F.lit(0).cast("long"))
    one = _limit(rows, F.shiftright("rank", LEVELS[0]), ("bin1", "start1"))
    inside = _match(rows.drop("before"), one, "inner").where(F.shiftright("rank", LEVELS[0]) == F.col("bin1")).withColumnRenamed("start1", "before")
    two = _limit(inside, F.shiftright("rank", LEVELS[1]), ("bin2", "start2"))
    edge = _match(inside.drop("before", "bin1"), two, "inner").where(F.shiftright("rank", LEVELS[1]) == F.col("bin2"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)) + F.col("start2")
    taken = edge.withColumn("order", _order("key")).withColumn("upto", upto).where(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"))
    last = taken.groupBy(F.col("source").alias("_s")).agg(F.max("order").alias("last"))
    out = base
    for more in (two.select("_s", "bin2"), last):
        out = out.join(more.withColumnRenamed("_s", "_o"), F.col("_s").eqNullSafe(F.col("_o")), "left").drop("_o")
    return out


def choose(rows: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """Adds source_size, target and `copies` to rows with source, size, rank and key."""
    held = _match(rows, ends)
    bin2 = F.shiftright("rank", LEVELS[1])
    sampled = F.col("bin2").isNull() | (bin2 < F.col("bin2")) | ((bin2 == F.col("bin2")) & F.coalesce(_order(key) <= F.col("last"), F.lit(False)))
    more = (sampled & (F.col("rest") > 0)).cast("long")
    return held.withColumn("copies", F.col("whole") + more).drop("whole", "rest", "bin2", "last")


def relative_odds(size: Column) -> Column:
    """Relative inclusion odds of a document: the binary digits of its size, so longer documents come sooner."""
    return F.length(F.bin(size)).cast("double")


def mix(docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), factor: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """Adds `size`, `source_size`, `target`, `copies` to every row; `copies` is how often the mix repeats it.

    Null sources are a source of their own, null sizes count as 0, null keys share one random number (such rows of
    one source are taken or left in order of size). Rows that equal the last taken one in key and size are taken with
    it. Input columns with the new names are replaced.
    """
    new = ["size", "source_size", "target", "copies"]
    kept = [c for c in without(docs, [*new, "_key", "rank", "whole", "rest", "odds", "factor"]).columns if c.lower() != "source"]
    n = F.coalesce(size.cast("long"), F.lit(0).cast("long"))
    rows = docs.select(*[col(c) for c in kept], col(source).cast("string").alias("source"), n.alias("size"), col(key).alias("_key"))
    sized = materialize(rows.select("source", "size", relative_odds(F.col("size")).alias("odds"), F.col("_key").alias("key")), "sizes")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), factor, most)
    base = materialize(copies(goal), "mix")
    factors = materialize(inclusion(sized, base), "mix")
    rank = lambda k: rank_key(F.col(k), F.least(F.lit(1.0), F.col("factor") * F.col("odds")), seed).alias("rank")
    ends = materialize(plan(_match(sized, factors).select("source", "size", "key", rank("key")), base), "mix")
    held = _match(rows.withColumn("odds", relative_odds(F.col("size"))), factors)
    return choose(held.select(*rows.columns, rank("_key")), ends, "_key").drop("_key", "rank")


def repeat(mixed: DataFrame) -> DataFrame:
    """One row per copy; documents without copies go."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_copy", "copies")
