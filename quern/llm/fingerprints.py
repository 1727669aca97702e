"""Homomorphic multiset fingerprints: every paragraph has a wide vector, a text has their sum modulo powers of two.

The first lanes hold full hashes (sha-256) of the paragraphs, modulo 2^56: equal multisets of paragraphs have equal
sums, whatever their order. The other lanes hold, modulo 2^24, signs drawn from the hash (md5) of each sentence of
the paragraph: their products estimate how much two texts share. Paragraphs are put in or taken out by adding or
subtracting their vectors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.core import col, materialize
from quern.llm.batches import bind, without

WIDE, SIGNS = 4, 48
WIDE_MOD, SIGN_MOD = 1 << 56, 1 << 24


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def lanes(text: Column) -> Column:
    """The vector of a text: 4 sums modulo 2^56, then 48 modulo 2^24. A null, empty or blank text has zeros.

    Paragraphs are the lines that hold more than spaces, sentences their non-blank parts between `.`, `!` and `?`.
    """
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda p: F.trim(p) != "")
    parts = F.filter(F.transform(F.split(body, "[.!?\n]"), lambda s: F.trim(s)), lambda s: s != "")
    wide = bind(
        F.transform(lines, lambda p: F.sha2(p, 256)),
        lambda hs: F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), lambda k: F.aggregate(hs, F.lit(0).cast("long"), lambda a, h: (a + _number(F.substring(h, k * 14 + 1, 14))).bitwiseAND(WIDE_MOD - 1))),
    )
    signs = bind(
        F.transform(parts, lambda s: _number(F.substring(F.md5(s), 1, 12))),
        lambda hs: F.transform(
            F.sequence(F.lit(0), F.lit(SIGNS - 1)),
            lambda k: (2 * F.aggregate(hs, F.lit(0).cast("long"), lambda a, h: a + F.call_function("shiftright", h, k).bitwiseAND(1)) - F.size(hs)).bitwiseAND(SIGN_MOD - 1),
        ),
    )
    return F.concat(wide, signs)


def modulus(i: Column) -> Column:
    return F.when(i < WIDE, F.lit(WIDE_MOD)).otherwise(F.lit(SIGN_MOD))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Vector after putting in (`sign` 1) or taking out (-1) the paragraphs of `b`."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p, i: (p["a"] + sign * p["b"]).bitwiseAND(modulus(i) - 1))


def as_text(vector: Column) -> Column:
    """Lowercase hexadecimal digits: 14 for each wide lane, 6 for each sign lane."""
    return F.array_join(F.transform(vector, lambda v, i: F.lower(F.lpad(F.hex(v), F.when(i < WIDE, 14).otherwise(6), "0"))), "")


def _signed(vector: Column) -> Column:
    return F.transform(F.slice(vector, WIDE + 1, SIGNS), lambda v: F.when(v >= SIGN_MOD // 2, v - SIGN_MOD).otherwise(v))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common sentences (Dice), 0 to 1; equal vectors give 1, also those of two blank texts."""
    both = bind(F.struct(_signed(a).alias("x"), _signed(b).alias("y")), lambda s: F.struct(_dot(s["x"], s["y"]).alias("xy"), (_dot(s["x"], s["x"]) + _dot(s["y"], s["y"])).alias("sum")))
    estimate = bind(both, lambda v: F.when(v["sum"] == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * v["xy"] / v["sum"]))))
    return F.when(a == b, F.lit(1.0)).otherwise(estimate)


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the vector of every whole text under `name`, which replaces an input column of that name."""
    return without(docs, [name]).select("*", lanes(col(text).cast("string")).alias(name)) if name.lower() != text.lower() else docs.withColumn(name, lanes(col(text).cast("string")))


def successors(ids: DataFrame, key: str, rows_per_block: int = 50_000) -> DataFrame:
    """(key, next_key) in ascending order, nulls last; the last key is followed by the first.

    Distinct keys are range-partitioned and stored, so each partition is a block of neighbours; only the first key
    of each block travels to the block before.
    """
    distinct = ids.select(col(key).alias("k")).distinct()
    blocks = max(1, -(-distinct.count() // rows_per_block))
    order = F.col("k").asc_nulls_last()
    held = materialize(distinct.repartitionByRange(blocks, order).select("k", F.spark_partition_id().alias("block")), "order")
    inner = held.select("k", "block", F.lead(F.struct("k")).over(Window.partitionBy("block").orderBy(order)).alias("next"))
    heads = held.groupBy("block").agg(F.min(F.struct(F.col("k").isNull(), F.col("k"))).alias("head")).select("block", F.struct(F.col("head.k").alias("k")).alias("head"))
    by = Window.orderBy("block")  # one row per block
    heads = heads.select("block", F.coalesce(F.lead("head").over(by), F.first("head").over(by)).alias("after"))
    return inner.join(heads, "block").select(F.col("k").alias(key), F.coalesce("next", "after")["k"].alias(f"next_{key}"))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, next_text, next_lanes): next_text is as much of the next document's text as half of this one has.

    Next is by ascending key; rows that share a key share their next document, and of rows that share the next key
    the smallest text is taken. Texts are dealt by key once; starts of texts then travel to the key before.
    """
    name = F.coalesce(F.concat(F.lit("="), col(key).cast("string")), F.lit("-"))  # a null key is a key, too
    rows = docs.select(name.alias("at"), F.coalesce(col(text).cast("string"), F.lit("")).alias("t"))
    follow = successors(docs.select(col(key).alias("k")), "k")
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    need = rows.groupBy("at").agg((F.max(F.length("t")) / 2).cast("int").alias("need"))
    links = materialize(follow.select("k", named("k").alias("at"), named("next_k").alias("next_at")).join(need, "at"), "links")
    # the first row of each key, found by lag: a rank filter would cut the rows before the shuffle, which then
    # could not be shared with the other side of the join
    nth = rows.select("at", "t", F.lag(F.lit(1)).over(Window.partitionBy("at").orderBy("t")).alias("before"))
    starts = nth.where("before is null").join(links.select(F.col("next_at").alias("at"), F.col("at").alias("to"), "need"), "at")
    starts = starts.select(F.col("to").alias("at"), F.expr("substring(t, 1, need)").alias("start"), lanes(F.col("t")).alias("next_lanes"))
    out = rows.join(starts, "at").join(links.select("at", "k"), "at")
    return out.select(F.col("k").alias(key), F.col("t").alias(text), F.expr("substring(start, 1, cast(length(t) div 2 as int))").alias("next_text"), "next_lanes")


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, edited_text, next_lanes): the second half of each text replaced by the next document's start."""
    n = F.length(text)
    keep = F.expr(f"substring(`{text}`, 1, cast(length(`{text}`) - length(`{text}`) div 2 as int))")
    return with_next(docs, key, text).select(key, text, n.cast("long").alias("n_chars"), F.concat(keep, F.col("next_text")).alias("edited_text"), "next_lanes")


def sql_lanes(text: str) -> str:
    """The vector of a text in DuckDB's SQL."""
    lines = f"[p for p in string_split({text}, chr(10)) if trim(p) <> '']"
    parts = f"[trim(s) for s in string_split_regex({text}, '[.!?\n]') if trim(s) <> '']"
    wide = ", ".join(f"coalesce(list_sum([('0x' || substr(h, {14 * k + 1}, 14))::BIGINT for h in shas]), 0) % {WIDE_MOD}" for k in range(WIDE))
    signs = f"[((2 * coalesce(list_sum([(h >> k) & 1 for h in hs]), 0) - len(hs))::BIGINT & {SIGN_MOD - 1}) for k in range({SIGNS})]"
    return f"(select list_concat([{wide}]::BIGINT[], {signs}) from (select [('0x' || substr(md5(x), 1, 12))::BIGINT for x in {parts}] as hs, [sha256(y) for y in {lines}] as shas))"


def sql_text(vector: str) -> str:
    wide = " || ".join(f"lpad(lower(to_hex({vector}[{i + 1}])), 14, '0')" for i in range(WIDE))
    return f"{wide} || array_to_string([lpad(lower(to_hex(v)), 6, '0') for v in {vector}[{WIDE + 1}:]], '')"


def sql_likeness(a: str, b: str) -> str:
    signed = lambda v: f"[if(v >= {SIGN_MOD // 2}, v - {SIGN_MOD}, v) for v in {v}[{WIDE + 1}:]]"
    dot = lambda x, y: f"list_sum([z[1] * z[2] for z in list_zip({x}, {y})])::BIGINT"
    x, y = signed(a), signed(b)
    norm = f"({dot(x, x)} + {dot(y, y)})"
    return f"case when {a} = {b} then 1.0::DOUBLE when {norm} = 0 then 0.0::DOUBLE else least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2.0::DOUBLE * {dot(x, y)} / {norm})) end"
