"""Sorting, top-k, set operations and lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.core import attach, col, explode_rows, one_row
from quern.operators.validate import fingerprint
from quern.operators.windows import fold_of


def sort_rows(df: DataFrame, by: Sequence[str], descending: bool = False) -> DataFrame:
    return df.orderBy(*[col(c).desc() if descending else col(c).asc() for c in by])


def top_rows(df: DataFrame, measure: str, tie: str, k: int) -> DataFrame:
    """k largest rows; each task keeps k, the driver never sees more."""
    return df.orderBy(col(measure).desc(), col(tie)).limit(k)


def top_groups(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), key).limit(k)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """k best rows per group; Spark cuts each group to k in every map task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(out, rank).where(F.col(out) <= k)


def page(df: DataFrame, order: Sequence[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows after `offset` in order; limit None or 0 means all the rest."""
    out = df.orderBy(*[col(c) for c in order]).offset(offset)
    return out.limit(limit) if limit else out


def concat_tables(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def shared_rows(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of `left` whose fingerprint occurs in `right`."""
    return _by_fingerprint(left, right, columns, "left_semi")


def unique_rows(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of `left` whose fingerprint does not occur in `right`."""
    return _by_fingerprint(left, right, columns, "left_anti")


def _by_fingerprint(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    marks = right.select(fingerprint(right, columns).alias("_h")).distinct()
    return left.withColumn("_h", fingerprint(left, columns)).join(marks, "_h", how).drop("_h")


def new_columns(before: DataFrame, after: DataFrame) -> list[str]:
    known = set(before.columns)
    return [c for c in after.columns if c not in known]


def first_appearances(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Distinct values per key with the order value of their first appearance."""
    return df.groupBy(*keys, value).agg(F.min(F.struct(*[col(c) for c in order])).alias("first_at"))


def lookup(df: DataFrame, reference: DataFrame, key: str, value: str, out: str, default=None) -> DataFrame:
    """Left lookup of one value by key; unmatched rows get missing (or a default)."""
    pairs = reference.select(col(key), col(value).alias(out)).dropDuplicates([key])
    found = attach(df, pairs, [key])
    return found if default is None else found.withColumn(out, F.coalesce(F.col(out), F.lit(default)))


def smoothed_means(df: DataFrame, key: str, target: str, alpha: float, overall: float) -> DataFrame:
    n, total = F.count(col(target)), F.sum(col(target))
    return df.groupBy(key).agg(((total + F.lit(alpha * overall)) / (n + alpha)).alias("_encoded"))


def target_encode(df: DataFrame, key: str, target: str, alpha: float = 5.0) -> DataFrame:
    """Smoothed target mean per category: (n·mean + α·overall) / (n + α)."""
    overall = one_row(df, F.avg(col(target)))[0]
    return attach(df, smoothed_means(df, key, target, alpha, overall), [key]).withColumnRenamed("_encoded", f"{key}_target_enc")


def target_encode_by_fold(df: DataFrame, key: str, target: str, row_id: str, alpha: float = 5.0, folds: int = 5) -> DataFrame:
    """Out-of-fold smoothed target mean: each fold uses totals minus its own; unseen categories
    get the overall mean. One aggregate by (key, fold), summed again by key."""
    overall = one_row(df, F.avg(col(target)))[0]
    marked = df.withColumn("fold", fold_of(col(row_id), folds=folds))
    own = marked.groupBy(key, "fold").agg(F.count(col(target)).alias("_n"), F.sum(col(target)).alias("_s"))
    whole = own.groupBy(key).agg(F.sum("_n").alias("_all_n"), F.sum("_s").alias("_all_s"))
    other = own.join(whole, key).select(
        key,
        "fold",
        F.when(F.col("_all_n") > F.col("_n"), (F.col("_all_s") - F.col("_s") + F.lit(alpha * overall)) / (F.col("_all_n") - F.col("_n") + alpha)).alias("_encoded"),
    )
    return attach(marked, other, [key, "fold"]).withColumn(f"{key}_target_enc", F.coalesce("_encoded", F.lit(overall))).drop("_encoded")


def match_phrases(df: DataFrame, text: str, phrases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole-word occurrences of the phrases of a gazetteer table in a text column, one row per text and phrase.

    The distinct words of a text are joined with the first words of the phrases, so only phrases that may begin in a
    text are looked for in it, however long they are. Phrases are lower case and match letter by letter, punctuation
    included; a word character may neither precede nor follow. Phrases without any word are looked for in every text.
    """
    known = phrases.select("phrase").where("phrase <> ''").distinct().withColumn("_first", F.regexp_extract("phrase", r"(?U)\w+", 0))
    low = F.lower(col(text))
    words = F.array_distinct(F.array_append(F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0)), F.lit("")))
    begun = explode_rows(df, keys, words, "_first").join(known, "_first").select(*[col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "phrase")
    # Dealt by text first: the join may run in the few tasks of a short list of phrases, which could not hold all pairs.
    begun = begun.repartition(*[F.col(f"_key{i}") for i in range(len(keys))]).distinct()
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    pattern = F.concat(F.lit(r"(?U)(?<!\w)"), F.regexp_replace("phrase", r"(?U)([^\w\s])", r"\\$1"), F.lit(r"(?!\w)"))
    near = df.select(*keys, low.alias("_text")).join(begun, same)
    return near.where(F.contains("_text", "phrase") & F.regexp_like("_text", pattern)).select(*keys, "phrase")
