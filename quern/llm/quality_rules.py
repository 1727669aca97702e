"""Quality rules: base limits, then robust multivariate outliers per language and source.

Each document has a vector of five transformed statistics: mean word length, share of symbols, of repeated lines,
of words in repeated windows, and of capitals. Per group a minimum-covariance-determinant estimate is found: from
several starts, concentration steps (the rows nearest to the current centre give the next mean and covariance) go on
until the determinant no longer falls, and the start with the smallest one wins. Everything is DataFrame expressions;
statistics are whole numbers (ten-thousandths) and their sums exact, so the estimate does not depend on the order of
rows.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.core import col, materialize
from quern.llm.batches import bind, without, words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
DIMS = range(5)
PAIRS = list(combinations_with_replacement(DIMS, 2))
SCALE = 10_000
SALTS = 32  # parts of a hot group while rows meet its estimate
# Least spread of each statistic on its log scale, so that a group without any variation rejects no small change.
FLOORS = [0.15, 0.20, 0.20, 0.20, 0.20]
_VECTOR = [f"_y{j}" for j in DIMS]
_GROUP = "_group"
#: Shares of a group's rows, nearest to the medians, that give the starts; 0 is the medians with spreads from quartiles.
STARTS = (0.0, 0.25, 0.5, 1.0)
_KEY = ["_pool", "_start"]


def _repeat_words(hashes: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more, from the windows' hashes."""

    def covered(v):
        ranked = F.sort_array(F.transform(v, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bind(ranked, lambda s: bind(F.sort_array(F.transform(F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))), lambda e: e["i"])), spread))

    def spread(p):
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(8), F.coalesce(F.get(p, j + 1) - x, F.lit(8)))), F.lit(0), lambda a, x: a + x)

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))


def measure(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds the base statistics, `base_failed`, the transformed vector and the group key to every row.

    A null text has no words. Null languages and sources are groups of their own. Input columns with the new
    names are replaced.
    """
    new = [*MEASURES, "base_failed", *_VECTOR, _GROUP]
    kept = [col(c) for c in without(docs, [*new, "_text", "_w", "_h", "_v"]).columns]
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    key = F.concat(F.coalesce(F.concat(F.lit("="), col(lang).cast("string")), F.lit("-")), F.lit("\x1f"), F.coalesce(F.concat(F.lit("="), col(source).cast("string")), F.lit("-")))
    a = docs.select(*kept, body.alias("_text"), words(body).alias("_w"), key.alias(_GROUP))
    b = a.select("*", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"), F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    windows = F.when(F.size("_h") >= 8, F.transform(F.sequence(F.lit(0), F.size("_h") - 8), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(8)]))).otherwise(F.array().cast("array<long>"))
    c = b.select("*", windows.alias("_v"))
    n = F.size("_w").cast("long")
    stats = [
        n,
        F.aggregate("_w", F.lit(0), lambda x, w: x + F.length(w)).cast("long"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        _repeat_words(F.col("_v")).cast("long"),
    ]
    d = c.select(*kept, _GROUP, *[s.alias(m) for s, m in zip(stats, MEASURES, strict=True)], F.size("_lines").alias("_n_lines"), F.regexp_count("_text", F.lit(r"\p{Lu}")).alias("_capitals"), F.rand(0).alias("_stop"))
    chars, count = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    vector = [
        F.log(chars / count),
        F.log(F.lit(0.02) + F.col("n_symbols") / chars),
        F.log(F.lit(0.25) + F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1))),
        F.log(F.lit(0.25) + F.col("n_repeat_words") / count),
        F.log(F.lit(0.05) + F.col("_capitals") / chars),
    ]
    # The last term is never true. Its random number keeps Spark from pushing filters on the verdict below these
    # projections, where it would compute their arrays once more, inside lambdas.
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")) | (F.col("_stop") < 0)
    return d.select(*kept, *MEASURES, failed.alias("base_failed"), *[F.round(x * SCALE).cast("long").alias(y) for x, y in zip(vector, _VECTOR, strict=True)], _GROUP)


def _pooled(rows: DataFrame, least: int) -> DataFrame:
    """Estimation group of each group key: itself, else its language's small groups, else all that are left, else none."""
    n = rows.groupBy(_GROUP).agg(F.count("*").alias("n"))
    n = n.withColumn("a", F.when(F.col("n") >= least, F.col(_GROUP))).withColumn("b", F.substring_index(_GROUP, "\x1f", 1))
    by_lang = n.where("a is null").groupBy("b").agg(F.sum("n").alias("nb"))
    left = by_lang.where(F.col("nb") < least).agg(F.sum("nb").alias("nc"))
    n = n.join(by_lang, "b", "left").join(left, F.lit(True), "left")
    pool = F.when(F.col("nb") >= least, F.col("b")).when(F.col("nc") >= least, F.lit("*"))
    return n.select(_GROUP, F.coalesce("a", pool).alias("_pool"))


def _chi2_share(x: float, p: int) -> float:
    """Probability that a chi-square value with p degrees of freedom is at most x (series of the incomplete gamma function)."""
    a, y = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= y / k
        total += term
    return min(1.0, total * math.exp(a * math.log(y) - y - math.lgamma(a))) if x > 0 else 0.0


def chi2_quantile(share: float, p: int) -> float:
    low, high = 0.0, 1.0
    while _chi2_share(high, p) < share and high < 1e4:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_share(mid, p) < share else (low, mid)
    return (low + high) / 2


def distance(prefix: str = "_") -> Column:
    """Squared Mahalanobis distance of a row's vector from its group's estimate (missing without an estimate)."""
    dx = [F.col(f"_y{j}") / F.lit(float(SCALE)) - F.col(f"{prefix}m{j}") for j in DIMS]
    return reduce(lambda a, b: a + b, [F.col(f"{prefix}a{i}{j}") * dx[i] * dx[j] * (1.0 if i == j else 2.0) for i, j in PAIRS])


def _precision(est: DataFrame, factor: Column) -> DataFrame:
    """Inverse of each covariance and the log of its determinant: spread floors on the diagonal, then one sweep per
    dimension, whose pivots multiply to the determinant."""
    at = lambda i, j: F.col(f"_c{min(i, j)}{max(i, j)}")
    keep = [*_KEY, *[f"_m{j}" for j in DIMS]]
    start = {(i, j): at(i, j) * factor for i, j in PAIRS}
    start |= {(j, j): F.greatest(start[j, j], F.lit(FLOORS[j] ** 2)) for j in DIMS}
    out = est.select(*keep, *[e.alias(f"_c{i}{j}") for (i, j), e in start.items()], F.lit(0.0).alias("_det"))
    for k in DIMS:
        swept = {}
        for i, j in PAIRS:
            if i == k and j == k:
                swept[i, j] = F.lit(-1.0) / at(k, k)
            elif k in (i, j):
                swept[i, j] = at(i, j) / at(k, k)
            else:
                swept[i, j] = at(i, j) - at(i, k) * at(j, k) / at(k, k)
        out = out.select(*keep, *[e.alias(f"_c{i}{j}") for (i, j), e in swept.items()], (F.col("_det") + F.log(F.abs(at(k, k)))).alias("_det"))
    return out.select(*keep, *[(-at(i, j)).alias(f"_a{i}{j}") for i, j in PAIRS], "_det")


def _start(rows: DataFrame) -> DataFrame:
    """First estimate: medians, and spreads from quartiles, read off a histogram of 0.02 steps per dimension.

    Its determinant counts as infinite.
    """
    step = SCALE // 50
    long = rows.select("_pool", F.posexplode(F.array(*[F.floor(F.col(y) / step) for y in _VECTOR])).alias("j", "bin"))
    bins = long.groupBy("_pool", "j", "bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy("_pool", "j")
    cum = bins.select("*", F.sum("n").over(by.orderBy("bin")).alias("upto"), F.sum("n").over(by).alias("all"))
    value = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, (F.col("bin") + 0.5) * step / SCALE))
    quart = cum.groupBy("_pool", "j").agg(value(0.25).alias("q1"), value(0.5).alias("q2"), value(0.75).alias("q3"))
    one = lambda j, e: F.max(F.when(F.col("j") == j, e))
    spread = lambda j: F.pow(F.greatest((one(j, F.col("q3")) - one(j, F.col("q1"))) / 1.349, F.lit(FLOORS[j])), F.lit(2.0))
    found = quart.groupBy("_pool").agg(*[one(j, F.col("q2")).alias(f"_m{j}") for j in DIMS], *[(F.lit(1.0) / spread(j) if i == j else F.lit(0.0)).alias(f"_a{i}{j}") for i, j in PAIRS])
    return found.select("_pool", F.lit(0).alias("_start"), *found.columns[1:], F.lit(float("inf")).alias("_det"))


def _concentrate(rows: DataFrame, est: DataFrame, shares: dict[int, float]) -> DataFrame:
    """Mean and covariance of the rows of each group that are nearest to its estimate, for several shares of them.

    `shares` maps the number of the new start to the share; with one number alone every estimate keeps its own. Rows
    are counted and summed per step of the log distance, so a hot group sends a few sums per task; the step that
    reaches the share counts whole.
    """
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    copies = est.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    near = salted.join(copies, ["_pool", "_salt"]).select(*_KEY, *_VECTOR, F.floor(F.log1p(F.greatest(distance(), F.lit(0.0))) * 32).alias("bin"))
    exact = lambda e: F.sum(e.cast("decimal(20,0)"))
    sums = near.groupBy(*_KEY, "bin").agg(F.count("*").alias("n"), *[exact(F.col(f"_y{j}")).alias(f"s{j}") for j in DIMS], *[exact(F.col(f"_y{i}") * F.col(f"_y{j}")).alias(f"p{i}{j}") for i, j in PAIRS])
    by = Window.partitionBy(*_KEY)
    below = sums.select("*", (F.sum("n").over(by.orderBy("bin")) - F.col("n")).alias("below"), F.sum("n").over(by).alias("all"))
    correct = {share: share / _chi2_share(chi2_quantile(share, len(DIMS)), len(DIMS) + 2) if share < 1 else 1.0 for share in shares.values()}
    wanted = F.inline(F.array(*[F.struct(F.lit(i).alias("_to"), F.lit(x).alias("share"), F.lit(correct[x]).alias("factor")) for i, x in shares.items()]))
    below = below.select("*", wanted)
    if len(shares) > 1:
        below = below.withColumn("_start", F.col("_to"))
    total = below.where(F.col("below") < F.col("all") * F.col("share")).groupBy(*_KEY).agg(F.sum("n").cast("double").alias("n"), F.first("factor").alias("factor"), *[F.sum(c).cast("double").alias(c) for c in sums.columns if c[0] in "sp"])
    mean = [F.col(f"s{j}") / F.col("n") / SCALE for j in DIMS]
    cov = {(i, j): F.col(f"p{i}{j}") / F.col("n") / SCALE**2 - mean[i] * mean[j] for i, j in PAIRS}
    found = total.select(*_KEY, *[m.alias(f"_m{j}") for j, m in enumerate(mean)], *[e.alias(f"_c{i}{j}") for (i, j), e in cov.items()], "factor")
    return _precision(found, F.col("factor"))


def fit(measured: DataFrame, share: float = 0.75, steps: int = 30, least: int = 50) -> DataFrame:
    """Estimates per group key, from all measured rows that pass the base rules.

    `share` of the rows carry the estimate (the robust subset). Each of STARTS takes concentration steps until the
    determinant of the covariance (with the spread floors) falls by less than a millionth, `steps` at most; the
    smallest determinant wins, the earlier start among equal ones. Groups of fewer than `least` rows are pooled by
    language, then together; still fewer have no estimate. Reads `measured` several times: give a stored table. One
    small table is written per step.
    """
    good = measured.where(~F.col("base_failed")).select(_GROUP, *_VECTOR)
    pools = materialize(_pooled(good, least).where("_pool is not null"), "pools")
    rows = good.join(pools, _GROUP).drop(_GROUP)
    first = materialize(_start(rows), "mcd")
    more = _concentrate(rows, first, {i: x for i, x in enumerate(STARTS) if i}).withColumn("_det", F.lit(float("inf")))
    est = materialize(first.unionByName(more).withColumn("moving", F.lit(True)), "mcd")
    for _ in range(steps):
        step = _concentrate(rows, est.where("moving").drop("moving"), {0: share})
        after = step.select(*_KEY, F.struct(*[c for c in step.columns if c not in _KEY]).alias("new"))
        both = est.join(after, _KEY, "left")
        better = F.coalesce(F.col("new._det") < F.col("_det") - 1e-6, F.lit(False))
        est = materialize(both.select(*_KEY, *[F.when(better, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in est.columns if c not in (*_KEY, "moving")], better.alias("moving")), "mcd")
        if est.where("moving").isEmpty():
            break
    best = est.groupBy("_pool").agg(F.min(F.struct("_det", "_start")).alias("m")).select("_pool", "m._start")
    return pools.join(est.join(best, _KEY).drop("_start", "_det", "moving"), "_pool").drop("_pool")


def judge(measured: DataFrame, estimates: DataFrame, tail: float = 1e-6) -> DataFrame:
    """Adds `distance` (squared, rounded to 6 digits) and `kept`.

    A row is kept if it passes the base rules and its distance is within the chi-square limit that a normal row
    exceeds with probability `tail`, or its group has no estimate.
    """
    extra = [c for c in estimates.columns if c != _GROUP]
    out = without(measured, ["distance", "kept"]).join(estimates, _GROUP, "left")
    d = F.round(distance(), 6)
    ok = ~F.col("base_failed") & F.coalesce(d <= chi2_quantile(1 - tail, len(DIMS)), F.lit(True))
    return out.select("*", d.alias("distance"), ok.alias("kept")).drop(*extra, *_VECTOR, _GROUP)


def filter_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of `docs` that the rules keep, with their columns.

    The narrow statistics are stored for the fit; the texts are then read once more and judged where they lie.
    """
    measured = measure(docs, text, lang, source)
    estimates = materialize(fit(materialize(measured.select("base_failed", *_VECTOR, _GROUP), "measures")), "mcd")
    boxed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("_row"), col(text).alias("_t"), col(lang).alias("_l"), col(source).alias("_s"))
    judged = judge(measure(boxed, "_t", "_l", "_s"), estimates)
    return judged.where("kept").select("_row.*")
