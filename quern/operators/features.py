"""Outliers, scaling, encoding, transforms, selection, reduction and resampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import functions as MF
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.core import LEVEL_LIMIT, attach, bounded_levels, col, describe_rows, hash_unit, materialize, numeric_columns, one_row, replace_columns
from quern.operators import ordered
from quern.operators.aggs import correlations, corrected_skew
from quern.operators.quantiles import quantiles
from quern.operators.vectors import nearest

# Most bytes of levels that are sent to every executor.
LEVEL_BYTES = 4 * 1024 * 1024

# ---- outliers -------------------------------------------------------------------------


def iqr_fences(df: DataFrame, cols: Sequence[str], factor: float = 1.5) -> dict[str, tuple[float, float]]:
    found = quantiles(df, cols, [0.25, 0.75])
    return {c: (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)) for c, (q1, q3) in found.items() if q1 is not None}


def iqr_flags(df: DataFrame, cols: Sequence[str], factor: float = 1.5) -> dict[str, Column]:
    """Outlier flag per column; a missing value is no outlier."""
    return {c: F.coalesce((col(c) < a) | (col(c) > b), F.lit(False)) for c, (a, b) in iqr_fences(df, cols, factor).items()}


def mark_outliers(df: DataFrame, cols: Sequence[str], factor: float = 1.5, suffix: str = "_outlier", source: DataFrame | None = None) -> DataFrame:
    """0/1 outlier columns; the fences come from `source` when `df` is costly to compute."""
    return df.withColumns({c + suffix: f.cast("int") for c, f in iqr_flags(df if source is None else source, cols, factor).items()})


def zscore_flags(df: DataFrame, cols: Sequence[str], threshold: float = 3.0) -> dict[str, Column]:
    """|x − mean| / population std above the threshold."""
    row = one_row(df, *[f(col(c)) for c in cols for f in (F.avg, F.stddev_pop)])
    out = {}
    for i, c in enumerate(cols):
        mean, std = row[2 * i], row[2 * i + 1]
        out[c] = F.coalesce(F.abs(col(c) - mean) / std > threshold, F.lit(False)) if std else F.lit(False)
    return out


def handle_outliers(df: DataFrame, method: str = "iqr", threshold: float = 1.5, strategy: str = "clip", columns: Sequence[str] | None = None) -> DataFrame:
    """Clip to the fences, remove rows, or winsorize to the 5–95% range.

    Only columns that have outliers change; all flags and fences come from the input table.
    """
    return apply_outliers(df, fit_outliers(df, method, threshold, strategy, columns))


def fit_outliers(df: DataFrame, method: str = "iqr", threshold: float = 1.5, strategy: str = "clip", columns: Sequence[str] | None = None) -> dict:
    """The test of rows to remove, or the limits of every column that has outliers."""
    cols = list(columns or numeric_columns(df))
    flags = iqr_flags(df, cols, threshold) if method == "iqr" else zscore_flags(df, cols, threshold)
    if strategy == "remove":
        gone = F.lit(False)
        for f in flags.values():
            gone = gone | f
        return {"gone": gone}
    hits = one_row(df, *[F.max(f.cast("int")) for f in flags.values()]) if flags else []
    touched = [c for c, n in zip(flags, hits) if n]
    if not touched:
        return {"limits": {}}
    if strategy == "winsorize":
        limits = {c: tuple(q) for c, q in quantiles(df, touched, [0.05, 0.95]).items()}
    elif strategy == "clip" and method == "iqr":
        limits = iqr_fences(df, touched, threshold)
    elif strategy == "clip":
        row = one_row(df, *[f(col(c)) for c in touched for f in (F.avg, F.stddev_samp)])
        limits = {c: (row[2 * i] - threshold * row[2 * i + 1], row[2 * i] + threshold * row[2 * i + 1]) for i, c in enumerate(touched)}
    else:
        raise ValueError(f"unknown strategy '{strategy}'")
    return {"limits": limits}


def apply_outliers(df: DataFrame, fitted: dict) -> DataFrame:
    """Remove the rows or set the limits of `fit_outliers`, on its table or another."""
    if "gone" in fitted:
        return df.where(~fitted["gone"])
    limits = {c: ends for c, ends in fitted["limits"].items() if c in df.columns}
    # least/greatest skip missing values, so a missing value must be kept missing explicitly.
    return replace_columns(df, {c: F.when(col(c).isNotNull(), F.least(F.greatest(col(c).cast("double"), F.lit(a)), F.lit(b))) for c, (a, b) in limits.items()})


# ---- scaling --------------------------------------------------------------------------


def fit_scaler(df: DataFrame, cols: Sequence[str], method: str) -> dict[str, tuple[float, float]]:
    """Shift and divisor per column: `minmax`, `zscore` (sample std) or `standard` (population std)."""
    spread = {"zscore": F.stddev_samp, "standard": F.stddev_pop}
    if method == "minmax":
        row = one_row(df, *[f(col(c).cast("double")) for c in cols for f in (F.min, F.max)])
        return {c: (row[2 * i], row[2 * i + 1] - row[2 * i] if row[2 * i] is not None else None) for i, c in enumerate(cols)}
    if method not in spread:
        raise ValueError(f"unknown scaling method '{method}'")
    row = one_row(df, *[f(col(c).cast("double")) for c in cols for f in (F.avg, spread[method])])
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(cols)}


def apply_scaler(df: DataFrame, fitted: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """(x − shift) / divisor; a constant column becomes 0."""

    def scaled(c: str) -> Column:
        shift, divisor = fitted[c]
        if divisor == 0:
            return F.lit(0.0)
        return (col(c).cast("double") - F.lit(shift).cast("double")) / F.lit(divisor).cast("double")

    return replace_columns(df, {c + suffix: scaled(c) for c in fitted})


def scale(df: DataFrame, cols: Sequence[str], method: str = "standard", suffix: str = "") -> DataFrame:
    return apply_scaler(df, fit_scaler(df, cols, method), suffix)


# ---- encoding -------------------------------------------------------------------------


def one_hot(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """0/1 column per lower-cased trimmed level, named `col_value`; a missing value reads `nan`."""
    clean = {c: F.coalesce(F.lower(F.trim(col(c).cast("string"))), F.lit("nan")) for c in cols}
    base = replace_columns(df, clean)
    marks = [(col(c) == v).cast("int").alias(f"{c}_{v}") for c in cols for v in bounded_levels(base, c)]
    return base.select(*[col(c) for c in df.columns if c not in cols], *marks)


def one_hot_sparse(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """One-hot vector per row for any number of levels, and the table of (level, code).

    Levels as in `one_hot`. `<column>_code` is the place of the 1 and `<column>_onehot` a sparse vector, which the
    models take as a feature. The levels stay in a table; only their number reaches the driver.
    """
    clean = F.coalesce(F.lower(F.trim(col(column).cast("string"))), F.lit("nan"))
    rows = replace_columns(df, {column: clean})
    codes = level_codes(rows, column)
    coded = attach(rows, codes.select(F.col("level").alias(column), F.col("code").cast("long").alias(f"{column}_code")), [column])
    encoder = OneHotEncoder(inputCol=f"{column}_code", outputCol=f"{column}_onehot", dropLast=False)
    return encoder.fit(coded).transform(coded), codes


# Fixed value: name of the column that pools rare levels.
POOLED = "infrequent_sklearn"


def fit_one_hot_capped(df: DataFrame, cols: Sequence[str], drop_first: bool = False, max_categories: int | None = None) -> dict[str, list[str]]:
    """Kept levels per column in order; the cap keeps the most frequent ones and pools the rest."""
    kept = {}
    for c in cols:
        text = df.select(F.coalesce(col(c).cast("string"), F.lit("nan")).alias("v"))
        counts = text.groupBy("v").agg(F.count("*").alias("n"))
        cap = max_categories or LEVEL_LIMIT
        # One level more than the cap tells whether pooling is needed; equal counts keep the later name.
        top = [r[0] for r in counts.orderBy(F.desc("n"), F.desc("v")).limit(cap + 1).collect()]
        pooled = len(top) > cap
        if pooled and not max_categories:
            raise ValueError(f"column '{c}' has more than {cap} levels; give max_categories")
        levels = sorted(top[: cap - 1] if pooled else top) + ([POOLED] if pooled else [])
        kept[c] = levels[1:] if drop_first else levels
        if pooled:
            kept[c + "\0frequent"] = sorted(top[: cap - 1])
    return kept


def apply_one_hot_capped(df: DataFrame, fitted: dict[str, list[str]]) -> DataFrame:
    """Unseen levels are pooled where a pool exists and all zero otherwise."""
    cols = [c for c in fitted if "\0" not in c]
    marks = []
    for c in cols:
        value = F.coalesce(col(c).cast("string"), F.lit("nan"))
        frequent = fitted.get(c + "\0frequent", [])
        for level in fitted[c]:
            hit = ~value.isin(frequent) if level == POOLED and frequent else value == level
            marks.append(hit.cast("double").alias(f"{c}_{level}"))
    return df.select(*[col(c) for c in df.columns if c not in cols], *marks)


def level_codes(df: DataFrame, column: str, limit: int = LEVEL_LIMIT) -> DataFrame:
    """(level, code) with codes 0.. in sorted order, for any number of levels.

    Few levels are numbered in one place. Many are range-sorted, written with a stable row
    number per partition, and shifted by the sizes of the partitions before.
    """
    levels = df.select(col(column).cast("string").alias("level")).where("level is not null").distinct()
    if levels.limit(limit + 1).count() <= limit:
        return levels.select("level", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("level")) - 1).alias("code"))
    ranged = levels.repartitionByRange("level").sortWithinPartitions("level").withColumn("_id", F.monotonically_increasing_id())
    stored = materialize(ranged, "level-codes").withColumn("_part", F.shiftright("_id", 33))
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return stored.join(offsets, "_part").select("level", (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("code"))


def label_encode(df: DataFrame, cols: Sequence[str], missing: str = "code") -> DataFrame:
    """Replace levels by their sorted codes. A missing value is its own level `nan`
    (`missing="code"`) or -1 (`missing="negative"`)."""
    return apply_codes(df, fit_codes(df, cols, missing), missing)


def _level(c: str, missing: str) -> Column:
    text = col(c).cast("string")
    return F.coalesce(text, F.lit("nan")) if missing == "code" else text


def fit_codes(df: DataFrame, cols: Sequence[str], missing: str = "code") -> dict[str, DataFrame]:
    """Levels and codes of every column, as tables."""
    return {c: level_codes(df.select(_level(c, missing).alias(c)), c) for c in cols}


def apply_codes(df: DataFrame, fitted: dict[str, DataFrame], missing: str = "code") -> DataFrame:
    """Replace levels by fitted codes; a level that the fitted table lacks is -1."""
    out = df
    for c in [c for c in fitted if c in df.columns]:
        codes = fitted[c].select(F.col("level").alias(c), F.col("code").cast("long").alias("_code"))
        joined = attach(replace_columns(out, {c: _level(c, missing)}), codes, [c]).select(*[col(n) for n in out.columns], "_code")
        out = replace_columns(joined, {c: F.coalesce("_code", F.lit(-1))}).drop("_code")
    return out


def frequency_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count / rows per level as `<col>_freq`; missing stays missing.

    The levels are stored and measured. Up to LEVEL_LIMIT of them in LEVEL_BYTES go to the rows: dealt by a column of
    a few levels, most rows would meet in one task. More are joined like any other table.
    """
    rows = df.count()
    out = df
    for c in cols:
        if f"{c}_freq" not in out.columns:
            freq = materialize(df.where(col(c).isNotNull()).groupBy(col(c)).agg((F.count("*") / F.lit(rows)).alias(f"{c}_freq")), "levels")
            levels, size = one_row(freq, F.count("*"), F.sum(F.octet_length(col(c).cast("string"))))
            few = levels <= LEVEL_LIMIT and (size or 0) <= LEVEL_BYTES
            out = attach(out, F.broadcast(freq) if few else freq, [c])
    return out.select(*df.columns, *[f"{c}_freq" for c in cols if f"{c}_freq" not in df.columns])


# ---- constructed columns --------------------------------------------------------------


def polynomial(df: DataFrame, cols: Sequence[str], degree: int = 2, interaction_only: bool = False) -> DataFrame:
    """Powers `a^d` and products `a_x_b` in one projection; existing names are left alone."""
    valid = [c for c in cols if c in df.columns]
    if len(valid) < 2:
        return df
    new: dict[str, Column] = {}
    for i, a in enumerate(valid):
        if not interaction_only:
            new.update({f"{a}^{d}": F.pow(col(a), F.lit(d)) for d in range(2, degree + 1)})
        new.update({f"{a}_x_{b}": col(a) * col(b) for b in valid[i + 1:]})
    return replace_columns(df, {n: e for n, e in new.items() if n not in df.columns})


# Fixed value: keeps ratio denominators away from zero.
EPSILON = 1e-10


def ratios(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    new = {f"{a}_div_{b}": col(a) / (col(b) + F.lit(EPSILON)) for a, b in pairs if a in df.columns and b in df.columns}
    return replace_columns(df, new)


def bin_edges(df: DataFrame, cols: Sequence[str], bins: int, strategy: str) -> dict[str, list[float]]:
    """Inner and outer edges per column; equal neighbours are merged."""
    if strategy == "quantile":
        found = quantiles(df, cols, [i / bins for i in range(bins + 1)])
    elif strategy == "uniform":
        row = one_row(df, *[f(col(c).cast("double")) for c in cols for f in (F.min, F.max)])
        found = {c: [row[2 * i] + (row[2 * i + 1] - row[2 * i]) * j / bins for j in range(bins + 1)] for i, c in enumerate(cols) if row[2 * i] is not None}
    else:
        raise ValueError(f"unknown binning strategy '{strategy}'")
    out = {}
    for c, edges in found.items():
        if edges and edges[0] is not None:
            out[c] = [edges[0], *[e for a, e in zip(edges, edges[1:]) if e - a > 1e-8]]
    return out


def bin_columns(df: DataFrame, cols: Sequence[str], bins: int = 5, strategy: str = "quantile", encode: str = "ordinal") -> DataFrame:
    """Bin number as `<col>_binned`, or one 0/1 column `<col>_bin_<i>` per bin."""
    new = {}
    for c, edges in bin_edges(df, [c for c in cols if c in df.columns], bins, strategy).items():
        inner = edges[1:-1]
        index = F.when(col(c).isNotNull(), sum(((col(c) >= e).cast("int") for e in inner), F.lit(0)))
        if encode == "ordinal":
            new[f"{c}_binned"] = index.cast("double")
        else:
            new.update({f"{c}_bin_{i}": (index == i).cast("double") for i in range(max(1, len(edges) - 1))})
    return replace_columns(df, new)


# ---- transforms -----------------------------------------------------------------------


def skewed_columns(df: DataFrame, cols: Sequence[str], threshold: float = 1.0) -> list[str]:
    row = one_row(df, *[corrected_skew(col(c).cast("double")) for c in cols]) if cols else []
    return [c for c, s in zip(cols, row) if s is not None and abs(s) > threshold]


def log_transform(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, float]]:
    """log1p(x + shift), the shift lifting the smallest value to 1 where it is not positive."""
    shifts = fit_log(df, cols)
    return apply_log(df, shifts), shifts


def fit_log(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    low = one_row(df, *[F.min(col(c)).cast("double") for c in cols])
    return {c: (1 - m if m is not None and m <= 0 else 0.0) for c, m in zip(cols, low)}


def apply_log(df: DataFrame, shifts: dict[str, float]) -> DataFrame:
    return replace_columns(df, {c: F.log1p(col(c) + F.lit(s)) for c, s in shifts.items()})


def boxcox_lambda(df: DataFrame, column: str, shift: float, rounds: int = 5) -> float:
    """Maximum-likelihood λ by a refined grid; each round is one aggregate over the data.

    With x scaled by its geometric mean the log-likelihood is −n/2·log var(z), so only the
    variance per grid point is needed.
    """
    x = col(column).cast("double") + F.lit(shift)
    mean_log = one_row(df, F.avg(F.ln(x)))[0]
    centred = F.ln(x) - F.lit(mean_log)

    def spread(lam: float) -> Column:
        z = centred if abs(lam) < 1e-9 else F.expm1(F.lit(lam) * centred) / F.lit(lam)
        return F.var_pop(z)

    best, step = 0.0, 0.5
    for _ in range(rounds):
        grid = [best + step * i for i in range(-10, 11)]
        row = one_row(df, *[spread(g) for g in grid])
        best = min(zip(row, grid), key=lambda p: p[0] if p[0] is not None and not math.isnan(p[0]) else math.inf)[1]
        step /= 10
    return best


def boxcox_transform(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(x^λ − 1)/λ after a shift to positive values; returns (λ, shift) per column."""
    low = one_row(df, *[F.min(col(c)).cast("double") for c in cols])
    fitted = {}
    for c, m in zip(cols, low):
        shift = 1e-6 - m if m <= 0 else 0.0
        fitted[c] = (boxcox_lambda(df, c, shift), shift)

    def power(c: str) -> Column:
        lam, shift = fitted[c]
        x = F.ln(col(c).cast("double") + F.lit(shift))
        return x if abs(lam) < 1e-9 else F.expm1(F.lit(lam) * x) / F.lit(lam)

    return replace_columns(df, {c: power(c) for c in cols}), fitted


# ---- selection and reduction ----------------------------------------------------------


def select_by_variance(df: DataFrame, threshold: float = 0.01) -> tuple[DataFrame, list[str]]:
    """Numeric columns whose population variance exceeds the threshold, then all others."""
    numbers = numeric_columns(df)
    row = one_row(df, *[F.var_pop(col(c).cast("double")) for c in numbers]) if numbers else []
    kept = [c for c, v in zip(numbers, row) if v is not None and v > threshold]
    if numbers and not kept:
        return df, []
    return df.select(*[col(c) for c in kept], *[col(c) for c in df.columns if c not in numbers]), kept


def drop_correlated(df: DataFrame, threshold: float = 0.95) -> tuple[DataFrame, list[str]]:
    """Drop the later column of every pair with |r| above the threshold."""
    if len(numeric_columns(df)) < 2:
        return df, []
    pairs = correlations(df).where(F.abs("r") > threshold).select("right").distinct().collect()
    gone = [c for c in df.columns if c in {r[0] for r in pairs}]
    return df.drop(*gone), gone


def pca_columns(df: DataFrame, cols: Sequence[str] | None = None, k: int | None = None, variance_ratio: float = 0.95, prefix: str = "pca") -> tuple[DataFrame, list[float]]:
    """Principal components of centred columns (missing as 0): k given, or the fewest reaching
    the variance ratio. Signs are arbitrary. Returns (table with components, explained shares)."""
    cols = list(cols or numeric_columns(df))
    filled = [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in cols]
    means = one_row(df, *[F.avg(e) for e in filled])
    centred = df.withColumns({f"_p{i}": e - F.lit(m) for i, (e, m) in enumerate(zip(filled, means))})
    names = [f"_p{i}" for i in range(len(cols))]
    packed = VectorAssembler(inputCols=names, outputCol="_v").transform(centred)
    shares = PCA(k=len(cols), inputCol="_v", outputCol="_pc").fit(packed)
    explained = list(shares.explainedVariance.toArray())
    if k is None:
        total, k = 0.0, len(cols)
        for i, s in enumerate(explained, start=1):
            total += s
            if total >= variance_ratio:
                k = i
                break
    parts = MF.vector_to_array(F.col("_pc"))
    out = shares.transform(packed).withColumn("_a", parts)
    return out.select(*df.columns, *[F.col("_a")[i].alias(f"{prefix}_{i + 1}") for i in range(k)]), explained[:k]


def cluster_labels(df: DataFrame, cols: Sequence[str], k: int = 4, seed: int = 42, out: str = "cluster_label") -> DataFrame:
    """k-means label on standardised columns (missing as 0); needs two columns and five rows."""
    valid = [c for c in cols if c in numeric_columns(df)]
    if len(valid) < 2 or df.limit(5).count() < 5:
        return df
    filled = df.withColumns({f"_c{i}": F.coalesce(col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(valid)})
    names = [f"_c{i}" for i in range(len(valid))]
    packed = VectorAssembler(inputCols=names, outputCol="_v").transform(scale(filled, names, "standard"))
    rows = df.limit(k).count()
    model = KMeans(k=min(k, rows), seed=seed, featuresCol="_v", predictionCol=out, maxIter=50).fit(packed)
    return model.transform(packed).select(*df.columns, out)


# ---- resampling -----------------------------------------------------------------------


def class_sizes(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(col(target)).agg(F.count("*").alias("_n"))


def _ranked_by_hash(df: DataFrame, target: str, row_id: str, seed: int) -> DataFrame:
    marked = df.withColumn("_u", hash_unit(col(row_id), seed=seed))
    return ordered.position(marked, [target], ["_u", row_id], "_pos")


def random_undersample(df: DataFrame, target: str, row_id: str, seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest, rows picked by seeded hash."""
    least = one_row(class_sizes(df, target), F.min("_n"))[0]
    return _ranked_by_hash(df, target, row_id, seed).where(F.col("_pos") <= least).select(*df.columns)


def random_oversample(df: DataFrame, target: str, row_id: str, seed: int = 42) -> DataFrame:
    """Every class raised to the size of the largest by repeating rows as evenly as possible."""
    sizes = class_sizes(df, target)
    most = one_row(sizes, F.max("_n"))[0]
    ranked = attach(_ranked_by_hash(df, target, row_id, seed), sizes, [target])
    copies = F.floor(F.lit(most) / F.col("_n")) + (F.col("_pos") <= F.lit(most) % F.col("_n")).cast("long")
    return ranked.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*df.columns)


def _synthesize(minority: DataFrame, wanted: DataFrame, neighbours: DataFrame, row_id: str, cols: Sequence[str], seed: int) -> DataFrame:
    """Interpolate each wanted copy towards one of its row's neighbours."""
    base = minority.select(col(row_id).cast("long").alias("_base"), *[col(c).cast("double").alias(f"_a{i}") for i, c in enumerate(cols)])
    mates = minority.select(col(row_id).cast("long").alias("item_id"), *[col(c).cast("double").alias(f"_b{i}") for i, c in enumerate(cols)])
    degree = neighbours.groupBy("query_id").agg(F.max("rank").alias("_k"))
    copies = wanted.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    drawn = copies.join(degree, copies["_base"] == degree["query_id"]).select(
        "_base", "_copy", (F.floor(hash_unit(F.col("_base"), F.col("_copy"), seed=seed) * F.col("_k")) + 1).cast("int").alias("rank"))
    pairs = drawn.join(neighbours.select(F.col("query_id").alias("_base"), "rank", "item_id"), ["_base", "rank"])
    u = hash_unit(F.col("_base"), F.col("_copy"), seed=seed + 1)
    joined = pairs.join(base, "_base").join(mates, "item_id")
    return joined.select("_base", "_copy", *[(F.col(f"_a{i}") + u * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(c) for i, c in enumerate(cols)])


def smote(df: DataFrame, target: str, minority, row_id: str, cols: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority rows raising the class to the size of the largest one.

    Each minority row gets an even share of the copies, each copy a point between the row and
    one of its k nearest minority rows. Returns only the new rows: (cols, target, _base, _copy).
    """
    sizes = {r[0]: r[1] for r in class_sizes(df, target).collect()}
    need, have = max(sizes.values()) - sizes[minority], sizes[minority]
    rows = df.where(col(target) == minority).withColumn("_v", F.array(*[col(c).cast("double") for c in cols]))
    hits = nearest(rows, rows, k, row_id, "_v", row_id, "_v", skip_self=True)
    ranked = ordered.position(rows.withColumn("_u", hash_unit(col(row_id), seed=seed)), [], ["_u", row_id], "_pos")
    share = F.lit(need // have).cast("long") + (F.col("_pos") <= need % have).cast("long")
    wanted = ranked.select(col(row_id).cast("long").alias("_base"), share.alias("_copies"))
    return _synthesize(rows, wanted, hits, row_id, cols, seed).withColumn(target, F.lit(minority))


def adasyn(df: DataFrame, target: str, minority, row_id: str, cols: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """As smote, with copies in proportion to the share of other classes among the k nearest rows."""
    sizes = {r[0]: r[1] for r in class_sizes(df, target).collect()}
    need = max(sizes.values()) - sizes[minority]
    every = df.withColumn("_v", F.array(*[col(c).cast("double") for c in cols]))
    rows = every.where(col(target) == minority)
    around = nearest(rows, every, k, row_id, "_v", row_id, "_v", skip_self=True)
    labels = df.select(col(row_id).cast("long").alias("item_id"), (col(target) != minority).cast("int").alias("_other"))
    mixed = around.join(labels, "item_id").groupBy(F.col("query_id").alias("_base")).agg(F.avg("_other").alias("_r"))
    total = one_row(mixed, F.sum("_r"))[0]
    if not total:
        raise ValueError("no minority row has a neighbour of another class")
    wanted = mixed.select("_base", F.round(F.col("_r") / F.lit(total) * F.lit(need)).cast("long").alias("_copies"))
    hits = nearest(rows, rows, k, row_id, "_v", row_id, "_v", skip_self=True)
    return _synthesize(rows, wanted, hits, row_id, cols, seed).withColumn(target, F.lit(minority))


def resample(df: DataFrame, target: str, row_id: str, cols: Sequence[str], method: str = "smote", seed: int = 42) -> DataFrame:
    """Balance the classes of a numeric table: smote, adasyn, random_oversample or random_undersample."""
    if method == "random_oversample":
        return random_oversample(df, target, row_id, seed).select(*cols, target)
    if method == "random_undersample":
        return random_undersample(df, target, row_id, seed).select(*cols, target)
    if method not in ("smote", "adasyn"):
        raise ValueError(f"unknown resampling method '{method}'")
    make = smote if method == "smote" else adasyn
    sizes = {r[0]: r[1] for r in class_sizes(df, target).collect()}
    out = df.select(*[col(c).cast("double").alias(c) for c in cols], target)
    for label, n in sizes.items():
        if n < max(sizes.values()):
            out = out.unionByName(make(df, target, label, row_id, cols, seed=seed).select(*cols, target))
    return out
