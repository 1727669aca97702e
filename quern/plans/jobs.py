"""Whole jobs: the data-service transform, model preprocessing and feature engineering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.core import bounded_levels, col, describe_rows, materialize, numeric_columns, one_row, replace_columns, string_columns, time_columns
from quern.functions import dates, text
from quern.operators import features, quality, shape

# Named settings of the transform job.
PROFILES = {
    "company_financials": {"dedup_subset": None, "normalize_cols": ["revenue"], "date_col": "report_date", "categorical_cols": ["region"]},
    "economic_indicators": {"dedup_subset": ["country", "year"], "normalize_cols": ["value"], "date_col": None, "categorical_cols": ["indicator"]},
}


def transform_table(
    df: DataFrame,
    dedup_subset: Sequence[str] | None = None,
    dedup_order: Sequence[str] = (),
    normalize_cols: Sequence[str] = (),
    date_col: str | None = None,
    categorical_cols: Sequence[str] = (),
    schema: dict[str, str] | None = None,
    missing_strategy: str = "median",
    tighten: bool = False,
) -> DataFrame:
    """Clean, impute, add date parts, z-score, one-hot and fit to a schema.

    Only fitted statistics and category levels reach the driver.
    """
    if not isinstance(df, DataFrame):
        raise TypeError(f"expected a DataFrame, got {type(df).__name__}")
    if df.isEmpty():
        raise ValueError("cannot process an empty table")
    out = shape.standardize_text(shape.standardize_columns(df))
    out = quality.remove_duplicates(out, dedup_subset, "first", dedup_order)
    # Half a dozen passes fit statistics on the deduplicated rows: shuffle them once.
    out = materialize(out, "transform")
    out = quality.impute(out, missing_strategy)
    if normalize_cols:
        out = quality.impute(shape.coerce_numeric(out, normalize_cols), missing_strategy, normalize_cols)
    if date_col:
        parsed = replace_columns(out, {date_col: F.try_to_timestamp(col(date_col).cast("string"))})
        out = replace_columns(parsed, dates.calendar_parts(col(date_col), date_col))
    if normalize_cols:
        out = features.scale(out, normalize_cols, "zscore")
    if categorical_cols:
        out = features.one_hot(out, categorical_cols)
    if schema:
        out = shape.enforce_schema(out, schema)
    return shape.optimize_types(out)[0] if tighten else out


def transform_with_profile(df: DataFrame, profile: str, profiles: dict[str, dict] | None = None, **extra) -> DataFrame:
    known = profiles or PROFILES
    if profile not in known:
        raise ValueError(f"unknown profile '{profile}', available: {list(known)}")
    return transform_table(df, **{k: v for k, v in known[profile].items() if v}, **extra)


def _fill(df: DataFrame, values: dict) -> DataFrame:
    return quality.apply_fill(df, {c: v for c, v in values.items() if c in df.columns})


#: Steps of preprocessing that apply a fitted value to any table, in the order of their fit.
STEPS = {
    "complete": lambda df, _: df.dropna(),
    "fill": _fill,
    "outliers": features.apply_outliers,
    "log_shift": features.apply_log,
    "target_codes": features.apply_codes,
    "codes": features.apply_codes,
    "one_hot": features.apply_one_hot_capped,
    "scaler": features.apply_scaler,
}


def preprocess(df: DataFrame, config: dict | None = None, target: str | None = None, row_id: str | None = None, train: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """Impute → deduplicate → outliers → log → encode → scale → balance.

    Every value (fills, fences, skewed columns and shifts, codes, levels, scaler) is fitted on `train` (default: the
    table itself). They are returned in order, and `apply_preprocess` applies them to any other table.
    """
    cfg = {
        "missing_strategy": "mean", "remove_duplicates": True, "handle_outliers": False, "outlier_method": "iqr", "outlier_threshold": 1.5,
        "outlier_strategy": "clip", "apply_log_transform": False, "skewness_threshold": 1.0, "scaling_method": "standard",
        "handle_imbalanced": False, "imbalanced_method": "smote", **(config or {}),
    }
    if target is not None and target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    if cfg["handle_imbalanced"] and not (target and row_id):
        raise ValueError("balancing needs a target and a row id")
    aside = [c for c in (target, row_id) if c]
    frames = [df] if train is None else [df, train]  # values are fitted on the last one
    fitted: dict = {}

    def take(step: str, value) -> None:
        fitted[step] = value
        frames[:] = [STEPS[step](f, value) for f in frames]

    if cfg["missing_strategy"] == "drop":
        take("complete", True)
    else:
        take("fill", quality.fill_values(frames[-1], df.columns, cfg["missing_strategy"]))
    if cfg["remove_duplicates"]:
        frames[:] = [materialize(quality.remove_duplicates(f), "preprocess") for f in frames]
    if cfg["handle_outliers"]:
        measured = [c for c in numeric_columns(frames[-1]) if c != row_id]
        take("outliers", features.fit_outliers(frames[-1], cfg["outlier_method"], cfg["outlier_threshold"], cfg["outlier_strategy"], measured))
    numbers = [c for c in numeric_columns(frames[-1]) if c not in aside]
    texts = [c for c in string_columns(frames[-1]) if c not in aside]
    if cfg["apply_log_transform"]:
        skewed = features.skewed_columns(frames[-1], numbers, cfg["skewness_threshold"])
        if skewed:
            take("log_shift", features.fit_log(frames[-1], skewed))
    if target and target in string_columns(frames[-1]):
        take("target_codes", features.fit_codes(frames[-1], [target]))
    if texts:
        few = [c for c in texts if frames[-1].select(col(c)).where(col(c).isNotNull()).distinct().limit(11).count() <= 10]
        many = [c for c in texts if c not in few]
        take("codes", features.fit_codes(frames[-1], few))
        if many:
            take("one_hot", features.fit_one_hot_capped(frames[-1], many, drop_first=True, max_categories=20))
    columns = [c for c in numeric_columns(frames[-1]) if c not in aside]
    # More than two distinct values: the smallest and largest do not cover all rows.
    ends = one_row(frames[-1], *[f(col(c)) for c in columns for f in (F.min, F.max)]) if columns else []
    between = one_row(frames[-1], *[F.max(((col(c) > ends[2 * i]) & (col(c) < ends[2 * i + 1])).cast("int")) for i, c in enumerate(columns)]) if columns else []
    wide = [c for c, b in zip(columns, between) if b == 1]
    if wide:
        take("scaler", features.fit_scaler(frames[-1], wide, cfg["scaling_method"]))
    out = frames[0]
    if cfg["handle_imbalanced"] and len(bounded_levels(out, target)) > 1:
        out = features.resample(out, target, row_id, [c for c in numeric_columns(out) if c not in aside], cfg["imbalanced_method"])
    return out, fitted


def apply_preprocess(df: DataFrame, fitted: dict) -> DataFrame:
    """Apply fitted preprocessing to new rows: same fills, limits, codes, levels and scale; rows are neither
    deduplicated nor balanced. The target may be absent; a level not seen in the fit is -1 or all zero."""
    for step, value in fitted.items():
        df = STEPS[step](df, value)
    return df


def engineer_features(df: DataFrame, config: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Dates → text features → interactions → frequencies → clusters → bins → PCA → selection.

    Text features, interactions, clusters and bins use all columns of their kind unless the config names some
    (`text_columns`, `interaction_columns`, `cluster_columns`, `binned_columns`). Returns the table and a report
    (column, change).
    """
    cfg = {
        "extract_date_features": True, "create_text_features": True, "create_clustering_features": False, "create_binning_features": False,
        "n_bins": 5, "binning_strategy": "quantile", "apply_pca": False, "pca_n_components": None, "pca_variance_ratio": 0.95,
        "feature_selection_method": "variance", "variance_threshold": 0.01, "correlation_threshold": 0.95,
        "text_columns": None, "interaction_columns": None, "cluster_columns": None, "binned_columns": None, **(config or {}),
    }
    numbers, texts = numeric_columns(df), string_columns(df)
    inferred = [r["column"] for r in shape.infer_datetime_columns(df).where("is_datetime").collect()]
    times = [*time_columns(df), *inferred]
    texts = [c for c in texts if c not in times]
    out = df
    if cfg["extract_date_features"] and times:
        out = replace_columns(out, {c: F.try_to_timestamp(col(c)) for c in inferred})
        parts = {n: e for c in times for n, e in dates.extended_parts(col(c), c).items()}
        out = replace_columns(out, {n: e for n, e in parts.items() if n not in out.columns})
    varied = [c for c in texts if c not in shape.constant_columns(df.select(*texts))] if texts else []
    if cfg["create_text_features"] and varied:
        parts = {n: e for c in cfg["text_columns"] or varied for n, e in text.text_features(col(c), c).items()}
        out = replace_columns(out, {n: e for n, e in parts.items() if n not in out.columns})
    if len(numbers) >= 2:
        out = features.polynomial(out, cfg["interaction_columns"] or numbers, 2, interaction_only=True)
    if texts:
        out = features.frequency_encode(out, texts)
    if cfg["create_clustering_features"] and len(numbers) >= 2:
        out = features.cluster_labels(out, cfg["cluster_columns"] or numbers)
    if cfg["create_binning_features"] and numbers:
        out = features.bin_columns(out, cfg["binned_columns"] or numbers, cfg["n_bins"], cfg["binning_strategy"], "onehot")
    if cfg["apply_pca"] and len(numeric_columns(out)) >= 2:
        out, _ = features.pca_columns(out, numeric_columns(out), cfg["pca_n_components"], cfg["pca_variance_ratio"])
    made = [c for c in out.columns if c not in df.columns]
    if cfg["feature_selection_method"] == "variance":
        final, _ = features.select_by_variance(out, cfg["variance_threshold"])
    elif cfg["feature_selection_method"] == "correlation":
        final, _ = features.drop_correlated(out, cfg["correlation_threshold"])
    else:
        final = out
    removed = [c for c in out.columns if c not in final.columns]
    final = shape.clear_infinite(final, None, "zero").fillna("0")
    report = describe_rows(df.sparkSession, [(c, "created") for c in made] + [(c, "removed") for c in removed], "column string, change string")
    return final, report
