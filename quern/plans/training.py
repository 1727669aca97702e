"""Baseline training job: check, prepare, split, train all, evaluate, record, pick the best."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from quern.core import numeric_columns
from quern.operators import models, validate
from quern.operators.aggs import detect_task_type
from quern.plans.jobs import preprocess

# Algorithms of a baseline per task.
BASELINES = {
    "classification": ["LogisticRegression", "DecisionTree", "RandomForest", "GradientBoosting", "SVM", "KNearestNeighbors", "NaiveBayes"],
    "regression": ["LinearRegression", "Ridge", "Lasso", "ElasticNet", "DecisionTreeRegressor", "RandomForestRegressor", "GradientBoostingRegressor", "KNNRegressor"],
}


def run_baseline(
    df: DataFrame,
    key: str,
    target: str,
    dataset: str,
    history: str | None = None,
    algorithms: dict[str, dict] | None = None,
    config: dict | None = None,
    fit_on: str = "train",
) -> tuple[DataFrame, DataFrame]:
    """Returns (runs, best run). All values of the preprocessing are fitted on the training
    rows, or on all rows with `fit_on="all"`."""
    ready = validate.readiness(df, target).collect()[0]
    if not ready["ready"]:
        raise ValueError(f"the dataset has only {ready['rows']} rows")
    task = detect_task_type(df, target)
    split = models.random_split if task == "regression" else None
    parts = split(df, key, {"train": 0.8, "test": 0.2}) if split else models.stratified_split(df, key, target)
    keys = parts.select(key, "split")
    fit_rows = parts.where("split = 'train'").drop("split") if fit_on == "train" else None
    prepared, _ = preprocess(df, config, target, key, train=fit_rows)
    features = [c for c in numeric_columns(prepared) if c not in (key, target)]
    rows = prepared.join(keys, key)
    chosen = algorithms or {name: {} for name in BASELINES[task]}
    results, _ = models.compare(rows.where("split = 'train'"), rows.where("split = 'test'"), features, target, chosen)
    runs = models.runs_table(df.sparkSession, results, dataset, dt.datetime.now(dt.timezone.utc).isoformat())
    if history:
        models.append_runs(runs, history)
    return runs, models.best_run(runs, task, "f1_score" if task == "classification" else "r2")
