"""Splits, model training, scoring, tuning, importance and run history on Spark ML."""

from __future__ import annotations

import random
import time
from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import functions as MF
from pyspark.ml import regression as R
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.core import attach, col, describe_rows, explode_rows, hash_unit, materialize, one_row, spread
from quern.operators import evaluate, ordered
from quern.operators.forests import CellForest
from quern.operators.neighbours import Neighbours
from quern.operators.shape import signed_log, signed_log_inverse
from quern.operators.windows import fold_of

# ---- splits ---------------------------------------------------------------------------


def random_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 42, out: str = "split") -> DataFrame:
    """Named parts in the given shares by seeded hash of the key: no shuffle, same on every run."""
    u, upto = hash_unit(col(key), seed=seed), 0.0
    edges = []
    for name, share in shares.items():
        upto += share / sum(shares.values())
        edges.append((name, upto))
    part = F.lit(edges[-1][0])
    for name, edge in reversed(edges[:-1]):
        part = F.when(u < edge, name).otherwise(part)
    return df.withColumn(out, part)


def stratified_split(df: DataFrame, key: str, target: str, test_size: float = 0.2, seed: int = 42, out: str = "split") -> DataFrame:
    """Exact test share per class by hash order; a plain random split when a class has one row."""
    sizes = df.groupBy(col(target)).agg(F.count("*").alias("_n"))
    if (one_row(sizes, F.min("_n"))[0] or 0) < 2:
        return random_split(df, key, {"train": 1 - test_size, "test": test_size}, seed, out)
    ranked = ordered.position(df.withColumn("_u", hash_unit(col(key), seed=seed)), [target], ["_u", key], "_pos")
    part = F.when(F.col("_pos") <= F.round(F.col("_n") * test_size), "test").otherwise("train")
    return attach(ranked, sizes, [target]).withColumn(out, part).select(*df.columns, out)


# ---- estimators -----------------------------------------------------------------------

CLASSIFIERS = {
    "LogisticRegression": lambda p: C.LogisticRegression(maxIter=p.get("max_iter", 500), regParam=p.get("reg_param", 0.0), standardization=False),
    "DecisionTree": lambda p: C.DecisionTreeClassifier(maxDepth=p.get("max_depth", 10), minInstancesPerNode=p.get("min_samples_leaf", 1), seed=p.get("seed", 42)),
    "RandomForest": lambda p: C.RandomForestClassifier(numTrees=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 10), minInstancesPerNode=p.get("min_samples_leaf", 1), seed=p.get("seed", 42)),
    "GradientBoosting": lambda p: C.GBTClassifier(maxIter=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 3), stepSize=p.get("learning_rate", 0.1), seed=p.get("seed", 42)),
    "XGBoost": lambda p: C.GBTClassifier(maxIter=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 6), stepSize=p.get("learning_rate", 0.1), subsamplingRate=p.get("subsample", 0.8), seed=p.get("seed", 42)),
    "SVM": lambda p: C.LinearSVC(regParam=p.get("reg_param", 0.01), maxIter=p.get("max_iter", 100), standardization=False),
    "KNearestNeighbors": lambda p: Neighbours(k=p.get("knn_neighbors", 5), weights=p.get("knn_weights", "uniform")),
    "NaiveBayes": lambda p: C.NaiveBayes(modelType="gaussian"),
}
REGRESSORS = {
    "LinearRegression": lambda p: R.LinearRegression(solver="normal"),
    "Ridge": lambda p: R.LinearRegression(regParam=p.get("reg_param", 0.0), elasticNetParam=0.0, standardization=False),
    "Lasso": lambda p: R.LinearRegression(regParam=p.get("reg_param", 0.0), elasticNetParam=1.0, standardization=False),
    "ElasticNet": lambda p: R.LinearRegression(regParam=p.get("reg_param", 0.0), elasticNetParam=p.get("elastic_net", 0.5), standardization=False),
    "DecisionTreeRegressor": lambda p: R.DecisionTreeRegressor(maxDepth=p.get("max_depth", 10), minInstancesPerNode=p.get("min_samples_leaf", 1), seed=p.get("seed", 42)),
    "RandomForestRegressor": lambda p: R.RandomForestRegressor(numTrees=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 10), seed=p.get("seed", 42)),
    "CellForestRegressor": lambda p: CellForest(numTrees=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 10), seed=p.get("seed", 42)),
    "GradientBoostingRegressor": lambda p: R.GBTRegressor(maxIter=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 3), stepSize=p.get("learning_rate", 0.1), seed=p.get("seed", 42)),
    "KNNRegressor": lambda p: Neighbours(k=p.get("knn_neighbors", 5), weights=p.get("knn_weights", "uniform"), regression=True),
}
# Search grids.
GRIDS = {
    "LogisticRegression": {"C": [0.01, 0.1, 1.0, 10.0]},
    "DecisionTree": {"maxDepth": [5, 10, 20], "minInstancesPerNode": [1, 2, 4]},
    "RandomForest": {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 20], "minInstancesPerNode": [1, 2, 4]},
    "GradientBoosting": {"stepSize": [0.01, 0.05, 0.1, 0.2], "maxIter": [50, 100, 200], "maxDepth": [3, 5, 7]},
    "SVM": {"C": [0.1, 1.0, 10.0]},
    "KNearestNeighbors": {"knn_neighbors": [3, 5, 7], "knn_weights": ["uniform", "distance"]},
    "KNNRegressor": {"knn_neighbors": [3, 5, 7], "knn_weights": ["uniform", "distance"]},
    "RandomForestRegressor": {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 20]},
    "GradientBoostingRegressor": {"stepSize": [0.01, 0.05, 0.1], "maxIter": [50, 100, 200], "maxDepth": [3, 5, 7]},
    "DecisionTreeRegressor": {"maxDepth": [5, 10, 20], "minInstancesPerNode": [1, 2, 4]},
    "Ridge": {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]},
    "Lasso": {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0]},
    "ElasticNet": {"alpha": [0.01, 0.1, 1.0, 10.0], "l1_ratio": [0.1, 0.3, 0.5, 0.7, 0.9]},
}


def task_of(algorithm: str) -> str:
    if algorithm in CLASSIFIERS:
        return "classification"
    if algorithm in REGRESSORS:
        return "regression"
    raise ValueError(f"unsupported algorithm '{algorithm}'")


PENALISED = {"LogisticRegression": "C", "SVM": "C", "Ridge": "alpha", "Lasso": "alpha", "ElasticNet": "alpha"}


def penalties(df: DataFrame, label: str, algorithm: str, choices: Sequence[dict]) -> list[dict]:
    """Parameters with `C`, `alpha` and `l1_ratio` (default 1, 1, 0.5) as Spark's `reg_param` and `elastic_net`.

    Spark penalises the mean loss, so an inverse strength C over the sum of losses is 1 / (C n). Linear models work on
    the label over its deviation: the absolute part of a penalty carries over, the squared part grows by the deviation,
    and ridge states its own against the sum of squares. A given `reg_param` is left as it is.
    """
    kind = PENALISED.get(algorithm)
    if kind is None or all("reg_param" in p for p in choices):
        return [dict(p) for p in choices]
    size = one_row(df.where(col(label).isNotNull()), F.count("*").alias("n"), F.stddev_pop(col(label).cast("double")).alias("spread"))
    n, spread = max(size["n"], 1), size["spread"] or 1.0

    def one(p: dict) -> dict:
        rest = {k: v for k, v in p.items() if k not in ("C", "alpha", "l1_ratio")}
        if "reg_param" in p:
            return rest
        if kind == "C":
            return rest | {"reg_param": 1.0 / (p.get("C", 1.0) * n)}
        alpha = p.get("alpha", 1.0)
        share = {"Ridge": 0.0, "Lasso": 1.0}.get(algorithm, p.get("l1_ratio", 0.5))
        absolute, squared = alpha * share, alpha * (1 - share) * spread / (n if algorithm == "Ridge" else 1)
        total = absolute + squared
        return rest | {"reg_param": total} | ({"elastic_net": absolute / total if total else 0.0} if algorithm == "ElasticNet" else {})

    return [one(p) for p in choices]


def estimator(algorithm: str, label: str, params: dict | None = None):
    known = CLASSIFIERS if task_of(algorithm) == "classification" else REGRESSORS
    made = known[algorithm](params or {})
    return made.setFeaturesCol("_features").setLabelCol(label).setPredictionCol("prediction")


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="_features")


def train(df: DataFrame, features: Sequence[str], label: str, algorithm: str, params: dict | None = None) -> PipelineModel:
    (native,) = penalties(df, label, algorithm, [params or {}])
    return Pipeline(stages=[assembler(features), estimator(algorithm, label, native)]).fit(df)


def batch_predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Prediction and, for probabilistic classifiers, one `probability_class_<i>` column each."""
    done = model.transform(df)
    extra = []
    if "probability" in done.columns:
        parts = MF.vector_to_array(F.col("probability"))
        extra = [parts[i].alias(f"probability_class_{i}") for i in range(model.stages[-1].numClasses)]
    return done.select(*df.columns, "prediction", *extra)


def scored_pairs(scored: DataFrame, label: str, task: str) -> DataFrame:
    """Truth, prediction and (binary classifiers) the probability of class 1, all as doubles."""
    binary = "probability_class_1" in scored.columns and "probability_class_2" not in scored.columns
    chance = F.col("probability_class_1") if task == "classification" and binary else F.lit(None).cast("double")
    return scored.select(col(label).cast("double").alias("_y"), F.col("prediction").cast("double").alias("_p"), chance.alias("_chance"))


def score_pairs(pairs: DataFrame, task: str, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics per key, all keys in one job."""
    if task == "regression":
        return evaluate.regression_metrics(pairs, "_y", "_p", keys)
    if not keys:
        return score_pairs(pairs.withColumn("_all", F.lit(1)), task, ["_all"]).drop("_all")
    found = evaluate.classification_metrics(pairs, "_y", "_p", keys).withColumnRenamed("f1", "f1_score")
    areas = evaluate.roc_auc(pairs, "_y", "_chance", keys).withColumnRenamed("auc", "roc_auc")
    return attach(found, areas, keys)


def score_model(scored: DataFrame, label: str, task: str) -> dict[str, float]:
    return score_pairs(scored_pairs(scored, label, task), task).collect()[0].asDict()


# ---- comparison, tuning, curves -------------------------------------------------------


def compare(train_df: DataFrame, test_df: DataFrame, features: Sequence[str], label: str, algorithms: dict[str, dict]) -> tuple[list[dict], dict[str, PipelineModel]]:
    """Train each algorithm on one split; a failing one is recorded and skipped.

    The columns in use are written once, in files for all cores, so no algorithm computes its input again; so are the
    predictions, of which several metrics are taken.
    """
    train_df, test_df = (materialize(spread(df.select(*dict.fromkeys([*features, label]))), "split") for df in (train_df, test_df))
    rows, fitted, pairs = [], {}, {}
    for name, params in algorithms.items():
        row = {"model_name": name, "task_type": None, "training_time_seconds": 0.0, "metrics": {}, "hyperparameters": {k: str(v) for k, v in params.items()}, "error": None}
        rows.append(row)
        start = time.perf_counter()
        try:
            row["task_type"] = task_of(name)
            fitted[name] = train(train_df, features, label, name, params)
            row["training_time_seconds"] = round(time.perf_counter() - start, 4)
            part = scored_pairs(batch_predict(fitted[name], test_df), label, task_of(name)).withColumn("_model", F.lit(name))
            known = pairs.get(task_of(name))
            pairs[task_of(name)] = part if known is None else known.unionByName(part)
        except Exception as exc:  # the other models still count
            row["error"] = str(exc).split("\n")[0]
    for task, scored in pairs.items():
        for r in score_pairs(materialize(scored, "scored"), task, ["_model"]).collect():
            found = r.asDict()
            target = next(row for row in rows if row["model_name"] == found["_model"])
            target["metrics"] = {k: v for k, v in found.items() if k != "_model" and v is not None}
    return rows, fitted


def cross_validate(df: DataFrame, key: str, features: Sequence[str], label: str, algorithm: str, folds: int = 5, params: dict | None = None) -> DataFrame:
    """Score per fold (accuracy or r2): (fold, score); summarise with `aggs.summarize`."""
    marked = materialize(df.select(*dict.fromkeys([*features, label]), fold_of(col(key), folds=folds).alias("_fold")), "folds")
    task, rows = task_of(algorithm), []
    for f in range(folds):
        model = train(marked.where(F.col("_fold") != f), features, label, algorithm, params)
        held = scored_pairs(batch_predict(model, marked.where(F.col("_fold") == f)), label, task)
        rows.append(held.withColumn("fold", F.lit(f)))
    name = "accuracy" if task == "classification" else "r2"
    return score_pairs(reduce(DataFrame.unionByName, rows), task, ["fold"]).select("fold", F.col(name).alias("score"))


def tune(df: DataFrame, key: str, features: Sequence[str], label: str, algorithm: str, grid: dict[str, list] | None = None, sample: int | None = None, folds: int = 3, parallelism: int = 4, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """Grid search, or a random sample of the grid, by cross-validation on hashed folds."""
    base = estimator(algorithm, label)
    choices = grid or GRIDS.get(algorithm, {})
    combos = [dict(zip(choices, values)) for values in product(*choices.values())]
    if sample and sample < len(combos):
        combos = random.Random(seed).sample(combos, sample)
    penalised = any(k in ("C", "alpha", "l1_ratio") for k in choices)
    native = penalties(df, label, algorithm, combos) if penalised else combos
    named = {"reg_param": "regParam", "elastic_net": "elasticNetParam", "knn_neighbors": "k", "knn_weights": "weights"}
    maps = [ParamGridBuilder().baseOn({base.getParam(named.get(k, k)): v for k, v in c.items()}).build()[0] for c in native]
    if task_of(algorithm) == "classification":
        judge = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    else:
        judge = RegressionEvaluator(labelCol=label, metricName="r2")
    search = CrossValidator(estimator=base, estimatorParamMaps=maps, evaluator=judge, numFolds=folds, parallelism=parallelism, foldCol="_fold")
    vectors = assembler(features)
    ready = vectors.transform(df).withColumn("_fold", fold_of(col(key), folds=folds))
    fitted = search.fit(ready)
    rows = [(str(c), float(m)) for c, m in zip(combos, fitted.avgMetrics)]
    best = PipelineModel(stages=[vectors, fitted.bestModel])
    return best, describe_rows(df.sparkSession, rows, "params string, score double")


def learning_curve(df: DataFrame, key: str, features: Sequence[str], label: str, algorithm: str, shares: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0), params: dict | None = None) -> DataFrame:
    """Train and test score on nested hash samples of the training rows."""
    split = random_split(df, key, {"train": 0.8, "test": 0.2})
    marked = materialize(split.select(*dict.fromkeys([*features, label]), "split", hash_unit(col(key), seed=7).alias("_u")), "curve")
    test, task, rows = marked.where("split = 'test'"), task_of(algorithm), []
    name = "accuracy" if task == "classification" else "r2"
    for share in shares:
        part = marked.where((F.col("split") == "train") & (F.col("_u") < share))
        model = train(part, features, label, algorithm, params)
        for side, held in (("train", part), ("test", test)):
            pairs = scored_pairs(batch_predict(model, held), label, task)
            rows.append(pairs.withColumns({"share": F.lit(float(share)), "side": F.lit(side)}))
    every = reduce(DataFrame.unionByName, rows)
    scores = score_pairs(every, task, ["share", "side"]).groupBy("share").pivot("side", ["train", "test"]).agg(F.first(name))
    sizes = every.where("side = 'train'").groupBy("share").agg(F.count("*").alias("rows"))
    return scores.join(sizes, "share").select("share", "rows", F.col("train").alias("train_score"), F.col("test").alias("test_score"))


# ---- explanations ---------------------------------------------------------------------


def feature_importance(model: PipelineModel, features: Sequence[str], k: int = 20) -> list[tuple[str, float]]:
    """Impurity importance or absolute coefficient, largest first."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficients"):
        values = abs(last.coefficients.toArray())
    else:
        return []
    ranked = sorted(zip(features, values), key=lambda p: (-p[1], p[0]))
    return [(f, float(v)) for f, v in ranked[:k]]


def permutation_importance(model: PipelineModel, df: DataFrame, key: str, features: Sequence[str], label: str, task: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """Mean and deviation of the score lost when one feature is shuffled.

    Per repeat the rows are put in a random order and every row takes values from the next one
    (the last from the first): one self-join per repeat serves all features, and all features
    and repeats are scored in one job.
    """
    base = materialize(df.select(key, label, F.array(*[col(f).cast("double") for f in features]).alias("_x")), "permuted")
    rows = base.count()
    last = PipelineModel(stages=[model.stages[-1]])
    trials = None
    for r in range(repeats):
        placed = ordered.position(base.withColumn("_u", hash_unit(col(key), seed=seed + r)), [], ["_u", key], "_pos")
        donors = placed.select((F.col("_pos") % rows + 1).alias("_pos"), F.col("_x").alias("_d"))
        part = placed.join(donors, "_pos").withColumn("_repeat", F.lit(r))
        trials = part if trials is None else trials.unionByName(part)

    def swapped(i: int) -> Column:
        return F.transform("_x", lambda v, j: F.when(j == i, F.element_at("_d", i + 1)).otherwise(v))

    swaps = [F.struct(F.lit(i).alias("_feature"), swapped(i).alias("_v")) for i in range(len(features))]
    mixed = explode_rows(trials, [label, "_repeat"], F.array(*swaps), "s").select(label, "_repeat", "s.*")
    scored = last.transform(mixed.withColumn("_features", MF.array_to_vector("_v")))
    plain = last.transform(base.withColumn("_features", MF.array_to_vector("_x")))
    keys, name = ["_repeat", "_feature"], "r2" if task == "regression" else "accuracy"
    if task == "regression":
        whole, parts = evaluate.regression_metrics(plain, label, "prediction"), evaluate.regression_metrics(scored, label, "prediction", keys)
    else:
        fit = lambda d: d.withColumns({label: col(label).cast("double"), "prediction": F.col("prediction").cast("double")})
        whole, parts = evaluate.classification_metrics(fit(plain), label, "prediction"), evaluate.classification_metrics(fit(scored), label, "prediction", keys)
    start = one_row(whole, F.max(name))[0]
    lost = F.lit(start) - F.col(name)
    names = F.array(*[F.lit(f) for f in features])
    out = parts.groupBy("_feature").agg(F.avg(lost).alias("mean_importance"), F.stddev_pop(lost).alias("std_importance"))
    return out.select(names[F.col("_feature")].alias("feature"), "mean_importance", "std_importance")


def signed_log_regression(train_df: DataFrame, test_df: DataFrame, features: Sequence[str], label: str, algorithm: str = "LinearRegression", params: dict | None = None) -> DataFrame:
    """Fit on the signed log of the target; errors on the log scale and on the original scale."""
    model = train(train_df.withColumn("_log", signed_log(col(label))), features, "_log", algorithm, params)
    scored = model.transform(test_df.withColumn("_log", signed_log(col(label)))).withColumn("_back", signed_log_inverse(F.col("prediction")))
    logs = evaluate.regression_metrics(scored, "_log", "prediction").withColumn("scale", F.lit("log"))
    return logs.unionByName(evaluate.regression_metrics(scored, label, "_back").withColumn("scale", F.lit("original")))


def forest_forecast(df: DataFrame, key: str, features: Sequence[str], label: str, trees: int = 200, test_size: float = 0.2) -> tuple[PipelineModel, dict[str, float]]:
    """Random-forest forecaster on engineered features with its held-out errors; the rows are dealt out to all cores.

    Features of dates have few distinct rows: all trees take their sums in one pass over the rows.
    """
    parts = random_split(spread(df), key, {"train": 1 - test_size, "test": test_size})
    model = train(parts.where("split = 'train'"), features, label, "CellForestRegressor", {"n_estimators": trees})
    return model, score_model(batch_predict(model, parts.where("split = 'test'")), label, "regression")


def ground_truth_check(model: PipelineModel, df: DataFrame, key: str, label: str, rows: int = 150, seed: int = 42) -> tuple[dict[str, float], DataFrame]:
    """Metrics and confusion table on a reproducible sample of labelled rows."""
    sample = df.orderBy(hash_unit(col(key), seed=seed), col(key)).limit(rows)
    scored = batch_predict(model, sample)
    typed = scored.withColumns({label: col(label).cast("double"), "prediction": F.col("prediction").cast("double")})
    return score_model(scored, label, "classification"), evaluate.confusion(typed, label, "prediction")


# ---- run history ----------------------------------------------------------------------

RUN_SCHEMA = (
    "timestamp string, model_name string, dataset_name string, task_type string, training_time_seconds double, "
    "hyperparameters map<string,string>, metrics map<string,double>"
)
# Metrics where less is better, and the deciding metric per task.
LOWER_BETTER = ["mae", "mse", "rmse", "training_time_seconds"]
PRIMARY = {"classification": "f1_score", "regression": "r2"}


def append_runs(runs: DataFrame, path: str) -> None:
    """Add runs to the history; metrics may be a map or JSON text."""
    if dict(runs.dtypes)["metrics"] == "string":
        runs = runs.withColumn("metrics", F.from_json("metrics", "map<string,double>"))
    runs.write.mode("append").parquet(path)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def best_run(runs: DataFrame, task: str = "classification", metric: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The run with the best value of the metric; the earliest wins a tie."""
    name = metric or PRIMARY[task]
    value = F.try_element_at("metrics", F.lit(name))
    usable = runs.withColumn("best_value", value).where("best_value is not null")
    order = -F.col("best_value") if name not in LOWER_BETTER else F.col("best_value")
    pick = F.min_by(F.struct("model_name", "dataset_name", "timestamp", "best_value"), F.struct(order, "timestamp", "model_name"))
    return usable.groupBy(*by).agg(pick.alias("r")).select(*by, "r.*").withColumn("best_metric", F.lit(name))


def comparison_table(runs: DataFrame, metrics: Sequence[str], task: str = "classification") -> DataFrame:
    """One row per run with its metrics as columns, best first."""
    cells = [F.round(F.try_element_at("metrics", F.lit(m)), 4).alias(m) for m in metrics]
    table = runs.select("model_name", "dataset_name", "training_time_seconds", "timestamp", *cells)
    lead = PRIMARY[task]
    return table.orderBy(F.desc_nulls_last(lead), "model_name") if lead in metrics else table


def runs_table(spark: SparkSession, rows: list[dict], dataset: str, timestamp: str) -> DataFrame:
    """Results of `compare` as run history rows."""
    data = [(timestamp, r["model_name"], dataset, r["task_type"], r["training_time_seconds"], r["hyperparameters"], {k: float(v) for k, v in r["metrics"].items() if v is not None}) for r in rows]
    return spark.createDataFrame(data, RUN_SCHEMA)
