"""Error measures, confusion tables, ranking curves and calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.core import col, one_row
from quern.operators import ordered


def regression_metrics(df: DataFrame, truth: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """mae, mse, rmse and r2; the spread of the truth comes from its population variance."""
    y, p = col(truth).cast("double"), col(predicted).cast("double")
    both = y.isNotNull() & p.isNotNull()
    err = F.when(both, y - p)
    mse = F.avg(err * err)
    spread = F.var_pop(F.when(both, y))
    return df.groupBy(*keys).agg(
        F.avg(F.abs(err)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.when(spread > 0, 1 - mse / spread).alias("r2")
    )


def confusion(df: DataFrame, truth: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, col(truth).cast("string").alias("label"), col(predicted).cast("string").alias("predicted")).agg(F.count("*").alias("rows"))


def class_report(matrix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """precision, recall, f1 and support per class from a confusion table; 0 where undefined."""
    hit = F.when(F.col("label") == F.col("predicted"), F.col("rows")).otherwise(0)
    by_label = matrix.groupBy(*keys, F.col("label").alias("class")).agg(F.sum("rows").alias("support"), F.sum(hit).alias("hits"))
    by_guess = matrix.groupBy(*keys, F.col("predicted").alias("class")).agg(F.sum("rows").alias("guesses"))
    both = by_label.join(by_guess, [*keys, "class"], "full").fillna(0, subset=["support", "hits", "guesses"])
    precision = F.coalesce(F.try_divide("hits", "guesses"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("hits"), F.col("guesses") + F.col("support")), F.lit(0.0))
    return both.select(*keys, "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def classification_metrics(df: DataFrame, truth: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """accuracy and support-weighted precision, recall and f1. Recall weighted by support is
    the share of hits, which is the accuracy."""
    report = class_report(confusion(df, truth, predicted, keys), keys)
    total = F.sum("support")
    weighted = {m: F.sum(F.col(m) * F.col("support")) / total for m in ("precision", "recall", "f1")}
    return report.groupBy(*keys).agg(weighted["recall"].alias("accuracy"), *[e.alias(m) for m, e in weighted.items()])


def score_table(df: DataFrame, truth: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score: ties and hot scores collapse map-side."""
    hit = (col(truth) == 1).cast("long")
    return df.where(col(score).isNotNull()).groupBy(*keys, col(score).cast("double").alias("score")).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))


def roc_auc(df: DataFrame, truth: str, score: str, keys: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    """Exact area under the ROC curve: the share of (positive, negative) pairs in the right
    order, ties counting half, from running totals over distinct scores."""
    table = score_table(df, truth, score, keys)
    run = ordered.running_sum(table, keys, ["score"], {"neg_upto": F.col("neg")}, block_rows=block_rows)
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    return run.groupBy(*keys).agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def curve_points(df: DataFrame, truth: str, score: str, block_rows: int | None = None) -> DataFrame:
    """One row per distinct score, from the highest: threshold, tpr, fpr, precision, recall."""
    table = score_table(df, truth, score)
    pos, neg = one_row(table, F.sum("pos"), F.sum("neg"))
    run = ordered.running_sum(table, [], ["score"], {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True, block_rows=block_rows)
    recall = F.try_divide("tp", F.lit(pos))
    return run.select(
        F.col("score").alias("threshold"),
        recall.alias("tpr"),
        F.try_divide("fp", F.lit(neg)).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        recall.alias("recall"),
    )


def calibration(df: DataFrame, truth: str, probability: str, bins: int = 10) -> DataFrame:
    """Mean predicted probability against share of positives in equal-width bins; empty bins absent."""
    index = F.least(F.floor(col(probability) * bins), F.lit(bins - 1)).cast("int")
    return df.where(col(probability).isNotNull()).groupBy(index.alias("bin")).agg(
        F.avg(probability).alias("mean_predicted"), F.avg(col(truth).cast("double")).alias("fraction_positive"), F.count("*").alias("rows")
    )


def residuals(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.withColumn("residual", col(truth) - col(predicted))


def threshold_sweep(df: DataFrame, truth: str, probability: str, thresholds: Sequence[float]) -> DataFrame:
    """accuracy, precision, recall and f1 per probability threshold, in one aggregate pass."""
    y = col(truth) == 1
    counts = []
    for i, t in enumerate(thresholds):
        guess = col(probability) >= F.lit(float(t))
        counts += [F.count_if(y & guess).alias(f"tp{i}"), F.count_if(~y & guess).alias(f"fp{i}"), F.count_if(y & ~guess).alias(f"fn{i}"), F.count_if(~y & ~guess).alias(f"tn{i}")]
    row = df.agg(*counts)
    cells = [F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "fn", "tn")]) for i, t in enumerate(thresholds)]
    table = row.select(F.inline(F.array(*cells)))

    def share(top, bottom):
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    return table.select(
        "threshold",
        share(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn).alias("f1"),
    )


def prediction_interval(df: DataFrame, predicted: str, scale: float, z: float = 1.96) -> DataFrame:
    return df.withColumns({"lower": col(predicted) - z * scale, "upper": col(predicted) + z * scale})
