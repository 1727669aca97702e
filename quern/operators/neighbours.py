"""k nearest neighbours as an estimator beside the Spark ML ones: fits, predicts and gives class shares."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml import functions as MF
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.core import col, materialize, one_row
from quern.operators import vectors

MOST_CLASSES = 100  # as for Spark's own classifiers of numbered classes


class _Settings(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    k = Param(Params._dummy(), "k", "number of neighbours", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform, or distance for votes by inverse distance", TypeConverters.toString)
    regression = Param(Params._dummy(), "regression", "mean of the neighbours in place of a vote", TypeConverters.toBoolean)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(k=5, weights="uniform", regression=False, featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability")

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)

    def setPredictionCol(self, value: str):
        return self._set(predictionCol=value)


class Neighbours(Estimator, _Settings):
    """Keeps the training vectors as a stored table; classes are numbered from 0 like Spark's."""

    @keyword_only
    def __init__(self, *, k: int = 5, weights: str = "uniform", regression: bool = False):
        super().__init__()
        if weights not in ("uniform", "distance"):
            raise ValueError(f"unknown weights '{weights}'")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> NeighboursModel:
        rows = dataset.select(MF.vector_to_array(col(self.getFeaturesCol())).alias("v"), col(self.getLabelCol()).cast("double").alias("target"))
        # Equal distances go to the smaller id, and ids follow the values: reruns agree.
        order = F.struct("v", "target")
        rows = materialize(rows.where("target is not null").select(F.concat_ws(":", F.sha2(F.to_json(order), 256), F.monotonically_increasing_id()).alias("id"), "v", "target"), "neighbours")
        found = one_row(rows, F.max("target"), F.min("target"), F.max(F.abs(F.col("target") - F.round("target"))))
        classes = 0
        if not self.getOrDefault(self.regression):
            if found[1] is not None and (found[1] < 0 or found[2] > 0 or found[0] >= MOST_CLASSES):
                raise ValueError(f"classes must be whole numbers from 0 to {MOST_CLASSES - 1}")
            classes = int(found[0]) + 1 if found[0] is not None else 0
        return self._copyValues(NeighboursModel(rows, classes))


class NeighboursModel(Model, _Settings):
    def __init__(self, rows: DataFrame | None = None, classes: int = 0):
        super().__init__()
        self.rows, self.numClasses = rows, classes

    def copy(self, extra=None) -> NeighboursModel:
        made = super().copy(extra)
        made.rows, made.numClasses = self.rows, self.numClasses
        return made

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds the prediction, and for classes the share of the (weighted) votes of each.

        The rows are stored once under a number, so that the search and the join back see the same ones.
        """
        asked = materialize(dataset.withColumn("_row", F.monotonically_increasing_id()), "asked")
        points = asked.select("_row", MF.vector_to_array(col(self.getFeaturesCol())).alias("_v"))
        hits = vectors.nearest(points, self.rows, self.getOrDefault(self.k), "_row", "_v", "id", "v")
        votes = hits.join(self.rows.select(F.col("id").alias("item_id"), "target"), "item_id")
        if self.getOrDefault(self.weights) == "distance":
            # An exact match outvotes everything else.
            exact = F.max((F.col("distance") == 0).cast("int")).over(vectors.Window.partitionBy("query_id"))
            votes = votes.withColumn("_exact", exact)
            weight = F.when(F.col("_exact") == 1, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.sqrt("distance")))
        else:
            weight = F.lit(1.0)
        votes = votes.select(F.col("query_id").alias("_row"), "target", weight.alias("w"))
        if self.getOrDefault(self.regression):
            found = votes.groupBy("_row").agg((F.sum(F.col("w") * F.col("target")) / F.sum("w")).alias(self.getPredictionCol()))
            return asked.join(found, "_row", "left").drop("_row")
        share = [F.try_divide(F.sum(F.when(F.col("target") == i, F.col("w")).otherwise(0.0)), F.sum("w")).alias(f"s{i}") for i in range(self.numClasses)]
        found = votes.groupBy("_row").agg(*share).select("_row", F.array(*[F.col(f"s{i}") for i in range(self.numClasses)]).alias("_share"))
        best = (F.array_position("_share", F.array_max("_share")) - 1).cast("double")
        out = asked.join(found, "_row", "left").withColumn(self.getPredictionCol(), best)
        return out.withColumn(self.getProbabilityCol(), MF.array_to_vector("_share")).drop("_row", "_share")
