"""Random forests of regression trees over few distinct feature rows ("cells"), as an estimator beside the Spark ML ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml import functions as MF
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from quern.core import col

# Most distinct feature rows, and bytes of the sums that a task keeps for all trees; most distinct values of a feature (Spark's bins).
MOST_CELLS, SUM_BYTES, BINS = 10_000, 64 * 1024 * 1024, 32
DRAWS = 1 << 16


def _poisson() -> tuple[np.ndarray, np.ndarray]:
    """Poisson(1) counts by 16 random bits, 255 where these do not settle it, and the chances of at most 0, 1, 2, ..."""
    chance = [np.exp(-1.0)]
    for n in range(1, 30):
        chance.append(chance[-1] / n)
    upto = np.cumsum(chance)
    low, high = (np.searchsorted(upto, (np.arange(DRAWS) + end) / DRAWS, side="right") for end in (0, 1))
    return np.where(low == high, low, 255).astype(np.uint8), upto


def bootstrap(rng: np.random.Generator, rows: int, trees: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How often each row is drawn for each tree."""
    bits = rng.integers(0, DRAWS, (rows, trees), dtype=np.uint16)
    drawn = table[0][bits]
    open_ = np.flatnonzero(drawn == 255)
    drawn.flat[open_] = np.searchsorted(table[1], (bits.flat[open_] + rng.random(len(open_))) / DRAWS, side="right")
    return drawn


def _coded(cells: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The number of the cell of each row; every row has one."""
    place, size = np.zeros(len(x), np.int64), 1
    at = np.zeros(len(cells), np.int64)
    for f in range(cells.shape[1]):
        values = np.unique(cells[:, f])
        place, at, size = place * len(values) + np.searchsorted(values, x[:, f]), at * len(values) + np.searchsorted(values, cells[:, f]), size * len(values)
    order = np.argsort(at)
    return order[np.searchsorted(at, place, sorter=order)]


def _sums(cells: np.ndarray, trees: int, center: float, seed: int):
    """Task function: drawn rows, their sum and sum of squares, of every tree and cell; a row for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        rng, table = np.random.default_rng([seed, task.partitionId() if task else 0]), _poisson()
        total = np.zeros((3, len(cells), trees))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = batch.column("y").to_numpy(zero_copy_only=False) - center
            cell = _coded(cells, x)
            order = np.argsort(cell, kind="stable")
            cell, y = cell[order], y[order]
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            drawn = bootstrap(rng, len(y), trees, table).astype(np.float64)
            for power in range(3):
                total[power, cell[starts]] += np.add.reduceat(drawn, starts)
                if power < 2:
                    drawn *= y[:, None]
        yield pa.RecordBatch.from_pydict({"tree": pa.array(range(trees), pa.int32()), "sums": [np.ascontiguousarray(total[:, :, t]).tobytes() for t in range(trees)]})

    return run


def grow(cells: np.ndarray, sums: np.ndarray, depth: int, tried: int, least: float, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature or -1, threshold, left, right, mean) of a tree by variance, as Spark's: `tried` features a node, cuts half-way."""
    values = [np.unique(cells[:, f], return_inverse=True) for f in range(cells.shape[1])]
    nodes: list = [None]
    todo = [(0, np.flatnonzero(sums[0] > 0), 0)]
    while todo:
        at, rows, level = todo.pop()
        n, s, ss = sums[:, rows].sum(axis=1) if len(rows) else np.zeros(3)
        mean = s / n if n else 0.0
        spread = ss - n * mean * mean
        best = (0.0, -1, 0)
        for f in rng.permutation(cells.shape[1])[:tried] if level < depth and spread > 0 else ():
            code, size = values[f][1][rows], len(values[f][0])
            left = np.cumsum([np.bincount(code, part, size) for part in sums[:, rows]], axis=1)[:, :-1]
            right = np.array([[n], [s], [ss]]) - left
            valid = (left[0] >= least) & (right[0] >= least)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(valid, left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - n * mean * mean, -np.inf)
            if len(gain) and gain.max() > max(best[0], 1e-12 * spread):
                best = (gain.max(), f, int(np.argmax(gain)))
        if best[1] < 0:
            nodes[at] = (-1, 0.0, 0, 0, mean)
            continue
        _, f, cut = best
        low = values[f][1][rows] <= cut
        nodes[at] = (int(f), float(values[f][0][cut] + values[f][0][cut + 1]) / 2, len(nodes), len(nodes) + 1, mean)
        todo += [(len(nodes), rows[low], level + 1), (len(nodes) + 1, rows[~low], level + 1)]
        nodes += [None, None]
    return nodes


class _Settings(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "most levels of splits", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the draws", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(numTrees=100, maxDepth=10, seed=42, featuresCol="features", labelCol="label", predictionCol="prediction")

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)

    def setPredictionCol(self, value: str):
        return self._set(predictionCol=value)


class CellForest(Estimator, _Settings):
    """The forest of Spark's RandomForestRegressor: each tree draws every row Poisson(1) times and tries a third of the features a node.

    Where rows have few distinct features, a split depends only on the drawn rows, their sum and sum of squares in each
    cell: one pass over the rows makes these for all trees, and a tree grows from its own. Other rows go to Spark's forest.
    """

    @keyword_only
    def __init__(self, *, numTrees: int = 100, maxDepth: int = 10, seed: int = 42):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        trees, depth, seed = (self.getOrDefault(p) for p in (self.numTrees, self.maxDepth, self.seed))
        given = dataset.select(MF.vector_to_array(col(self.getFeaturesCol())).alias("v"), col(self.getLabelCol()).cast("double").alias("y"))
        most = min(MOST_CELLS, SUM_BYTES // (24 * trees))
        found = given.groupBy("v").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.count_if(F.col("y").isNull() | F.isnan("y")).alias("bad")).limit(most + 1).collect()
        cells = np.array(sorted(tuple(x + 0.0 for x in r["v"]) for r in found))
        if not 0 < len(found) <= most or any(r["bad"] for r in found) or not np.isfinite(cells).all() or max(len(np.unique(c)) for c in cells.T) > BINS:
            plain = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), predictionCol=self.getPredictionCol())
            return plain.fit(dataset)
        # -0.0 and 0.0 are one value.
        cells = np.unique(cells, axis=0)
        center = sum(r["s"] for r in found) / sum(r["n"] for r in found)
        tried = -(-cells.shape[1] // 3) if trees > 1 else cells.shape[1]

        def grown(table: pa.Table) -> pa.Table:
            tree = table.column("tree")[0].as_py()
            sums = sum(np.frombuffer(b.as_buffer(), np.float64) for b in table.column("sums")).reshape(3, -1)
            nodes = grow(cells, sums, depth, tried, 1.0, np.random.default_rng([seed, 1, tree]))
            return pa.table({name: pa.array(part, kind) for name, part, kind in zip(("feature", "threshold", "left", "right", "mean"), zip(*nodes), (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64()))} | {"tree": pa.array([tree] * len(nodes), pa.int32()), "node": pa.array(range(len(nodes)), pa.int32())})

        # One task a core: each hands on the sums of all trees.
        sums = given.coalesce(dataset.sparkSession.sparkContext.defaultParallelism).mapInArrow(_sums(cells, trees, center, seed), "tree int, sums binary")
        nodes = sums.groupBy("tree").applyInArrow(grown, "feature int, threshold double, left int, right int, mean double, tree int, node int").toPandas().sort_values(["tree", "node"])
        nodes["mean"] += center
        return self._copyValues(CellForestModel(nodes, cells.shape[1]))


class CellForestModel(Model, _Settings):
    """Nodes of all trees; a prediction is the mean of the trees'."""

    def __init__(self, nodes: pd.DataFrame | None = None, width: int = 0):
        super().__init__()
        self.nodes, self.width = nodes, width

    def copy(self, extra=None) -> CellForestModel:
        made = super().copy(extra)
        made.nodes, made.width = self.nodes, self.width
        return made

    def predict(self, rows: np.ndarray) -> np.ndarray:
        total, trees = np.zeros(len(rows)), 0
        for _, part in self.nodes.groupby("tree"):
            feature, threshold, left, right, mean = (part[c].to_numpy() for c in ("feature", "threshold", "left", "right", "mean"))
            at = np.zeros(len(rows), np.int64)
            while (feature[at] >= 0).any():
                low = rows[np.arange(len(rows)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(feature[at] >= 0, np.where(low, left[at], right[at]), at)
            total += mean[at]
            trees += 1
        return total / trees

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model = CellForestModel(self.nodes, self.width)
        features = MF.vector_to_array(col(self.getFeaturesCol()))

        @pandas_udf("double")
        def predicted(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            known: dict[bytes, float] = {}
            for columns in batches:
                # A single column comes without its tuple.
                rows, back = np.unique(np.column_stack(columns if isinstance(columns, tuple) else (columns,)).astype(np.float64), axis=0, return_inverse=True)
                keys = [row.tobytes() for row in rows]
                new = [i for i, key in enumerate(keys) if key not in known]
                if len(known) + len(new) > MOST_CELLS:
                    known.clear()
                    new = list(range(len(keys)))
                if new:
                    known.update(zip([keys[i] for i in new], model.predict(rows[new])))
                yield pd.Series(np.array([known[key] for key in keys], np.float64)[back.reshape(-1)])

        return dataset.withColumn(self.getPredictionCol(), predicted(*[F.get(features, F.lit(i)) for i in range(self.width)]))
