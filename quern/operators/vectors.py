"""Exact nearest neighbours of a set of query vectors, and checks of a vector store."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.core import col, materialize, one_row

# Vectors packed into one row; every block of queries meets every block of items.
BLOCK_BYTES = 16 * 1024 * 1024
SLICE_ROWS = 1024
# Bytes of vectors that are measured again at once.
PIECE_BYTES = 8 * 1024 * 1024
# Blocks that a core should have, unless they would hold fewer rows than these.
CORE_BLOCKS, LEAST_ROWS = 2, 4096
# Bytes of two blocks that may be read many at a time.
LIGHT_BYTES = 4 * 1024 * 1024
# Rows of a leaf, leaves that are searched first, and most dimensions in which boxes around leaves rule out much.
LEAF_ROWS, FIRST_LEAVES, BOXED_DIMENSIONS = 256, 16, 16
# A row group for every few blocks: writers and readers hold a row group in memory.
BLOCK_FILES = {"parquet.block.size": str(2 * BLOCK_BYTES), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}

# A task gets whole files, each counted as some megabytes: small ones keep the blocks of a task, and so of an Arrow batch, few.
COUNT_FILES = {"maxRecordsPerFile": "2"}


def squared_distance(a: Column, b: Column) -> Column:
    """Σ (aᵢ − bᵢ)² of two numeric arrays, accumulated in double."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def dimensions(df: DataFrame, vector: str) -> tuple[int, int | None, int | None]:
    """(vectors, smallest dimension, largest dimension)."""
    size = F.size(col(vector))
    return tuple(one_row(df.where(col(vector).isNotNull()), F.count("*"), F.min(size), F.max(size)))


def _pack(table: pa.Table) -> pa.Table:
    """The blocks of a group of vectors, a row each: ids, and values end to end."""
    table = table.sort_by("block")
    values = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ids, block = table.column("i").combine_chunks(), table.column("block").to_numpy()
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    ends = np.append(starts, len(ids))
    packed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)
    at = np.append(0, np.cumsum(pc.list_value_length(table.column("v")).to_numpy()))[ends]
    return pa.table({"block": pa.array(block[starts], pa.int32()), "i": packed, "v": pa.array([values[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary())})


def _pack_counts(size: int):
    """Task function: rows (i, at, n) of a task as blocks of `size` rows, end to end, with the rows that have each position."""

    def block_of(held: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(held)
        at, n = (pa.concat_arrays([c.flatten() for c in table.column(name).chunks]) for name in ("at", "n"))
        lengths = pc.list_value_length(table.column("at")).to_numpy().astype(np.int32)
        found, rows = np.unique(at.to_numpy(zero_copy_only=False), return_counts=True)
        whole = [pa.concat_arrays(table.column("i").chunks), pa.array(lengths), at, n, pa.array(found.astype(np.int32)), pa.array(rows)]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in whole], names=["i", "lengths", "at", "n", "found", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            while len(table):
                part = table.slice(0, size - count)
                held, count, table = [*held, part], count + len(part), table.slice(len(part))
                if count == size:
                    yield block_of(held)
                    held, count = [], 0
        if count:
            yield block_of(held)

    return run


def blocks(rows: DataFrame, parts: int, counts: bool = False, groups: int | None = None) -> DataFrame:
    """(block, i, v): the vectors (i, v) packed into `parts` rows, those of a group of blocks by one call.

    The number of partitions is fixed: by their compressed size, many blocks of sparse vectors would meet in one task.
    Sparse `counts` (i, at, n) stay where they are, in blocks of `parts` rows of a task.
    """
    kind = rows.schema["i"].dataType.simpleString()
    if counts:
        return rows.mapInArrow(_pack_counts(parts), f"i array<{kind}>, lengths array<int>, at {rows.schema["at"].dataType.simpleString()}, n array<int>, found array<int>, rows array<bigint>")
    block = F.pmod(F.xxhash64("i", "v"), F.lit(parts)).cast("int")
    placed = rows.select(block.alias("block"), "i", col("v").cast("array<double>").alias("v")).withColumn("group", F.col("block") % (groups or parts))
    return placed.repartition(groups or parts, "group").groupBy("group").applyInArrow(lambda table: _pack(table.drop_columns("group")), f"block int, i array<{kind}>, v binary")


def _reached(kept: pd.DataFrame, n: int, k: int) -> np.ndarray:
    """Largest distance among the k kept items of each of n queries, infinite for those with fewer."""
    at = kept["q"].to_numpy()
    worst = np.full(n, -np.inf)
    np.maximum.at(worst, at, kept["distance"].to_numpy())
    return np.where(np.bincount(at, minlength=n) >= k, worst, np.inf)


def _best(q: np.ndarray, ids: np.ndarray, x: np.ndarray, items: np.ndarray, k: int, inner: bool, skip_self: bool, known: pd.DataFrame | None = None) -> pd.DataFrame:
    """The k best items of a block, and of those known before, for each of some queries: (q, item, distance).

    A rough distance rules out most items; whatever may be among the k best is measured again in full.
    """
    q_sq, x_sq = (q * q).sum(axis=1), (x * x).sum(axis=1)
    # Inner products are first taken in single precision, where its error (half of `slack`) is known.
    single = inner and max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < 1e15
    small = np.float32 if single else np.float64
    rough_q, rough_x = (-q if inner else q).astype(small, copy=False), x.astype(small, copy=False)
    own = 0
    if skip_self:
        codes = pd.factorize(np.concatenate([items, ids]))[0]
        names, own_names = codes[: len(items)], codes[len(items) :]
        own = int(np.bincount(names).max(initial=0))
    best = [] if known is None else [known]
    held = sum(map(len, best))
    reached = np.full(len(q), np.inf) if known is None else _reached(known, len(q), k)
    seen = held
    for start in range(0, len(x), SLICE_ROWS):
        part = x[start:start + SLICE_ROWS]
        rough = rough_q @ rough_x[start:start + SLICE_ROWS].T
        if not inner:
            rough = q_sq[:, None] + x_sq[None, start:start + SLICE_ROWS] - 2 * rough
        near, open_ = reached, ~np.isfinite(reached)
        if open_.any():
            last = min(k + own, rough.shape[1]) - 1
            near = np.where(open_, np.partition(rough, last, axis=1)[:, last].astype(np.float64), reached)
        if single:
            slack = 1e-30 + 2.0**-23 * (q.shape[1] + 4) * np.sqrt(q_sq * x_sq[start:start + SLICE_ROWS].max())
        else:
            slack = 1e-9 * (1 + np.abs(near) + q_sq)
        with np.errstate(over="ignore"):
            near = np.where(np.isfinite(near), near + slack, np.finfo(small).max).astype(small)
        if single:
            near = np.nextafter(near, np.float32(np.inf))
        # Far faster than `nonzero` in two dimensions.
        qi, xi = np.divmod(np.flatnonzero(rough <= near[:, None]), rough.shape[1])
        if skip_self:
            other = own_names[qi] != names[start + xi]
            qi, xi = qi[other], xi[other]
        if not len(qi):
            continue
        # Many items may be as near as the k-th: their vectors are laid side by side a piece at a time.
        exact, step = np.empty(len(qi)), max(1, PIECE_BYTES // (8 * max(q.shape[1], 1)))
        for at in range(0, len(qi), step):
            a, b = q[qi[at:at + step]], part[xi[at:at + step]]
            exact[at:at + step] = -(a * b).sum(axis=1) if inner else ((a - b) ** 2).sum(axis=1)
        best.append(pd.DataFrame({"q": qi, "item": items[start + xi], "distance": exact}))
        held += len(qi)
        # The sooner the distance to reach is known, the fewer items are measured again.
        if held >= max(2 * seen, k * len(q)):
            best = [_keep(best, k)]
            reached = _reached(best[0], len(q), k)
            held = seen = len(best[0])
    return _keep(best, k) if best else pd.DataFrame({"q": np.zeros(0, np.int64), "item": items[:0], "distance": np.zeros(0)})


def _leaves(x: np.ndarray) -> list[np.ndarray]:
    """Row numbers in leaves of neighbouring rows: halves along the widest dimension, and halves of these."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF_ROWS:
            done.append(rows)
            continue
        part = x[rows]
        wide = np.argmax(part.max(axis=0) - part.min(axis=0))
        order = np.argpartition(part[:, wide], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


def _first_copies(x: np.ndarray, items: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k smallest items of each distinct vector: ties go to the smaller id, so no other is found."""
    rank = np.empty(len(items), np.int64)
    rank[np.argsort(items, kind="stable")] = np.arange(len(items))
    order = np.lexsort((rank, *x.T))
    new = np.ones(len(x), bool)
    new[1:] = (x[order[1:]] != x[order[:-1]]).any(axis=1)
    starts = np.flatnonzero(new)
    place = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    return order[place < k]


class _Boxed:
    """A block of items in leaves with boxes around them, to search only those that can hold one of the k best."""

    def __init__(self, x: np.ndarray, items: np.ndarray, k: int):
        kept = _first_copies(x, items, k)
        leaves = _leaves(x[kept])
        at = kept[np.concatenate(leaves)]
        self.x, self.items = x[at], items[at]
        self.sizes = np.array([len(leaf) for leaf in leaves])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.low, self.high = np.minimum.reduceat(self.x, self.starts), np.maximum.reduceat(self.x, self.starts)

    def _rows(self, leaves: np.ndarray) -> np.ndarray:
        sizes = self.sizes[leaves]
        return np.repeat(self.starts[leaves] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())

    def _gaps(self, q: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Squared distance of every query from the box of every leaf."""
        total = np.zeros((len(q), len(leaves)))
        for d in range(q.shape[1]):
            at = q[:, d, None]
            total += np.maximum(np.maximum(self.low[leaves, d] - at, at - self.high[leaves, d]), 0.0) ** 2
        return total

    def best(self, q: np.ndarray, ids: np.ndarray, k: int, skip_self: bool) -> pd.DataFrame:
        """As `_best`, for neighbouring queries: the leaves next to them set the distance that others must reach."""
        gap = np.maximum(np.maximum(self.low - q.max(axis=0), q.min(axis=0) - self.high), 0.0)
        least = (gap * gap).sum(axis=1)
        order = np.argsort(least, kind="stable")
        enough = int(np.searchsorted(np.cumsum(self.sizes[order]), k + 1)) + 1
        first = max(enough, min(int((least == 0).sum()), FIRST_LEAVES))
        rows = self._rows(order[:first])
        found = _best(q, ids, self.x[rows], self.items[rows], k, False, skip_self)
        last = found["distance"].groupby(found["q"]).agg(["size", "max"])
        rest = order[first:]
        if len(last) == len(q) and last["size"].min() == k:
            bound = last["max"].to_numpy() * (1 + 1e-9)
            rest = rest[least[rest] <= bound.max()]
            rest = rest[(self._gaps(q, rest) <= bound[:, None]).any(axis=0)]
        if not len(rest):
            return found
        rows = self._rows(rest)
        return _keep([found, _best(q, ids, self.x[rows], self.items[rows], k, False, skip_self)], k)


def _found(q: np.ndarray, ids: np.ndarray, x: np.ndarray, items: np.ndarray, k: int, inner: bool, skip_self: bool, known: Sequence[pd.DataFrame] = ()) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
    """Some of the queries' ids and their best items, also of those known of each part, until all queries have been searched."""
    if inner or not 0 < x.shape[1] <= BOXED_DIMENSIONS or not (np.isfinite(x).all() and np.isfinite(q).all()):
        parts = [np.arange(at, min(at + SLICE_ROWS, len(ids))) for at in range(0, len(ids), SLICE_ROWS)]
        for n, rows in enumerate(parts):
            yield ids[rows], _best(q[rows], ids[rows], x, items, k, inner, skip_self, known[n] if known else None)
        return
    boxed = _Boxed(x, items, k + skip_self)
    for n, rows in enumerate(_leaves(q)):
        out = boxed.best(q[rows], ids[rows], k, skip_self)
        yield ids[rows], _keep([known[n], out], k) if known else out


def _dense(lengths: np.ndarray, at: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Vectors of length 1 from counts times weights, with the sums of Spark's Normalizer."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    values = n * weights[at]
    norm = np.sqrt(np.bincount(rows, values * values, minlength=len(lengths)))
    x = np.zeros((len(lengths), len(weights)))
    x[rows, at] = values / np.where(norm > 0, norm, 1.0)[rows]
    return x


def _search(k: int, inner: bool, skip_self: bool, kind: pa.DataType, item_kind: pa.DataType, weights: np.ndarray | None = None):
    """Task function: the best items of each query in every pair of blocks; with `weights`, items are sparse counts.

    Pairs with the same block of queries follow each other where the items are copied, or the queries are one block:
    these keep k items in all, and small blocks of items are searched together.
    """

    def batch_of(ids: np.ndarray, out: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids[out["q"].to_numpy()], kind), pa.array(out["item"].to_numpy(), item_kind), pa.array(out["distance"].to_numpy())], names=["query_id", "item_id", "distance"])

    def values(batch: pa.RecordBatch, row: int, *names: str) -> list[np.ndarray]:
        return [batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in names]

    def vectors(batch: pa.RecordBatch, row: int, c: str, n: int) -> np.ndarray:
        return np.frombuffer(batch.column(c)[row].as_buffer(), np.float64).reshape(n, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block of queries, its parts that have been searched, and blocks of items to be searched next.
        at, ids, q, done, waiting = None, None, None, [], []

        def searched() -> list:
            items, x = (np.concatenate(side) if len(side) > 1 else side[0] for side in zip(*waiting))
            return list(_found(q, ids, x, items, k, inner, skip_self, [out for _, out in done]))

        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column("asked")[row].as_py()
                if block != at:
                    done, waiting = searched() if waiting else done, []
                    yield from (batch_of(*part) for part in done)
                    at, done = block, []
                    (ids,) = values(batch, row, "qi")
                    q = vectors(batch, row, "qv", len(ids))
                (items,) = values(batch, row, "ii")
                x = vectors(batch, row, "iv", len(items)) if weights is None else _dense(*values(batch, row, "lengths", "at", "n"), weights)
                together = sum(len(held) for held, _ in waiting) + len(items)
                if waiting and (together > LEAST_ROWS or together * q.shape[1] * 8 > BLOCK_BYTES):
                    done, waiting = searched(), []
                waiting.append((items, x))
        done = searched() if waiting else done
        yield from (batch_of(*part) for part in done)

    return run


def _id(df: DataFrame, name: str) -> Column:
    """Ids travel as text or as whole numbers."""
    return col(name) if isinstance(df.schema[name].dataType, T.StringType) else col(name).cast("long")


def _keep(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    every = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
    q, distance = every["q"].to_numpy(), every["distance"].to_numpy()
    order = np.lexsort((distance, q))
    q, distance = q[order], distance[order]
    if ((q[1:] == q[:-1]) & (distance[1:] == distance[:-1])).any():
        every = every.sort_values(["q", "distance", "item"])
    else:
        every = every.iloc[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return every[place < k]


class Packed:
    """A table of vectors in stored blocks, for several searches of it."""

    def __init__(self, df: DataFrame, row_id: str, vector: str, block_rows: int | None = None):
        self.rows, self.low, self.high = dimensions(df, vector)
        size = block_rows or max(1, BLOCK_BYTES // (8 * max(self.high or 1, 1)))
        cores = df.sparkSession.sparkContext.defaultParallelism
        spare = 1 if block_rows else min(CORE_BLOCKS * cores, self.rows // LEAST_ROWS)
        self.parts = max(-(-self.rows // size), spare, 1)
        rows = df.where(col(vector).isNotNull()).select(_id(df, row_id).alias("i"), col(vector).alias("v"))
        self.id, self.weights = rows.schema["i"].dataType, None
        # Bytes of a block.
        self.bytes = -(-self.rows // self.parts) * 8 * (self.high or 1)
        groups = min(self.parts, max(-(-self.parts * self.bytes // BLOCK_BYTES), CORE_BLOCKS * cores))
        self.table = materialize(blocks(rows, self.parts, False, groups), "vectors", BLOCK_FILES) if self.rows else None


class PackedCounts:
    """Sparse counts (`at`, `n`) of `width` positions in stored blocks, as `Packed`.

    A vector is its counts times the `weights` given later, brought to length 1: it is made where it is searched.
    """

    def __init__(self, df: DataFrame, row_id: str, width: int):
        rows = df.select(_id(df, row_id).alias("i"), "at", "n")
        self.id, self.low, self.high, self.weights = rows.schema["i"].dataType, width, width, None
        size = max(1, BLOCK_BYTES // (8 * width))
        self.table = materialize(blocks(rows, size, True), "counts", BLOCK_FILES | COUNT_FILES)
        self.rows, self.parts, entries = (n or 0 for n in one_row(self.table, F.sum(F.size("i")), F.count("*"), F.max(F.size("at"))))
        self.bytes = 8 * entries

    def frequencies(self) -> np.ndarray:
        """Rows that have each position."""
        pairs = self.table.select(F.explode(F.arrays_zip("found", "rows")).alias("p")).groupBy("p.found").agg(F.sum("p.rows").alias("rows"))
        out = np.zeros(self.high)
        for r in pairs.collect():
            out[r["found"]] = r["rows"]
        return out


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vector: str = "vector",
    item_id: str = "item_id",
    item_vector: str = "vector",
    inner: bool = False,
    skip_self: bool = False,
    block_rows: int | None = None,
    packed: Packed | PackedCounts | None = None,
) -> DataFrame:
    """Exact k nearest items per query: (query_id, item_id, distance, score, rank).

    Both sides are packed into blocks of BLOCK_BYTES (or `block_rows` vectors). The blocks of the smaller side are
    copied to every block of the larger one and joined on its number (the items, if both have as many rows); each pair of
    blocks keeps k rows per query, or all pairs of a block of queries where the items are copied; these are merged per query.
    Where a side is one block and blocks are at most LIGHT_BYTES, nothing is dealt out: that block meets the others where they lie. A corpus `packed` before is not packed again. There are CORE_BLOCKS blocks of the larger side for every core, as long as they keep
    LEAST_ROWS rows. In up to BOXED_DIMENSIONS dimensions both blocks are cut into leaves, and a leaf of queries skips
    the leaves of items whose box is farther away than its k-th neighbours; in more, every pair is compared. Memory does not depend on the number of queries or items, nothing passes the driver
    but their counts. Distance is squared L2, or the negative inner product; ties go to the smaller item id.
    """
    store = packed or Packed(corpus, item_id, item_vector, block_rows)
    same = packed is None and queries is corpus and (query_id, query_vector) == (item_id, item_vector)
    asking = store if same else Packed(queries, query_id, query_vector, block_rows)
    n, items = asking.rows, store.rows
    if n and items and not asking.low == asking.high == store.low == store.high:
        raise ValueError(f"query dimension {asking.low}..{asking.high} does not fit item dimension {store.low}..{store.high}")
    schema = T.StructType([T.StructField("query_id", asking.id), T.StructField("item_id", store.id), T.StructField("distance", T.DoubleType())])
    if not n or not items or k <= 0:
        found = corpus.sparkSession.createDataFrame([], schema)
    else:
        payload = ["ii", "iv"] if store.weights is None else ["ii", "lengths", "at", "n"]
        rows = store.table.toDF("block", *payload) if store.weights is None else store.table.select(F.col("i").alias("ii"), *payload[1:])
        asked = asking.table.toDF("asked", "qi", "qv")
        if min(asking.parts, store.parts) == 1 and asking.bytes + store.bytes <= LIGHT_BYTES:
            # One light block meets the others where they lie.
            pairs = rows.crossJoin(asked).select("asked", "qi", "qv", *payload)
        else:
            parts = max(asking, store, key=lambda side: side.rows).parts
            if store.weights is not None:
                rows = rows.withColumn("block", F.pmod(F.xxhash64(F.get("ii", F.lit(0))), F.lit(parts)).cast("int"))
            asked = asked.withColumn("block", F.col("asked"))
            few, many = (asked, rows) if n < items else (rows, asked)
            copies = few.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            # More partitions than blocks, as few blocks should share one.
            pairs = copies.repartition(4 * parts, "block").join(many.repartition(4 * parts, "block").hint("shuffle_merge"), "block").select("asked", "qi", "qv", *payload)
        kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in schema.fields[:2]]
        found = pairs.mapInArrow(_search(k, inner, skip_self, *kinds, store.weights), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "item_id"))
    score = -F.col("distance") if inner else 1 / (1 + F.col("distance"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", F.round(score, 6))


def knn_predict(train: DataFrame, test: DataFrame, k: int, row_id: str, vector: str, target: str, weights: str = "uniform", regression: bool = False, skip_self: bool = False) -> DataFrame:
    """k-nearest-neighbour vote (smallest class on a tie) or mean: (row_id, prediction)."""
    hits = nearest(test, train, k, row_id, vector, row_id, vector, skip_self=skip_self)
    labels = train.select(_id(train, row_id).alias("item_id"), col(target).alias("target"))
    voted = hits.join(labels, "item_id")
    if weights == "distance":
        # An exact match outvotes everything else.
        weight = F.when(F.col("distance") == 0, F.lit(1e12)).otherwise(1 / F.sqrt("distance"))
    else:
        weight = F.lit(1.0)
    voted = voted.withColumn("w", weight)
    if regression:
        return voted.groupBy(F.col("query_id").alias(row_id)).agg((F.sum(F.col("w") * F.col("target")) / F.sum("w")).alias("prediction"))
    votes = voted.groupBy("query_id", "target").agg(F.sum("w").alias("w"))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("w"), "target"))
    return votes.withColumn("_r", first).where("_r = 1").select(F.col("query_id").alias(row_id), F.col("target").alias("prediction"))


def store_integrity(documents: DataFrame, vectors: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    """One row: vectors, documents, wrong dimensions, broken values, orphans both ways, status."""
    v = one_row(
        vectors,
        F.count("*").alias("vectors"),
        F.count_if(F.coalesce(F.size(col(vector)), F.lit(-1)) != dimension).alias("wrong_dimension"),
        F.count_if(F.exists(col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")))).alias("broken"),
    )
    total = documents.count()
    sides = documents.select(key, F.lit(1).alias("d"), F.lit(0).alias("v")).unionByName(vectors.select(key, F.lit(0).alias("d"), F.lit(1).alias("v")))
    gaps = sides.groupBy(key).agg(F.max("d").alias("d"), F.max("v").alias("v")).agg(
        F.count_if((F.col("d") == 1) & (F.col("v") == 0)).alias("without_vector"), F.count_if((F.col("d") == 0) & (F.col("v") == 1)).alias("without_document")
    )
    bad = (F.lit(v["wrong_dimension"] + v["broken"]) + F.col("without_vector") + F.col("without_document")) > 0
    status = F.lit("FAIL") if not v["vectors"] else F.when(bad | F.lit(v["vectors"] != total), "WARN").otherwise("PASS")
    measured = [F.lit(v[n]).alias(n) for n in ("vectors", "wrong_dimension", "broken")]
    return gaps.select(*measured, F.lit(total).alias("documents"), "without_vector", "without_document", status.alias("status"))
