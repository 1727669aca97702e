"""Helpers shared by the operators that work on Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.core import col

# Words are runs of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` names it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), use), 0)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The table without the columns that would clash with new ones (names compare as in Spark)."""
    taken = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in taken])


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have at most `limit` bytes together; a longer text is a run of its own."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end and the offsets of each; nulls are empty."""
    whole = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = whole.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(whole) + 1 + whole.offset)[whole.offset :] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lists(values: np.ndarray | pa.Array, sizes: np.ndarray) -> pa.Array:
    """A list column from all items end to end and the size of each list."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))


def release(collect: bool = True) -> None:
    """Give freed memory back to the system, at the end of a task: Python workers are kept for later tasks."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
