"""Hooks for user-supplied functions, all moved in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.core import col


def value_check(fn: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """A validation predicate over whole batches of values, usable as a rule's custom check."""
    return F.pandas_udf(lambda s: fn(s).astype(bool), T.BooleanType())


def text_scorer(fn: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """A sentiment scorer giving values in [-1, 1] for batches of texts."""
    return F.pandas_udf(lambda s: fn(s).clip(-1.0, 1.0).astype(float), T.DoubleType())


def column_of(df: DataFrame, columns: list[str], fn: Callable[[pd.DataFrame], pd.Series], dtype: T.DataType, out: str) -> DataFrame:
    """Add a column computed by a table-to-column pandas function, in parallel over batches.

    The function must treat rows independently: a batch is any run of rows.
    """

    def run(rows: pd.DataFrame) -> pd.Series:
        return fn(rows)

    return df.withColumn(out, F.pandas_udf(run, dtype)(F.struct(*[col(c) for c in columns])))
