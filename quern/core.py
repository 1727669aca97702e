"""Helpers shared by every module: session, scratch space, size checks, tidy reports."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Most distinct values that may become columns, literals or a driver-side list.
LEVEL_LIMIT = 10_000


def get_session(app: str = "quern", cores: str | None = None) -> SparkSession:
    """A session with adaptive execution on; on a cluster the submitted settings win."""
    builder = SparkSession.builder.appName(app)
    if cores:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.driver.memory", "12g")
            .config("spark.sql.shuffle.partitions", cores)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    spark = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder path under the shared checkpoint folder of the session.

    Only a local master may fall back to the machine's temporary folder: on a cluster
    the executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", base)
    stamp = f"{label}-{os.getpid()}-{os.urandom(6).hex()}"
    return base.rstrip("/") + "/" + stamp


def materialize(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a table to shared storage and read it back: cuts lineage, survives lost executors."""
    path = scratch_dir(df.sparkSession, label)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str, *cols: str) -> DataFrame:
    """One of the given parquet tables, optionally pruned to the named columns."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*cols) if cols else df


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a few files out to all cores before work that is heavy per row.

    A table in fewer files than cores would keep most cores idle. Larger tables pass through
    without a shuffle, as their files already fill the cluster.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def one_row(df: DataFrame, *aggs: Column):
    """A single row of aggregates on the driver."""
    return df.agg(*aggs).collect()[0]


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by its exact name, also when the name holds dots or spaces."""
    return F.col(quote(name))


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replace or append columns in one projection, keeping the column order."""
    kept = [new[c].alias(c) if c in new else col(c) for c in df.columns]
    added = [e.alias(c) for c, e in new.items() if c not in df.columns]
    return df.select(*kept, *added)


def per_column(
    df: DataFrame,
    cols: Sequence[str],
    measures: dict[str, Callable[[str], Column]],
) -> DataFrame:
    """One aggregate pass over many columns, returned as one row per column."""
    aggs = [f(c).alias(f"v{i}_{m}") for i, c in enumerate(cols) for m, f in measures.items()]
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"v{i}_{m}").alias(m) for m in measures])
        for i, c in enumerate(cols)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def bounded_levels(df: DataFrame, column: str, limit: int = LEVEL_LIMIT) -> list:
    """Sorted distinct non-missing values, refused beyond the limit."""
    rows = df.select(col(column)).where(col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"column '{column}' has more than {limit} levels")
    return sorted(r[0] for r in rows)


def attach(df: DataFrame, stats: DataFrame, keys: Iterable[str], how: str = "left") -> DataFrame:
    """Join per-group statistics back to the rows.

    There is no broadcast hint: Spark broadcasts the statistics only when their measured
    size is under its threshold, and otherwise splits hot keys of the sort-merge join.
    """
    return df.join(stats, list(keys), how)


def explode_rows(df: DataFrame, keep: Sequence[Column | str], items: Column, value: str, position: str = "_at") -> DataFrame:
    """One row per array item with its position.

    A plain explode makes Spark add a filter on the size of the array below it, which computes
    an expensive array (tokens, chunks, parsed payloads) twice; the outer form does not.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(position, value)).where(F.col(position).isNotNull())


def hash_unit(*cols: Column, seed: int = 42) -> Column:
    """Reproducible number in [0, 1) from the md5 of the key text and a seed."""
    text = F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def describe_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small report table built from values already on the driver."""
    return spark.createDataFrame(rows, schema)
