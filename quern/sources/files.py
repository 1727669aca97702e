"""File sources and sinks: csv, json, json lines, parquet, and loading by extension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.core import col, replace_columns
from quern.sources import workbooks


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require_path(spark: SparkSession, path: str | None, kind: str) -> str:
    if not path:
        raise ValueError(f"{kind} settings are missing the required key 'path'")
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return path


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    encoding: str = "utf-8",
    has_header: bool = True,
    dtype_overrides: dict[str, str] | None = None,
    parse_dates: Sequence[str] | None = None,
    schema: str | T.StructType | None = None,
) -> DataFrame:
    """Delimited text. Types are inferred unless a schema is given (give one for large input:
    inferring reads the data twice); overrides and date columns are converted afterwards,
    unreadable values becoming missing. Headerless files get the positions as names."""
    require_path(spark, path, "CSV")
    reader = spark.read.option("sep", delimiter).option("encoding", encoding).option("header", has_header)
    # Columns with an override or a date keep their text until they are converted.
    raw = reader.schema(schema) if schema is not None else reader.option("inferSchema", True).option("prefersDate", True)
    df = raw.csv(path)
    if schema is None and dtype_overrides:
        kept = [T.StructField(f.name, T.StringType() if f.name in dtype_overrides else f.dataType) for f in df.schema.fields]
        df = spark.read.option("sep", delimiter).option("encoding", encoding).option("header", has_header).schema(T.StructType(kept)).csv(path)
    if not has_header and schema is None:
        df = df.toDF(*[str(i) for i in range(len(df.columns))])
    new: dict[str, Column] = {c: col(c).try_cast(t) for c, t in (dtype_overrides or {}).items() if c in df.columns}
    new.update({c: F.try_to_timestamp(col(c).cast("string")) for c in parse_dates or [] if c in df.columns})
    return replace_columns(df, new)


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects as dotted columns, at any depth; lists stay as values."""

    def leaves(kind: T.StructType, at: Column | None, name: str):
        for f in kind.fields:
            inner = col(f.name) if at is None else at.getField(f.name)
            label = f"{name}.{f.name}" if name else f.name
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, inner, label)
            else:
                yield inner.alias(label)

    return df.select(*leaves(df.schema, None, ""))


def walk_records(df: DataFrame, record_path: str | None) -> DataFrame:
    """Rows of the list found at a dotted path; the error names the key that is absent."""
    if not record_path:
        return df
    kind, at = df.schema, None
    for key in record_path.split("."):
        if not isinstance(kind, T.StructType) or key not in kind.names:
            raise KeyError(f"record_path '{record_path}' is invalid: key '{key}' not found")
        at = col(key) if at is None else at.getField(key)
        kind = kind[key].dataType
    rows = df.select((F.explode(at) if isinstance(kind, T.ArrayType) else at).alias("r"))
    inner = rows.schema["r"].dataType
    return rows.select("r.*") if isinstance(inner, T.StructType) else rows.withColumnRenamed("r", "0")


def read_json(spark: SparkSession, path: str, record_path: str | None = None, normalize: bool = True, encoding: str = "utf-8", lines: bool = False, schema: str | T.StructType | None = None) -> DataFrame:
    require_path(spark, path, "JSON")
    reader = spark.read.option("multiLine", not lines).option("encoding", encoding)
    records = walk_records((reader.schema(schema) if schema is not None else reader).json(path), record_path)
    return flatten(records) if normalize else records


def extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """csv (all text), json (an object is one row) or jsonl (blank lines skipped); others are refused."""
    kind = extension(path)
    if kind == ".csv":
        return spark.read.option("header", True).csv(require_path(spark, path, "CSV"))
    if kind in (".json", ".jsonl"):
        return read_json(spark, path, normalize=False, lines=kind == ".jsonl")
    raise ValueError(f"unsupported file type: '{kind}'")


def load_table(spark: SparkSession, path: str, file_type: str | None = None, **options) -> DataFrame:
    """csv, excel or parquet by extension; an unknown extension is read as csv."""
    by_name = {".csv": "csv", ".xlsx": "excel", ".xls": "excel", ".parquet": "parquet"}
    kind = file_type or by_name.get(extension(path), "csv")
    if kind not in ("csv", "excel", "parquet"):
        raise ValueError(f"unsupported file type: '{kind}'")
    require_path(spark, path, kind)
    if kind == "parquet":
        return spark.read.options(**options).parquet(path)
    if kind == "excel":
        return workbooks.read_workbooks(spark, path, **options)
    return read_csv(spark, path, **options)


def records_table(spark: SparkSession, records: Sequence[dict], schema: str | T.StructType) -> DataFrame:
    """Table of a few records already on the driver; absent keys become missing."""
    names = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], schema)


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported format '{fmt}'")


def map_chunks(df: DataFrame, fn, schema: str | T.StructType, rows: int | None = None) -> DataFrame:
    """Apply a table-to-table pandas function chunk by chunk, wherever the chunks lie.

    The chunk size is the session's Arrow batch size; `rows` splits batches further.
    """

    def run(batches):
        for batch in batches:
            step = rows or max(1, len(batch))
            for start in range(0, len(batch), step):
                yield fn(batch.iloc[start:start + step])

    return df.mapInPandas(run, schema)
