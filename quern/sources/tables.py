"""Row tables kept as parquet folders: create, insert, read, page, update, delete.

A table is a folder of versions. An insert adds a parquet folder of its own to the newest version; an update or delete
writes the whole changed table as the next version, which counts once it is complete. Writers of one process take turns.
Several processes that write the same table at the same time need a table format with transactions, which is left to the cluster.
"""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.core import col, one_row
from quern.operators import ordered

_turn = threading.Lock()


class TableError(ValueError):
    """A table is missing or a request is unsafe."""


def sample_types(record: dict[str, Any]) -> dict[str, str]:
    """Column types from a first record: float → double, int → bigint, everything else text."""
    return {k: "double" if isinstance(v, float) else "bigint" if isinstance(v, int) else "string" for k, v in record.items()}


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- versions ---------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _version(self, table: str) -> int:
        """Number of the newest complete version, 0 where there is none."""
        fs, p = self._fs(f"{self.root}/{table}")
        found = fs.globStatus(self._fs(f"{p}/v*/rows/_SUCCESS")[1]) if fs.exists(p) else []
        return max((int(s.getPath().getParent().getParent().getName()[1:]) for s in found), default=0)

    def _folder(self, table: str) -> str:
        """Folder of the newest version: the rows it began with, and those added since."""
        version = self._version(table)
        if not version:
            raise TableError(f"no such table: {table}")
        return f"{self.root}/{table}/v{version}"

    def exists(self, table: str) -> bool:
        return self._version(table) > 0

    # ---- schema -----------------------------------------------------------------------

    def create(self, table: str, columns: dict[str, str], if_not_exists: bool = True, auto_id: bool = False) -> None:
        if self.exists(table):
            if if_not_exists:
                return
            raise TableError(f"table '{table}' already exists")
        types = {**columns, **({"id": "bigint"} if auto_id else {})}
        empty = self.spark.createDataFrame([], T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in types.items())))
        empty.write.parquet(f"{self.root}/{table}/v1/rows")

    def drop(self, table: str, if_exists: bool = True) -> None:
        if not self.exists(table) and not if_exists:
            raise TableError(f"no such table: {table}")
        fs, p = self._fs(f"{self.root}/{table}")
        fs.delete(p, True)

    def frame(self, table: str) -> DataFrame:
        """All rows of the newest version; inserts that are still running do not show."""
        folder = self._folder(table)
        schema = self.spark.read.parquet(f"{folder}/rows").schema
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)

    # ---- rows -------------------------------------------------------------------------

    def insert(self, table: str, rows: DataFrame | Sequence[dict[str, Any]], order: Sequence[str] = ()) -> int:
        """Append rows and return how many were written; an empty list writes none.

        Where the table has an automatic id, a list is numbered as given and a DataFrame by `order`.
        """
        schema = self.frame(table).schema
        numbered = "id" in schema.names
        if not isinstance(rows, DataFrame):
            rows = [rows] if isinstance(rows, dict) else list(rows)
            if not rows:
                return 0
            numbered = numbered and "id" not in rows[0]
            names = [n for n in schema.names if not (numbered and n == "id")]
            unknown = sorted({k for r in rows for k in r} - set(schema.names))
            plain = [{k: str(v) if isinstance(v, (dt.date, dt.datetime)) else v for k, v in r.items()} for r in rows]
            if numbered:
                plain, names = [{**r, "_place": i + 1} for i, r in enumerate(plain)], [*names, "_place"]
            fields = T.StructType([schema[n] if n in schema.names else T.StructField(n, T.LongType()) for n in names])
            rows = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in plain], fields)
        else:
            numbered = numbered and "id" not in rows.columns
            unknown = [c for c in rows.columns if c not in schema.names]
            if numbered and not order:
                raise TableError("numbering a DataFrame needs an order column")
            rows = ordered.position(rows, [], order, "_place") if numbered else rows
        if unknown:
            raise TableError(f"table '{table}' has no column {unknown}")
        with _turn:
            if numbered:
                last = one_row(self.frame(table), F.max("id"))[0] or 0
                rows = rows.withColumn("id", F.col("_place") + last).drop("_place")
            fitted = rows.select(*[(col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
            return self._write(fitted, f"{self._folder(table)}/added-{uuid.uuid4().hex}")

    def _write(self, df: DataFrame, path: str) -> int:
        """Rows written, counted from the new files' footers.

        An Observation would count while writing, but it leaves the session unserialisable, which
        breaks scoring with models whose training summary refers to it.
        """
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).count()

    def _where(self, df: DataFrame, where: dict[str, Any] | None) -> Column:
        """Equality filters combined with AND; a value of another type is converted to the column's."""
        tests = [col(c) == F.lit(v).try_cast(df.schema[c].dataType) for c, v in (where or {}).items()]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def read(self, table: str, columns: Sequence[str] = ("*",), where: dict[str, Any] | None = None, order_by: str | None = None, limit: int | None = None) -> DataFrame:
        df = self.frame(table)
        out = df.where(self._where(df, where)) if where else df
        if order_by:
            name, _, way = order_by.partition(" ")
            out = out.orderBy(col(name).desc() if way.strip().lower() == "desc" else col(name).asc())
        out = out if tuple(columns) == ("*",) else out.select(*[col(c) for c in columns])
        return out.limit(limit) if limit else out

    def read_one(self, table: str, where: dict[str, Any]) -> dict | None:
        rows = self.read(table, where=where, limit=1).collect()
        return rows[0].asDict() if rows else None

    def page(self, table: str, offset: int = 0, limit: int | None = None, where: dict[str, Any] | None = None, order_by: str = "id") -> DataFrame:
        """Rows after `offset` in id order; a missing or zero limit means all the rest."""
        out = self.read(table, where=where, order_by=order_by).offset(offset)
        return out.limit(limit) if limit else out

    def count(self, table: str, where: dict[str, Any] | None = None) -> int:
        return self.read(table, where=where).count()

    # ---- rewriting --------------------------------------------------------------------

    def _rewrite(self, table: str, where: dict[str, Any], change: Callable[[DataFrame, Column], DataFrame]) -> int:
        """Write change(rows, hit) as the next version and return how many rows were hit."""
        with _turn:
            version, df = self._version(table), self.frame(table)
            hit = F.coalesce(self._where(df, where), F.lit(False))
            hits = df.where(hit).count()
            if hits:
                change(df, hit).write.mode("overwrite").parquet(f"{self.root}/{table}/v{version + 1}/rows")
            return hits

    def update(self, table: str, changes: dict[str, Any], where: dict[str, Any]) -> int:
        def changed(df: DataFrame, hit: Column) -> DataFrame:
            new = {c: F.when(hit, F.lit(v).cast(df.schema[c].dataType)).otherwise(col(c)) for c, v in changes.items()}
            return df.select(*[new.get(c, col(c)).alias(c) for c in df.columns])

        return self._rewrite(table, where, changed)

    def delete(self, table: str, where: dict[str, Any]) -> int:
        if not where:
            raise TableError("delete needs a filter, so that it cannot wipe the table")
        return self._rewrite(table, where, lambda df, hit: df.where(~hit))
