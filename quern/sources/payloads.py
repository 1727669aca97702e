"""Landed API payloads: unwrapping envelopes and assembling pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.core import explode_rows

# Envelope keys in order of precedence.
ENVELOPE_KEYS = ["results", "records", "data", "items"]


def unwrap(payload: Column) -> Column:
    """Records of a JSON payload as an array of JSON values: a bare list, the first list under an
    envelope key, else the object itself; text that is no list or object gives no records."""
    value = F.try_parse_json(payload)
    kind = F.schema_of_variant(value)
    bare = F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
    lists = [F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")).startswith("ARRAY"), F.try_variant_get(value, f"$.{k}", "array<variant>")) for k in ENVELOPE_KEYS]
    single = F.when(kind.startswith("OBJECT"), F.array(value))
    return F.coalesce(bare, *lists, single, F.array().cast("array<variant>"))


def read_payloads(df: DataFrame, payload: str, schema: str | T.StructType | None = None, keys: list[str] | None = None) -> DataFrame:
    """One row per record, typed by `schema` or as JSON text in `record`."""
    keys = keys or []
    rows = explode_rows(df, keys, unwrap(F.col(payload)), "_v", "position")
    text = rows.select(*keys, "position", F.to_json("_v").alias("record"))
    if schema is None:
        return text
    return text.select(*keys, "position", F.from_json("record", schema).alias("r")).select(*keys, "position", "r.*")


def assemble_pages(df: DataFrame, page: str, payload: str, page_size: int, keys: list[str] | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """Records of the pages up to the first empty page, or the first page shorter than the page
    size; with `keys` several sources are assembled at once."""
    keys = keys or []
    sized = df.withColumn("_n", F.size(unwrap(F.col(payload))))
    ends = sized.where(F.col("_n") < page_size).groupBy(*keys).agg(F.min(page).alias("_last"))
    joined = sized.join(ends, keys, "left") if keys else sized.withColumn("_last", F.lit(ends.collect()[0]["_last"]))
    wanted = joined.where(F.col("_last").isNull() | (F.col(page) <= F.col("_last"))).drop("_n", "_last")
    return read_payloads(wanted, payload, schema, [*keys, page])
