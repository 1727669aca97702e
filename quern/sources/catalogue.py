"""Named sources: settings by category, defaults merged under them, one call to load."""

from __future__ import annotations

import copy
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.sources import files, payloads, workbooks

log = logging.getLogger("quern.sources")


class SourceError(ValueError):
    """A source is unknown or could not be read."""


def _csv(spark: SparkSession, s: dict) -> DataFrame:
    keys = ("delimiter", "encoding", "has_header", "dtype_overrides", "parse_dates", "schema")
    return files.read_csv(spark, s.get("path"), **{k: s[k] for k in keys if k in s})


def _json(spark: SparkSession, s: dict) -> DataFrame:
    keys = ("record_path", "normalize", "encoding", "lines", "schema")
    return files.read_json(spark, s.get("path"), **{k: s[k] for k in keys if k in s})


def _excel(spark: SparkSession, s: dict) -> DataFrame:
    keys = ("sheet_name", "header_row", "skip_rows", "dtype_overrides")
    return workbooks.read_workbooks(spark, files.require_path(spark, s.get("path"), "Excel"), **{k: s[k] for k in keys if k in s})


def _landed(spark: SparkSession, s: dict) -> DataFrame:
    """Payload files landed by a fetcher: one payload per file, or page files when paginated."""
    from pyspark.sql import functions as F

    raw = spark.read.option("wholetext", True).text(files.require_path(spark, s.get("path"), "API"))
    if not s.get("paginate"):
        return payloads.read_payloads(raw, "value", s.get("schema"))
    paged = raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("int").alias("page"), "value")
    return payloads.assemble_pages(paged, "page", "value", s.get("pagination", {}).get("page_size", 100), schema=s.get("schema"))


READERS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {
    "csv_sources": _csv,
    "excel_sources": _excel,
    "json_sources": _json,
    "api_sources": _landed,
}


class Catalogue:
    """Settings tree: category → name → settings, plus `defaults` per kind."""

    def __init__(self, settings: dict | str):
        if isinstance(settings, str):
            with open(settings, encoding="utf-8") as f:
                if settings.endswith(".json"):
                    settings = json.load(f)
                else:
                    import yaml

                    settings = yaml.safe_load(f)
        self.settings = settings or {}

    def list_sources(self, category: str | None = None) -> dict[str, list[str]]:
        wanted = [category] if category else sorted(READERS)
        return {c: list(self.settings.get(c, {})) for c in wanted}

    def get_source(self, category: str, name: str) -> dict:
        if not isinstance(category, str) or category not in READERS:
            raise SourceError(f"unknown category '{category}', expected one of {sorted(READERS)}")
        known = self.settings.get(category, {})
        if not isinstance(name, str) or not name:
            raise SourceError("the source name must be a non-empty text")
        if name not in known:
            raise SourceError(f"source '{name}' not found under '{category}', available: {list(known)}")
        defaults = self.settings.get("defaults", {}).get(category.replace("_sources", ""), {})
        return {**copy.deepcopy(defaults), **copy.deepcopy(known[name])}

    def ingest(self, spark: SparkSession, category: str, name: str) -> DataFrame:
        """Load one source; a failing read names the source, an empty one warns."""
        source = self.get_source(category, name)
        try:
            df = READERS[category](spark, source)
        except Exception as exc:
            raise SourceError(f"[{name}] failed to read source: {exc}") from exc
        if df.isEmpty():
            log.warning("[%s] loaded table is empty", name)
        return df
