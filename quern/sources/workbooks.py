"""Bulk reading of spreadsheet and word-processor files: one file per row in, plain rows out."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.core import bounded_levels, col

_CELL_ROWS = 5_000


def binary_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, content) of the files under a folder whose names match the pattern."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def _tag(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _tag(t) == "t")


def _position(ref: str) -> int:
    """Zero-based column of a cell reference such as AB12."""
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _sheet_rows(content: bytes) -> Iterator[tuple[str, int, list]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_texts(n) for n in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _tag(n) == "si"]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (n for n in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _tag(n) == "sheet"):
            target = next(links[v] for k, v in sheet.attrib.items() if k.endswith("}id"))
            target = target.lstrip("/") if target.startswith("/") else "xl/" + target
            with z.open(target) as stream:
                for _, row in ElementTree.iterparse(stream):
                    if _tag(row) != "row":
                        continue
                    cells: dict[int, str | None] = {}
                    for c in row:
                        kind = c.get("t")
                        value = next((v.text for v in c if _tag(v) == "v"), None)
                        if kind == "inlineStr":
                            value = _texts(c)
                        elif kind == "s" and value is not None:
                            value = shared[int(value)]
                        elif kind == "b" and value is not None:
                            value = "true" if value == "1" else "false"
                        cells[_position(c.get("r")) if c.get("r") else len(cells)] = value
                    width = max(cells, default=-1) + 1
                    yield sheet.get("name"), int(row.get("r")), [cells.get(i) for i in range(width)]
                    row.clear()


def parse_workbooks(files: DataFrame) -> DataFrame:
    """(path, sheet, sheet_no, row_no, cells) of all sheets of all workbooks."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                out, order = [], {}
                for sheet, row_no, cells in _sheet_rows(content):
                    out.append((path, sheet, order.setdefault(sheet, len(order)), row_no, cells))
                    if len(out) >= _CELL_ROWS:
                        yield pd.DataFrame(out, columns=["path", "sheet", "sheet_no", "row_no", "cells"])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["path", "sheet", "sheet_no", "row_no", "cells"])

    return files.mapInPandas(run, "path string, sheet string, sheet_no int, row_no int, cells array<string>")


def promote_header(rows: DataFrame, header_row: int = 0, skip_rows: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Name the cells by each sheet's header row; rows above it are dropped.

    Gives path, sheet, row_no and one text column per header name found in any sheet.
    """
    at = header_row + skip_rows + 1
    header = rows.where(F.col("row_no") == at).select("path", "sheet", F.col("cells").alias("_names"))
    body = rows.where(F.col("row_no") > at).join(header, ["path", "sheet"])
    if columns is None:
        columns = bounded_levels(header.select(F.explode("_names").alias("name")), "name", 16_384)
    size = F.least(F.size("_names"), F.size("cells"))
    known = F.filter(F.arrays_zip(F.slice("_names", F.lit(1), size).alias("k"), F.slice("cells", F.lit(1), size).alias("v")), lambda p: p["k"].isNotNull())
    cells = body.select("path", "sheet", "row_no", F.map_from_entries(known).alias("_m"))
    return cells.select("path", "sheet", "row_no", *[F.try_element_at("_m", F.lit(c)).alias(c) for c in columns])


def read_workbooks(spark: SparkSession, path: str, sheet_name: str | int = 0, header_row: int = 0, skip_rows: int = 0, dtype_overrides: dict[str, str] | None = None) -> DataFrame:
    """One sheet (by name or position) or `all` sheets of one or many workbooks."""
    rows = parse_workbooks(binary_files(spark, path, "*.xls[xm]"))
    if isinstance(sheet_name, int):
        rows = rows.where(F.col("sheet_no") == sheet_name)
    elif sheet_name.lower() != "all":
        rows = rows.where(F.col("sheet") == sheet_name)
    named = promote_header(rows, header_row, skip_rows)
    return named.withColumns({c: col(c).try_cast(t) for c, t in (dtype_overrides or {}).items() if c in named.columns})


def parse_word_files(files: DataFrame) -> DataFrame:
    """(path, text, paragraph_count): the non-blank paragraphs of each document, joined."""

    def paragraphs(content: bytes) -> list[str]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml"))
        found = (_texts(p) for p in body.iter() if _tag(p) == "p")
        return [t for t in found if t.strip()]

    def run(batches):
        for batch in batches:
            parts = [paragraphs(c) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "text": ["\n".join(p).strip() for p in parts], "paragraph_count": [len(p) for p in parts]})

    return files.mapInPandas(run, "path string, text string, paragraph_count int").where("text != ''")
