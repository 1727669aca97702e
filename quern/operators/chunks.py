"""Cutting documents into overlapping chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.core import col, explode_rows
from quern.llm.batches import release, slices
from quern.operators.shape import strip_ends

# Chunk settings.
CHUNK_SIZE, CHUNK_OVERLAP = 500, 50
# Bytes of text that are cut at a time.
SLICE_BYTES = 1024 * 1024
SEPARATORS = ["\n\n", "\n", ".", " ", ""]


def window_chunks(df: DataFrame, document_id: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Fixed windows of `size` characters starting every `size − overlap`; blank ones are dropped.

    A document's windows are made inside its row, so numbering them needs no shuffle.
    """
    length = F.length(col(text))
    last = F.greatest(length - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    pieces = F.transform(starts, lambda s: strip_ends(F.substring(col(text), s + 1, F.lit(size))))
    kept = F.filter(pieces, lambda p: p != "")
    return number_chunks(df.withColumn("_pieces", kept), document_id, "_pieces", [c for c in df.columns if c != text])


def number_chunks(df: DataFrame, document_id: str, pieces: str, parents: Sequence[str]) -> DataFrame:
    """One row per piece: parent columns, `chunk_id` (from 1), `chunk_index` (from 0), `chunk_total`, `text`."""
    rows = explode_rows(df, [*[col(c) for c in parents], F.size(pieces).alias("chunk_total")], F.col(pieces), "text", "chunk_index")
    label = F.concat(col(document_id).cast("string"), F.lit("-chunk-"), (F.col("chunk_index") + 1).cast("string"))
    return rows.select(*[col(c) for c in parents], label.alias("chunk_id"), "chunk_index", "chunk_total", "text")


def chunk_document(chunk_id: Column) -> Column:
    """The text of a document's id, from the id of one of its chunks."""
    return F.regexp_extract(chunk_id, r"(?s)^(.*)-chunk-\d+$", 1)


def _pack(pieces: list[str], size: int, overlap: int, measure: Callable[[str], int]) -> list[str]:
    """Greedy chunks of whole pieces; a new chunk starts with the last pieces that fit the overlap."""
    out, held, total = [], [], 0
    for piece in pieces:
        n = measure(piece)
        if held and total + n > size:
            out.append("".join(p for p, _ in held).strip())
            while held and (total > overlap or total + n > size):
                total -= held.pop(0)[1]
        held.append((piece, n))
        total += n
    out.append("".join(p for p, _ in held).strip())
    return [c for c in out if c]


def cut_recursively(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS, measure: Callable[[str], int] = len) -> list[str]:
    """Cut at the coarsest separator that occurs; pieces that are still too long are cut at the
    next one. A separator stays at the start of the piece that follows it."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1:]
    if sep == "":
        if measure is len:
            starts = range(0, max(len(text) - overlap, 1), size - overlap)
            return [c for c in (text[s:s + size].strip() for s in starts) if c]
        return _pack(list(text), size, overlap, measure)
    head, *rest = text.split(sep)
    out, small = [], []
    for piece in (p for p in [head, *(sep + r for r in rest)] if p):
        if measure(piece) < size:
            small.append(piece)
            continue
        if small:
            out += _pack(small, size, overlap, measure)
            small = []
        out += cut_recursively(piece, size, overlap, finer, measure) if finer else [piece]
    return out + (_pack(small, size, overlap, measure) if small else [])


def recursive_chunks(
    df: DataFrame,
    document_id: str,
    text: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: Sequence[str] = tuple(SEPARATORS),
    measure: Callable[[str], int] = len,
) -> DataFrame:
    """Recursive chunks of every document, inheriting its other columns. Cutting is a small
    per-text function; documents stay where they are, and a task holds the chunks of SLICE_BYTES of text."""
    seps = list(separators)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                pieces = [cut_recursively(t, size, overlap, seps, measure) if t and t.strip() else [] for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pieces, pa.list_(pa.string()))], names=[*part.schema.names, "_pieces"])
        release()

    schema = T.StructType([*df.schema.fields, T.StructField("_pieces", T.ArrayType(T.StringType()))])
    return number_chunks(df.mapInArrow(cut, schema), document_id, "_pieces", [c for c in df.columns if c != text])


def chunk_statistics(chunks: DataFrame, document_id: str) -> DataFrame:
    size = F.length("text")
    return chunks.groupBy(col(document_id)).agg(F.min(size).alias("min_chars"), F.max(size).alias("max_chars"), F.avg(size).alias("mean_chars"), F.count("*").alias("chunks"))
