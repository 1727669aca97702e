"""Text corpora and table rows as documents with stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.core import col
from quern.operators.shape import strip_ends
from quern.sources import workbooks

# Fixed value: the URL namespace of name-based ids.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def name_uuid(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version-5 id of a name: the SHA-1 of namespace and name with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))

    def cut(start: int, size: int) -> Column:
        return F.substring(digest, start, size)

    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)), F.concat(variant, cut(19, 2)), cut(21, 12))


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def metadata(path: Column, kind: str | Column) -> dict[str, Column]:
    """Stable id, file name, source and type of a document file."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    label = F.lit(kind) if isinstance(kind, str) else kind
    return {"document_id": name_uuid(path), "file_name": name, "source": name, "document_type": label, "file_path": path}


def decode_text(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def as_documents(files: DataFrame, kind: str = "txt") -> DataFrame:
    """Trimmed non-blank documents of (path, content) rows."""
    path = plain_path(F.col("path"))
    text = strip_ends(decode_text(F.col("content")))
    meta = metadata(path, kind)
    return files.select(*[e.alias(n) for n, e in meta.items()], text.alias("text")).where("text != ''")


def read_corpus(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """All text files under a folder."""
    return as_documents(workbooks.binary_files(spark, root, pattern))


def read_word_corpus(spark: SparkSession, root: str) -> DataFrame:
    texts = workbooks.parse_word_files(workbooks.binary_files(spark, root, "*.docx"))
    meta = metadata(plain_path(F.col("path")), "docx")
    return texts.select(*[e.alias(n) for n, e in meta.items()], "text", "paragraph_count")


def rows_as_documents(df: DataFrame, path: str, order: list[str], file_type: str = "csv") -> DataFrame:
    """One document per row: `column: value` lines, with its row number and the row total."""
    from quern.operators import ordered

    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(col(c).cast("string"), F.lit("nan"))) for c in df.columns]
    body = df.select(*order, F.concat_ws("\n", *lines).alias("text"))
    numbered = ordered.position(body, [], order, "_pos")
    meta = metadata(F.lit(path), file_type)
    total = F.lit(df.count())
    return numbered.select(*[e.alias(n) for n, e in meta.items()], (F.col("_pos") - 1).alias("row"), total.alias("total_rows"), "text")
