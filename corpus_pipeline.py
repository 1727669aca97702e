"""From raw documents to token ids: quality rules, near and substring deduplication, source mix, piece ids.

Each stage takes (spark, docs, folder) and returns the columns of documents (the last one its own); its rows are
written as Parquet and read again as the next stage's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.core import col, materialize, read_table
from quern.llm import mixing, pieces, quality_rules, simhash, substrings
from quern.llm.batches import words

#: Near copies share at least 0.8 of their distinct five-word shingles. The bits only name candidates, wide of that: over
#: 512 bits such a pair differs in 78 on average (standard deviation 8; 96 and 9 if it has four and five shingles),
#: unrelated texts in 256; over the first 64 bits in 10 (12) and 32. The shingles decide.
NEAR = {"shingle": 5, "similarity": 0.8, "lanes": 8, "radius": 130, "first_radius": 24, "tile_rows": 8192}

#: Rows of an Arrow batch: whole texts meet in it, in the executor and in its Python worker.
BATCH_ROWS = "1000"


def short_batches(spark: SparkSession) -> None:
    """Hold fewer texts at a time than Spark's 10,000 rows; results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.filter_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    short_batches(spark)
    return simhash.deduplicate(docs, **NEAR)


def cut_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the passages of 20 words or more that an earlier document has, too; n_chars follows the text."""
    short_batches(spark)
    out = substrings.remove_repeats(docs, size=20)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """150% of all words, shared by the sources with weights 3, 1, 2; documents taken twice are repeated."""
    boxed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("_row"), "doc_id", "source", F.size(words(F.col("text"))).alias("_words"))
    return mixing.repeat(mixing.mix(boxed, F.col("_words"))).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Piece ids of every text."""
    short_batches(spark)
    out = pieces.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("source_mix", mix_sources),
    ("piece_ids", encode),
]

#: The robust estimate, the fingerprints and the piece ids are not expressible in SQL; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table to token ids."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
