"""Index, question and configuration-sweep jobs over documents."""

from __future__ import annotations

import time
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.core import col, describe_rows, materialize, spread
from quern.functions.text import clean_documents
from quern.operators import chunks, retrieval, vectors
from quern.operators.terms import HashEmbedder
from quern.sources.files import path_exists


def embed_chunks(documents: DataFrame, document_id: str, text: str, size: int, overlap: int, dimension: int = 384, recursive: bool = True) -> tuple[DataFrame, HashEmbedder]:
    """Clean → chunk → embed."""
    return embed_clean(clean_documents(documents, text), document_id, text, size, overlap, dimension, recursive)


def embed_clean(clean: DataFrame, document_id: str, text: str, size: int, overlap: int, dimension: int = 384, recursive: bool = True) -> tuple[DataFrame, HashEmbedder]:
    """Chunk → embed."""
    cut = (chunks.recursive_chunks if recursive else chunks.window_chunks)(clean, document_id, text, size, overlap)
    embedder = HashEmbedder(dimension)
    return embedder.fit_transform(cut, "text"), embedder


def index_documents(documents: DataFrame, path: str, document_id: str = "document_id", text: str = "text", size: int = chunks.CHUNK_SIZE, overlap: int = chunks.CHUNK_OVERLAP, force: bool = False) -> DataFrame:
    """Build the chunk store and its embedder under `path`; an existing store is kept unless
    forced. Returns one row of counts."""
    spark = documents.sparkSession
    built = force or not path_exists(spark, f"{path}/chunks/_SUCCESS")
    if built:
        table, embedder = embed_chunks(documents, document_id, text, size, overlap)
        embedder.model.write().overwrite().save(f"{path}/embedder")
        table.write.mode("overwrite").parquet(f"{path}/chunks")
    stored = spark.read.parquet(f"{path}/chunks")
    return stored.agg(F.count_distinct(col(document_id)).alias("documents"), F.count("*").alias("chunks"), F.lit(built).alias("built"))


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, HashEmbedder]:
    from pyspark.ml import PipelineModel

    embedder = HashEmbedder()
    embedder.model = PipelineModel.load(f"{path}/embedder")
    return spark.read.parquet(f"{path}/chunks"), embedder


def answer_questions(questions: DataFrame, path: str, question_id: str = "question_id", question: str = "question", k: int = retrieval.RETRIEVAL_K, min_score: float | None = None) -> DataFrame:
    """Prompt, sources and hit count per question; without a hit the answer is fixed."""
    store, embedder = open_store(questions.sparkSession, path)
    asked = embedder.transform(questions, question)
    hits = retrieval.retrieve(asked, store, k, min_score, question_id)
    prompts = retrieval.build_prompts(hits, questions, [question_id], question)
    found = hits.groupBy(question_id).agg(F.count("*").alias("hits"))
    out = prompts.join(retrieval.sources_used(hits, [question_id]), question_id, "left").join(found, question_id, "left").fillna(0, subset=["hits"])
    return out.withColumn("answer", F.when(F.col("hits") == 0, F.lit(retrieval.NO_ANSWER)))


def sweep(documents: DataFrame, questions: DataFrame, document_id: str, text: str, question_id: str, question: str, sizes=(300, 500), overlaps=(30, 50), ks=(3, 5), dimension: int = 384) -> DataFrame:
    """One row per chunk size × overlap × k, ranked by quality and measured speed.

    Documents are cleaned once. Chunks and vectors depend on size and overlap only, so words are cut and their counts
    packed for the searches once for each pair; the speed is that of a search of the packed counts. Texts of chunks are
    not stored: the few that were found are cut from their documents again.
    """
    spark = documents.sparkSession
    clean = materialize(spread(clean_documents(documents, text)), "clean")
    rows = []
    for size, overlap in product(sizes, overlaps):
        embedder = HashEmbedder(dimension)
        packed = embedder.fit_packed(chunks.window_chunks(clean, document_id, text, size, overlap), "text", "chunk_id")
        count = packed.rows
        asked = embedder.transform(questions, question)
        for k in ks:
            start = time.perf_counter()
            found = vectors.nearest(asked, asked, k, question_id, "vector", "chunk_id", packed=packed)
            hits = materialize(found.select(col("query_id").alias(question_id), col("item_id").alias("chunk_id"), "score"), "hits")
            named = hits.select(chunks.chunk_document(F.col("chunk_id")).alias("_document")).distinct()
            used = clean.join(named, col(document_id).cast("string") == F.col("_document"), "left_semi")
            texts = chunks.window_chunks(used, document_id, text, size, overlap).select("chunk_id", "text")
            pairs = hits.join(texts, "chunk_id").join(questions.select(question_id, col(question).alias("_q")), question_id)
            mean = pairs.agg(F.count("*"), F.avg("score"), F.avg(retrieval.lexical_overlap(F.col("_q"), F.col("text")))).collect()[0]
            spent = time.perf_counter() - start
            rows.append((size, overlap, k, count, mean[0], round(mean[1] or 0.0, 6), round(mean[2] or 0.0, 6), spent))
    slowest = max(r[-1] for r in rows)
    ranked = sorted(((*r, retrieval.composite(r[5], r[6], r[7], slowest)) for r in rows), key=lambda r: (-r[-1], r[-2]))
    schema = "chunk_size int, chunk_overlap int, top_k int, chunk_count bigint, num_results bigint, avg_similarity double, lexical_relevance double, latency double, composite_score double"
    return describe_rows(spark, ranked, schema)
