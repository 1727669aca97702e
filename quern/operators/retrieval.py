"""Retrieval over a chunk table: search, context, prompts and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.core import attach, col
from quern.operators.shape import strip_ends
from quern.operators.vectors import Packed, nearest

# Separator, fallback text, defaults.
SEPARATOR = "\n\n---\n\n"
NO_CONTEXT = "No relevant context available."
NO_ANSWER = "Information not found."
RETRIEVAL_K = 5
SYSTEM_PROMPT = (
    "Rely on the passages below and nothing else. Where they leave a question partly open, name the gap. "
    f"Where they do not answer it at all, say only: {NO_ANSWER}"
)


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = RETRIEVAL_K, min_score: float | None = None, question_id: str = "question_id", chunk_id: str = "chunk_id", vector: str = "vector", inner: bool = False, packed: Packed | None = None) -> DataFrame:
    """Best k chunks per question above a minimum score, with the chunk's columns.

    A blank question has no vector and finds nothing. The vectors of the chunks may have been `packed` before.
    """
    hits = nearest(questions, chunks, k, question_id, vector, chunk_id, vector, inner, packed=packed)
    if min_score is not None:
        hits = hits.where(F.col("score") >= min_score)
    kept = chunks.drop(vector).withColumnRenamed(chunk_id, "item_id")
    return hits.join(kept, "item_id").withColumnsRenamed({"query_id": question_id, "item_id": chunk_id})


# ---- context and prompts --------------------------------------------------------------


def _first_texts(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Trimmed texts, blank ones dropped, each text once per question at its best rank."""
    clean = hits.withColumn("text", strip_ends(F.col("text"))).where("text != ''")
    first = F.row_number().over(Window.partitionBy(*keys, "text").orderBy("rank"))
    return clean.withColumn("_copy", first).where("_copy = 1").drop("_copy")


def _optional(hits: DataFrame, name: str, label: str, truthy: bool = False) -> Column:
    if name not in hits.columns:
        return F.lit("")
    value = col(name).cast("string")
    present = col(name).isNotNull() & (value != "") if truthy else col(name).isNotNull()
    return F.when(present, F.concat(F.lit(label), value)).otherwise("")


def _source(hits: DataFrame) -> Column:
    name = col("source") if "source" in hits.columns else F.lit(None)
    return F.concat(F.lit("Source: "), F.coalesce(F.nullif(name.cast("string"), F.lit("")), F.lit("unknown")))


def _assemble(parts: DataFrame, keys: list[str], limit: int | None, least: int, trim_end: bool) -> DataFrame:
    """Join the parts of a question in rank order within the length budget.

    A question has at most k hits, so its window and list are small.
    """
    size = F.length("_part")
    upto = F.sum(size).over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    sized = parts.withColumn("_upto", upto.cast("int"))
    if limit is None:
        kept = F.col("_part")
    else:
        room = F.lit(limit) - (F.col("_upto") - size)
        cut = F.substring(F.col("_part"), F.lit(1), room)
        cut = F.regexp_replace(cut, r"(?U)\s+$", "") if trim_end else cut
        kept = F.when(F.col("_upto") <= limit, F.col("_part")).when(room > least, F.concat(cut, F.lit("...")))
    lines = sized.withColumn("_kept", kept).where("_kept is not null").groupBy(*keys)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "_kept")))
    return lines.agg(F.array_join(F.transform(ordered, lambda s: s["_kept"]), SEPARATOR).alias("context"))


def _with_every_question(context: DataFrame, questions: DataFrame, keys: list[str]) -> DataFrame:
    return attach(questions, context, keys).withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))


def build_context(hits: DataFrame, questions: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Context per question: distinct texts in rank order, each under a header with source and
    ids, cut at the length budget (a cut part needs more than 80 characters)."""
    first = _first_texts(hits, keys)
    header = F.concat(
        _source(first),
        _optional(first, "document_id", " | Document ID: ", truthy=True),
        _optional(first, "chunk_id", " | Chunk ID: "),
        _optional(first, "chunk_index", " | Chunk Index: "),
        _optional(first, "page", " | Page: "),
    )
    parts = first.withColumn("_part", F.concat(header, F.lit("\n"), "text"))
    return _with_every_question(_assemble(parts, keys, limit, 80, trim_end=True), questions, keys)


def build_prompts(hits: DataFrame, questions: DataFrame, keys: list[str], question: str, limit: int | None = 4000, with_score: bool = False, system: str = SYSTEM_PROMPT) -> DataFrame:
    """Prompt and chat messages per question from its hits (a cut part needs more than 50 characters)."""
    first = _first_texts(hits, keys)
    page = F.when(col("page").isNotNull() & (col("page").cast("string") != ""), F.concat(F.lit(" (Page "), col("page").cast("string"), F.lit(")"))).otherwise("") if "page" in first.columns else F.lit("")
    header = F.concat(
        _source(first),
        _optional(first, "document_id", " | Document ID: ", truthy=True),
        page,
        _optional(first, "chunk_id", " | Chunk ID: ", truthy=True),
        _optional(first, "chunk_index", " | Chunk Index: "),
        F.format_string(" | Relevance: %.4f", F.coalesce(col("score"), F.lit(0.0))) if with_score else F.lit(""),
    )
    parts = first.withColumn("_part", F.concat(header, F.lit("\n"), "text"))
    filled = _with_every_question(_assemble(parts, keys, limit, 50, trim_end=False), questions, keys)
    asked = strip_ends(col(question))
    user = F.concat(F.lit("CONTEXT:\n"), "context", F.lit("\n\nUSER QUESTION:\n"), asked, F.lit("\n\nANSWER:"))
    prompt = F.concat(F.lit("SYSTEM INSTRUCTIONS\n\n" + system + "\n\n"), user)
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
    return filled.withColumns({"prompt": prompt, "messages": messages})


def sources_used(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct sources per question in the order of their first appearance."""
    first = hits.groupBy(*keys, "source").agg(F.min("rank").alias("_at"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", "source")))
    return first.groupBy(*keys).agg(F.transform(ordered, lambda s: s["source"]).alias("sources"))


# ---- evaluation -----------------------------------------------------------------------

# Words that do not count in the lexical overlap.
OVERLAP_STOPS = [
    "a", "an", "the", "and", "or", "but", "of", "to", "in", "on", "for", "with", "is", "are", "was", "were", "be", "been", "being", "it",
    "this", "that", "what", "which", "how", "why", "when", "where", "do", "does", "did", "not", "at", "by", "from", "as", "your", "you",
    "we", "they", "he", "she", "i", "me", "my", "can", "could", "will", "would", "should", "have", "has", "had", "about", "please", "tell",
    "explain", "describe", "give",
]


def overlap_tokens(c: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))
    return F.array_except(found, F.array(*[F.lit(w) for w in OVERLAP_STOPS]))


def lexical_overlap(query: Column, text: Column) -> Column:
    """Share of the query's meaningful tokens that occur in the text, 0 without any."""
    asked = overlap_tokens(query)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, overlap_tokens(text))), F.size(asked)), F.lit(0.0))


def query_terms(query: Column) -> Column:
    """Distinct purely alphabetic words of a query."""
    return F.filter(F.array_distinct(F.split(F.lower(query), r"(?U)\s+")), lambda w: F.regexp_like(w, F.lit(r"^\p{L}+$")))


def term_share(query: Column, text: Column) -> Column:
    """Share of the query's alphabetic words that are substrings of the text."""
    asked = query_terms(query)
    found = F.filter(asked, lambda w: F.contains(F.lower(text), w))
    return F.coalesce(F.try_divide(F.size(found), F.size(asked)), F.lit(0.0))


def relevance(hits: DataFrame, questions: DataFrame, keys: list[str], question: str) -> DataFrame:
    """Mean term share over a question's chunks and the verdict (relevant from 0.2 on)."""
    asked = questions.select(*keys, col(question).alias("_q"))
    scored = hits.join(asked, keys).withColumn("_s", term_share(F.col("_q"), F.col("text")))
    means = attach(asked, scored.groupBy(*keys).agg(F.avg("_s").alias("_m")), keys)
    blank = strip_ends(F.coalesce("_q", F.lit(""))) == ""
    score = F.round(F.when(blank, 0.0).otherwise(F.coalesce("_m", F.lit(0.0))), 4)
    status = F.when(blank, "empty_query").when(F.col("_m").isNull(), "no_context").when(F.col("_m") >= 0.2, "relevant").otherwise("not_relevant")
    return means.select(*keys, score.alias("relevance_score"), status.alias("relevance_status"))


def claims(answer: Column, context: Column) -> dict[str, Column]:
    """Sentences of an answer split into supported ones (any of the first five words occurs in
    the context) and the others, and whether the context is missing."""
    low = F.lower(F.coalesce(context, F.lit("")))
    parts = F.filter(F.transform(F.split(answer, r"\."), strip_ends), lambda s: s != "")

    def backed(sentence: Column) -> Column:
        first = F.slice(F.split(F.lower(sentence), r"(?U)\s+"), 1, 5)
        return F.exists(first, lambda w: F.contains(low, w))

    blank = strip_ends(F.coalesce(answer, F.lit(""))) == ""
    none = F.array().cast("array<string>")
    return {
        "supported": F.when(blank, none).otherwise(F.filter(parts, backed)),
        "unsupported": F.when(blank, F.array(F.lit("No answer generated."))).otherwise(F.filter(parts, lambda s: ~backed(s))),
        "missing_context": blank | (strip_ends(low) == ""),
    }


def search_quality(hits: DataFrame, keys: list[str], lexical: str | None = None) -> DataFrame:
    """Per question: results, mean score, duplicates by (source, chunk id), mean lexical overlap."""
    identity = F.struct("source", "chunk_id")
    extra = [F.round(F.avg(lexical), 6).alias("lexical")] if lexical else []
    return hits.groupBy(*keys).agg(F.count("*").alias("results"), F.round(F.avg("score"), 6).alias("mean_score"), (F.count("*") - F.count_distinct(identity)).alias("duplicates"), *extra)


def store_evaluation(quality: DataFrame, integrity: DataFrame) -> DataFrame:
    """One row: questions, mean score, duplicates and PASS/WARN/FAIL with the store's integrity."""
    total = quality.agg(
        F.count("*").alias("questions"), F.coalesce(F.round(F.avg("mean_score"), 6), F.lit(0.0)).alias("mean_score"), F.min("mean_score").alias("_least"), F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates")
    )
    good = (F.col("_least") > 0.3) & (F.col("duplicates") == 0)
    failed = integrity.collect()[0]["status"] == "FAIL"
    status = F.lit("FAIL") if failed else F.when(good, "PASS").otherwise("WARN")
    return total.select("questions", "mean_score", "duplicates", status.alias("status"))


def composite(similarity: float, lexical: float, latency: float, slowest: float) -> float:
    """0.6 · quality + 0.4 · speed of one configuration."""
    speed = max(1.0 - latency / slowest, 0.0) if slowest else 0.0
    return round(0.6 * (similarity + lexical) / 2 + 0.4 * speed, 6)
