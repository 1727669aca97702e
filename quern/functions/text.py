"""Text cleaning, counting, sentiment, entities, tokens and word error rate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.shape import squeeze, strip_ends

# ---- cleaning -------------------------------------------------------------------------


def clean_text(c: Column, lowercase: bool = True, remove_urls: bool = True) -> Column:
    """Drop URLs, turn punctuation into blanks, collapse whitespace, lower."""
    out = F.regexp_replace(c, r"(?U)https?://\S+|www\.\S+", " ") if remove_urls else c
    out = squeeze(F.regexp_replace(out, r"(?U)[^\w\s]", " "))
    return F.lower(out) if lowercase else out


def clean_document(c: Column, remove_special: bool = False) -> Column:
    """Normalise line breaks and blanks of a document, keeping its paragraphs."""
    out = strip_ends(c)
    for pattern, new in (
        (r"\r\n|\r", "\n"),
        (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""),
        (r"\n{3,}", "\n\n"),
        (r" +", " "),
        (r"\t+", "\t"),
        (r"\n +", "\n"),
        (r" +\n", "\n"),
    ):
        out = F.regexp_replace(out, pattern, new)
    if remove_special:
        out = F.regexp_replace(out, r"""(?U)[^\w\s.,;:!?'"()-]""", "")
        out = F.regexp_replace(out, r"(?U)\s+", " ")
    return strip_ends(F.coalesce(out, F.lit("")))


def clean_documents(df: DataFrame, column: str) -> DataFrame:
    """Clean a text column and drop the documents that become empty.

    A document survives when it holds anything but whitespace and control characters; testing
    that on the raw text spares cleaning it a second time for the filter.
    """
    kept = df.where(F.regexp_like(F.col(column), F.lit(r"(?U)[^\s\x00-\x1f\x7f]")))
    return kept.withColumn(column, clean_document(F.col(column)))


def clean_ascii(c: Column) -> Column:
    """Lower-case ASCII letters and digits only, words one blank apart."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "))


# ---- counting -------------------------------------------------------------------------


def words(c: Column) -> Column:
    """Tokens between runs of whitespace, without empty ones."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def text_features(c: Column, prefix: str) -> dict[str, Column]:
    """Characters, words and distinct words; a missing text counts as the word `nan`."""
    text = F.coalesce(c, F.lit("nan"))
    return {
        f"{prefix}_length": F.length(text),
        f"{prefix}_word_count": F.size(words(text)),
        f"{prefix}_unique_word_count": F.size(F.array_distinct(words(text))),
    }


def regex_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"(?U)\b\w+\b")), F.lit(0))


def sentence_marks(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"[.!?]+")), F.lit(0))


def mean_word_length(c: Column) -> Column:
    n = regex_words(c)
    return F.when(n > 0, F.length(c) / n).otherwise(0.0)


def dense_characters(c: Column) -> Column:
    """Characters other than blanks and line feeds."""
    return F.length(F.translate(c, " \n", ""))


def prompt_stats(c: Column) -> dict[str, Column]:
    return {"characters": F.length(c), "words": F.size(words(c)), "lines": F.regexp_count(c, F.lit(r"\n")) + 1}


def contains_any(c: Column, *needles: str) -> Column:
    """1 when a lower-cased text contains any of the given literal strings."""
    text, flag = F.lower(F.coalesce(c, F.lit(""))), F.lit(False)
    for n in needles:
        flag = flag | F.contains(text, F.lit(n))
    return flag.cast("int")


# ---- sentiment ------------------------------------------------------------------------

# Sentiment lexicon.
POSITIVE_WORDS = [
    "good", "great", "excellent", "positive", "growth", "gain", "profit", "strong", "improve", "improved", "success",
    "successful", "boost", "record", "surge", "opportunity", "beneficial", "upbeat", "recovery",
]
NEGATIVE_WORDS = [
    "bad", "poor", "negative", "decline", "loss", "weak", "fall", "fell", "crisis", "risk", "risky", "recession",
    "downturn", "concern", "fraud", "cut", "layoff", "layoffs", "shortage", "delay", "failure", "collapse",
]


def sentiment_score(c: Column, positive: list[str] | None = None, negative: list[str] | None = None) -> Column:
    """(pos − neg) / (pos + neg) over lexicon words, 0 without any."""
    tokens = words(clean_text(c))
    pos = F.size(F.filter(tokens, lambda t: t.isin(positive or POSITIVE_WORDS)))
    neg = F.size(F.filter(tokens, lambda t: t.isin(negative or NEGATIVE_WORDS)))
    return F.coalesce(F.try_divide(pos - neg, pos + neg), F.lit(0.0))


def sentiment(c: Column, scorer: Callable[[Column], Column] | None = None) -> Column:
    """Struct of label and score; `scorer` may be any Column function with values in [-1, 1]."""
    score = scorer(c) if scorer else sentiment_score(c)
    label = F.when(score > 0.15, "Positive").when(score < -0.15, "Negative").otherwise("Neutral")
    return F.struct(label.alias("label"), F.round(score, 3).alias("score"))


# ---- entities -------------------------------------------------------------------------

# Entity patterns.
ENTITY_PATTERNS = {
    "PERSON_OR_ORG": r"(?U)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\b",
    "MONEY": r"(?Ui)([₹$€£]\s?\d[\d,]*(?:\.\d+)?\s?(?:crore|lakh|million|billion|trillion)?)",
    "PERCENT": r"(?U)(\d+(?:\.\d+)?\s?%)",
    "DATE": r"(?U)(\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b(?:19|20)\d{2}\b)",
}


def entities(c: Column) -> Column:
    """Map of entity type to its distinct sorted spans; types without spans are absent."""
    spans = []
    for label, pattern in ENTITY_PATTERNS.items():
        found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), strip_ends)
        spans.append(F.struct(F.lit(label).alias("label"), F.array_sort(F.array_distinct(F.filter(found, lambda x: x != ""))).alias("spans")))
    return F.map_from_entries(F.filter(F.array(*spans), lambda s: F.size(s["spans"]) > 0))


# ---- tokens ---------------------------------------------------------------------------

# Common English words left out of keywords.
KEYWORD_STOPS = ["the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "is", "are", "was", "were", "be", "with", "as", "by", "at", "this", "that"]


def keyword_tokens(c: Column) -> Column:
    return F.filter(words(clean_text(c)), lambda t: (F.length(t) > 2) & ~t.isin(KEYWORD_STOPS))


# English stop words (forms without an apostrophe).
ENGLISH_STOPS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then once here there when where why
how all any both each few more most other some such no nor not only own same so than too very s t can will just don should
now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split()


def raw_tokens(c: Column) -> Column:
    """Words and single punctuation marks, as they count before normalising."""
    return F.regexp_extract_all(c, F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1))


def normal_tokens(c: Column, stops: list[str] | None = None) -> Column:
    """Lower-case tokens without digits, ASCII punctuation and stop words."""
    letters = F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\d+", ""), r"\p{Punct}", "")
    return F.filter(words(letters), lambda t: ~t.isin(ENGLISH_STOPS if stops is None else stops))


def token_reduction(c: Column) -> dict[str, Column]:
    """Tokens before and after normalising, removed tokens and the percent removed."""
    before, after = F.size(raw_tokens(c)), F.size(normal_tokens(c))
    return {
        "original_tokens": before,
        "processed_tokens": after,
        "removed_tokens": before - after,
        "reduction_percent": F.round(F.try_divide((before - after) * 100.0, before), 2),
    }


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip_ends), lambda s: s != "")


# ---- word error rate ------------------------------------------------------------------


# First character that stands for a word: beyond the surrogates, so each takes one code point.
FIRST = 0x10000


def _as_characters(tokens: Column, known: Column) -> Column:
    """One character per word, by the word's place among the known ones."""
    codes = F.transform(tokens, lambda w: F.lpad(F.hex(F.array_position(known, w) + FIRST), 8, "0"))
    return F.decode(F.unhex(F.concat_ws("", codes)), "UTF-32")


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Case-insensitive word edit distance over reference words; without any, 1 if the other text has words, else 0.

    Each distinct word of a pair becomes one character, so Spark's edit distance on characters counts words. More
    than a million distinct words in one pair are refused by the decoder.
    """
    split = lambda c: words(F.lower(F.coalesce(c, F.lit(""))))
    # A transform over one item computes the words once, however often the lambda names them.
    pair = F.array(F.struct(split(reference).alias("r"), split(hypothesis).alias("h")))
    known = F.transform(pair, lambda p: F.struct(p["r"].alias("r"), p["h"].alias("h"), F.array_distinct(F.concat(p["r"], p["h"])).alias("k")))

    def rate(p: Column) -> Column:
        distance = F.levenshtein(_as_characters(p["r"], p["k"]), _as_characters(p["h"], p["k"]))
        return F.when(F.size(p["r"]) > 0, distance / F.size(p["r"])).otherwise(F.when(F.size(p["h"]) > 0, 1.0).otherwise(0.0))

    return F.get(F.transform(known, rate), 0)
