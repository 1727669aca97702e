"""Term tables: bag of words, TF-IDF, chi-square, embeddings by hashing, text models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import functions as MF
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, HashingTF, IndexToString, Normalizer, RegexTokenizer, StopWordsRemover, StringIndexer, Word2Vec, Word2VecModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.core import attach, col, explode_rows, hash_unit, materialize, one_row, scratch_dir, spread
from quern.functions.text import ENGLISH_STOPS
from quern.operators import vectors
from quern.operators.sets import top_per_group

# ---- long-form term tables ------------------------------------------------------------


def term_tokens(c: Column, stops: Sequence[str] = (), bigrams: bool = False) -> Column:
    """Lower-case words of two or more characters, stop words removed, then neighbouring pairs."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b(\w\w+)\b"), F.lit(1))
    if stops:
        tokens = F.filter(tokens, lambda t: ~t.isin(list(stops)))
    if not bigrams:
        return tokens
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(tokens, pairs)


def term_counts(df: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(doc, term, count); combined map-side, so frequent terms and long documents shrink first."""
    return explode_rows(df, [col(doc)], tokens, "term").groupBy(col(doc), "term").agg(F.count("*").alias("count"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("count").alias("total"))


def bag_of_words(df: DataFrame, doc: str, tokens: Column, min_df: int | float = 1, max_df: int | float = 1.0, max_features: int | None = None) -> DataFrame:
    """Term counts over a vocabulary bounded by document frequency (a share when a float)."""
    counts = term_counts(df, doc, tokens)
    rows = df.select(col(doc)).distinct().count()
    low = min_df * rows if isinstance(min_df, float) else min_df
    high = max_df * rows if isinstance(max_df, float) else max_df
    # Testing the total keeps the counts in this branch, so both branches share one shuffle and
    # the texts are cut into tokens once.
    vocabulary = document_frequencies(counts).where((F.col("df") >= low) & (F.col("df") <= high) & (F.col("total") > 0))
    if max_features:
        vocabulary = vocabulary.orderBy(F.desc("total"), "term").limit(max_features)
    return attach(counts, vocabulary.select("term", "df"), ["term"], "inner").select(doc, "term", "count", "df")


def corpus_frequencies(df: DataFrame, tokens: Column) -> DataFrame:
    return explode_rows(df, [], tokens, "term").groupBy("term").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "term")


# Bytes of text (as far as known from the columns of a table) that one block of documents holds.
BLOCK_BYTES = 16 * 1024 * 1024


def _block_counts(table: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Documents and terms of a block, and its (document number, term number, count), by document."""
    tokens = table.column("tokens").combine_chunks()
    docs = table.column("doc").combine_chunks().dictionary_encode(null_encoding="encode")
    terms = tokens.flatten().dictionary_encode()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0))
    owner = np.repeat(np.asarray(docs.indices, np.int64), sizes)
    pairs, counts = np.unique(owner * max(len(terms.dictionary), 1) + np.asarray(terms.indices, np.int64), return_counts=True)
    at, term = np.divmod(pairs, max(len(terms.dictionary), 1))
    return docs.dictionary, terms.dictionary, at, term, counts


def _block_terms(table: pa.Table) -> pa.Table:
    """(block, term, df, total) of one block."""
    _, terms, _, term, counts = _block_counts(table)
    df = np.bincount(term, minlength=len(terms))
    total = np.bincount(term, weights=counts, minlength=len(terms)).astype(np.int64)
    return pa.table({"block": pa.array(np.full(len(terms), table.column("block")[0].as_py(), np.int32)), "term": terms.cast(pa.string()), "df": pa.array(df.astype(np.int64)), "total": pa.array(total)})


def _block_weights(rows: int, sublinear: bool, keep: Sequence[str], schema: pa.Schema):
    """Group function: the weights of a block's documents, given the document frequencies of its terms."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows or not known.num_rows:
            return schema.empty_table()
        _, terms, at, term, counts = _block_counts(table)
        place = pc.index_in(terms.cast(pa.string()), known.column("term").combine_chunks())
        held = np.asarray(pc.is_valid(place))[term]
        at, term, counts = at[held], term[held], counts[held]
        df = np.asarray(known.column("df"), np.float64)[np.asarray(pc.fill_null(place, 0), np.int64)[term]]
        raw = (1 + np.log(counts) if sublinear else counts.astype(np.float64)) * (np.log((1.0 + rows) / (1 + df)) + 1)
        norm = np.sqrt(np.bincount(at, weights=raw * raw, minlength=int(at.max(initial=0)) + 1))
        # The columns to keep are those of the first row of a document.
        codes = np.asarray(table.column("doc").combine_chunks().dictionary_encode(null_encoding="encode").indices, np.int64)
        first = np.unique(codes, return_index=True)[1][at]
        kept = [table.column(c).combine_chunks().take(pa.array(first)) for c in ("doc", *keep)]
        return pa.Table.from_arrays([*kept, terms.cast(pa.string()).take(pa.array(term)), pa.array(raw / norm[at])], schema=schema)

    return run


def tf_idf(df: DataFrame, doc: str, tokens: Column, min_df: int | float = 1, max_df: int | float = 1.0, max_features: int | None = None, sublinear: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """(doc, columns to keep, term, weight): tf · (ln((1+n)/(1+df)) + 1), each document scaled to length 1.

    Documents are dealt into blocks of about BLOCK_BYTES. What travels between blocks is each block's distinct terms and
    their frequencies, not the terms of every document; tokens are cut after the texts have been dealt.
    """
    used = [c for c in df.columns if isinstance(df.schema[c].dataType, T.StringType)]
    rows, size = one_row(df, F.count_distinct(F.struct(col(doc))), F.sum(sum((F.coalesce(F.octet_length(col(c)), F.lit(0)) for c in used), F.lit(0)).cast("long")))
    parts = max(-(-(size or 0) // BLOCK_BYTES), df.sparkSession.sparkContext.defaultParallelism)
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(col(doc)), F.lit(parts)).cast("int")).repartition(parts, "_block")
    cut = dealt.select(F.col("_block").alias("block"), col(doc).alias("doc"), *[col(c) for c in keep], tokens.alias("tokens"))
    local = materialize(cut.select("block", "doc", "tokens").groupBy("block").applyInArrow(_block_terms, "block int, term string, df long, total long"), "block-terms")
    low = min_df * rows if isinstance(min_df, float) else min_df
    high = max_df * rows if isinstance(max_df, float) else max_df
    vocabulary = local.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where((F.col("df") >= low) & (F.col("df") <= high))
    if max_features:
        vocabulary = vocabulary.orderBy(F.desc("total"), "term").limit(max_features)
    known = local.select("block", "term").join(vocabulary.select("term", "df"), "term")
    schema = T.StructType([T.StructField(doc, df.schema[doc].dataType), *[df.schema[c] for c in keep], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])
    run = _block_weights(rows, sublinear, list(keep), to_arrow_schema(schema))
    return cut.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, schema)


def top_terms(weights: DataFrame, group: str, k: int) -> DataFrame:
    """Highest-weighted terms per group, from summed weights."""
    totals = weights.groupBy(col(group), "term").agg(F.sum("weight").alias("weight"))
    return top_per_group(totals, [group], [F.desc("weight"), F.col("term")], k)


def chi_square(weights: DataFrame, doc: str, labels: DataFrame, label: str) -> DataFrame:
    """Σ (observed − expected)² / expected per term, where a class expects its share of the
    documents of the term's total weight. Weights that hold the label already are not joined with the labels."""
    labelled = weights.withColumn("_class", col(label)) if label in weights.columns else weights.join(labels.select(doc, col(label).alias("_class")), doc)
    observed = labelled.groupBy("term", "_class").agg(F.sum("weight").alias("o"))
    # Σ (o − e)²/e over all classes, with e = total·share, is Σ o²/(total·share) − total: classes
    # where the term is absent need no row of their own.
    sizes = labels.groupBy(col(label).alias("_class")).agg(F.count("*").alias("n"))
    share = attach(observed, sizes, ["_class"]).withColumn("share", F.col("n") / F.lit(labels.count()))
    per_term = share.groupBy("term").agg(F.sum("o").alias("total"), F.sum(F.col("o") * F.col("o") / F.col("share")).alias("s"))
    return per_term.select("term", (F.col("s") / F.col("total") - F.col("total")).alias("chi2"))


def entity_counts(df: DataFrame, doc: str, entities: Column) -> DataFrame:
    """Entity labels over a corpus: documents with the label and distinct spans in them."""
    pairs = explode_rows(df, [col(doc)], F.map_entries(entities), "e")
    spans = pairs.select(col(doc), F.col("e.key").alias("label"), F.col("e.value").alias("spans"))
    return spans.groupBy("label").agg(F.count("*").alias("documents"), F.sum(F.size("spans")).alias("spans"))


# ---- embeddings -----------------------------------------------------------------------


class HashEmbedder:
    """A model-free text vector: hashed word counts, inverse document frequency, length 1.

    `fit` makes one pass for the document frequencies; the same fitted embedder must serve both
    the chunks and the questions.
    """

    def __init__(self, dimension: int = 384):
        self.dimension = dimension
        self.model: PipelineModel | None = None

    def fit(self, df: DataFrame, text: str) -> HashEmbedder:
        self.model = Pipeline(stages=self._stages()).fit(self._tokens(df, text))
        return self

    def _stages(self) -> list:
        return [
            HashingTF(numFeatures=self.dimension, inputCol="_tokens", outputCol="_tf"),
            IDF(inputCol="_tf", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="_unit"),
        ]

    @staticmethod
    def _tokens(df: DataFrame, text: str) -> DataFrame:
        """Blank texts are skipped."""
        return df.where(F.trim(col(text)) != "").withColumn("_tokens", term_tokens(col(text)))

    def fit_transform(self, df: DataFrame, text: str, out: str = "vector") -> DataFrame:
        """`fit` and `transform` of the same texts: they are made and cut into words once, and stored with their counts."""
        counts, idf, unit = self._stages()
        counted = materialize(counts.transform(self._tokens(df, text)).select(*df.columns, "_tf"), "term-counts")
        fitted = idf.fit(counted)
        self.model = PipelineModel(stages=[counts, fitted, unit])
        return unit.transform(fitted.transform(counted)).select(*df.columns, MF.vector_to_array(F.col("_unit")).alias(out))

    def fit_packed(self, df: DataFrame, text: str, row_id: str) -> vectors.PackedCounts:
        """`fit`, and the texts packed for searches: they are made and cut into words once, and their counts stored sparse."""
        counts, _, unit = self._stages()
        tf = F.unwrap_udt("_tf")
        found = counts.transform(self._tokens(df, text)).select(col(row_id), tf["indices"].cast("array<smallint>" if self.dimension < 1 << 15 else "array<int>").alias("at"), tf["values"].cast("array<int>").alias("n"))
        packed = vectors.PackedCounts(found, row_id, self.dimension)
        # The weights of Spark's IDF.
        packed.weights = np.log((packed.rows + 1.0) / (packed.frequencies() + 1.0))
        scale = ElementwiseProduct(scalingVec=Vectors.dense(packed.weights), inputCol="_tf", outputCol="_idf")
        self.model = PipelineModel(stages=[counts, scale, unit])
        return packed

    def transform(self, df: DataFrame, text: str, out: str = "vector") -> DataFrame:
        if self.model is None:
            raise ValueError("fit the embedder first")
        done = self.model.transform(self._tokens(df, text))
        return done.select(*df.columns, MF.vector_to_array(F.col("_unit")).alias(out))


# Tokens that one partition of the training takes at most, and at least to be cut for another core; most passes over them.
PARTITION_TOKENS, LEAST_TOKENS = 2_000_000, 200_000
MOST_PASSES = 5


def training_parts(tokens: int, cores: int) -> int:
    """Partitions of at most PARTITION_TOKENS tokens, the same number for every core; fewer than cores below LEAST_TOKENS each."""
    rounds = -(-tokens // (PARTITION_TOKENS * cores))
    return max(1, min(rounds * cores, tokens // LEAST_TOKENS))


def word_vectors(df: DataFrame, text: str, size: int = 100, window: int = 5, min_count: int = 2, seed: int = 42, partitions: int | None = None):
    """Fitted word embeddings; `nearest_words` searches their vectors.

    Partitions are trained side by side and averaged after each pass; the more partitions, the more passes. A pass
    lasts as long as its slowest core, so there are as many partitions for every core (`training_parts`).
    """
    tokens = materialize(spread(df.select(col(text))).select(term_tokens(col(text)).alias("tokens")), "word-tokens")
    total = one_row(tokens, F.sum(F.size("tokens")))[0] or 0
    parts = partitions or training_parts(total, df.sparkSession.sparkContext.defaultParallelism)
    return Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, numPartitions=parts, maxIter=min(parts, MOST_PASSES), inputCol="tokens", outputCol="_v").fit(tokens)


def stored_vectors(model: Word2VecModel, spark: SparkSession) -> DataFrame:
    """(word, vector) of fitted embeddings, as floats from storage.

    `getVectors` makes a local table of doubles, and Spark computes what is selected from it on the driver.
    """
    path = scratch_dir(spark, "word-vectors")
    model.save(path)
    return spark.read.parquet(f"{path}/data").select("word", "vector")


def nearest_words(words: DataFrame, k: int, word: str = "word", vector: str = "vector") -> DataFrame:
    """The k words of the largest cosine similarity to every word: (word, neighbour, similarity, rank).

    Takes a table of words and array vectors; ties go to the smaller word, words without length have no neighbours.
    """
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = words.select(col(word).alias("word"), col(vector).cast("array<double>").alias("v")).withColumn("n", length).where("n > 0").select("word", F.transform("v", lambda x: x / F.col("n")).alias("v"))
    unit = materialize(unit, "unit-vectors")
    found = vectors.nearest(unit, unit, k, "word", "v", "word", "v", inner=True, skip_self=True)
    return found.select(F.col("query_id").alias("word"), F.col("item_id").alias("neighbour"), F.col("score").alias("similarity"), "rank")


# ---- models ---------------------------------------------------------------------------

# Bytes of text in a partition of a fit: Spark holds the words of a partition as objects, some six times as large.
FIT_BYTES = 64 * 1024 * 1024


def fit_parts(df: DataFrame, text: str) -> int:
    """Partitions of about FIT_BYTES of text, one for every core at least."""
    size = one_row(df, F.sum(F.octet_length(col(text)).cast("long")))[0] or 0
    return max(-(-size // FIT_BYTES), df.sparkSession.sparkContext.defaultParallelism)


def _text_stages(text: str, features: int, stops: Sequence[str], min_df: float = 1.0) -> list:
    return [
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"(?U)\w\w+", gaps=False),
        StopWordsRemover(inputCol="_tokens", outputCol="_kept", stopWords=list(stops)),
        CountVectorizer(inputCol="_kept", outputCol="_tf", vocabSize=features, minDF=min_df),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_features"),
    ]


def train_text_classifier(df: DataFrame, text: str, label: str, model: str = "naive_bayes", features: int = 5000, stops: Sequence[str] = tuple(ENGLISH_STOPS)) -> PipelineModel:
    """TF-IDF with naive Bayes, or with logistic regression under balanced class weights."""
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(df)
    back = IndexToString(inputCol="_prediction", outputCol="predicted", labels=index.labels)
    if model == "naive_bayes":
        estimator = NaiveBayes(featuresCol="_features", labelCol="_label", predictionCol="_prediction", probabilityCol="_probability", rawPredictionCol="_raw")
        rows = df
    elif model == "logistic":
        sizes = df.groupBy(col(label)).agg(F.count("*").alias("_n"))
        total, classes = one_row(sizes, F.sum("_n"), F.count("*"))
        weight = sizes.select(col(label), (F.lit(total) / (F.lit(classes) * F.col("_n"))).alias("_weight"))
        rows = attach(df, weight, [label])
        estimator = LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", predictionCol="_prediction", probabilityCol="_probability", rawPredictionCol="_raw", maxIter=100, regParam=0.01)
    else:
        raise ValueError(f"unknown text model '{model}'")
    *cut, counter, idf, unit = _text_stages(text, features, stops)
    # Each step reads what the step before it has stored: texts are cut into words once, not for every fit.
    parts = fit_parts(df, text)
    kept = ["_label", *(["_weight"] if model == "logistic" else [])]
    words = materialize(PipelineModel(stages=cut).transform(index.transform(rows).select(*kept, col(text)).repartition(parts)).select(*kept, "_kept"), "words")
    counter = counter.fit(words.repartition(parts))
    counts = materialize(counter.transform(words).drop("_kept"), "word-counts")
    idf = idf.fit(counts)
    fitted = estimator.fit(unit.transform(idf.transform(counts.repartition(parts))))
    return PipelineModel(stages=[*cut, counter, idf, unit, fitted, back])


def classify_texts(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predicted label and the probability of every class, in label order."""
    done = model.transform(df)
    return done.select(*df.columns, "predicted", MF.vector_to_array(F.col("_probability")).alias("probability"))


def class_labels(model: PipelineModel) -> list[str]:
    return list(model.stages[-1].getLabels())


def class_top_terms(model: PipelineModel, k: int = 30) -> list[tuple[str, str, float]]:
    """Terms with the largest coefficients per class of a logistic text model."""
    vocabulary = next(s for s in model.stages if hasattr(s, "vocabulary")).vocabulary
    fitted = model.stages[-2]
    matrix = fitted.coefficientMatrix.toArray()
    labels = class_labels(model)
    if len(matrix) == 1:
        matrix = [-matrix[0], matrix[0]]
    rows = []
    for label, weights in zip(labels, matrix):
        for i in sorted(range(len(vocabulary)), key=lambda j: (-weights[j], vocabulary[j]))[:k]:
            rows.append((label, vocabulary[i], float(weights[i])))
    return rows


def lda_topics(df: DataFrame, text: str, topics: int = 5, terms: int = 8, min_df: float = 2.0, max_df: float = 0.9, seed: int = 42, vocabulary: int = 1 << 18) -> DataFrame:
    """(topic, position, term, weight) of the strongest words per topic, over the `vocabulary` most frequent words.

    Every step of the fit reads all texts, dealt by their size.
    """
    tokens = df.select(col(text)).repartition(fit_parts(df, text)).withColumn("_tokens", term_tokens(col(text), ENGLISH_STOPS))
    counter = CountVectorizer(inputCol="_tokens", outputCol="_tf", minDF=min_df, vocabSize=vocabulary)
    # Spark reads a maxDF of 1.0 as "in one document"; here it means no upper limit.
    vectors = (counter.setMaxDF(max_df) if max_df < 1 else counter).fit(tokens)
    model = LDA(k=topics, seed=seed, maxIter=10, subsamplingRate=1.0, featuresCol="_tf").fit(vectors.transform(tokens))
    found = model.describeTopics(terms)
    pairs = found.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("position", "t"))
    rows = pairs.select("topic", "position", F.col("t.termIndices").alias("i"), F.col("t.termWeights").alias("weight"))
    names = df.sparkSession.createDataFrame(list(enumerate(vectors.vocabulary)), "i int, term string")
    return rows.join(names, "i").select("topic", "position", "term", "weight")


# Openings and endings of augmented questions.
PREFIXES = ["Please ", "Can you ", "Kindly ", "I want to ", ""]
SUFFIXES = [" please", " right now", " for me", " today", ""]


def augment(df: DataFrame, text: str, row_id: str, copies: int = 12, seed: int = 42) -> DataFrame:
    """Every text followed by `copies` lower-cased variants with a drawn opening and ending."""

    def drawn(items: list[str], salt: int) -> Column:
        at = F.floor(hash_unit(col(row_id), F.col("copy"), seed=seed + salt) * len(items)) + 1
        return F.element_at(F.array(*[F.lit(x) for x in items]), at.cast("int"))

    rows = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    variant = F.trim(F.concat(drawn(PREFIXES, 0), F.lower(col(text)), drawn(SUFFIXES, 1)))
    return rows.withColumn(text, F.when(F.col("copy") == 0, col(text)).otherwise(variant))
