"""Findings of round 3 that were left open: each test fails on the code before its change."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from quern.functions import numeric
from quern.llm import pieces
from quern.operators import aggs, features, shape, terms, vectors
from quern.plans import knowledge
from quern.workload import QUERIES


def test_piece_memory_follows_a_block():
    """Pipeline: four megabytes of words in one Arrow batch are cut a block at a time."""
    texts = [" ".join(f"word{i * 131 % 7919} and" for i in range(start, start + 400)) for start in range(0, 320_000, 400)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "_text": texts})
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = pieces.load(path)
    tracemalloc.start()
    got = [ids.as_py() for out in pieces._encode([batch], path, False) for ids in out.column("ids")[:1]]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0] == sp.encode(texts[0])
    assert sum(map(len, texts)) > 4e6 and peak < 40e6


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


FOLDER = "/root/testdata/sf0.001"


def test_metric_pairs_cut_each_text_once(spark):
    """a filter must not make Spark read the name and the number a second time."""
    rows = spark.createDataFrame([(1, "R2 Score", "97 %", 1), (1, "r_2", "0.5", 2), (1, "loss", "3", 3), (2, " macro f1 ", "n/a", 1), (2, "accuracy %", "1,000", 2), (2, None, "1", 3)], "k int, name string, raw string, at int")
    out = numeric.metrics_from_pairs(rows, ["k"], "name", "raw", "at")
    assert plan(out).count("%, percent") == 1
    assert sorted(map(tuple, out.collect())) == [(1, "R2", 0.5), (2, "Accuracy", 1000.0)]


def test_long_pivot_holds_a_cell_once(spark):
    """one aggregate makes the cells."""
    out = QUERIES["a11_pivot_long"](spark, FOLDER)
    assert plan(out).count("Aggregate [") == 1
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "a", 3.0), (1, None, 9.0), (2, "b", None), (2, "c", 4.0), (2, "c", None)], "k int, c string, v double")
    assert sorted(map(tuple, aggs.pivot_long(rows, "k", "c", "v", F.sum).collect())) == [(1, "a", 5.0), (2, "c", 4.0)]


def test_column_roles_repeat_no_rows(spark):
    """distinct values of several columns are not counted over copies of the rows."""
    rows = spark.createDataFrame([(1, "a", None), (2, "a", 1.0), (3, "b", None)], "row_id int, kind string, v double")
    out = shape.column_roles(rows)
    assert "Expand" not in plan(out)
    assert {r["column"]: (r["dtype"], r["distinct"], r["missing"], r["role"]) for r in out.collect()} == {"row_id": ("int", 3, 0, "id"), "kind": ("string", 2, 0, "categorical"), "v": ("double", 1, 2, "numeric")}


def test_frequencies_go_to_the_rows(spark, monkeypatch):
    """rows of a column with few levels are not dealt by it; many levels are joined."""
    rows = spark.createDataFrame([(i, "a" if i % 4 else "b", None if i < 2 else "x") for i in range(8)], "id int, s string, t string")
    want = sorted((i, *((0.75, "a") if i % 4 else (0.25, "b")), None if i < 2 else 0.75) for i in range(8))
    got = lambda df: sorted((r.id, r.s_freq, r.s, r.t_freq) for r in df.collect())
    few = features.frequency_encode(rows, ["s", "t"])
    assert plan(few).count("strategy=broadcast") == 2 and got(few) == want
    monkeypatch.setattr(features, "LEVEL_LIMIT", 1)
    many = features.frequency_encode(rows, ["s", "t"])
    assert plan(many).count("strategy=broadcast") == 1 and got(many) == want


def test_word_training_gives_every_core_the_same():
    """two million tokens a partition left cores idle, or in need of a second round of whole partitions."""
    assert [terms.training_parts(n, 12) for n in (0, 100_000, 1_000_000, 4_000_000, 27_300_000, 136_000_000)] == [1, 1, 5, 12, 24, 72]


def test_search_keeps_k_items_of_all_blocks(monkeypatch):
    """a block of queries that meets many blocks of items hands on k rows a query, not k for every pair of blocks."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 24))
    x[7], x[311], x[599] = x[3], x[3], 2 * x[3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([f"w{i:03d}" for i in range(600)], object)
    monkeypatch.setattr(vectors, "SLICE_ROWS", 64)
    pack = lambda rows: (ids[rows].tolist(), x[rows].tobytes())
    halves = [np.arange(0, 300), np.arange(300, 600)]
    pairs = [(a, *pack(halves[a]), *pack(rows)) for a in (0, 1) for rows in np.array_split(rng.permutation(600), 4)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pairs)], names=["asked", "qi", "qv", "ii", "iv"])
    for inner in (True, False):
        run = vectors._search(5, inner, True, pa.string(), pa.string())
        got = pa.Table.from_batches(run([batch])).to_pandas()
        assert len(got) == 5 * 600
        exact = -(x @ x.T) if inner else ((x[:, None] - x[None]) ** 2).sum(-1)
        np.fill_diagonal(exact, np.inf)
        for word, part in got.groupby("query_id"):
            i = int(word[1:])
            assert word not in set(part["item_id"])
            assert np.allclose(np.sort(part["distance"]), np.sort(exact[i])[:5], atol=1e-12)


def test_same_table_is_packed_once(spark, monkeypatch):
    """words are queries and items alike; ties go to the smaller word, with copies in several blocks."""
    made = []
    real = vectors.blocks
    monkeypatch.setattr(vectors, "blocks", lambda *a: made.append(1) or real(*a))
    rows = spark.createDataFrame([(f"w{i:02d}", [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2)] * 6) for i in range(60)], "word string, v array<double>")
    got = vectors.nearest(rows, rows, 3, "word", "v", "word", "v", inner=True, skip_self=True, block_rows=7).collect()
    assert len(made) == 1 and len(got) == 180
    for r in got:
        i = int(r["query_id"][1:])
        assert r["item_id"] == [f"w{j:02d}" for j in range(i % 3, 60, 3) if j != i][r["rank"] - 1]


def test_sweep_builds_each_store_once(spark, monkeypatch):
    """documents are cleaned once, words are cut once and vectors packed once for every size and overlap, not for every k."""
    calls = {"clean": 0, "blocks": 0, "tokens": 0}

    def counted(module, attribute, name):
        real = getattr(module, attribute)

        def run(*given, **named):
            calls[name] += 1
            return real(*given, **named)

        monkeypatch.setattr(module, attribute, run)

    counted(knowledge, "clean_documents", "clean")
    counted(vectors, "blocks", "blocks")
    counted(terms, "term_tokens", "tokens")
    documents = spark.createDataFrame([(i, f"plain words about topic{i % 3} and number{i} " * 9) for i in range(6)], "document_id int, text string")
    questions = spark.createDataFrame([(1, "topic1"), (2, "number4 words")], "question_id int, question string")
    out = knowledge.sweep(documents, questions, "document_id", "text", "question_id", "question", sizes=(60, 90), overlaps=(10,), ks=(2, 3)).collect()
    assert {(r["chunk_size"], r["top_k"], r["num_results"]) for r in out} == {(60, 2, 4), (60, 3, 6), (90, 2, 4), (90, 3, 6)}
    # Two stores, each with one cut of the chunks and one of the questions; packed once, and the questions for each of four searches.
    assert calls == {"clean": 1, "blocks": 2 + 4, "tokens": 4}


def test_one_fit_embeds_as_two_passes_do(spark):
    """counts that were stored give the vectors of `fit` and `transform`."""
    rows = spark.createDataFrame([(i, " ".join(f"w{i * j % 7}" for j in range(5)) if i % 4 else " ") for i in range(20)], "id int, text string")
    once = terms.HashEmbedder(16).fit_transform(rows, "text")
    twice = terms.HashEmbedder(16).fit(rows, "text").transform(rows, "text")
    assert once.columns == twice.columns and sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_topics_deal_texts_by_size(spark, monkeypatch):
    """the words that a task of the fit reads follow FIT_BYTES, not the input over the cores."""
    given = []
    real = terms.CountVectorizer.fit
    monkeypatch.setattr(terms.CountVectorizer, "fit", lambda self, df: given.append(df.rdd.getNumPartitions()) or real(self, df))
    rows = spark.createDataFrame([(f"goal match player team{i % 5} season " * 20,) for i in range(400)], "text string").coalesce(1)
    size = rows.selectExpr("sum(octet_length(text))").collect()[0][0]
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(terms, "FIT_BYTES", size // (3 * cores))
    assert terms.lda_topics(rows, "text", 2, 3, min_df=1.0, max_df=1.0).count() == 6
    assert given[0] >= 3 * cores


def test_classifier_cuts_words_once(spark, monkeypatch):
    """the fits read stored words and counts; only the first step reads texts."""
    seen = []
    for kind in (terms.CountVectorizer, terms.IDF, terms.LogisticRegression):
        monkeypatch.setattr(kind, "fit", lambda self, df, real=kind.fit: seen.append(df.columns) or real(self, df))
    rows = spark.createDataFrame([(i, "good growth profit" if i % 3 else "goal match player", "a" if i % 3 else "b") for i in range(30)], "id int, text string, label string")
    model = terms.train_text_classifier(rows, "text", "label", "logistic")
    assert len(seen) == 3 and not any("text" in columns for columns in seen)
    assert terms.classify_texts(model, rows).where("predicted = label").count() == 30
