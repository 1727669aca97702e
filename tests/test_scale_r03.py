"""Work that must not grow faster than the input: boxed search, dealt input, blocks in small row groups, small batches."""

import collections
import math

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.operators import chunks, models, ordered, sets, spatial, terms, vectors, windows


def searched(how, q, ids, x, items, k, skip):
    parts = how(q, ids, x, items, k, False, skip)
    found = pd.concat([pd.DataFrame({"id": some[out["q"].to_numpy()], "item": out["item"].to_numpy(), "d": out["distance"].to_numpy()}) for some, out in parts])
    return found.sort_values(["id", "d", "item"]).reset_index(drop=True)


@pytest.mark.parametrize("width, levels", [(2, 12), (2, 100_000), (4, 100_000), (1, 5), (2, 1)])
def test_boxed_search_finds_what_brute_force_finds(width, levels):
    """Many equal vectors and equal distances, or none."""
    rng = np.random.default_rng(width + levels)
    x, q = (rng.integers(0, levels, (n, width)).astype(float) for n in (3000, 900))
    items, ids = rng.permutation(3000), np.arange(900)
    for skip in (False, True):
        brute = searched(lambda *a: [(a[1], vectors._best(*a))], q, ids, x, items, 4, skip)
        pd.testing.assert_frame_equal(searched(vectors._found, q, ids, x, items, 4, skip), brute)


def test_boxed_search_skips_far_leaves(monkeypatch):
    met, plain = [], vectors._best
    monkeypatch.setattr(vectors, "_best", lambda q, ids, x, *rest: met.append(len(q) * len(x)) or plain(q, ids, x, *rest))
    rng = np.random.default_rng(3)
    for _ in vectors._found(rng.normal(size=(8000, 2)), np.arange(8000), rng.normal(size=(40_000, 2)), np.arange(40_000), 5, False, False):
        pass
    assert sum(met) < 8000 * 40_000 / 8


def test_forest_is_trained_by_all_cores(spark, tmp_path, monkeypatch):
    """A table in one file is one task for a scan."""
    spark.range(0, 400, 1, 1).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y")).write.parquet(str(tmp_path / "rows"))
    seen, plain = [], models.train
    monkeypatch.setattr(models, "train", lambda df, *rest: seen.append(df.rdd.getNumPartitions()) or plain(df, *rest))
    models.forest_forecast(spark.read.parquet(str(tmp_path / "rows")), "id", ["x"], "y", trees=2)
    assert seen == [spark.sparkContext.defaultParallelism]


def exchanged(df):
    """The keys of the shuffles in a plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [line for line in lines if "Exchange hashpartitioning" in line]


def test_weights_by_block_of_documents(spark):
    """Documents in several rows, without an id or without words; terms never travel with their document."""
    rows = [(1, "en", "a b b c"), (2, "de", "b c c"), (1, "en", "a d"), (None, "fr", "c d d"), (3, "en", ""), (4, "en", None), (5, "de", "z")]
    df = spark.createDataFrame(rows, "id long, lang string, text string")
    found = terms.tf_idf(df, "id", F.filter(F.split("text", " "), lambda w: w != ""), min_df=2, keep=["lang"])
    counts = collections.defaultdict(collections.Counter)
    for i, _, text in rows:
        counts[i].update((text or "").split())
    df_of = collections.Counter(w for c in counts.values() for w in c)
    expected = {}
    for i, c in counts.items():
        raw = {w: n * (math.log((1 + len(counts)) / (1 + df_of[w])) + 1) for w, n in c.items() if df_of[w] >= 2}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        expected |= {(i, w): v / norm for w, v in raw.items()}
    got = {(r["id"], r["term"]): r["weight"] for r in found.collect()}
    assert got == pytest.approx(expected)
    assert {(r["id"], r["lang"]) for r in found.collect()} == {(1, "en"), (2, "de"), (None, "fr")}
    assert not any("id#" in line for line in exchanged(found))


def test_keywords_move_texts_once(spark):
    from quern.workload import QUERIES

    assert len(exchanged(QUERIES["k04_top_keywords"](spark, "/root/testdata/sf0.001"))) == 1


def test_lookup_decides_pairs_where_they_meet(spark):
    """Flat, steep and many-sided features with holes, against even-odd counting of all edges."""
    rng = np.random.default_rng(5)
    shapes = []
    for n in range(25):
        x, y, w, h = rng.uniform(-5, 5), rng.uniform(-5, 5), 10 ** rng.uniform(-3, 0.7), 10 ** rng.uniform(-3, 0.7)
        turn = np.linspace(0, 2 * np.pi, int(rng.integers(4, 400)))
        ring = [[x + w * math.cos(t), y + h * math.sin(t)] for t in turn[:-1]]
        hole = [[x + w * a, y + h * b] for a, b in ((-0.1, -0.1), (0.2, -0.1), (0.1, 0.3))]
        shapes.append((f"f{n}", [ring + ring[:1], hole + hole[:1]]))
    centres = [(float(np.mean([p[0] for p in r[0]])), float(np.mean([p[1] for p in r[0]]))) for _, r in shapes]
    spots = [(i, float(cx + rng.normal() * 0.1), float(cy + rng.normal() * 0.1)) for i, (cx, cy) in enumerate(centres * 8)]

    def inside(x, y, rings):
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for r in rings for a, b in zip(r, r[1:])) % 2 == 1

    points = spark.createDataFrame(spots, "id int, lon double, lat double")
    features = spark.createDataFrame(shapes, "name string, rings array<array<array<double>>>")
    expected = {(i, name) for i, x, y in spots for name, rings in shapes if inside(x, y, rings)}
    found = spatial.locate(points, features, keep=["name"])
    assert found.columns == ["id", "lon", "lat", "name"] and len(expected) > 20
    rows = [(r["id"], r["name"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    assert {(r["id"], r["name"]) for r in spatial.locate(points, features).collect()} == expected


def test_chunks_are_cut_a_slice_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(chunks, "SLICE_BYTES", 100)
    texts = [None, "", " \n", "a b. " * 300, "é" * 700, *(f"row {i}.\n\nmore of it" for i in range(40))]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "id int, source string, text string").coalesce(1)
    found = chunks.recursive_chunks(df, "id", "text", 50, 5)
    expected = {f"{i}-chunk-{n + 1}": c for i, t in enumerate(texts) if t and t.strip() for n, c in enumerate(chunks.cut_recursively(t, 50, 5))}
    assert {r["chunk_id"]: r["text"] for r in found.collect()} == expected and {r["source"] for r in found.collect()} == {"s"}


def test_blocks_of_vectors_lie_in_small_row_groups(spark, monkeypatch, tmp_path):
    """A writer counts the bytes of a row group only after a hundred rows, unless told otherwise."""
    monkeypatch.setitem(vectors.BLOCK_FILES, "parquet.block.size", "100000")
    stored, plain = [], vectors.materialize
    monkeypatch.setattr(vectors, "materialize", lambda df, *rest: stored.append(plain(df.coalesce(1), *rest)) or stored[-1])
    rows = spark.range(4000).select("id", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.rand(3)).alias("v"))
    vectors.nearest(rows.where("id < 3"), rows, 2, "id", "v", "id", "v", block_rows=100).count()
    files = [f for s in stored for f in s.inputFiles()]
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    assert sum(g.num_rows for g in groups) == 41 and max(g.row_group(i).num_rows for g in groups for i in range(g.num_row_groups)) < 10


def test_phrase_pairs_are_dealt_before_they_are_made_distinct(spark):
    """A short list of phrases is one task, and so was the table of all pairs."""
    df = spark.range(0, 3000, 1, 1).select("id", F.lit("red ring of the sea").alias("text"))
    phrases = spark.createDataFrame([("red ring",), ("of the",), ("the red",), ("ring",)], "phrase string")
    found = sets.match_phrases(df, "text", phrases, ["id"])
    assert found.count() == 9000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan


def test_small_keys_are_not_cut(spark):
    """Many rows in many keys: one shuffle by key for both steps back, and none for the fit."""
    df = spark.range(3000).select((F.col("id") % 300).alias("key"), "id", F.sqrt("id").alias("value"))
    _, order, cut = ordered.blocked(df, ["id"], 50, ["key"])
    assert (order, cut) == (["id"], False)
    assert ordered.blocked(df, ["id"], 5, ["key"])[2] and ordered.blocked(df, ["id"], 50)[2]
    whole, parts = (windows.autoregressive_forecast(df, ["key"], ["id"], "value", 2, n) for n in (50, 4))
    assert len(exchanged(whole)) == 1
    got = {(r["key"], r["step"]): r["forecast"] for r in parts.collect()}
    assert len(got) == 600 and got == pytest.approx({(r["key"], r["step"]): r["forecast"] for r in whole.collect()})


def test_permuted_rows_are_computed_once(spark):
    rows = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), (F.col("id") % 21).cast("double").alias("y"))
    model = models.train(rows, ["a", "b"], "y", "LinearRegression")
    found = models.permutation_importance(model, rows, "id", ["a", "b"], "y", "regression", repeats=2)
    assert found.inputFiles() and all("/permuted-" in f for f in found.inputFiles())
