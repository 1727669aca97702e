"""Phrases, levels, point lookup, word neighbours and the ends of streams on small hand-made rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quern.core import scratch_dir
from quern.functions import lists
from quern.operators import aggs, features, sets, spatial, terms
from quern.streaming import streams


def test_phrases_of_any_length_and_with_punctuation(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"so {long.upper()} ends"), (1, "the u.s. dollar fell"), (2, "xu.s. dollar"), (2, "u.s. dollars"), (3, None), (3, ""), (None, "cost: $$ and c++ (net)"), (4, "uxs. dollar a\\eb")]
    texts = spark.createDataFrame(rows, "k int, t string")
    phrases = spark.createDataFrame([(p,) for p in (long, "u.s. dollar", "dollar", "$$", "c++", "(net)", "a\\eb", "", None, "dollar")], "phrase string")
    got = sorted((r["k"] or 0, r["phrase"]) for r in sets.match_phrases(texts, "t", phrases, ["k"]).collect())
    assert got == sorted([(0, "$$"), (0, "(net)"), (0, "c++"), (1, long), (1, "dollar"), (1, "u.s. dollar"), (2, "dollar"), (4, "a\\eb"), (4, "dollar")])
    assert sets.match_phrases(texts.limit(0), "t", phrases, ["k"]).count() == sets.match_phrases(texts, "t", phrases.limit(0), ["k"]).count() == 0


def test_twenty_thousand_levels(spark):
    rows = spark.range(40_000).select("id", F.concat(F.lit(" L"), F.lpad((F.col("id") % 20_000).cast("string"), 5, "0")).alias("level"), (F.col("id") % 3).alias("k"))
    coded, codes = features.one_hot_sparse(rows, "level")
    assert codes.count() == 20_000
    vectors = coded.where("id in (0, 19999, 20007)").orderBy("id").collect()
    assert [(r["level_onehot"].size, list(r["level_onehot"].indices), r["level_code"]) for r in vectors] == [(20_000, [0], 0), (20_000, [19_999], 19_999), (20_000, [7], 7)]
    assert aggs.pivot_long(rows, "k", "level", "id").count() == 40_000
    with pytest.raises(ValueError, match="levels"):
        aggs.pivot_wide(rows, "k", "level", "id")
    missing = spark.createDataFrame([(1, None), (2, "A "), (3, "a")], "id int, level string")
    assert [(r["id"], r["level"], r["level_code"]) for r in features.one_hot_sparse(missing, "level")[0].orderBy("id").collect()] == [(1, "nan", 1), (2, "a", 0), (3, "a", 0)]


def ring(points):
    return [[float(x), float(y)] for x, y in [*points, points[0]]]


def inside(x, y, rings):
    """Even-odd rule, edge by edge."""
    odd = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:]):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


def test_points_in_one_cell_and_features_of_all_sizes(spark):
    rng = np.random.default_rng(5)
    star = [(20 + (4 + 3 * (i % 2)) * np.cos(i / 200 * np.pi), 20 + (4 + 3 * (i % 2)) * np.sin(i / 200 * np.pi)) for i in range(400)]
    shapes = {
        "world": [ring([(-180, -90), (180, -90), (180, 90), (-180, 90)])], "star": [ring(star)],
        "frame": [ring([(19, 19), (21, 19), (21, 21), (19, 21)]), ring([(19.5, 19.5), (20.5, 19.5), (20.5, 20.5), (19.5, 20.5)])],
        "speck": [ring([(20, 20), (20.001, 20), (20.0005, 20.001)])], "line": [ring([(1, 1), (2, 1)])], "none": [],
    }
    twice = [*shapes.items(), ("star", shapes["star"])]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate([*rng.uniform(19.999, 20.002, (300, 2)), *rng.uniform(10, 30, (300, 2)), (1.5, 1.0), (20, 20)])]
    df = spark.createDataFrame([*points, (-1, None, 1.0)], "id int, lon double, lat double")
    found = spatial.locate(df, spark.createDataFrame(twice, "name string, rings array<array<array<double>>>"))
    assert found.columns == ["id", "lon", "lat", "name", "rings"]
    got = sorted((r["id"], r["name"]) for r in found.select("id", "name").collect())
    assert got == sorted((i, n) for i, x, y in points for n, rings in twice if inside(x, y, rings))
    empty = spark.createDataFrame([], "name string, rings array<array<array<double>>>")
    assert spatial.locate(df, empty).count() == spatial.locate(df.limit(0), found.select("name", "rings")).count() == 0


def test_nearest_words_match_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 6))
    x[7] = x[3] * 2  # the same direction
    rows = [(f"w{i:02d}", [float(v) for v in x[i]]) for i in range(80)] + [("zero", [0.0] * 6)]
    got = terms.nearest_words(spark.createDataFrame(rows, "word string, vector array<double>"), 4).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = unit @ unit.T
    assert len(got) == 320 and {r["word"] for r in got} == {f"w{i:02d}" for i in range(80)}
    for r in got:
        i, j = int(r["word"][1:]), int(r["neighbour"][1:])
        others = np.sort(np.delete(cosine[i], i))[::-1]
        assert i != j and abs(cosine[i, j] - others[r["rank"] - 1]) < 1e-9 and abs(r["similarity"] - cosine[i, j]) < 1e-6
    assert [r["neighbour"] for r in got if r["word"] == "w07" and r["rank"] == 1] == ["w03"]


def test_word_vectors_train_over_partitions(spark):
    texts = spark.createDataFrame([("red green blue colour paint",), ("one two three four number",)] * 200, "t string")
    found = terms.word_vectors(texts, "t", size=16, partitions=3).getVectors().select("word", vector_to_array("vector").alias("vector"))
    near = {r["word"]: r["neighbour"] for r in terms.nearest_words(found, 1).collect()}
    assert len(near) == 10


def land(spark, path, schema, *rows):
    spark.createDataFrame([(k, dt.datetime.fromisoformat(t), v) for k, t, v in rows], schema).write.mode("append").parquet(path)


def test_end_of_input_closes_every_window(spark):
    path, out, mark = (scratch_dir(spark, n) for n in ("in", "out", "mark"))
    schema = "k int, ts timestamp, v double"

    def run():
        streams.append_all(streams.file_stream(spark, path, schema), out, mark, lambda s: streams.windowed_means(s, "ts", "v", ["k"]))

    land(spark, path, schema, (1, "2024-01-01 00:10", 1.0), (None, "2024-01-01 00:20", 3.0), (1, "2024-01-01 05:59", 9.0), (1, "2024-01-01 06:00", None))
    run()
    assert {r["window_start"].hour for r in spark.read.parquet(out).collect()} == {0}
    streams.end_of_input(spark, path, schema, "ts")
    run()
    got = {(r["window_start"].hour, r["k"]): (r["mean"], r["rows"]) for r in spark.read.parquet(out).collect()}
    assert got == {(0, 1): (1.0, 1), (0, None): (3.0, 1), (5, 1): (9.0, 1), (6, 1): (None, 1)}
    bare = scratch_dir(spark, "in")
    spark.createDataFrame([], schema).write.parquet(bare)
    streams.end_of_input(spark, bare, schema, "ts")
    assert spark.read.schema(schema).parquet(bare).count() == 0


def test_repeats_are_known_after_a_restart(spark):
    path, out, mark = (scratch_dir(spark, n) for n in ("in", "out", "mark"))
    schema = "k int, ts timestamp, v double"
    for rows in ([(1, "2024-01-01 00:10", 1.0), (2, "2024-01-01 00:20", 1.0)], [(1, "2024-01-01 00:10", 2.0), (3, "2024-01-01 00:40", 1.0)], [(2, "2024-01-01 00:50", 3.0), (3, "2024-01-01 00:40", 2.0)]):
        land(spark, path, schema, *rows)
        streams.append_all(streams.file_stream(spark, path, schema), out, mark, lambda s: streams.drop_repeats(s, "ts", ["k"]))
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(out).collect()) == [(1, 1.0), (2, 1.0), (3, 1.0)]


def test_texts_that_are_no_lists_give_no_labels(spark):
    texts = ["['a', \"b's\"]", "[ 'x\\'y' , 1.5, ]", "[]", "a, b", "plain", "['open'", "[bare]", "['a' 'b']", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["x"] for r in df.orderBy("i").select(lists.literal_items(F.col("t")).alias("x")).collect()]
    assert got == [["a", "b's"], ["x'y", "1.5"], [], [], [], [], [], [], [], []]
