"""Queries without SQL and scale paths, against brute force on small fixtures."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.core import scratch_dir
from quern.functions import nlu, numeric, text
from quern.operators import aggs, chunks, features, models, ordered, quality, retrieval, spatial, terms, vectors, windows
from quern.plans import jobs, knowledge, training
from quern.streaming import streams
from quern.workload import QUERIES


def brute_wer(ref, hyp):
    a, b = ref.lower().split(), hyp.lower().split()
    if not a:
        return 1.0 if b else 0.0
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return prev[-1] / len(a)


def test_word_error_rate(spark):
    rng = np.random.default_rng(1)
    rows = [(" ".join(rng.choice(list("abcd"), rng.integers(0, 12))), " ".join(rng.choice(list("ABCde"), rng.integers(0, 12)))) for _ in range(200)]
    got = spark.createDataFrame(rows, "r string, h string").select("r", "h", text.word_error_rate(F.col("r"), F.col("h")).alias("w")).collect()
    for r in got:
        assert r["w"] == pytest.approx(brute_wer(r["r"], r["h"]))


def test_boxcox_lambda(spark):
    x = np.random.default_rng(2).lognormal(1.0, 0.7, 400) ** 1.5
    df = spark.createDataFrame(pd.DataFrame({"x": x}))

    def llf(lam):
        y = np.log(x) if lam == 0 else (x**lam - 1) / lam
        return (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())

    best = features.boxcox_lambda(df, "x", 0.0)
    assert llf(best) >= max(llf(g) for g in np.linspace(-2, 2, 2001)) - 1e-6
    out, fitted = features.boxcox_transform(df, ["x"])
    lam = fitted["x"][0]
    np.testing.assert_allclose(np.sort(out.toPandas().x), np.sort((x**lam - 1) / lam), rtol=1e-9)


def recursive_reference(text_, size, overlap):
    """Properties every recursive cut must have."""
    pieces = chunks.cut_recursively(text_, size, overlap)
    assert all(len(p) <= size and p == p.strip() and p for p in pieces)
    kept = {w for p in pieces for w in p.split()}
    return pieces, kept


def test_recursive_chunks():
    para = "First paragraph. It has sentences. And more words here.\n\nSecond paragraph is short.\n\n" + "word " * 200
    pieces, kept = recursive_reference(para, 120, 20)
    assert {w for w in para.split()} <= kept
    assert pieces[0].startswith("First paragraph")
    assert chunks.cut_recursively("short", 500, 50) == ["short"]
    assert chunks.cut_recursively("a" * 1000, 400, 100) == ["a" * 400, "a" * 400, "a" * 400]
    assert chunks.cut_recursively("aaa bbb ccc ddd", 8, 4, [" ", ""]) == ["aaa bbb", "bbb ccc", "ccc ddd"]


def test_nearest_blocks_and_dimensions(spark):
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(300, 6)), rng.normal(size=(11, 6))
    x[7] = x[3]
    corpus = spark.createDataFrame([(f"i{i:03d}", v.tolist()) for i, v in enumerate(x)], "id string, v array<double>").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id bigint, v array<double>")
    for size in (None, 3 * 6 * 8):
        got = vectors.nearest(asked, corpus, 4, "id", "v", "id", "v", block_rows=size).orderBy("query_id", "rank").collect()
        d = ((q[:, None, :] - x[None]) ** 2).sum(2)
        want = [(i, f"i{j:03d}") for i in range(11) for j in np.lexsort((np.arange(300), d[i]))[:4]]
        assert [(r["query_id"], r["item_id"]) for r in got] == want
    assert vectors.nearest(asked, corpus, 999, "id", "v", "id", "v").count() == 11 * 300
    assert vectors.nearest(asked.limit(0), corpus, 3, "id", "v", "id", "v").count() == 0
    with pytest.raises(ValueError, match="dimension"):
        vectors.nearest(asked.withColumn("v", F.slice("v", 1, 3)), corpus, 3, "id", "v", "id", "v")


def test_smote_and_adasyn(spark):
    rng = np.random.default_rng(9)
    rows = [(i, *(float(v) for v in rng.normal(size=2)), 0) for i in range(60)] + [(100 + i, *(float(v) for v in rng.normal(1, 0.5, size=2)), 1) for i in range(13)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, y int")
    made = features.smote(df, "y", 1, "id", ["a", "b"]).toPandas()
    assert len(made) == 47 and made.groupby("_base").size().max() - made.groupby("_base").size().min() <= 1
    points = {r[0]: np.array(r[1:3]) for r in rows if r[3] == 1}
    for r in made.itertuples():
        p, base = np.array([r.a, r.b]), points[r._3 if hasattr(r, "_3") else made.loc[r.Index, "_base"]]
        near = sorted((np.sum((base - o) ** 2), k) for k, o in points.items() if not np.array_equal(o, base))[:5]
        assert any(abs(np.linalg.det(np.stack([points[k] - base, p - base]))) < 1e-9 and -1e-9 <= np.dot(p - base, points[k] - base) <= d + 1e-9 for d, k in near)
    assert features.adasyn(df, "y", 1, "id", ["a", "b"]).count() > 0
    even = features.resample(df, "y", "id", ["a", "b"], "random_undersample").groupBy("y").count().collect()
    assert {r["count"] for r in even} == {13}


def test_pca_and_clusters(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(200, 2)) @ np.array([[3.0, 1.0, 0.5], [0.2, 0.1, 2.0]])
    df = spark.createDataFrame(pd.DataFrame(m, columns=["a", "b", "c"]))
    out, shares = features.pca_columns(df, None, None, 0.95)
    centred = m - m.mean(0)
    values = np.linalg.eigvalsh(np.cov(centred.T))[::-1]
    np.testing.assert_allclose(shares, (values / values.sum())[: len(shares)], rtol=1e-6)
    np.testing.assert_allclose(out.toPandas()["pca_1"].var(), values[0], rtol=1e-6)
    two = spark.createDataFrame([(float(i % 2) * 10 + i * 0.001, float(i % 2) * -10) for i in range(40)], "x double, y double")
    labels = features.cluster_labels(two, ["x", "y"], 2).toPandas()
    assert labels.groupby("cluster_label").size().tolist() == [20, 20] and (labels.groupby("cluster_label").y.nunique() == 1).all()
    assert "cluster_label" not in features.cluster_labels(two.limit(3), ["x", "y"]).columns


def test_level_codes_many_levels(spark):
    df = spark.createDataFrame([(f"v{i:05d}",) for i in range(3000)] * 2, "c string").repartition(7)
    got = features.level_codes(df, "c", limit=100).orderBy("code").collect()
    assert [r["code"] for r in got] == list(range(3000)) and [r["level"] for r in got] == sorted(r["level"] for r in got)


def test_ordered_slices_between_cuts(spark, monkeypatch):
    monkeypatch.setattr(ordered, "MAX_CUTS", 4)
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 4000), "t": rng.permutation(4000) ** 2, "v": rng.random(4000)})
    got = ordered.running_sum(spark.createDataFrame(pdf), ["k"], ["t"], {"s": F.col("v")}, block_rows=100).toPandas().sort_values(["k", "t"])
    np.testing.assert_allclose(got.s.values, pdf.sort_values(["k", "t"]).groupby("k").v.cumsum().values)


def test_keep_first_and_fill_match_pandas(spark):
    pdf = pd.DataFrame({"k": [1, 1, 2, 2, 2], "t": [2, 1, 5, 4, 6], "v": ["b", "a", None, "d", "e"]})
    df = spark.createDataFrame(pdf)
    first = {r["k"]: r["v"] for r in quality.remove_duplicates(df, ["k"], "first", ["t"]).collect()}
    assert first == {1: "a", 2: "d"}
    with pytest.raises(ValueError):
        quality.remove_duplicates(df, ["k"])
    assert quality.fill_along(df, ["k"], ["t"], ["v"]).where("v is null").count() == 0


def test_corrected_skew_and_summary(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10)], "x double")
    assert df.agg(aggs.corrected_skew(F.col("x"))).collect()[0][0] == pytest.approx(1.76363, abs=1e-5)
    assert tuple(aggs.summarize(df.limit(0), "x").collect()[0]) == (0.0, 0.0, 0.0, 0.0)
    assert aggs.confidence_interval(df.limit(1).withColumn("k", F.lit(1)), ["k"], "x").collect()[0]["lower"] == 1.0


def test_growth_and_forecast(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([100.0, 110.0, 0.0, 5.0])], "k string, t int, v double")
    got = [r["growth_percent"] for r in windows.growth_rate(df, ["k"], ["t"], "v").orderBy("t").collect()]
    assert got[0] == pytest.approx(10.0) and got[1] == -100.0 and got[2] is None
    steps = [r["forecast"] for r in windows.moving_average_forecast(df, ["k"], ["t"], "v", 3, 2).orderBy("step").collect()]
    assert steps == pytest.approx([115 / 3, (0 + 5 + 115 / 3) / 3])


def test_text_models(spark):
    rows = [(i, "good growth profit strong market" if i % 2 else "goal match player team season", "business" if i % 2 else "sport") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    for kind in ("naive_bayes", "logistic"):
        model = terms.train_text_classifier(df, "text", "label", kind)
        got = terms.classify_texts(model, df)
        assert got.where("predicted = label").count() == 40
        assert terms.class_labels(model) == ["business", "sport"]
    assert {r[0] for r in terms.class_top_terms(model, 3)} == {"business", "sport"}
    topics = terms.lda_topics(df, "text", 2, 3, min_df=1.0, max_df=1.0).collect()
    assert len(topics) == 6
    assert terms.word_vectors(df, "text", 8).getVectors().count() == 10


def test_models_learn(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    pdf = pd.DataFrame({"id": range(400), "a": x[:, 0], "b": x[:, 1], "y": (x[:, 0] + 0.1 * rng.normal(size=400) > 0).astype(int), "z": 3 * x[:, 0] + 1})
    df = spark.createDataFrame(pdf)
    rows = models.stratified_split(df, "id", "y")
    results, fitted = models.compare(rows.where("split = 'train'"), rows.where("split = 'test'"), ["a", "b"], "y", {"LogisticRegression": {}, "DecisionTree": {"max_depth": 3}, "Nonsense": {}})
    by_name = {r["model_name"]: r for r in results}
    assert by_name["LogisticRegression"]["metrics"]["accuracy"] > 0.9 and by_name["LogisticRegression"]["metrics"]["roc_auc"] > 0.95
    assert "Nonsense" in by_name["Nonsense"]["error"]
    probs = models.batch_predict(fitted["LogisticRegression"], df).selectExpr("probability_class_0 + probability_class_1 as s").agg(F.min("s"), F.max("s")).collect()[0]
    assert probs[0] == pytest.approx(1) and probs[1] == pytest.approx(1)
    line = models.train(df, ["a", "b"], "z", "LinearRegression")
    shuffled = {r["feature"]: r["mean_importance"] for r in models.permutation_importance(line, df, "id", ["a", "b"], "z", "regression", 2).collect()}
    assert shuffled["a"] > 1 and abs(shuffled["b"]) < 1e-6
    assert models.feature_importance(line, ["a", "b"])[0][0] == "a"
    _, table = models.tune(df, "id", ["a", "b"], "y", "LogisticRegression", {"regParam": [0.0, 10.0]}, folds=2)
    assert table.count() == 2


def test_index_and_answers(spark):
    docs = spark.createDataFrame([("d1", "The river floods the northern valley every spring. " * 12), ("d2", "Solar panels turn sunlight into electric power. " * 12), ("d3", "  ")], "document_id string, text string")
    path = scratch_dir(spark, "kb")
    first = knowledge.index_documents(docs.withColumn("source", F.col("document_id")), path).collect()[0]
    assert first["documents"] == 2 and first["built"]
    assert not knowledge.index_documents(docs, path).collect()[0]["built"]
    asked = spark.createDataFrame([(1, "When does the river flood the valley?"), (2, "   ")], "question_id bigint, question string")
    got = {r["question_id"]: r for r in knowledge.answer_questions(asked, path, k=2).collect()}
    assert got[1]["hits"] == 2 and got[1]["sources"][0] == "d1" and "USER QUESTION:\nWhen does" in got[1]["prompt"]
    assert got[2]["hits"] == 0 and got[2]["answer"] == retrieval.NO_ANSWER and retrieval.NO_CONTEXT in got[2]["prompt"]


def test_context_budget(spark):
    hits = spark.createDataFrame([(1, 1, "a" * 100, "s"), (1, 2, "a" * 100, "s"), (1, 3, "b" * 300, "s"), (1, 4, "c", "s")], "q int, rank int, text string, source string")
    asked = spark.createDataFrame([(1, "x"), (2, "y")], "q int, question string")
    got = {r["q"]: r["context"] for r in retrieval.build_context(hits, asked, ["q"], 250).collect()}
    head = "Source: s\n"
    assert got[1] == head + "a" * 100 + retrieval.SEPARATOR + head + "b" * 130 + "..."
    assert got[2] == retrieval.NO_CONTEXT


def test_intents(spark):
    rows = [("", "UNKNOWN_INTENT"), ("show the boundary map", "GIS_VIEW"), ("predict churn", "PREDICTION"), ("gdp statistics", "DATA_METRIC"), ("explain this", "FAQ"), ("hi", "UNKNOWN_INTENT")]
    got = spark.createDataFrame(rows, "q string, want string").select("want", nlu.intent(F.col("q"))["intent"].alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)
    found = spark.createDataFrame([("credit score 680 and density index in WARANGAL, Ranga Reddy 2024",)], "q string").select(nlu.domain_entities(F.col("q")).alias("e")).collect()[0]["e"]
    assert found["locations"] == ["Ranga Reddy", "Warangal"] and found["metrics"] == ["credit score", "density", "density index"] and found["dates"] == ["2024"]
    assert found["features"]["credit_score"] == 680.0


def test_point_in_polygon_with_hole(spark):
    outer, hole = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]], [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0], [4.0, 4.0]]
    triangle = [[20.0, 0.0], [30.0, 0.0], [25.0, 10.0], [20.0, 0.0]]
    shapes = spark.createDataFrame([("square", [outer, hole]), ("triangle", [triangle])], "name string, rings array<array<array<double>>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 25.0, 5.0), (4, 20.5, 9.0), (5, -1.0, 5.0)], "id int, lon double, lat double")
    got = {(r["id"], r["name"]) for r in spatial.locate(points, shapes, cell=2.0).collect()}
    assert got == {(1, "square"), (3, "triangle")}


def test_stream_restart_and_late_rows(spark):
    path, out, mark = (scratch_dir(spark, n) for n in ("in", "out", "mark"))
    schema = "k int, ts timestamp, v double"

    def land(*rows):
        spark.createDataFrame([(k, dt.datetime.fromisoformat(t), v) for k, t, v in rows], schema).coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = streams.file_stream(spark, path, schema, files_per_batch=1)
        streams.append_all(stream, out, mark, lambda s: streams.windowed_means(s, "ts", "v", ["k"]))

    land((1, "2024-01-01 00:10", 1.0), (1, "2024-01-01 00:20", 3.0))
    land((1, "2024-01-01 05:00", 9.0))
    run()
    land((1, "2024-01-01 00:30", 100.0), (1, "2024-01-01 09:00", 2.0))
    run()
    run()
    got = {r["window_start"].hour: r["mean"] for r in spark.read.parquet(out).collect()}
    assert got == {0: 2.0, 5: 9.0}


def test_penalties_match_their_definitions(spark):
    """Ridge against the normal equations; lasso and elastic net against their optimality conditions."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2)) * [1.0, 5.0] + [2.0, -1.0]
    y = x @ [3.0, -0.7] + rng.normal(size=60) * 4
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, y double")
    cx, cy = x - x.mean(0), y - y.mean()
    fit = lambda name, p: models.train(df, ["a", "b"], "y", name, p).stages[-1].coefficients.toArray()
    assert fit("Ridge", {"alpha": 100.0}) == pytest.approx(np.linalg.solve(cx.T @ cx + 100 * np.eye(2), cx.T @ cy), rel=1e-6)
    for name, p, share in (("Lasso", {"alpha": 0.5}, 1.0), ("ElasticNet", {"alpha": 0.5, "l1_ratio": 0.3}, 0.3)):
        w = fit(name, p)
        slope = cx.T @ (cy - cx @ w) / 60
        assert slope == pytest.approx(0.5 * share * np.sign(w) + 0.5 * (1 - share) * w, abs=1e-3)


def test_preprocessing_is_fitted_on_the_training_rows(spark):
    """Other rows never change the fitted values, and applying them to the same rows gives the same table."""
    schema = "k int, x double, c string, t string, y string"
    train = spark.createDataFrame([(i, float(i * i), "abc"[i % 3], f"w{i % 12:02}", "no" if i % 4 else "yes") for i in range(48)], schema)
    odd = spark.createDataFrame([(100, 1e9, "new", "other", "no"), (101, None, "a", None, "yes"), (102, -5.0, "b", "w01", "yes")], schema)
    cfg = {"handle_outliers": True, "apply_log_transform": True, "skewness_threshold": 0.1}
    alone, first = jobs.preprocess(train, cfg, "y", "k", train=train)
    both, second = jobs.preprocess(train.unionByName(odd), cfg, "y", "k", train=train)
    plain = lambda f: {k: v for k, v in f.items() if "codes" not in k}
    assert plain(first) == plain(second) and list(first) == list(second)
    applied = jobs.apply_preprocess(odd, first)
    assert set(applied.columns) == set(both.columns) == set(alone.columns)
    rows = lambda df: {r["k"]: r.asDict() for r in df.collect()}
    whole = rows(both)
    for k, r in (rows(alone) | rows(applied)).items():
        assert whole[k] == pytest.approx(r)
    assert "y" not in jobs.apply_preprocess(odd.drop("y"), first).columns


def test_all_columns_become_features(spark):
    cols = [f"t{i}" for i in range(7)]
    df = spark.createDataFrame([(*[f"a{i} b"[: 2 + (i + j) % 3] for j in range(7)], float(i)) for i in range(6)], ", ".join([*(f"{c} string" for c in cols), "v double"]))
    out, _ = jobs.engineer_features(df, {"feature_selection_method": "none"})
    assert all(f"{c}_length" in out.columns for c in cols)


def test_best_regression_run_is_found(spark):
    runs = spark.createDataFrame([("t1", "m1", "d", "regression", 1.0, {}, {"r2": 0.4}), ("t2", "m2", "d", "regression", 1.0, {}, {"r2": 0.9})], models.RUN_SCHEMA)
    best = models.best_run(runs, "regression").collect()
    assert [(r["model_name"], r["best_value"]) for r in best] == [("m2", 0.9)]
    assert [r["model_name"] for r in models.comparison_table(runs, ["r2"], "regression").collect()] == ["m2", "m1"]


@pytest.mark.parametrize("name", ["l12_batch_predict", "n05_text_naive_bayes", "n06_text_logistic"])
def test_unlabelled_documents_are_scored(spark, name):
    folder = "/root/testdata/sf0.001"
    docs, labels = ({r["doc_id"] for r in spark.read.parquet(f"{folder}/{t}.parquet").select("doc_id").collect()} for t in ("documents", "labels"))
    rows = QUERIES[name](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs) and docs - labels
    assert not any(v is None for r in rows for v in r)


@pytest.mark.parametrize("name, operator", [("l04_grid_search", "tune"), ("l05_classifiers", "compare"), ("l08_compare_regressors", "compare"), ("l10_feature_importance", "train"), ("l14_forest_forecast", "forest_forecast"), ("l16_learning_curve", "learning_curve"), ("l17_baseline_job", "run_baseline"), ("n10_word_vectors", "word_vectors"), ("r16_configuration_sweep", "sweep")])
def test_queries_run_the_operator_with_its_defaults(spark, monkeypatch, name, operator):
    class Called(Exception):
        pass

    def stop(*given, **named):
        raise Called(given, named)

    for module in (models, terms, training, knowledge):
        if hasattr(module, operator):
            monkeypatch.setattr(module, operator, stop)
    with pytest.raises(Called) as found:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    given, named = found.value.args
    assert not named
    if operator == "compare":
        assert given[-1] == {n: {} for n in training.BASELINES["classification" if name[:3] == "l05" else "regression"]}
    else:
        assert len(given) == {"tune": 5, "train": 4, "forest_forecast": 4, "learning_curve": 5, "run_baseline": 5, "word_vectors": 2, "sweep": 6}[operator]


def test_all_labels_and_page_paths(spark):
    folder = "/root/testdata/sf0.001"
    labels = {r["label"] for r in QUERIES["n11_all_entity_counts"](spark, folder).collect()}
    assert labels - {"PERCENT", "MONEY"}
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    want = pages.select("page_id", *[e.alias(n) for n, e in numeric.dataset_tag(F.col("url")).items()], numeric.is_result_file(F.col("url")).alias("is_result"))
    got = QUERIES["x36_page_dataset_tag"](spark, folder)
    assert got.exceptAll(want).count() == 0 and got.count() == pages.count()
