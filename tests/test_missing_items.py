"""Search without the driver, neighbours as a model, cuts over any order, narrowed quantiles, one correlation."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.operators import aggs, models, ordered, quantiles, vectors


def test_nearest_in_blocks_of_both_sides(spark):
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(90, 4)), rng.normal(size=(70, 4))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "id string, v array<float>")
    x, q = x.astype(np.float32).astype(float), q.astype(np.float32).astype(float)
    d = ((q[:, None, :] - x[None]) ** 2).sum(2)
    for size in (10, 1000):
        got = {(r.query_id, r["rank"]): r.item_id for r in vectors.nearest(asked, corpus, 3, "id", "v", "id", "v", block_rows=size).collect()}
        assert got == {(f"q{i}", k + 1): int(j) for i in range(70) for k, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
        inner = {(r.query_id, r["rank"]): r.item_id for r in vectors.nearest(corpus, asked, 2, "id", "v", "id", "v", inner=True, block_rows=size).collect()}
        assert inner == {(i, k + 1): f"q{j}" for i in range(90) for k, j in enumerate(np.argsort(-(x @ q.T)[i], kind="stable")[:2])}
    itself = vectors.nearest(corpus, corpus, 1, "id", "v", "id", "v", skip_self=True, block_rows=10).collect()
    own = ((x[:, None, :] - x[None]) ** 2).sum(2) + np.diag(np.full(90, np.inf))
    assert {r.query_id: r.item_id for r in itself} == dict(enumerate(own.argmin(1).tolist()))


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 3)) + np.repeat(np.eye(3) * 2, 80, axis=0)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(240), y=np.repeat([0.0, 1.0, 2.0], 80))
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_neighbour_model(classes, weights):
    pdf, df = classes
    test = pdf.id % 4 == 0
    model = models.train(df.where("id % 4 <> 0"), ["a", "b", "c"], "y", "KNearestNeighbors", {"knn_neighbors": 7, "knn_weights": weights})
    got = models.batch_predict(model, df).toPandas().set_index("id").sort_index()
    x, y = pdf.loc[~test, ["a", "b", "c"]].to_numpy(), pdf.y[~test].to_numpy()
    for i, row in pdf.iterrows():
        d = np.sqrt(((x - row[["a", "b", "c"]].to_numpy(float)) ** 2).sum(1))
        near = np.argsort(d, kind="stable")[:7]
        w = np.ones(7) if weights == "uniform" else (d[near] == 0).astype(float) if (d[near] == 0).any() else 1 / d[near]
        share = np.array([w[y[near] == c].sum() for c in range(3)]) / w.sum()
        assert np.allclose(got.loc[i, [f"probability_class_{c}" for c in range(3)]].to_numpy(float), share)
        assert got.loc[i, "prediction"] == share.argmax()
    value = models.train(df.where("id % 4 <> 0"), ["a", "b"], "c", "KNNRegressor")
    out = models.batch_predict(value, df.where("id % 4 = 0")).toPandas()
    x = pdf.loc[~test, ["a", "b"]].to_numpy()
    for _, r in out.iterrows():
        near = np.argsort(((x - [r.a, r.b]) ** 2).sum(1), kind="stable")[:5]
        assert abs(r.prediction - pdf.c[~test].to_numpy()[near].mean()) < 1e-9


def test_neighbours_in_compare_and_tune(classes):
    _, df = classes
    rows, fitted = models.compare(df.where("id % 4 <> 0"), df.where("id % 4 = 0"), ["a", "b", "c"], "y", {"KNearestNeighbors": {}, "KNNRegressor": {"knn_neighbors": 3}})
    assert [r["error"] for r in rows] == [None, None] and rows[0]["metrics"]["accuracy"] > 0.6 and set(fitted) == {"KNearestNeighbors", "KNNRegressor"}
    best, scores = models.tune(df, "id", ["a", "b", "c"], "y", "KNearestNeighbors", folds=2)
    assert scores.count() == 6 and "prediction" in models.batch_predict(best, df).columns
    with pytest.raises(ValueError, match="classes"):
        models.train(df, ["a"], "b", "KNearestNeighbors")


ORDERS = {
    "text": ("string", lambda i: f"t{i * 37 % 500:04d}"),
    "tied": ("long", lambda i: 5),
    "null": ("string", lambda i: None),
    "time": ("timestamp", lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i * 37 % 500)),
    "mixed": ("double", lambda i: None if i % 3 else float(i % 7)),
}


@pytest.mark.parametrize("kind", list(ORDERS))
def test_cuts_over_any_order(spark, kind):
    dtype, value = ORDERS[kind]
    rows = [(i % 3, value(i), i, None if i % 4 else i) for i in range(500)]
    df = spark.createDataFrame(rows, f"k int, o {dtype}, id int, v int")
    work, _, cut = ordered.blocked(df, ["o"], 10)
    sizes = [r["count"] for r in work.groupBy("_block").count().collect()]
    assert cut and len(sizes) > 20 and max(sizes) < 60
    got = ordered.position(df, ["k"], ["o"], "pos", block_rows=10).toPandas()
    for _, part in got.groupby("k"):
        assert sorted(part.pos) == list(range(1, len(part) + 1))
        by = part.sort_values("pos").o.tolist()
        plain = [x for x in by if not pd.isna(x)]
        assert plain == sorted(plain) and by[: len(by) - len(plain)] == [x for x in by if pd.isna(x)]
    back = ordered.position(df, ["k"], ["o", "id"], "pos", descending=True, block_rows=10).toPandas()
    want = ordered.position(df, ["k"], ["o", "id"], "pos", descending=True).toPandas()
    assert back.set_index("id").pos.sort_index().equals(want.set_index("id").pos.sort_index())
    for backward in (False, True):
        a, b = (ordered.fill(df, ["k"], ["o", "id"], ["v"], backward, n).toPandas().set_index("id").v.sort_index() for n in (10, None))
        assert a.equals(b)
    a, b = (ordered.previous(df, ["k"], ["o", "id"], {"p": "id"}, n).toPandas().set_index("id").p.sort_index() for n in (10, None))
    assert a.equals(b)


@pytest.mark.parametrize("values", ["normal", "skewed", "ties", "huge"])
def test_narrowed_quantiles(spark, values):
    rng = np.random.default_rng(5)
    n = 100_000
    x = {"normal": rng.normal(size=n), "skewed": np.exp(rng.normal(size=n) * 20), "ties": rng.integers(0, 4, n).astype(float), "huge": np.where(rng.random(n) < 0.5, -1e308, 1e308) * rng.random(n)}[values]
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(pd.DataFrame({"v": x, "k": np.where(np.arange(n) < 50, 1, 0)}))
    np.testing.assert_allclose(quantiles.quantiles(df, ["v"], probs, limit=10)["v"], np.quantile(x, probs), rtol=1e-9)
    got = quantiles.group_quantiles(df, ["k"], ["v"], [0.5], limit=60).toPandas().set_index("k").v_q0
    np.testing.assert_allclose([got[0], got[1]], [np.median(x[50:]), np.median(x[:50])], rtol=1e-9)


def test_infinite_values_have_quantiles(spark):
    df = spark.createDataFrame([(float("inf"),)] * 30 + [(float(i),) for i in range(40)] + [(float("-inf"),)] * 30, "v double")
    assert quantiles.quantiles(df, ["v"], [0.1, 0.5, 0.9], limit=5)["v"] == [float("-inf"), 19.5, float("inf")]


def test_one_correlation_at_every_width(spark):
    rng = np.random.default_rng(6)
    n = 400
    pdf = pd.DataFrame({f"c{i}": rng.normal(size=n) for i in range(9)})
    pdf["c1"] = np.where(np.arange(n) < 200, 1e9, 5 + 1e-4 * rng.normal(size=n))  # nearly constant where c0 is present, far off elsewhere
    pdf.loc[:199, "c0"] = np.nan
    pdf["c2"] = 7.3
    pdf.loc[::3, "c3"] = np.nan
    df = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in pdf.columns]).repartition(4)
    nine = {(r.left, r.right): r.r for r in aggs.correlations(df).collect()}
    for width in (2, 4, 8):
        for (a, b), r in ((k, v) for k, v in nine.items() if int(k[1][1]) < width):
            part = {(x.left, x.right): x.r for x in aggs.correlations(df, [f"c{i}" for i in range(width)]).collect()}[a, b]
            assert part == r or abs(part - r) < 1e-12
    for (a, b), r in nine.items():
        both = pdf[[a, b]].dropna()
        if "c2" in (a, b):
            assert r is None
        else:
            assert abs(r - np.corrcoef(both[a], both[b])[0, 1]) < 1e-8


def test_distinct_counts(spark):
    df = spark.createDataFrame([(i % 7, None if i % 2 else f"t{i % 5}", i % 3 > 0) for i in range(100)], "a int, b string, c boolean")
    assert {r.column: r["distinct"] for r in aggs.distinct_counts(df).collect()} == {"a": 7, "b": 5, "c": 2}
    plan = aggs.distinct_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
