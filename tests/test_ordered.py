"""Block-wise ordered operators and bracketed quantiles against pandas."""

import numpy as np
import pandas as pd
import pytest

from quern.operators import ordered, quantiles


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 6, n)),
        "t": rng.permutation(n),
        "v": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n).round(2)),
    })
    sdf = spark.createDataFrame(pdf).selectExpr("k", "t", "nanvl(v, null) v")
    return pdf.sort_values(["k", "t"]).reset_index(drop=True), sdf


@pytest.mark.parametrize("block_rows", [None, 100])
def test_position_and_running_sum(frame, block_rows):
    pdf, sdf = frame
    got = ordered.position(sdf, ["k"], ["t"], "pos", block_rows=block_rows).toPandas().sort_values(["k", "t"])
    assert (got.pos.values == pdf.groupby("k").cumcount().values + 1).all()
    down = ordered.position(sdf, ["k"], ["t"], "pos", descending=True, block_rows=block_rows).toPandas().sort_values(["k", "t"])
    assert (down.pos.values == pdf.groupby("k").cumcount(ascending=False).values + 1).all()


@pytest.mark.parametrize("block_rows", [None, 100])
def test_previous(frame, block_rows):
    pdf, sdf = frame
    got = ordered.previous(sdf, ["k"], ["t"], {"p": "t"}, block_rows=block_rows).toPandas().sort_values(["k", "t"])
    np.testing.assert_array_equal(got.p.astype(float).values, pdf.groupby("k").t.shift(1).values)


@pytest.mark.parametrize("block_rows", [None, 100])
@pytest.mark.parametrize("backward", [False, True])
def test_fill(frame, block_rows, backward):
    pdf, sdf = frame
    got = ordered.fill(sdf, ["k"], ["t"], ["v"], backward, block_rows).toPandas().sort_values(["k", "t"])
    want = pdf.groupby("k").v.bfill() if backward else pdf.groupby("k").v.ffill()
    np.testing.assert_array_equal(got.v.values, want.values)


@pytest.mark.parametrize("probs", [[0.25, 0.5, 0.75], [0.0, 0.05, 0.95, 1.0]])
def test_quantiles_bracketed(spark, probs, monkeypatch):
    rng = np.random.default_rng(3)
    n = 60_000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 40, n)), "v": np.r_[rng.lognormal(size=n - 5000), np.full(5000, 1.0)]})
    sdf = spark.createDataFrame(pdf)
    want = pdf.v.quantile(probs).values
    np.testing.assert_allclose(quantiles.quantiles(sdf, ["v"], probs, limit=100)["v"], want, rtol=1e-12)
    monkeypatch.setattr(quantiles, "ACCURACY", 1000)
    got = quantiles.group_quantiles(sdf, ["k"], ["v"], probs, limit=20_000).toPandas().set_index("k").sort_index()
    per = pdf.groupby("k").v.quantile(probs).unstack().sort_index()
    np.testing.assert_allclose(got[[f"v_q{j}" for j in range(len(probs))]].values, per.values, rtol=1e-12)
