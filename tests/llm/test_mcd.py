"""The robust estimate and its verdicts against a plain version, and a cluster that traps a single start."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.core import materialize
from quern.llm import quality_rules as Q

P = 5


def table(spark, groups):
    rows = [(i, False, *map(int, v), g) for g, x in groups.items() for i, v in enumerate(np.round(x * Q.SCALE).astype(int))]
    schema = "id int, base_failed boolean, " + ", ".join(f"_y{j} long" for j in range(P)) + ", _group string"
    return materialize(spark.createDataFrame(rows, schema).repartition(6), "rows")


def inverse(cov):
    cov = cov.copy()
    for j in range(P):
        cov[j, j] = max(cov[j, j], Q.FLOORS[j] ** 2)
    return np.linalg.inv(cov), np.linalg.slogdet(cov)[1]


def nearest(x, mean, inv, share):
    d = np.einsum("ni,ij,nj->n", x - mean, inv, x - mean)
    bins = np.floor(np.log1p(np.maximum(d, 0)) * 32)
    below = np.array([(bins < b).sum() for b in bins])
    part = x[below < len(x) * share]
    factor = share / Q._chi2_share(Q.chi2_quantile(share, P), P + 2) if share < 1 else 1.0
    return part.mean(0), *inverse(np.cov(part.T, bias=True) * factor)


def plain(x, starts=Q.STARTS):
    """Mean and inverse covariance of the smallest determinant."""
    x = np.round(x * Q.SCALE) / Q.SCALE
    step = Q.SCALE // 50
    mean, inv = np.zeros(P), np.zeros((P, P))
    for j in range(P):
        bins = np.sort(np.floor(np.round(x[:, j] * Q.SCALE) / step))
        q = [(bins[int(np.ceil(len(bins) * s)) - 1] + 0.5) * step / Q.SCALE for s in (0.25, 0.5, 0.75)]
        mean[j], inv[j, j] = q[1], 1 / max((q[2] - q[0]) / 1.349, Q.FLOORS[j]) ** 2
    best = None
    for share in starts:
        m, v, det = (mean, inv, np.inf) if share == 0 else (*nearest(x, mean, inv, share)[:2], np.inf)
        while True:
            new = nearest(x, m, v, 0.75)
            if not new[2] < det - 1e-6:
                break
            m, v, det = new
        if best is None or det < best[2]:
            best = m, v, det
    return best


def trapped(rng):
    """A dense cluster of 24% beside a wide, correlated cloud."""
    wide = rng.normal(size=(760, P)) @ (rng.normal(size=(P, P)) * 1.2)
    return np.concatenate([wide, rng.normal(size=(240, P)) * 0.05 + np.array([5, 4, -4, 5, 4])])


def test_verdicts_against_a_plain_version(spark):
    rng = np.random.default_rng(8)
    groups = {"=en\x1f=a": rng.normal(size=(300, P)), "=en\x1f=b": np.abs(rng.normal(size=(120, P))) ** 3, "=de\x1f=a": trapped(rng), "=fr\x1f=a": np.zeros((80, P))}
    groups["=en\x1f=a"][:20] += 9
    rows = table(spark, groups)
    got = Q.judge(rows, materialize(Q.fit(rows), "mcd")).withColumn("g", F.col("id")).collect()
    kept = {}
    for g, x in groups.items():
        m, v, _ = plain(x)
        y = np.round(x * Q.SCALE) / Q.SCALE - m
        d = np.einsum("ni,ij,nj->n", y, v, y)
        kept[g] = d
    limit = Q.chi2_quantile(1 - 1e-6, P)
    want = sorted((i, round(float(d), 4) if d < 1e4 else None, bool(round(d, 6) <= limit)) for x in kept.values() for i, d in enumerate(x))
    found = sorted((r.id, round(r.distance, 4) if r.distance < 1e4 else None, r.kept) for r in got)
    assert [(a, c) for a, _, c in found] == [(a, c) for a, _, c in want] or [x for x in found if x not in want] == []


def test_a_cluster_does_not_carry_the_estimate(spark):
    rng = np.random.default_rng(21)
    x = trapped(rng)
    best = plain(x)
    alone = [plain(x, (s,))[2] for s in Q.STARTS]
    assert best[2] == min(alone) < max(alone) - 0.1  # a single start can end higher
    rows = table(spark, {"=en\x1f=a": x})
    est = materialize(Q.fit(rows), "mcd").first()
    assert np.allclose([est[f"_m{j}"] for j in range(P)], best[0], atol=1e-6)
    inv = np.array([[est[f"_a{min(i, j)}{max(i, j)}"] for j in range(P)] for i in range(P)])
    assert np.allclose(inv, best[1], rtol=1e-5, atol=1e-6)


@pytest.mark.parametrize("rows", [0, 30])
def test_too_few_rows_have_no_estimate(spark, rows):
    data = table(spark, {"=en\x1f=a": np.ones((max(rows, 1), P))}).limit(rows)
    assert Q.fit(data).count() == 0
