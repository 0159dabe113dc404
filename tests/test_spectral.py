"""The spectral fit against a dense solution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import spectral
from marlstone.scratch import Scratch

WEIGHT = {"rbf": lambda r: np.exp(-r * r / 2), "matern": lambda r: (1 + np.sqrt(3) * r) * np.exp(-np.sqrt(3) * r), "rational": lambda r: 1 / (1 + r * r / 2)}


def dense(x, p):
    """Weights and normalised weights as matrices."""
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    w = np.zeros_like(d2)
    for i in range(len(x)):
        near = [j for j in np.lexsort((np.arange(len(x)), np.round(d2[i], 9))) if j != i][: p.k_nbrs]
        v = WEIGHT[p.kernel](np.sqrt(d2[i, near]) / p.sigma)
        for j, s in zip(near, v):
            if s >= p.gamma * v.max():
                w[i, j] = s
    w = (w + w.T) / 2
    d = np.sqrt(w.sum(axis=1))
    return w, w / d[:, None] / d[None]


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0, 0], [6, 0, 0], [0, 6, 1]])
    return np.concatenate([rng.normal(size=(n, 3)) * 0.9 + c for n, c in zip((60, 50, 40), centres)])


def rows_of(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("kernel", spectral.KERNELS)
def test_graph(spark, blobs, kernel):
    p = spectral.Params(kernel, 1.5, 7, 0.2, weights=(1.0, 0.5, 2.0))
    w, s = dense(blobs * np.array(p.weights), p)
    got = spectral.graph(rows_of(spark, blobs), p, Scratch(spark, "test")).collect()
    assert len(got) == (w > 0).sum()
    assert all(abs(r.w - w[r.i, r.j]) < 1e-8 and abs(r.s - s[r.i, r.j]) < 1e-8 for r in got)


def test_eigenvectors_and_groups(spark, blobs):
    p = spectral.Params("rbf", 2.0, 12)
    _, s = dense(blobs, p)
    values, vectors = np.linalg.eigh(s)
    rows, run = rows_of(spark, blobs), Scratch(spark, "test")
    got, x = spectral.eigenvectors(spectral.graph(rows, p, run), rows.select("id"), 4, 1, run)
    assert np.allclose(got, values[::-1][:4], atol=1e-6)
    v = np.zeros((len(blobs), 4))
    for r in x.collect():
        v[r.id] = r.x
    assert np.allclose(np.linalg.svd(v.T @ vectors[:, ::-1][:, :3], compute_uv=False), 1, atol=1e-4)  # one subspace
    a = spectral.fit(rows, p, 3, n_floor=5)
    b = spectral.fit(rows.repartition(3), p, 3, n_floor=5)
    assert spectral.same_estimate(a, b) == (len(blobs), 0)
    group = {r.id: r.group for r in a.collect()}
    truth = [0] * 60 + [1] * 50 + [2] * 40
    agree = sum(max(sum(group[i] == g for i in range(len(truth)) if truth[i] == t) for g in (1, 2, 3)) for t in range(3))
    assert agree >= 0.95 * len(truth) and {group[0], group[70], group[140]} == {1, 2, 3}
    with pytest.raises(ValueError, match="one estimator"):
        spectral.same_estimate(a, a.withColumn("group", F.lit(9)))


def test_kmeans_fills_empty_groups(spark):
    x = [(i, [1.0, 0.0]) for i in range(20)] + [(20 + i, [0.0, 1.0]) for i in range(3)]
    got = {r.id: r.label for r in spectral.kmeans(spark.createDataFrame(x, "id long, x array<double>"), 2, 3, reps=2).collect()}
    assert len(set(got.values())) == 2 and len({got[i] for i in range(20)}) == 1
