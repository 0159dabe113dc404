"""Nearest neighbours against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from marlstone.operators import neighbours


def brute(q, x, k):
    out = {}
    for i, v in q:
        d = sorted((round(float(((np.array(v) - np.array(w)) ** 2).sum()), 9), j) for j, w in x if j != i)
        out[i] = d[:k]
    return out


def test_same_as_all_pairs(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 5)) * 8
    x = [(i, (centres[i % 6] + rng.normal(size=5)).tolist()) for i in range(900)]
    x += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(400)]  # a hot vector
    q = [r for r in x if r[0] % 20 == 0] + [(5000, [50.0] * 5)]
    rows = spark.createDataFrame([(i, i % 7, v) for i, v in x], "id long, label int, v array<double>").repartition(5)
    ask = spark.createDataFrame(q, "id long, v array<double>")
    got = neighbours.nearest(ask, rows, 6, count=8, least=50).collect()
    want = brute(q, x, 6)
    assert len(got) == len(q)
    for r in got:
        assert [(b.d, b.id) for b in r.best] == want[r.id] and all(b.label == b.id % 7 for b in r.best)
    assert sum(r.compared for r in got) < 0.6 * len(q) * len(x)  # most blocks are never looked at


def test_few_rows_and_votes(spark):
    rows = spark.createDataFrame([(1, 4, [0.0]), (2, 3, [1.0])], "id long, label int, v array<double>")
    got = {r.id: [b.id for b in r.best] for r in neighbours.nearest(rows.select("id", "v"), rows, 5).collect()}
    assert got == {1: [2], 2: [1]}
    assert [r.best for r in neighbours.nearest(rows.select("id", "v"), rows.where("id > 9"), 5).collect()] == [[], []]
    b = spark.createDataFrame([([(0.0, 1, 5), (0.1, 2, 3), (0.2, 3, 5), (0.3, 4, 3), (0.4, 5, 9)],)], "b array<struct<d:double,id:long,label:int>>")
    assert b.select(neighbours.vote(F.col("b")).alias("v")).first().v == 3
