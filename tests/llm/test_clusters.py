import hashlib

import numpy as np
import pytest

from marlstone.llm import clusters
from marlstone.llm.queries import op11_clusters
from tests.llm import oracle

SCHEMA = "vec_id long, embedding array<float>, cluster string, label int"


def plain(rows, k, rounds):
    """Lloyd with Python integers."""
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in kept[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v: min((gap(v, m), i) for i, m in enumerate(c))
    for _ in range(rounds):
        by = {}
        for _, v in kept:
            by.setdefault(best(v)[1], []).append(v)
        c = [[sum(x) // len(x) for x in zip(*by[i])] if i in by else m for i, m in enumerate(c)]
    out = [(i, best(v)) for i, v in kept]
    part = {}
    for _, (d, m) in out:
        part[m] = part.get(m, 0) + d
    sha = lambda m: hashlib.sha256(",".join(map(str, c[m])).encode()).hexdigest()
    return sorted(((i, m, d, part[m], sum(part.values()), sha(m)) for i, (d, m) in out), key=repr)


def test_same_as_sql(spark, sf):
    assert len(oracle.same(op11_clusters(spark, sf), sf, clusters.ORACLE)) == 500


def test_same_as_plain_lloyd_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(60)]
    same = [0.25] * 64
    rows += [(100 + i, same) for i in range(50)] + [(7, same), (7, same), (None, same), (None, [-0.001] * 64)]  # copies, repeated and null ids
    rows += [(900, None), (901, []), (902, [0.1] * 63), (903, [0.1] * 65), (904, [float("nan")] + [0.0] * 63), (905, [float("inf")] + [0.0] * 63), (906, [None] + [0.0] * 63)]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA)
    for k, rounds in ((8, 3), (40, 5)):
        for n in (1, 5):
            got = clusters.cluster(df.repartition(n), k, rounds)
            assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, k, rounds)


def test_few_and_no_vectors(spark):
    one = clusters.cluster(spark.createDataFrame([(5, [-1.0] * 64, None, None)], SCHEMA)).collect()
    assert [tuple(r)[:5] for r in one] == [(5, 0, 0, 0, 0)]
    assert clusters.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert clusters.cluster(spark.createDataFrame([(1, None, None, None)], SCHEMA)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        clusters.cluster(spark.createDataFrame([(1, [1e30] * 64, None, None)], SCHEMA)).collect()
