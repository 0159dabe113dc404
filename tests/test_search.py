import os
import random

import numpy as np
from pyspark.sql import functions as F

from marlstone.operators import readout, search


def band(c):
    at = c["w"] * F.col("a")
    return F.floor(c["k"] * (at - F.floor(at)))  # band 0 is dust


def _rows(spark, n=400):
    draw = random.Random(3)
    rows = [(i, draw.random(), draw.gauss(0, 1) if i % 9 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "t long, a double, profit double")


def test_against_plain_sums(spark, tmp_path):
    rows, df = _rows(spark)
    cs = search.design(10, {"w": (0.1, 2.5)}, [2, 3, 5], 7)
    assert len({c["w"] for c in cs}) == 10 and all(0.1 <= c["w"] < 2.5 for c in cs)
    shift = spark.range(1, 7).select(readout.shift_of(7, F.col("id"), F.lit(400))).collect()
    p = np.array([x or 0.0 for _, _, x in rows])
    turned = [p] + [np.roll(p, s) for (s,) in shift]
    want = {}
    for c in cs:
        at = np.array([c["w"] * a for _, a, _ in rows])
        blob = np.floor(c["k"] * (at - np.floor(at)))
        groups = [blob == b for b in set(blob) - {0.0} if (blob == b).sum() >= 20]
        if len(groups) > 1:
            x = [sum(q[g].sum() ** 2 / g.sum() for g in groups) for q in turned]
            want[c["candidate"]] = (len(groups), x[0], (x[0] - np.mean(x[1:])) / np.std(x[1:], ddof=1))
    found = search.search(df, cs, band, ["t"], 7, 6, 20, str(tmp_path / "d"), batch=4)
    got = {r.candidate: r for r in search.scored(found).collect()}
    assert got.keys() == want.keys() and len(want) < 10
    for c, (n, x, z) in want.items():
        assert got[c].n_blobs == n and np.isclose(got[c].separation, x) and np.isclose(got[c].z, z) and len(got[c].null_z) == 6
    top = search.winners(search.scored(found), cs).collect()
    assert {r.k: r.candidate for r in top} == {k: max((c["candidate"] for c in cs if c["k"] == k and c["candidate"] in want), key=lambda i: want[i][2]) for k in {cs[i]["k"] for i in want}}
    assert sum(r.best for r in top) == 1


def test_a_later_run_goes_on(spark, tmp_path):
    """A batch without its mark is written anew, a finished one is only read; the winner is the same."""
    _, df = _rows(spark)
    cs = search.design(9, {"w": (0.1, 2.5)}, [3, 4], 7)
    run = lambda: sorted(map(tuple, search.search(df, cs, band, ["t"], 7, 5, 10, str(tmp_path / "d"), batch=3).select("candidate", "n_blobs", "x").collect()), key=repr)
    first = run()
    kept = (tmp_path / "d/batch-00000/_SUCCESS").stat().st_mtime_ns
    os.remove(tmp_path / "d/batch-00001/_SUCCESS")
    assert [(c, n, np.round(x, 9).tolist()) for c, n, x in run()] == [(c, n, np.round(x, 9).tolist()) for c, n, x in first]
    assert (tmp_path / "d/batch-00000/_SUCCESS").stat().st_mtime_ns == kept and (tmp_path / "d/batch-00001/_SUCCESS").exists()


def test_few_rows(spark, tmp_path):
    _, df = _rows(spark, 2)
    cs = search.design(2, {"w": (0.1, 2.5)}, [3], 7)
    assert search.search(df, cs, band, ["t"], 7, 5, 1, str(tmp_path / "d")).count() == 0
