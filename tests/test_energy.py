import math

import numpy as np

from marlstone.operators import cards, energy


def test_against_all_pairs(spark):
    """One population holds half of all rows; points repeat; broken rows are left out; strips are smaller than a population."""
    draw = np.random.default_rng(5)
    rows = [("big", draw.normal(size=3).tolist()) for _ in range(400)] + [("b", (draw.normal(size=3) + 1).tolist()) for _ in range(150)] + [("c", [1.0, 1.0, 1.0])] * 100 + [("d", [1.0, 1.0, 1.0])]
    bad = [(None, [1.0, 1.0, 1.0]), ("big", None), ("b", [1.0]), ("c", [1.0, float("nan"), 1.0]), ("none", [1.0, None, 1.0]), ("c", [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame(rows + bad, "population_ref string, v array<double>")
    points = {p: np.array([v for q, v in rows if q == p]) for p in ("big", "b", "c", "d")}
    mean = lambda p, q: np.linalg.norm(points[p][:, None] - points[q][None], axis=2).mean()
    for strip in (64, 10_000):
        got = {(r.a, r.b): r for r in energy.energy_distances(df, 3, strip).collect()}
        assert got.keys() == {(a, b) for a in points for b in points if a < b}
        for (a, b), r in got.items():
            assert (r.n_a, r.n_b) == (len(points[a]), len(points[b]))
            assert math.isclose(r.distance, 2 * mean(a, b) - mean(a, a) - mean(b, b), abs_tol=1e-6)
    assert energy.energy_distances(df.limit(0), 3).count() == 0


def test_one_coordinate_as_by_ranks(spark):
    df = spark.createDataFrame([(p, float(x * x % 37)) for p in "abc" for x in range(ord(p) % 7 + 20)], "population_ref string, x double")
    by_rank = {(r.a, r.b): r.distance for r in cards.energy_distances(df, "x").collect()}
    by_pair = {(r.a, r.b): r.distance for r in energy.energy_distances(df.selectExpr("population_ref", "array(x) AS v"), 1, 16).collect()}
    assert by_rank.keys() == by_pair.keys() and all(math.isclose(by_rank[k], by_pair[k], abs_tol=1e-6) for k in by_rank)
