"""Spectral fit of groups of rows: nearest-neighbour graph, normalised weights, leading eigenvectors, k-means, dust.

Rows, edges and eigenvectors are tables; what comes to the driver are Gram matrices of a few columns, ranks and centroids, whose size doesn't depend on the rows. Multiplying by the
matrix is a join of its edges with the vectors and a sum by row, so no dense matrix is made anywhere. One function of parameters, number of groups and seed is all there is: whoever asks again gets the same fit
(``same_estimate``).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators import neighbours
from marlstone.scratch import Scratch

KERNELS = ("rbf", "matern", "rational")
SPARE = 8  # further columns, by which the iteration converges faster
FIXED = 1 << 32  # steps of a unit in k-means, whose sums are of whole numbers


@dataclass(frozen=True)
class Params:
    """``sigma``: width of the kernel; ``k_nbrs``: neighbours of a row; ``gamma``: edges below this share of their row's strongest are dropped; ``n_diff``: power of the eigenvalues; ``weights``:
    of the components, 1 where there are none."""

    kernel: str = "rbf"
    sigma: float = 1.0
    k_nbrs: int = 10
    gamma: float = 0.0
    n_diff: int = 1
    weights: tuple[float, ...] = field(default=())

    def seed(self, k: int) -> int:
        """Of the parameters' text and the number of groups."""
        return int(hashlib.sha256(json.dumps([asdict(self), k], sort_keys=True).encode()).hexdigest()[:8], 16)


def kernel(name: str, d2: Column, sigma: float) -> Column:
    """Similarity by squared distance."""
    r = F.sqrt(d2) / sigma
    if name == "rbf":
        return F.exp(-r * r / 2)
    if name == "matern":
        return (1 + np.sqrt(3.0) * r) * F.exp(-np.sqrt(3.0) * r)
    if name == "rational":
        return 1 / (1 + r * r / 2)
    raise ValueError(f"kernel {name}, of {KERNELS}")


def graph(rows: DataFrame, p: Params, run: Scratch) -> DataFrame:
    """(i, j, s, w): the edges of the symmetric graph of rows (id, v), in both directions, with weight w and normalised weight s = w / sqrt(degree i * degree j)."""
    v = F.col("v")
    if p.weights:
        v = F.zip_with(v, F.array(*map(F.lit, p.weights)), lambda x, w: x * w)
    x = run.table("rows", rows.select("id", v.alias("v"), F.lit(0).alias("label")))
    near = neighbours.nearest(x.select("id", "v"), x, p.k_nbrs).select(F.col("id").alias("i"), F.explode("best").alias("b"))
    near = near.select("i", F.col("b.id").alias("j"), kernel(p.kernel, F.col("b.d"), p.sigma).alias("w"))
    if p.gamma:
        top = near.groupBy(F.col("i").alias("_i")).agg(F.max("w").alias("_m"))
        near = near.join(top, F.col("i") == F.col("_i")).where(F.col("w") >= p.gamma * F.col("_m")).drop("_i", "_m")
    both = near.unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg((F.sum("w") / 2).alias("w"))
    both = run.table("edges", both.where("w > 0"))
    d = both.groupBy(F.col("i").alias("n")).agg(F.sqrt(F.sum("w")).alias("d"))
    out = both.join(d.select(F.col("n").alias("_i"), F.col("d").alias("_di")), F.col("i") == F.col("_i")).join(d.select(F.col("n").alias("_j"), F.col("d").alias("_dj")), F.col("j") == F.col("_j"))
    return run.table("graph", out.select("i", "j", (F.col("w") / F.col("_di") / F.col("_dj")).alias("s"), "w"))


def _product(edges: DataFrame, x: DataFrame, m: int) -> DataFrame:
    """(id, x, y): the vectors x (id, x) and (S + I) / 2 times them, whose eigenvalues aren't negative. A row without edges has only its own half."""
    far = x.select(F.col("id").alias("j"), F.col("x").alias("_x"))
    moved = edges.join(far, "j").groupBy("i").agg(*[F.sum(F.col("s") * F.get("_x", F.lit(c))).alias(f"y{c}") for c in range(m)])
    half = lambda c: (F.coalesce(F.col(f"y{c}"), F.lit(0.0)) + F.get("x", F.lit(c))) / 2
    return x.join(moved, F.col("id") == F.col("i"), "left").select("id", "x", F.array(*[half(c) for c in range(m)]).alias("y"))


def _gram(rows: DataFrame, a: str, b: str, m: int) -> np.ndarray:
    """a' b of two columns of vectors, as a small matrix; a task gives one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((m, m))
        for t in batches:
            if len(t):
                g += np.stack(t[a].to_numpy()).T @ np.stack(t[b].to_numpy())
        yield pd.DataFrame({"g": [g.ravel()]})

    parts = rows.select(a, b) if a != b else rows.select(a)
    sums = parts.mapInPandas(run, "g array<double>").agg(*[F.sum(F.get("g", F.lit(i))).alias(f"g{i}") for i in range(m * m)])
    return np.array([x or 0.0 for x in sums.first()]).reshape(m, m)


def _turned(rows: DataFrame, col: str, r: np.ndarray, name: str = "x") -> DataFrame:
    """The vectors times a small matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            if len(t):
                yield pd.DataFrame({"id": t["id"], name: list(np.stack(t[col].to_numpy()) @ r)})

    return rows.select("id", col).mapInPandas(run, f"id long, {name} array<double>")


def eigenvectors(edges: DataFrame, ids: DataFrame, k: int, seed: int, run: Scratch, rounds: int = 60, tolerance: float = 1e-9) -> tuple[np.ndarray, DataFrame]:
    """The ``k`` greatest eigenvalues of the graph's normalised matrix, falling, and (id, x) with their vectors as components.

    Block power iteration: multiply, then make the columns orthogonal by the inverse root of their Gram matrix; it ends when the values stand still.
    """
    m = k + SPARE
    start = F.array(*[F.xxhash64(F.col("id"), F.lit(seed), F.lit(c)) / 2.0**63 for c in range(m)])
    x, last = ids.select("id", start.alias("x")), None
    for n in range(rounds):
        y = run.table("power", _product(edges, x, m))
        values, u = np.linalg.eigh(_gram(y, "y", "y", m))
        keep = np.maximum(values, values.max() * 1e-14)
        now = np.sqrt(keep[::-1][:k])
        x = _turned(y, "y", u / np.sqrt(keep))
        if last is not None and n > 2 and np.abs(now - last).max() <= tolerance:
            break
        last = now
    y = run.table("power", _product(edges, run.table("basis", x), m))
    h = _gram(y, "x", "y", m)
    values, u = np.linalg.eigh((h + h.T) / 2)
    order = np.argsort(values)[::-1][:k]
    return 2 * values[order] - 1, _turned(y, "x", u[:, order])


def kmeans(rows: DataFrame, k: int, seed: int, reps: int = 5, rounds: int = 100) -> DataFrame:
    """(id, label) from 0 of rows (id, x) of about unit length, by the best of ``reps`` seeded starts, which run side by side.

    A start's centroids are the rows of the least hash. Components are steps of 1 / ``FIXED``, so that sums don't depend on how rows are dealt. A group that has lost all its rows takes the row that is farthest from its own
    centroid. What comes to the driver is a row for each start and group.
    """
    picks = [rows.orderBy(F.xxhash64("id", F.lit(seed), F.lit(r)), "id").select("x").limit(k).collect() for r in range(reps)]
    if not picks[0]:
        return rows.select("id", F.lit(0).alias("label"))
    c = np.array([[p.x for p in pick] for pick in picks], float)
    k, dim = c.shape[1], c.shape[2]
    for _ in range(rounds):
        known = rows.sparkSession.sparkContext.broadcast(c)

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = known.value
            n, s, cost = np.zeros((reps, k), np.int64), np.zeros((reps, k, dim), np.int64), np.zeros(reps, np.int64)
            far = [(-1.0, None)] * reps
            for t in batches:
                if not len(t):
                    continue
                x = np.stack(t["x"].to_numpy())
                fixed = np.round(x * FIXED).astype(np.int64)
                for r in range(reps):
                    d = ((x[:, None, :] - c[r][None]) ** 2).sum(axis=2)
                    at = d.argmin(axis=1)
                    least = d[np.arange(len(x)), at]
                    np.add.at(s[r], at, fixed)
                    n[r] += np.bincount(at, minlength=k)
                    cost[r] += int(np.round(least * (1 << 20)).sum())
                    if least.max() > far[r][0]:
                        far[r] = (float(least.max()), x[least.argmax()].tolist())
            yield pd.DataFrame([(r, g, n[r, g], s[r, g].tolist(), cost[r] if g == 0 else 0, {"d": far[r][0], "x": far[r][1]}) for r in range(reps) for g in range(k)], columns=["r", "g", "n", "s", "cost", "far"])

        parts = rows.select("x").mapInPandas(step, "r int, g int, n long, s array<long>, cost long, far struct<d:double,x:array<double>>")
        told = parts.groupBy("r", "g").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(dim)]).alias("s"), F.sum("cost").alias("cost"), F.max("far").alias("far")).collect()
        new, costs = c.copy(), np.zeros(reps)
        for t in told:
            costs[t.r] += t.cost
            new[t.r, t.g] = np.array(t.s, float) / FIXED / t.n if t.n else t.far.x
        if np.array_equal(new, c):
            break
        c = new
    best = rows.sparkSession.sparkContext.broadcast(c[int(costs.argmin())])

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            if len(t):
                yield pd.DataFrame({"id": t["id"], "label": ((np.stack(t["x"].to_numpy())[:, None, :] - best.value[None]) ** 2).sum(axis=2).argmin(axis=1).astype(np.int32)})

    return rows.select("id", "x").mapInPandas(label, "id long, label int")


def fit(rows: DataFrame, p: Params, k: int, reps: int = 5, n_floor: int = 1, indeg_q: float = 0.0, rounds: int = 60) -> DataFrame:
    """(id, group, degree) of rows (id, v): groups 1 .. ``k``, and 0 for dust.

    The second to the (k+1)-th eigenvector, times their eigenvalues (0 where negative) to the power ``n_diff``, give a row its place, at unit length; places are grouped by k-means. Dust are rows whose degree is below
    the ``indeg_q`` point of all degrees, and groups of fewer than ``n_floor`` rows.
    """
    seed = p.seed(k)
    run = Scratch(rows.sparkSession, "spectral")
    edges = graph(rows, p, run)
    values, vectors = eigenvectors(edges, rows.select("id"), k + 1, seed, run, rounds)
    scale = np.maximum(values[1:], 0.0) ** p.n_diff
    at = _turned(vectors, "x", np.vstack([np.zeros((1, k)), np.diag(scale)]))
    norm = F.greatest(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    at = run.table("places", at.select("id", norm.alias("n"), "x").select("id", F.transform("x", lambda x: x / F.col("n")).alias("x")))
    found = run.table("labels", kmeans(at, k, seed, reps))
    degree = edges.groupBy(F.col("i").alias("_i")).agg(F.sum("w").alias("degree"))
    found = run.table("degrees", found.join(degree, F.col("id") == F.col("_i"), "left").select("id", "label", F.coalesce("degree", F.lit(0.0)).alias("degree")))
    from marlstone.operators.scoring import quantiles

    low = quantiles(found.withColumn("one", F.lit(1)), ["one"], "degree", [indeg_q]).select(F.col("q0").alias("low")) if indeg_q else found.sparkSession.createDataFrame([(0.0,)], "low double")
    sizes = found.groupBy(F.col("label").alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    out = found.join(F.broadcast(sizes), F.col("label") == F.col("_l")).join(F.broadcast(low))  # k rows, and one
    dust = (F.col("degree") < F.col("low")) | (F.col("_n") < n_floor)
    return out.select("id", F.when(dust, 0).otherwise(F.col("label") + 1).alias("group"), "degree")


def same_estimate(a: DataFrame, b: DataFrame, share: float = 0.0) -> tuple[int, int]:
    """(rows, rows that differ) of two fits of one estimator; an error where more than ``share`` of them differ."""
    both = a.select("id", F.col("group").alias("_a")).join(b.select("id", F.col("group").alias("_b")), "id", "full")
    n, other = both.agg(F.count(F.lit(1)), F.count_if(~F.col("_a").eqNullSafe(F.col("_b")))).first()
    if other > share * n:
        raise ValueError(f"not one estimator: {other} of {n} rows differ")
    return n, other
