"""Plain Lloyd clustering in exact integer arithmetic.

Centroids, a few rows whatever the input, go to all tasks. Each task reads its vectors in batches, squares integer differences to one
centroid after the other in NumPy and keeps the least; argmin takes the lowest number among equals. A task adds up its vectors by cluster
and gives one row for each cluster at most; these rows merge through a groupBy. Integer sums don't depend on order, so that results are the
same however the vectors are dealt and whichever executors are lost. No vector is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.scratch import Scratch

CENTROIDS = 40
ROUNDS = 5
DIM = 64
SCALE = 256
SEED = 2
#: Components of greater size don't fit: 64 squared differences of twice this size are just below 2 ** 63.
MOST = 1 << 27


def quantized(v: Column, dim: int = DIM, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as longs, or null unless there are ``dim`` components, none null, NaN or infinite. A component beyond ``MOST`` is an error."""
    ok = (F.size(v) == dim) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    part = lambda x: F.floor(x.cast("double") * scale)
    fits = F.forall(v, lambda x: F.abs(x.cast("double") * scale) <= MOST)
    return F.when(ok, F.when(fits, F.transform(v, part)).otherwise(F.raise_error(F.lit(f"a component beyond {MOST} / {scale}"))))


def vectors(rows: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v of the rows (vec_id, embedding) that are kept."""
    return rows.select("vec_id", quantized(F.col("embedding"), dim, scale).alias("v")).where("v IS NOT NULL")


def _order(seed: int) -> list[Column]:
    """By hash of the id; a null id hashes as an empty one. Repeated ids go by their components."""
    return [F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), F.col("v")]


def first_centroids(kept: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose ids have the least hash, as rows; fewer if there are fewer vectors."""
    return np.array([r.v for r in kept.orderBy(*_order(seed)).limit(k).collect()], np.int64)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and squared distance of each row of ``v``."""
    all_d = np.empty((len(centroids), len(v)), np.int64)
    for i, c in enumerate(centroids):
        d = v - c
        np.einsum("ij,ij->i", d, d, out=all_d[i])
    at = all_d.argmin(axis=0)
    return at, all_d[at, np.arange(len(v))]


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64, copy=False)


def sums(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n and s (sums by component) of the vectors nearest to each centroid; empty clusters have no row."""
    known = kept.sparkSession.sparkContext.broadcast(centroids)
    dim = centroids.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = known.value
        n, s = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for b in batches:
            if len(b):
                v = _stacked(b["v"])
                at, _ = nearest(v, c)
                by = np.argsort(at, kind="stable")
                found, begin = np.unique(at[by], return_index=True)
                s[found] += np.add.reduceat(v[by], begin, axis=0)
                n += np.bincount(at, minlength=len(c))
        there = np.flatnonzero(n)
        if len(there):
            yield pd.DataFrame({"cluster": there.astype(np.int32), "n": n[there], "s": list(s[there])})

    parts = kept.select("v").mapInPandas(run, "cluster int, n long, s array<long>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(dim)]).alias("s"))


def lloyd(kept: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """The centroids after ``rounds`` rounds: floor of the mean by component; a centroid without vectors stays."""
    c = first_centroids(kept, k, seed)
    for _ in range(rounds if len(c) else 0):
        for r in sums(kept, c).collect():  # a row for each centroid at most
            c[r.cluster] = [x // r.n for x in r.s]
    return c


def assign(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance (squared) of every vector."""
    known = kept.sparkSession.sparkContext.broadcast(centroids)
    kind = kept.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                at, d = nearest(_stacked(b["v"]), known.value)
                yield pd.DataFrame({"vec_id": b["vec_id"], "cluster": at.astype(np.int32), "distance": d})

    return kept.select("vec_id", "v").mapInPandas(run, f"vec_id {kind}, cluster int, distance long")


def cluster(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """A row for each kept row of ``rows`` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Rows whose vector is null, has another number of components or one that is null, NaN or infinite are left out. Repeated rows count each; a null id
    is an id as others. Fewer vectors than ``k`` give fewer centroids, none an empty table. Other columns are ignored.
    """
    spark = rows.sparkSession
    run = Scratch(spark, "clusters")
    kept = vectors(rows, dim, scale)
    c = lloyd(kept, k, rounds, seed)
    if not len(c):
        return spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    done = run.table("assigned", assign(kept, c))
    by = {r.cluster: r.d for r in done.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row for each centroid at most
    facts = [(i, by[i], sum(by.values()), hashlib.sha256(",".join(map(str, c[i].tolist())).encode()).hexdigest()) for i in by]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The rounds written out, one after the other, over (row, component) pairs."""
    near = """a{i} AS (SELECT id, min_by(c, (d, c)) AS c, min(d) AS d FROM
 (SELECT x.id, m.c, list_sum([(x.v[j] - m.v[j]) * (x.v[j] - m.v[j]) FOR j IN range(1, 65)])::BIGINT AS d FROM x, m{i} m) GROUP BY id)"""
    step = """m{n} AS (SELECT m.c, coalesce(s.v, m.v) AS v FROM m{i} m LEFT JOIN (SELECT c, list(q ORDER BY j) AS v FROM
 (SELECT a.c, j, ((sum(x.v[j]) - ((sum(x.v[j]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS q FROM a{i} a JOIN x USING (id), range(1, 65) r(j) GROUP BY a.c, j) GROUP BY c) s USING (c))"""
    parts = [p for i in range(rounds) for p in (near.format(i=i), step.format(i=i, n=i + 1))]
    return f"""WITH k AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND list_bool_and([coalesce(isfinite(e), false) FOR e IN embedding])),
x AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('{SEED}:', vec_id)), v) - 1 AS id, vec_id, v FROM (SELECT vec_id, [floor({SCALE} * e::DOUBLE)::BIGINT FOR e IN embedding] AS v FROM k)),
m0 AS (SELECT id AS c, v FROM x WHERE id < {k}), {", ".join(parts)}, {near.format(i=rounds)}
SELECT x.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
 sha256(list_aggregate(m.v, 'string_agg', ',')) AS centroid_sha256 FROM a{rounds} a JOIN x USING (id) JOIN m{rounds} m USING (c)"""


ORACLE = _oracle()
