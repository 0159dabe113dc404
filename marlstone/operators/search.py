"""Search over groupings: a seeded low-discrepancy design, scored against one set of circular shifts, in batches that a later run goes on from.

All candidates see the same shifts. So each row gets the profits that it has under every shift once, and a candidate's separations under all of them are one aggregation by group that Spark combines before
the shuffle; no candidate moves rows again. As shifts are that cheap, every candidate meets all of them (no halving of the field), and the gate prices the whole width of the search.
Finished batches are tables of their own: one that an interrupted run left without its ``_SUCCESS`` file is written anew, the others are read. A candidate depends on its number and the seed only, so
runs agree whatever was done before.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.gates import gate
from marlstone.operators.placing import placed
from marlstone.operators.readout import shift_of
from marlstone.scratch import Scratch

PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
BATCH = 32  # candidates


def design(count: int, ranges: dict[str, tuple[float, float]], ks: list[int], seed: int) -> list[dict]:
    """Candidates 0, 1, ..: ``k`` in turn and, for each of at most twelve ranges, an additive recurrence by the root of a prime from a start of the seed."""
    out = []
    for i in range(count):
        c = {"candidate": i, "k": ks[i % len(ks)]}
        for j, (name, (low, high)) in enumerate(ranges.items()):
            u = int(hashlib.md5(f"{seed}:{j}".encode()).hexdigest()[:8], 16) / 4294967296.0 + i * math.sqrt(PRIMES[j])
            c[name] = low + (high - low) * (u - math.floor(u))
        out.append(c)
    return out


def shifted(rows: DataFrame, order: list[str], seed: int, shifts: int) -> DataFrame:
    """``rows`` with ``_p``: the profit as it is and under each circular shift in ``order``. Fewer than three rows have no shifts: none is left."""
    at = placed(rows, [], order).where("n > 2")
    moved = at.select("profit", "place", "n", F.explode(F.sequence(F.lit(0), F.lit(shifts))).alias("_s"))
    moved = moved.select(F.pmod(F.col("place") + F.when(F.col("_s") == 0, 0).otherwise(shift_of(seed, F.col("_s"), F.col("n"))), F.col("n")).alias("place"), "_s", "profit")
    there = moved.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", F.coalesce("profit", F.lit(0.0)).alias("profit")))), lambda v: v["profit"]).alias("_p"))  # one for each shift
    return at.drop("n").join(there, "place")


def separations(rows: DataFrame, candidates: list[dict], blob: Callable[[Column], Column], shifts: int, least: int) -> DataFrame:
    """(candidate, n_blobs, x): for each candidate its groups of ``least`` rows or more and, as it is and under each shift, their squared sums of profits over counts. Group 0 and null are dust.

    Candidates with fewer than two such groups separate nothing and have no row.
    """
    table = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in one.items()]) for one in candidates])
    dealt = rows.select("*", F.explode(table).alias("_c")).select(F.col("_c.candidate").alias("candidate"), blob(F.col("_c")).alias("blob"), "_p").where("blob > 0")
    sums = dealt.groupBy("candidate", "blob").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("_p", F.lit(i))).alias(f"s{i}") for i in range(shifts + 1)]).where(F.col("n") >= least)
    x = F.array(*[F.sum(F.col(f"s{i}") * F.col(f"s{i}") / F.col("n")) for i in range(shifts + 1)])
    return sums.groupBy("candidate").agg(F.count(F.lit(1)).alias("n_blobs"), x.alias("x")).where("n_blobs > 1")


def _finished(rows: DataFrame, path: str) -> bool:
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def search(rows: DataFrame, candidates: list[dict], blob: Callable[[Column], Column], order: list[str], seed: int, shifts: int, least: int, done: str, batch: int = BATCH) -> DataFrame:
    """``separations`` of all candidates over ``rows`` (profit, the ``order`` columns and what ``blob`` reads). ``done`` is the folder of finished batches: of the same rows and parameters, which the caller names it by."""
    spark, parts = rows.sparkSession, [f"{done}/batch-{i:05d}" for i in range(-(-len(candidates) // batch))]
    todo = [i for i, path in enumerate(parts) if not _finished(rows, path)]
    if todo:
        given = Scratch(spark, "search").table("rows", shifted(rows, order, seed, shifts))
        for i in todo:
            separations(given, candidates[i * batch : (i + 1) * batch], blob, shifts, least).write.mode("overwrite").parquet(parts[i])
    return spark.read.schema("candidate int, n_blobs bigint, x array<double>").parquet(*parts)


def scored(found: DataFrame) -> DataFrame:
    """(candidate, n_blobs, separation, z, null_z): how far a candidate's separation is from its shifted ones in their sample deviations, 1e-12 at least, and the shifted ones likewise."""
    null = F.slice("x", 2, F.size("x") - 1)
    mean = F.aggregate("_n", F.lit(0.0), lambda a, v: a + v) / F.size("_n")
    out = found.withColumn("_n", null).withColumn("_m", mean)
    spread = F.sqrt(F.aggregate("_n", F.lit(0.0), lambda a, v: a + (v - F.col("_m")) * (v - F.col("_m"))) / (F.size("_n") - 1))
    out = out.withColumn("_s", F.greatest(F.coalesce(spread, F.lit(0.0)), F.lit(1e-12)))
    return out.select("candidate", "n_blobs", F.get("x", F.lit(0)).alias("separation"), ((F.get("x", F.lit(0)) - F.col("_m")) / F.col("_s")).alias("z"), F.transform("_n", lambda v: (v - F.col("_m")) / F.col("_s")).alias("null_z"))


def winners(scores: DataFrame, candidates: list[dict], q: float = 0.95) -> DataFrame:
    """(k, candidate, n_blobs, separation, z, gate, passes, best): of each k the candidate of the greatest z, the least of equal ones; whether it is above the q point of the greatest null score of all candidates, shift by shift; and whether it is the best of all."""
    ks = F.create_map(*[F.lit(v) for c in candidates for v in (c["candidate"], c["k"])])
    maxima = scores.select(F.posexplode("null_z").alias("shuffle", "z")).groupBy("shuffle").agg(F.max("z").alias("z"))
    rank = F.struct(F.col("z"), -F.col("candidate"))
    top = scores.groupBy(ks[F.col("candidate")].alias("k")).agg(*[F.max_by(c, rank).alias(c) for c in ("candidate", "n_blobs", "separation", "z")])
    best = top.agg(F.max_by("candidate", rank).alias("_best"))
    out = top.join(F.broadcast(gate(maxima, q).select(F.col("gate_hazen").alias("gate"))), how="left").join(F.broadcast(best), how="left")  # one row each
    return out.select("k", "candidate", "n_blobs", "separation", "z", "gate", (F.col("z") > F.col("gate")).alias("passes"), (F.col("candidate") == F.col("_best")).alias("best"))
