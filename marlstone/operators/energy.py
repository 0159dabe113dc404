"""Energy distances between populations of points in several coordinates.

The distance of two populations is twice the mean Euclidean distance between their points less the mean distances within each, copies of a point counted as often as they stand. It is made of the
distances of all pairs of points, so its work is quadratic by definition; what can be kept small is what leaves a task. Rows are dealt at random into strips of about ``STRIP``, a task meets two strips,
chunk by chunk, and gives one sum for each pair of populations in them. Strips don't depend on populations, so one that holds a third of all rows is dealt like the others, and all pairs of populations
come of one pass. Each row is sent to as many tasks as there are strips. Populations are some hundreds, as a task holds a sum for each pair of those it meets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.scratch import Scratch

STRIP = 8192  # rows, on average
CHUNK = 512


def pair_sums(xs: np.ndarray, x_of: np.ndarray, ys: np.ndarray, y_of: np.ndarray, count: int) -> np.ndarray:
    """Sums of the distances of the rows of two matrices by the populations (0 to ``count`` - 1, both in ascending order) of the two rows."""
    out = np.zeros((count, count))
    if not len(xs) or not len(ys):
        return out
    cuts = np.flatnonzero(np.r_[True, y_of[1:] != y_of[:-1]])
    squares = np.einsum("ij,ij->i", ys, ys)
    for at in range(0, len(xs), CHUNK):
        part = xs[at : at + CHUNK]
        d = squares - 2.0 * (part @ ys.T)
        d += np.einsum("ij,ij->i", part, part)[:, None]
        np.sqrt(np.maximum(d, 0.0, out=d), out=d)
        np.add.at(out, (x_of[at : at + CHUNK, None], y_of[cuts][None, :]), np.add.reduceat(d, cuts, axis=1))
    return out


def _meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over the unordered pairs of rows of two strips, or of one."""
    low, high = key
    names, codes = np.unique(rows["population_ref"].to_numpy(str), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    of, strip = codes[order], rows["strip"].to_numpy()[order]
    v = np.stack(rows["v"].to_numpy())[order].astype(float)
    a, b = strip == low, strip == high
    sums = pair_sums(v[a], of[a], v[b], of[b], len(names))
    if low == high:
        sums /= 2  # both orders of each pair
    sums = np.triu(sums) + np.tril(sums, -1).T
    i, j = np.nonzero(sums)
    return pd.DataFrame({"a": names[i], "b": names[j], "s": sums[i, j]})


def energy_distances(points: DataFrame, size: int, strip: int = STRIP) -> DataFrame:
    """(a, b, n_a, n_b, distance) for each pair of populations, a before b, of rows (population_ref string, v: array of double).

    Rows without a population, or whose vector hasn't exactly ``size`` finite components, are left out; so is a population that keeps none. Repeated rows count each time. No rows give no pairs.
    """
    run = Scratch(points.sparkSession, "energy")
    fine = F.col("population_ref").isNotNull() & (F.size("v") == size) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # Written, so that a repeated task deals the same numbers.
    rows = run.table("rows", points.where(fine).select("population_ref", "v").withColumn("_row", F.monotonically_increasing_id()))
    sizes = run.table("sizes", rows.groupBy("population_ref").agg(F.count(F.lit(1)).alias("n")))
    strips = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // strip))
    dealt = rows.withColumn("strip", F.pmod(F.xxhash64("_row"), F.lit(strips)))
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(strips - 1).cast("long"))))
    sent = sent.select(F.least("strip", "other").alias("low"), F.greatest("strip", "other").alias("high"), "strip", "population_ref", "v")
    sums = run.table("sums", sent.groupBy("low", "high").applyInPandas(_meet, "a string, b string, s double").groupBy("a", "b").agg(F.sum("s").alias("s")))
    one = sizes.join(sums.where("a = b").select(F.col("a").alias("population_ref"), "s"), "population_ref", "left").select("population_ref", "n", (2 * F.coalesce("s", F.lit(0.0)) / (F.col("n") * F.col("n"))).alias("within"))
    left, right = (one.select(F.col("population_ref").alias(c), F.col("n").alias(f"n_{c}"), F.col("within").alias(f"_{c}")) for c in "ab")
    # Populations, not their rows: one line a pair is the result itself. Pairs at distance 0 throughout have no sum.
    pairs = left.join(right, F.col("a") < F.col("b")).join(sums, ["a", "b"], "left")
    between = F.coalesce("s", F.lit(0.0)) / (F.col("n_a") * F.col("n_b"))
    return pairs.select("a", "b", "n_a", "n_b", (2 * between - F.col("_a") - F.col("_b")).alias("distance"))
