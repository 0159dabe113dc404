"""Readout of fitted groups: which are selected, what they earn by window, how stable they are under other seeds, and how far their separation stands out of chance.

Rows: id, blob (0 is dust), profit, win_id and train. Blobs are few; what is decided about them is joined back to the rows, which aren't gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.semantics import profit_factor
from marlstone.operators.placing import placed


def factor(p: Column, none: Column | None = None) -> Column:
    """Profit factor; without losses 10 where there are gains, else ``none``."""
    return profit_factor(p, F.when(F.max(F.when(p > 0, p)).isNotNull(), F.lit(10.0)).otherwise(F.lit(None).cast("double") if none is None else none))


def selected(rows: DataFrame, by: list[str], least_pf: float, least_n: int) -> DataFrame:
    """(by, blob) of blobs, dust apart, whose training rows are enough and reach the factor."""
    b = rows.where("train AND blob > 0").groupBy(*by, "blob").agg(factor(F.col("profit"), F.lit(0.0)).alias("pf"), F.count(F.lit(1)).alias("n"))
    return b.where((F.col("pf") >= least_pf) & (F.col("n") >= least_n)).select(*by, "blob")


def traded(rows: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the chosen blobs."""
    return rows.join(chosen, [*by, "blob"], "left_semi")


def by_window(rows: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
    """(by, win_id, n, pf) of the chosen blobs' rows in each window; window 0 pools all from the second on."""
    own = traded(rows, chosen, by).where("win_id > 0").withColumn("_w", F.explode(F.when(F.col("win_id") >= 2, F.array("win_id", F.lit(0))).otherwise(F.array("win_id"))))
    return own.groupBy(*by, F.col("_w").alias("win_id")).agg(F.count(F.lit(1)).alias("n"), factor(F.col("profit")).alias("pf"))


def carrier(rows: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
    """(by, blob): the chosen blob with most rows from the second window on; the least of equal ones, and one without such rows counts as none."""
    n = chosen.join(rows.where("win_id >= 2").groupBy(*by, "blob").agg(F.count(F.lit(1)).alias("_n")), [*by, "blob"], "left")
    return n.groupBy(*by).agg(F.max_by("blob", F.struct(F.coalesce("_n", F.lit(0)), -F.col("blob"))).alias("blob"))


def reseeds(fits: DataFrame, members: DataFrame, least_pf: float, least_n: int) -> DataFrame:
    """(seed, pooled, jaccard, best, selected) of other seeds' fits (seed and rows): the factor of what each selects, from the second window on, and its training blob that is most like the carrier's training ``members`` (id).

    Of equally alike blobs the least is best; without any common row there is none.
    """
    by = ["seed"]
    chosen = selected(fits, by, least_pf, least_n)
    pooled = traded(fits, chosen, by).where("win_id >= 2").groupBy("seed").agg(factor(F.col("profit")).alias("pooled"))
    own = fits.where("train AND blob > 0")
    n = members.agg(F.count(F.lit(1)).alias("_m"))
    sizes = own.groupBy("seed", "blob").agg(F.count(F.lit(1)).alias("_n"))
    both = own.join(members.select("id").distinct(), "id", "left_semi").groupBy("seed", "blob").agg(F.count(F.lit(1)).alias("_k"))
    alike = both.join(sizes, ["seed", "blob"]).join(F.broadcast(n)).withColumn("j", F.col("_k") / (F.col("_n") + F.col("_m") - F.col("_k")))  # n: one row
    best = alike.groupBy("seed").agg(F.max("j").alias("jaccard"), F.max_by("blob", F.struct(F.col("j"), -F.col("blob"))).alias("best"))
    hit = chosen.select(F.col("seed").alias("_s"), F.col("blob").alias("_b")).withColumn("_sel", F.lit(True))
    out = fits.select("seed").distinct().join(pooled, "seed", "left").join(best, "seed", "left").join(hit, (F.col("seed") == F.col("_s")) & (F.col("best") == F.col("_b")), "left")
    return out.select("seed", "pooled", F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"), "best", F.coalesce("_sel", F.lit(False)).alias("selected"))


def shift_of(seed: int, i: Column, n: Column) -> Column:
    """The i-th shift, 1 to n - 1, of a seed."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), i.cast("string"))), 1, 8), 16, 10).cast("long")
    return h % (n - 1) + 1


def shift_nulls(rows: DataFrame, by: str, order: list[str], seed: int, shuffles: int) -> DataFrame:
    """(by, shuffle, x): the separation of blobs, as the sum of squared profits over counts, for profits shifted circularly in order; shuffle 0 is not shifted. Groups of two rows or fewer have none."""
    at = placed(rows.select(by, "blob", "profit", *[o for o in order if o not in (by, "blob", "profit")]), [by], order).where("n > 2").select(F.col(by).alias("_b"), "blob", "profit", "place", "n")
    s = F.explode(F.sequence(F.lit(0), F.lit(shuffles)))
    moved = at.select("_b", "profit", "place", "n", s.alias("shuffle")).withColumn("_k", F.pmod(F.col("place") + F.when(F.col("shuffle") == 0, 0).otherwise(shift_of(seed, F.col("shuffle"), F.col("n"))), F.col("n")))
    there = at.select(F.col("_b").alias("_c"), F.col("place").alias("_p"), "blob")
    sums = moved.join(there, (F.col("_b") == F.col("_c")) & (F.col("_k") == F.col("_p"))).where("blob > 0").groupBy("_b", "shuffle", "blob").agg(F.sum("profit").alias("s"), F.count(F.lit(1)).alias("c"))
    return sums.groupBy(F.col("_b").alias(by), "shuffle").agg(F.sum(F.col("s") * F.col("s") / F.col("c")).alias("x"))


def null_vector(nulls: DataFrame, by: str) -> DataFrame:
    """(by, x, z, null_z): the separation as it is, its distance from the shifted ones in their deviations (1e-12 at least), and the standardised null scores in order of their shuffle, an array of as many."""
    shifted = nulls.where("shuffle > 0")
    stats = shifted.groupBy(by).agg(F.avg("x").alias("_m"), F.greatest(F.coalesce(F.stddev_samp("x"), F.lit(0.0)), F.lit(1e-12)).alias("_s"), F.array_sort(F.collect_list(F.struct("shuffle", "x"))).alias("_x"))
    out = nulls.where("shuffle = 0").select(by, "x").join(stats, by)
    return out.select(by, "x", ((F.col("x") - F.col("_m")) / F.col("_s")).alias("z"), F.transform("_x", lambda v: (v["x"] - F.col("_m")) / F.col("_s")).alias("null_z"))
