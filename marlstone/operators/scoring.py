"""Scorecards, health gates, descriptor statistics and rank transfer over masked populations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.semantics import profit_factor
from marlstone.operators.placing import placed
from marlstone.scratch import Scratch

P = F.col


def scorecard(pop: DataFrame, by: list[str]) -> DataFrame:
    """n, win rate, expectancy, profit factor, Sharpe ratio by population deviation, totals and mean win and loss of each group."""
    p = F.col("profit")
    capped = F.when(F.max(F.when(p > 0, p)).isNotNull(), F.lit(10.0))
    sd = F.stddev_pop(p)
    return pop.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(p > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg(p).alias("expectancy"), profit_factor(p, capped).alias("pf"), F.when(sd > 0, F.avg(p) / sd).alias("sharpe"), F.sum(p).alias("total"), F.avg(F.when(p > 0, p)).alias("avg_win"), F.avg(F.when(p <= 0, p)).alias("avg_loss"))


def baseline_health(masked: DataFrame, by: list[str], last: int, least_last: int = 30, least_rows: int = 0) -> DataFrame:
    """Training statistics, counts by window and whether a group is healthy: profit factor of 1.05, a positive mean and enough rows of the last window."""
    train = F.when(F.col("train"), F.col("profit"))
    counts = [F.count_if(F.col("win_id") == i).alias(f"n_w{i}") for i in range(1, last + 1)]
    out = masked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(train).alias("train_n"), profit_factor(train, F.lit(None).cast("double")).alias("train_pf"), F.avg(train).alias("train_exp"), *counts)
    lossless = F.col("train_pf").isNull() & (F.col("train_n") > 0)  # an infinite factor
    healthy = (lossless | (F.col("train_pf") >= 1.05)) & (F.col("train_exp") > 0) & (F.col(f"n_w{last}") >= least_last) & (F.col("n") >= least_rows)
    return out.withColumn("healthy", F.coalesce(healthy, F.lit(False)))


def rank_transfer_rows(masked: DataFrame, by: list[str], last: int, floor: int = 30) -> DataFrame:
    """Profit factors in training, out of sample (window 2 on) and in the last window, each null unless it has more than ``floor`` rows."""

    def pf(where: Column) -> Column:
        p = F.when(where, F.col("profit"))
        return F.when(F.count(p) > floor, profit_factor(p, least=1e-9))

    return masked.groupBy(*by).agg(pf(F.col("train")).alias("train_pf"), pf(F.col("win_id") >= 2).alias("oos_pf"), pf(F.col("win_id") == last).alias("last_pf"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation, ties by average rank, over rows that have both.

    They are written first, as ranks are joined by value: sums that are computed again may differ in their last digits.
    """
    both = Scratch(rows.sparkSession, "spearman").table("both", rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y))
    for c in (x, y):
        ranks = placed(both.select(F.col(c).alias("_v")), [], ["_v"]).groupBy("_v").agg((F.avg("place") + 1).alias(f"_r_{c}"))
        both = both.join(ranks, F.col(c) == F.col("_v")).drop("_v")
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr(f"_r_{x}", f"_r_{y}").alias("spearman"))


def pf_variants(pop: DataFrame, by: list[str]) -> DataFrame:
    """The profit factor under each rule for groups without a loss."""
    p = F.col("profit")
    wins = F.max(F.when(p > 0, p)).isNotNull()
    return pop.groupBy(*by).agg(profit_factor(p, F.when(wins, F.lit(10.0))).alias("pf_capped"), profit_factor(p, F.lit(None).cast("double")).alias("pf_open"), profit_factor(p, least=1e-9).alias("pf_floored"), profit_factor(p, F.when(wins, F.lit(10.0)).otherwise(0.0)).alias("pf_zero"))


def _bits(x: pd.Series) -> pd.Series:
    """The bits of doubles as longs of the same order."""
    b = np.ascontiguousarray(x.to_numpy(np.float64)).view(np.int64)
    return pd.Series(b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


def quantiles(rows: DataFrame, by: list[str], x: str, qs: list[float], bits: int = 16) -> DataFrame:
    """(by, n, q0, q1, ..): exact quantiles of each group by linear interpolation between neighbours. Nulls don't count.

    The wanted ranks are sought in histograms of the values' bits: counts by the leading ``bits`` tell the one bucket that holds a rank, and only its values are counted again by the next bits,
    four rounds in all. A group of any size is a few buckets' counts; no task holds its values.
    """
    run = Scratch(rows.sparkSession, "quantiles")
    gs = [f"_g{i}" for i in range(len(by))]
    values = rows.where(F.col(x).isNotNull()).groupBy(*[F.col(c).alias(g) for c, g in zip(by, gs)], F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    values = run.table("values", values.withColumn("_b", F.pandas_udf(_bits, "long")("_x")))
    n = F.col("n")
    want = [F.struct(F.lit(2 * i + side).alias("_i"), F.least(n - 1, F.floor((n - 1) * F.lit(q)) + side).alias("_r")) for i, q in enumerate(qs) for side in (0, 1)]
    goal = values.groupBy(*gs).agg(F.sum("_c").alias("n")).select(*gs, "n", F.inline(F.array(*want))).withColumn("_at", F.lit(0).cast("long"))
    for shift in range(64 - bits, -1, -bits):
        inside, top = values, F.lit(0).cast("long")
        if shift + bits < 64:
            top = F.shiftright("_b", shift + bits)
            at = goal.select(*[F.col(g).alias(f"_w{g}") for g in gs], F.col("_at").alias("_w")).distinct()
            inside = values.join(at, reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_w{g}")) for g in gs], top == F.col("_w")), "left_semi")
        hist = inside.groupBy(*[F.col(g).alias(f"_h{g}") for g in gs], top.alias("_top"), F.shiftright("_b", shift).alias("_bucket")).agg(F.sum("_c").alias("_k"), F.any_value("_x").alias("_v"))
        hist = hist.withColumn("_upto", F.sum("_k").over(Window.partitionBy(*[f"_h{g}" for g in gs], "_top").orderBy("_bucket")))
        same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_h{g}")) for g in gs], F.col("_at") == F.col("_top"))
        hit = goal.drop("_v").join(hist, same).where((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_k")))
        goal = hit.select(*gs, "n", "_i", (F.col("_r") - F.col("_upto") + F.col("_k")).alias("_r"), F.col("_bucket").alias("_at"), F.col("_v"))
    pick = lambda i: F.max(F.when(F.col("_i") == i, F.col("_v")))
    share = lambda q: (n - 1) * F.lit(q) - F.floor((n - 1) * F.lit(q))
    out = goal.groupBy(*gs, "n").agg(*[pick(2 * i + side).alias(f"_q{i}{side}") for i in range(len(qs)) for side in (0, 1)])
    return out.select(*[F.col(g).alias(c) for c, g in zip(by, gs)], "n", *[(F.col(f"_q{i}0") + (F.col(f"_q{i}1") - F.col(f"_q{i}0")) * share(q)).alias(f"q{i}") for i, q in enumerate(qs)])


def descriptors(pop: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """n, median, quartile range, 5 % and 95 % points and Bowley skewness of each feature and group, by exact linear interpolation. Targets aren't read."""
    long = pop.select(*by, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("v")).select(*by, "v.*")
    q = quantiles(long, [*by, "feature"], "x", [0.05, 0.25, 0.5, 0.75, 0.95])
    p5, p25, p50, p75, p95 = (F.col(f"q{i}") for i in range(5))
    return q.select(*by, "feature", "n", p50.alias("median"), (p75 - p25).alias("iqr"), p5.alias("p05"), p95.alias("p95"), F.try_divide(p75 + p25 - 2 * p50, p75 - p25).alias("bowley"))
