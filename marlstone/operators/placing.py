"""Places of rows in ordered groups, for groups of any size.

A window over a group's rows would put a group in one task. Here rows are dealt by range of (group, order), the dealt table is written, so that
counts and numbers come from the same deal, and each range continues the count of those before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.scratch import Scratch

AHEAD_ROWS = 100_000  # of (range, group) that may be sent to all tasks


def _dealt(rows: DataFrame, by: list[str], order: list[str], own: Column, run: Scratch | None, joined=F.sum, start: int | None = 0, keep: list[str] | None = None, ranges: int | None = None, **totals: Column) -> tuple[DataFrame, DataFrame, Column]:
    """Rows dealt by range, and by (range, group) what ``own`` comes to in the ranges before (``_ahead``, by ``joined``) and ``totals`` of the group; and how the two join.

    ``_id`` numbers the rows of a range in order, without gaps. Only the sums of (range, group) meet by group: at most one for each range and one for each group.
    Few of them are sent to all tasks; the rows never are, though their files may be tiny (a column of few values). Only ``by`` and ``keep`` are written, where it is told.
    ``ranges`` tells how many there are: so many are kept apart, where Spark would else put small ones together until a task's sort spills.
    """
    run = run or Scratch(rows.sparkSession, "placed")
    gs = [f"_g{i}" for i in range(len(by))]
    ordered = rows.repartitionByRange(*([ranges] if ranges else []), *by, *order).sortWithinPartitions(*by, *order)
    ordered = ordered.select(*(rows.columns if keep is None else dict.fromkeys([*by, *keep])), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_id"))
    dealt = run.table("dealt", ordered)
    sums = dealt.groupBy("_p", *[F.col(c).alias(g) for c, g in zip(by, gs)]).agg(own.alias("_k"), F.min("_id").alias("_first"))
    whole = Window.partitionBy(*(gs or [F.lit(0)]))
    before = F.coalesce(joined("_k").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(start)).alias("_ahead")
    ahead = run.table("ahead", sums.select(F.col("_p").alias("_q"), "_first", *gs, before, *[t.over(whole).alias(n) for n, t in totals.items()]))
    if ahead.count() <= AHEAD_ROWS:
        ahead = F.broadcast(ahead)
    else:
        dealt = dealt.hint("merge")
    return dealt, ahead, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(by, gs)], F.col("_p") == F.col("_q"))


def placed(rows: DataFrame, by: list[str], order: list[str], run: Scratch | None = None, keep: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Adds ``place`` (from 0, by ``order``) and ``n`` (rows) within each group; a null is a group as others. Rows that are equal in ``order`` get places in any order.

    Of the other columns only ``keep`` come back, where it is told.
    """
    dealt, ahead, same = _dealt(rows, by, order, F.count(F.lit(1)), run, keep=keep, ranges=ranges, n=F.sum("_k"))
    return dealt.join(ahead, same).withColumn("place", F.col("_ahead") + F.col("_id") - F.col("_first")).drop("_p", "_q", "_id", "_first", "_ahead", *[f"_g{i}" for i in range(len(by))])


def running(rows: DataFrame, by: list[str], order: list[str], value: str, name: str = "total", run: Scratch | None = None, whole: str | None = None) -> DataFrame:
    """Adds as ``name`` the sum of ``value`` over the group's rows up to this one by ``order``, and as ``whole`` that of all its rows; a null counts nothing."""
    dealt, ahead, same = _dealt(rows, by, order, F.coalesce(F.sum(value), F.lit(0)), run, **({whole: F.sum("_k")} if whole else {}))
    upto = Window.partitionBy("_p", *by).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("_r", F.coalesce(F.sum(value).over(upto), F.lit(0)))
    return own.join(ahead, same).withColumn(name, F.col("_ahead") + F.col("_r")).drop("_p", "_q", "_id", "_first", "_r", "_ahead", *[f"_g{i}" for i in range(len(by))])


def highest(rows: DataFrame, by: list[str], order: list[str], value: str, name: str = "top", run: Scratch | None = None) -> DataFrame:
    """Adds as ``name`` the greatest ``value`` of the group's rows up to this one by ``order``."""
    dealt, ahead, same = _dealt(rows, by, order, F.max(value), run, F.max, None)
    upto = Window.partitionBy("_p", *by).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("_r", F.max(value).over(upto))
    return own.join(ahead, same).withColumn(name, F.greatest("_ahead", "_r")).drop("_p", "_q", "_id", "_first", "_r", "_ahead", *[f"_g{i}" for i in range(len(by))])


def points(rows: DataFrame, by: list[str], x: str, qs: list[float]) -> DataFrame:
    """(by, n, q0, q1, ..): quantiles of each group by plotting positions (i - 0.5) / n, clamped at both ends. Nulls don't count.

    Equal values are counted before they are ordered, so a column of few values is a few rows.
    """
    values = rows.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    at = running(values, by, ["_x"], "_c", "_upto", whole="n")
    n = F.col("n")
    holds = lambda i: (F.col("_upto") - F.col("_c") < i) & (i <= F.col("_upto"))
    pick, out = [], []
    for k, q in enumerate(qs):
        where = n * F.lit(q) + 0.5
        low = F.greatest(F.lit(1), F.least(n, F.floor(where)))
        high = F.least(n, low + 1)
        pick += [F.max(F.when(holds(low), F.col("_x"))).alias(f"_lo{k}"), F.max(F.when(holds(high), F.col("_x"))).alias(f"_hi{k}"), F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), where - low))).alias(f"_s{k}")]
        out.append((F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * F.col(f"_s{k}")).alias(f"q{k}"))
    return at.groupBy(*by).agg(F.max("n").alias("n"), *pick).select(*by, "n", *out)


def neighbour(rows: DataFrame, by: list[str], col: str, name: str, step: int = 1) -> DataFrame:
    """Adds as ``name`` the value of ``col`` that stands ``step`` places later in the group of placed rows, null past its end."""
    far = rows.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], (F.col("place") - step).alias("_at"), F.col(col).alias(name))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)], F.col("place") == F.col("_at"))
    return rows.join(far, same, "left").drop("_at", *[f"_b{i}" for i in range(len(by))])
