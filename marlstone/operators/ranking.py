"""Grids, promotion with novelty, rankings and set similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators.placing import placed
from marlstone.scratch import Scratch

GRID = {"strategy": ["A", "B", "C"], "sl_atr_mult": [1.0, 1.5, 2.0], "tp_atr_mult": [1.0, 1.5, 2.0, 2.5, 3.0], "donchian": [20, 40, 60], "atr_fast": [7, 14], "days": ["all", "no_mon", "no_fri", "mid"]}


def grid(spark: SparkSession, values: dict = GRID) -> DataFrame:
    """Every combination of the value lists, with a key of the lists' values."""
    out = spark.range(1).select()
    for name, v in values.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, v))).alias(name))
    return out.withColumn("key", F.concat_ws("|", *[F.col(n).cast("string") for n in values]))


def systematic_sample(rows: DataFrame, key: str, family: Column, about: int) -> DataFrame:
    """The whole family and every step-th of the rest in key order, step = max(1, rest // about).

    Rows are numbered over ranges of the key.
    """
    rest = rows.where(~family)
    step = max(1, rest.count() // about)
    return rows.where(family).select(*rows.columns).unionByName(placed(rest, [], [key]).where(F.col("place") % step == 0).select(*rows.columns))


def lex_key(*cols: Column) -> Column:
    """Fields joined by a bar, None where null."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("None")) for c in cols])


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


def promote(cards: DataFrame, capacity: int, share: float, tie: str = "key") -> DataFrame:
    """(key, score, how): the best ``capacity - int(capacity * share)`` by score, then the rest by least overlap with these, others parked; equal scores by ``tie``.

    ``cards``: key, score, ids. Both cuts are limits on an ordering, so no window runs over all cards. Overlaps are counts of shared ids by a join; of the
    promoted cards' ids, which may be many, none is gathered. A card without ids overlaps with nothing, so it is among the first for novelty; only where no card at all has ids (all
    null) do the places for novelty stay unfilled.
    """
    novel = int(capacity * share)
    run = Scratch(cards.sparkSession, "promote")
    best = [F.col("score").desc_nulls_last(), F.col(tie)]
    named = cards.select("key", "score", *([tie] if tie != "key" else []))
    top = run.table("top", named.orderBy(*best).limit(capacity - novel).select("key"))
    how = top.select("key", F.lit("score").alias("how"))
    if novel and cards.where("ids IS NOT NULL").limit(1).count():
        ids = cards.select("key", F.explode(F.array_distinct("ids")).alias("_id"))
        held = ids.join(F.broadcast(top), "key", "left_semi").select(F.col("key").alias("_top"), "_id")  # ``top`` has ``capacity`` keys at most
        both = ids.join(F.broadcast(top), "key", "left_anti").join(held, "_id").groupBy("key", "_top").agg(F.count(F.lit(1)).alias("_both"))
        sizes = cards.select("key", F.size(F.array_distinct("ids")).alias("_n"))
        both = both.join(sizes, "key").join(F.broadcast(sizes.join(F.broadcast(top), "key", "left_semi").select(F.col("key").alias("_top"), F.col("_n").alias("_m"))), "_top")
        most = both.groupBy("key").agg(F.max(F.col("_both") / (F.col("_n") + F.col("_m") - F.col("_both"))).alias("_o"))
        rest = named.join(F.broadcast(top), "key", "left_anti")
        fresh = rest.join(most, "key", "left").withColumn("overlap", F.coalesce("_o", F.lit(0.0))).orderBy("overlap", *best).limit(novel)
        how = how.unionByName(fresh.select("key", F.lit("novelty").alias("how")))
    return cards.select("key", "score").join(F.broadcast(how), "key", "left").withColumn("how", F.coalesce("how", F.lit("parked")))


def cut_score(promoted: DataFrame) -> float | None:
    """The score of the last card that was promoted by score, or else of the first for novelty; None without any."""
    last = promoted.where("how = 'score'").agg(F.min("score")).first()[0]
    return last if last is not None else promoted.where("how = 'novelty'").agg(F.max("score")).first()[0]


def best_by_rank(rows: DataFrame, by: list[str], ranks: dict[str, int], what: str, order: str) -> DataFrame:
    """The verdict of the highest rank in each group; the first by ``order`` of equal ones."""
    rank = F.coalesce(*[F.when(F.col(what) == k, v) for k, v in ranks.items()], F.lit(-1))
    return rows.groupBy(*by).agg(F.max_by(F.struct(what, order), F.struct(rank, -F.col(order))).alias("b")).select(*by, f"b.{what}", f"b.{order}")


def top_recent(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def djb2(s: Column, m: int = 2147483647) -> Column:
    """Seed of a key: h = 33 h + code, modulo 2 ** 31 - 1."""
    return F.aggregate(F.sequence(F.lit(1), F.char_length(s)), F.lit(5381).cast("long"), lambda h, i: (h * 33 + F.ascii(F.substring(s, i, F.lit(1)))) % m)
