"""Bars, population, windows and event log over the tables at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_of(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """OHLCV bars of ticks (series, ts, id, price, amount, taker): first and last by (ts, id), not by arrival."""
    at = F.struct("ts", "id")
    out = ticks.groupBy("series", F.window("ts", width)["start"].alias("ts"))
    return out.agg(F.min_by("price", at).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", at).alias("c"), F.count(F.lit(1)).alias("volume"), F.sum("amount").alias("quote_volume"), F.sum("taker").alias("taker_buy"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: a series for each event type, price 1 + value, and every other event taker-bought."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("series"), "ts", F.col("event_id").alias("id"), (1 + F.col("value")).alias("price"), F.col("value").alias("amount"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(0).cast("long").alias("taker"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(ticks(spark, sf_dir))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades. ``key`` orders rows of one entry time; profit is relative to the price."""
    p = F.col("l_extendedprice") * ((1 - F.col("l_discount")) * (1 + F.col("l_tax")) - 1)
    key = F.concat_ws("-", *[F.format_string("%012d", F.col(c).cast("long")) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    side = F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell")
    return table(spark, sf_dir, "lineitem").select(side.alias("side"), F.col("l_returnflag").alias("component"), F.col("l_shipdate").alias("entry_ts"), p.alias("profit"), key.alias("key"), "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")


POPULATION_SQL = """pop AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, l_returnflag AS component, l_shipdate AS entry_ts,
 l_extendedprice * ((1 - l_discount) * (1 + l_tax) - 1) AS profit, printf('%012d-%012d-%012d-%012d', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key,
 l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem)"""
BARS_SQL = """bars AS (SELECT event_type AS series, time_bucket(INTERVAL 1 HOUR, ts) AS ts, arg_min(1 + value, (ts, event_id)) AS o, max(1 + value) AS h, min(1 + value) AS l,
 arg_max(1 + value, (ts, event_id)) AS c, count(*)::BIGINT AS volume, sum(value) AS quote_volume, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS taker_buy FROM events GROUP BY 1, 2)"""

#: (name, start, end inclusive, role): the last certifies forward.
WINDOWS = [("W1", "1995-06-01", "1996-05-31", "backward_only"), ("W2", "1996-10-01", "1997-06-30", "middle"), ("W3", "1998-03-01", "1998-12-31", "middle"), ("W4", "2000-09-01", "2001-08-31", "forward_certifier")]
EXCLUSIONS = [("1997-03-01", "1997-03-31")]
EMBARGO_LEFT, EMBARGO_RIGHT = 2, 55


def windows(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, *w) for i, w in enumerate(WINDOWS)]
    return spark.createDataFrame(rows, "ord int, name string, start string, end string, role string").withColumns({c: F.to_date(c).cast("timestamp_ntz") for c in ("start", "end")})


def days(n: int) -> Column:
    return F.expr(f"INTERVAL {n} DAYS")
