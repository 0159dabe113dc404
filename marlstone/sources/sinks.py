"""Writers: populations, contract exports, ledgers and content-addressed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POPULATION = ["trade_id", "side", "entry_ts", "exit_ts", "entry_price", "exit_price", "volume", "profit", "profit_usd", "exit_reason", "f_hour", "f_ema", "f_mom", "f_dv", "f_iv", "f_hurst", "incumbent_cluster_id", "legacy_row_index", "mt5_deal_in", "mt5_deal_out"]


def population(df: DataFrame, path: str) -> None:
    df.select(*POPULATION, *[c for c in df.columns if c.startswith("fc_")]).write.mode("error").parquet(path)


def exports(objects: DataFrame, path: str) -> None:
    """Frozen objects (kind, id, frozen, doc) as JSON, a folder for each kind."""
    objects.where("frozen").select("kind", "id", "doc").repartition("kind").write.partitionBy("kind").mode("overwrite").json(path)


def addressed(df: DataFrame, content: str) -> DataFrame:
    """Add the content-addressed path: two digits of the sha256, then all."""
    sha = F.sha2(F.col(content), 256)
    return df.withColumn("sha256", sha).withColumn("path", F.concat_ws("/", F.substring(sha, 1, 2), sha))


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def render(log: DataFrame) -> DataFrame:
    """(seq, text) of events (seq, ts, type, actor, event_id, event_hash, brief map<string,string>): each event renders by itself, so that a longer log begins with a shorter one's text."""
    keys = F.slice(F.sort_array(F.map_keys("brief")), 1, 8)
    pairs = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), F.element_at("brief", k))), " · ")
    head = F.format_string("\n## [%d] %s · %s · %s", "seq", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "type", "actor")
    foot = F.format_string("`event %s · hash %s`", "event_id", F.substring("event_hash", 1, 12))
    line: Column = F.when(F.length(pairs) > 0, F.concat(F.lit("`"), pairs, F.lit("`")))
    return log.select("seq", F.concat(F.concat_ws("\n", head, line, foot), F.lit("\n")).alias("text"))


def routed(decided: DataFrame, accepted: str, rejected: str) -> None:
    """Decisions to two folders, with their reasons."""
    decided.where("accepted").write.mode("append").json(accepted)
    decided.where("NOT accepted").write.mode("append").json(rejected)
