"""Readers of the file formats of market data, trades and event logs."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR = "ts timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, trades long, taker_buy_base double, taker_buy_quote double"
EVENT = "event_id string, seq long, ts timestamp, type string, actor string, provenance string, hypothesis string, reasoning string, expected_outcome string, cites array<string>, payload string, imported boolean, prev_hash string, event_hash string"


def bars_parquet(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz")) if "ts" in df.columns else df


def mt3_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV: date, time, open, high, low, close, then tick volume, volume, spread (nine columns or more) or volume (seven). Fewer fail."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.split("value", ",").alias("f"))
    n = F.size("f")
    lines = lines.withColumn("f", F.when(n >= 7, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("a row of fewer than seven columns: "), F.array_join("f", ",")))))
    num = lambda i: F.col("f")[i].cast("double")
    wide = n >= 9
    ts = F.to_timestamp_ntz(F.concat_ws(" ", F.trim(F.col("f")[0]), F.trim(F.col("f")[1])), F.lit("yyyy.MM.dd HH:mm"))
    at = lambda i: F.when(wide, F.try_element_at("f", F.lit(i + 1)).cast("double")).otherwise(0.0)
    return lines.select(ts.alias("ts"), num(2).alias("open"), num(3).alias("high"), num(4).alias("low"), num(5).alias("close"), F.when(wide, F.try_element_at("f", F.lit(8))).otherwise(F.col("f")[6]).cast("double").alias("volume"), at(8).alias("spread"), at(6).alias("tickvol"))


def _unzipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the CSV members; a header is skipped, and the unit of a file's times is told by its first row."""
    for batch in batches:
        for content in batch["content"]:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in z.namelist():
                    with z.open(name) as f:
                        rows, unit = [], None
                        for r in csv.reader(io.TextIOWrapper(f, "utf-8")):
                            if not r or not r[0].strip().isdigit():
                                continue
                            unit = unit or ("us" if int(r[0]) > 1e15 else "ms")
                            rows.append([int(r[0]), *map(float, (*r[1:6], r[7])), int(float(r[8])), float(r[9]), float(r[10])])
                            if len(rows) == 50_000:
                                yield _bar_frame(rows, unit)
                                rows = []
                        if rows:
                            yield _bar_frame(rows, unit)


def _bar_frame(rows: list[list], unit: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in BAR.split(", ")])
    return out.assign(ts=pd.to_datetime(out["ts"], unit=unit).astype("datetime64[us]"))


def kline_zips(spark: SparkSession, path: str) -> DataFrame:
    """Zipped kline CSVs, a file a task: twelve columns, of which close time and the last are left out."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_unzipped, BAR)


def months(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.trunc(F.lit(end).cast("date"), "month"), F.expr("INTERVAL 1 MONTH"))).alias("month"))


def canonical_bars(parts: list[DataFrame], start: str, end: str) -> DataFrame:
    """Union of bars, one row for each ts (of repeated ones that of the least values), in order; a month without a bar is an error."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    rest = [c for c in whole.columns if c != "ts"]
    one = whole.groupBy("ts").agg(F.min(F.struct(*rest)).alias("r")).select("ts", "r.*")
    have = one.select(F.trunc(F.col("ts").cast("date"), "month").alias("month")).distinct()
    gap = months(one.sparkSession, start, end).join(have, "month", "left_anti").orderBy("month").limit(12).collect()
    if gap:
        raise ValueError("no bars in " + ", ".join(str(r.month)[:7] for r in gap))
    return one.orderBy("ts")


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of an event log with the raw line (for hashing) and whether it can't be parsed."""
    raw = spark.read.text(path).where(F.length("value") > 0)
    parsed = F.from_json("value", EVENT + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return raw.select(parsed.alias("e"), F.col("value").alias("raw")).select("e.*", "raw").withColumn("torn", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")


def json_doc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def sectioned_text(spark: SparkSession, path: str, sections=("BUY", "SELL", "Perceptron"), encoding: str = "UTF-16") -> DataFrame:
    """Rows of seven fields under [section] headings: section, pos, cluster and six features. Other rows are left out."""
    body = F.decode("content", encoding)
    lines = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.posexplode(F.split(body, r"\r?\n")).alias("line_no", "line"))
    heads = lines.withColumn("head", F.nullif(F.regexp_extract("line", r"^\s*\[(\w+)\]\s*$", 1), F.lit("")))
    # A file is a small document; a window over one file's lines is one task for each file.
    one = Window.partitionBy("file").orderBy("line_no")
    named = heads.withColumn("section", F.last("head", ignorenulls=True).over(one)).where(F.col("head").isNull() & F.col("section").isin(*sections))
    f = F.split(F.trim("line"), r"\s*,\s*")
    rows = named.withColumn("f", f).where(F.size("f") == 7)
    names = ["hour", "ema", "mom", "dv", "iv", "hurst"]
    pos = F.row_number().over(Window.partitionBy("file", "section").orderBy("line_no")) - 1
    return rows.select("file", "section", pos.alias("pos"), F.col("f")[0].cast("double").cast("long").alias("cluster"), *[F.col("f")[i + 1].cast("double").alias(n) for i, n in enumerate(names)])


def deals_csv(spark: SparkSession, path: str) -> DataFrame:
    """Positional deals: ts, deal, side, direction, volume, price, profit (of outs; missing: 0, with ``coerced``), comment.

    Columns are 0 time, 1 deal, 3 side, 4 in or out, 5 volume, 6 price, 10 profit, 12 comment. Rows of fewer than seven fields and such that don't begin with two digits, as headers, are left out.
    """
    raw = spark.read.csv(path, schema=", ".join(f"c{i} string" for i in range(13)), enforceSchema=True)
    raw = raw.where(F.col("c0").rlike(r"^\d\d") & F.col("c6").isNotNull() | F.col("c0").rlike(r"^\d\d") & F.coalesce(*[F.col(f"c{i}") for i in range(7, 13)]).isNotNull())
    is_in = F.lower(F.trim("c4")) == "in"
    bad = F.coalesce(F.trim("c10"), F.lit("")).isin("", "nan", "NaN")
    profit = F.when(~is_in, F.when(bad, 0.0).otherwise(F.trim("c10").cast("double")))
    return raw.select(F.to_timestamp_ntz(F.trim("c0"), F.lit("yyyy.MM.dd HH:mm:ss")).alias("ts"), F.col("c1").cast("long").alias("deal"), F.lower(F.trim("c3")).alias("side"), F.when(is_in, "in").otherwise("out").alias("direction"), F.col("c5").cast("double").alias("volume"), F.col("c6").cast("double").alias("price"), profit.alias("profit"), (~is_in & bad).alias("coerced"), F.when(~is_in, F.coalesce(F.trim("c12"), F.lit(""))).alias("comment"))


def vectors(pop: DataFrame, side: str, seats: list[str]) -> DataFrame:
    """One side's feature vector, profit and date text; a missing column fails at analysis."""
    return pop.where(F.col("side") == side).select(F.array(*[F.col(c).cast("double") for c in seats]).alias("v"), "profit", F.replace(F.col("entry_ts").cast("string"), F.lit("-"), F.lit(".")).alias("entry"))


def resume(configs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Configs that no earlier run has finished."""
    return configs.join(done.select(key).distinct(), key, "left_anti")


def checked(doc: DataFrame, required: dict[str, Column]) -> DataFrame:
    """The document, or an error that names the first failed assertion."""
    out = doc
    for name, ok in required.items():
        out = out.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"contract: {name}")).cast("boolean")))
    return out


def with_daily(monthly: DataFrame, daily: DataFrame) -> DataFrame:
    """Bars of monthly files and, of months that no monthly file has a bar of, those of daily ones; days that are missing there leave a gap. ``canonical_bars`` refuses a month with neither."""
    month = lambda c: F.trunc(F.col(c).cast("date"), "month")
    there = monthly.select(month("ts").alias("_m")).distinct()
    return monthly.unionByName(daily.join(F.broadcast(there), month("ts") == F.col("_m"), "left_anti"))  # a row a month


def resampled(bars: DataFrame, width: str) -> DataFrame:
    """OHLC bars (ts, open, high, low, close) of ``width``, by their first and last values in time; intervals without a bar, or with a missing price, are left out."""
    value = lambda f, c: f(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("ts")))
    out = bars.groupBy(F.window("ts", width)["start"].alias("_t")).agg(value(F.min_by, "open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), value(F.max_by, "close").alias("close"))
    return out.withColumnRenamed("_t", "ts").dropna()


def price_bars(spark: SparkSession, path: str, width: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(signal bars, all bars) of a file or folder: Parquet by its suffix, else headerless CSV; signal bars are resampled to ``width``, where one is told."""
    raw = (bars_parquet(spark, path) if path.rstrip("/").endswith(".parquet") else mt3_csv(spark, path)).select("ts", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")])
    return (resampled(raw, width) if width else raw), raw
