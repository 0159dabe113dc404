"""Scalar expressions: clock law, bands, canonical hashes and cell encodings."""

from __future__ import annotations

import hashlib
import json
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEME = "digest_v1"
KINDS = ("float64", "int64", "timestamp_us", "string")


def us_dst_hours(ts: Column) -> Column:
    """Server offset from UTC: 3 from the second Sunday of March to the first of November, else 2; the change is at date midnight."""
    sunday = lambda month, n: F.date_add(F.next_day(F.date_sub(F.make_date(F.year(ts), F.lit(month), F.lit(1)), 1), "Sun"), 7 * (n - 1)).cast("timestamp_ntz")
    return F.when((ts >= sunday(3, 2)) & (ts < sunday(11, 1)), 3).otherwise(2)


def band(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the band that x falls in: below the first edge, between two, or from the last on."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        out = F.when(x < edge, label).otherwise(out)
    return F.when(x.isNotNull(), out)


def packed_key(key: Column) -> Column:
    """A population's key (digits and hyphens, ``null`` for a missing part) in half its bytes; the packed keys are equal and ordered as the keys are."""
    symbols = F.translate(key, "-0123456789lnu", "123456789ABCDE")
    return F.unhex(F.when(F.length(symbols) % 2 == 0, symbols).otherwise(F.concat(symbols, F.lit("0"))))


def canonical(value) -> bytes:
    """JSON bytes with sorted keys, no spaces, UTF-8; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


@F.pandas_udf(T.StringType())
def canonical_sha256(doc: pd.Series) -> pd.Series:
    """sha256 of the canonical form of a JSON text; null if it isn't JSON."""

    def one(text):
        try:
            return hashlib.sha256(canonical(json.loads(text))).hexdigest()
        except (ValueError, TypeError):
            return None

    return doc.map(one)


def _little(x: Column) -> Column:
    """The 8 bytes of a long, lowest first."""
    h = F.lpad(F.hex(x), 16, "0")
    return F.concat(*[F.unhex(F.substring(h, 15 - 2 * i, 2)) for i in range(8)])


@F.pandas_udf(T.BinaryType())
def _double_bytes(x: pd.Series) -> pd.Series:
    return x.map(lambda v: struct.pack("<d", v))


def cell(x: Column, kind: str) -> Column:
    """A presence byte, then the value: doubles and longs as 8 bytes, strings with their length in 4, lowest byte first."""
    if kind == "float64":
        body = _double_bytes(F.coalesce(x.cast("double"), F.lit(0.0)))
    elif kind == "int64":
        body = _little(x.cast("long"))
    elif kind == "timestamp_us":
        body = _little(F.unix_micros(x.cast("timestamp")))
    elif kind == "string":
        raw = F.encode(x, "UTF-8")
        body = F.concat(F.substring(_little(F.length(raw).cast("long")), 1, 4), raw)
    else:
        raise ValueError(f"no cell encoding for {kind}")
    return F.when(x.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), body))


def content_digest(df: DataFrame, kinds: dict[str, str], sort: list[str]) -> str:
    """sha256 over a header and all rows, by sort key (null last), then row bytes; equal tables have equal digests however they are dealt.

    One hash over ordered rows is serial by definition: rows are sorted by range over the cluster and come to the driver one partition at a time.
    """
    digest = hashlib.sha256(SCHEME.encode() + canonical({"columns": list(kinds), "dtypes": kinds}))
    blob = F.concat(*[cell(F.col(c), k) for c, k in kinds.items()])
    order = [x for c in sort for x in (F.col(c).isNull(), F.col(c))]
    rows = df.withColumn("_blob", blob).orderBy(*order, "_blob").select("_blob")
    for r in rows.toLocalIterator():
        digest.update(r[0])
    return digest.hexdigest()


SNAPSHOT = {"open": "<f8", "high": "<f8", "low": "<f8", "close": "<f8", "volume": "<f8", "quote_volume": "<f8", "trades": "<i8", "taker_buy_base": "<f8", "taker_buy_quote": "<f8"}


def snapshot_digest(bars: DataFrame, columns: dict[str, str] = SNAPSHOT, scheme: str = "snap_digest_v1") -> tuple[str, int, tuple[str, str]]:
    """(digest, rows, range of ts) of a snapshot: sha256 over the scheme, the number of rows, each column's name and its little-endian values in order of ts, and the range.

    One hash over a column after the other is serial by definition. Rows are dealt by range of ts and written; each task packs its columns, and the driver reads
    one column's packed parts in order, one part at a time.
    """
    from marlstone.scratch import Scratch

    run = Scratch(bars.sparkSession, "snapshot")
    dealt = run.table("dealt", bars.select("ts", *columns).repartitionByRange("ts").sortWithinPartitions("ts").withColumn("_p", F.spark_partition_id()))

    def pack(batches):
        for i, b in enumerate(batches):
            for part, g in b.groupby("_p"):
                yield pd.DataFrame([(int(part), i, c, g[c].to_numpy().astype(k).tobytes()) for c, k in columns.items()], columns=["part", "i", "name", "bytes"])

    parts = dealt.repartition("_p").sortWithinPartitions("_p", "ts").mapInPandas(pack, "part int, i int, name string, bytes binary")
    parts = run.table("packed", parts)
    n, first, last = dealt.agg(F.count(F.lit(1)), F.min("ts"), F.max("ts")).first()
    ends = tuple(str(pd.Timestamp(t)) if t is not None else "" for t in (first, last))
    digest = hashlib.sha256(f"{scheme}n={n}".encode())
    for c in columns:
        digest.update(c.encode())
        for r in parts.where(F.col("name") == c).orderBy("part", "i").select("bytes").toLocalIterator():
            digest.update(r[0])
    digest.update("|".join(ends).encode())
    return digest.hexdigest(), n, ends


def changed_since(rows: DataFrame, by: str, order: str, col: str) -> DataFrame:
    """Rows whose value differs from the one before of their group."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("_b", F.lag(col).over(w)).where(F.col("_b").isNull() | ~F.col("_b").eqNullSafe(F.col(col))).drop("_b")


def environment_hash() -> str:
    """Hash of the installed distributions, the Python and the platform that results were made with."""
    import platform
    import sys
    from importlib import metadata

    installed = sorted({f"{d.metadata['Name']}=={d.version}" for d in metadata.distributions()})
    return hashlib.sha256(canonical({"freeze": installed, "python": sys.version, "platform": platform.platform()})).hexdigest()
