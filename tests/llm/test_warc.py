import base64
import gzip
import hashlib
import os

from marlstone.llm import warc
from marlstone.scratch import Scratch

SCHEMA = "page_id long, url string, html string, digest string"


def plain(rows, least=0):
    first = {}
    for p, _, h, *_ in rows:
        b = (h or "").encode()
        if p is not None and len(b) >= least:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, _, h, *_ in rows:
        b = (h or "").encode()
        to = first.get(b)
        to = None if to is None or to == p or len(b) < least else to
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [tuple(r) for r in pages.collect()]
    back = warc.round_trip(pages, roll=20_000)
    assert got(back) == plain(rows)
    html = {r[0]: r[2] for r in rows}
    assert all(r.payload is None if r.record_type == "revisit" else bytes(r.payload).decode() == html[r.page_id] for r in back.collect())


def test_edges(spark):
    rows = [(5, "u", "same", "x"), (2, "u", "same", "x"), (9, None, None, None), (8, "a\r\nb", "", ""), (None, "n", "same", ""), (None, None, None, ""), (7, "é", "é" * 200_000, ""), (2, "u", "same", "x"), (2, "v", "other", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(warc.round_trip(df)) == plain(rows)
    assert got(warc.round_trip(df, least=5)) == plain(rows, least=5)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_deterministic_files_that_gzip_reads(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    listed = []
    for df in (pages, pages.repartition(7)):
        run = Scratch(spark, "warc-test")
        files = warc.write(df, run.path, roll=8_000, shard_bytes=100_000).orderBy("file").collect()
        assert len({f.file[:11] for f in files}) > 1 and len(files) > 6 and sum(f.records for f in files) == pages.count()
        root = run.path.removeprefix("file://")
        assert all(gzip.open(f"{root}/{f.file}").read().startswith(b"WARC/1.1\r\n") for f in files)
        assert not [f for f in os.listdir(root) if f.startswith(".tmp")]
        listed.append(files)
    assert listed[0] == listed[1]


def test_shards_of_uneven_ids(spark):
    rows = [(i, "u", "x" * 1000, "") for i in range(50)] + [(1 << 60, "u", "y", ""), (None, "u", "z", ""), (-(1 << 60), "u", "w", "")]
    df = warc.sharded(warc.plan(spark.createDataFrame(rows, SCHEMA)), 5_000).select("page_id", "shard")
    got = sorted(((r.page_id is None, r.page_id or 0), r.shard) for r in df.collect())
    assert len(got) == len(rows) and [s for _, s in got] == sorted(s for _, s in got)
    dense = warc.sharded(warc.plan(spark.createDataFrame([(i, "u", "x" * 1000, "") for i in range(0, 9_000_000, 90_000)] + [(40 + i, "u", "x" * 1000, "") for i in range(50)], SCHEMA)), 5_000)
    assert dense.count() == 150 and max(r["count"] for r in dense.groupBy("shard").count().collect()) <= 11
