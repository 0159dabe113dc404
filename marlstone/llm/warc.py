"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page_id. The ranges (shards) follow from sums of payload bytes over a grid of ids, not from
a sample, so that the same table gives the same files however it was dealt. Each shard is written as
gzip members, one a record, and rolls to the next file once the compressed size reaches the limit. Headers are
made anew from the row: dates, record ids and digests follow from the content alone. A file is
written under a temporary name of its attempt and renamed when complete; a task that runs again writes the same bytes under the same
name. Last comes the manifest, a table that Spark commits as a whole: readers take only the files it lists,
with their sizes and digests, so that what a failed run left is never read.

Records with equal payloads are one response (the smallest page_id) and revisits that refer to it.
The archives lie in a folder that all executors reach, of any kind that pyarrow's file systems open.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.scratch import Scratch

ROLL_BYTES = 64 << 20
SHARD_BYTES = 128 << 20  # of payloads
GRID = 1 << 16
MOST_CELLS = 1_000_000  # 12 bytes each
LEAST_BYTES = 0
DATE = "2020-01-01T00:00:00Z"
MANIFEST = "file string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _uri(page_id: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, page_id)}>"


def _head(pairs: list[tuple[str, object]]) -> bytes:
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    return "".join(f"{k}: {clean(v)}\r\n" for k, v in pairs if v is not None).encode()


def b32(hexes: str) -> str:
    return base64.b32encode(bytes.fromhex(hexes)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, place: str) -> bytes:
    """One WARC/1.1 record, as a gzip member. ``place`` tells apart rows that are equal in all else."""
    http = b"HTTP/1.1 200 OK\r\n" + _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = b"WARC/1.1\r\n" + _head([
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _uri(f"{page_id}/{digest}/{place}")),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("X-Page-Id", page_id),
        ("X-Refers-To-Page-Id", refers_to),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block)),
    ]) + b"\r\n"
    out = io.BytesIO()
    with gzip.GzipFile(filename="", fileobj=out, mode="wb", mtime=0, compresslevel=6) as z:
        z.write(head + block + b"\r\n\r\n")
    return out.getvalue()


def members(data) -> Iterator[bytes]:
    """The records of an archive, one gzip member each, read in pieces."""
    rest = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            piece = rest or data.read(1 << 20)
            if not piece:
                if parts:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(z.decompress(piece))
            rest = z.unused_data if z.eof else b""
        yield b"".join(parts)


def parse(member: bytes) -> dict:
    """Headers and payload of a record; digests are verified."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    named = dict(x.split(": ", 1) for x in lines[1:])
    if not lines[0].startswith("WARC/") or len(rest) != int(named["Content-Length"]) + 4:
        raise ValueError("broken record")
    block = rest[:-4]
    if named["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError(f"block digest differs: {named['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = named["WARC-Type"] == "revisit"
    if not revisit and (length != len(payload) or digest != base64.b32encode(hashlib.sha1(payload).digest()).decode()):
        raise ValueError(f"payload digest differs: {named['WARC-Record-ID']}")
    number = lambda k: int(named[k]) if k in named else None
    return {"page_id": number("X-Page-Id"), "url": named.get("WARC-Target-URI"), "record_type": named["WARC-Type"], "payload_bytes": length, "payload_digest": digest, "refers_to": number("X-Refers-To-Page-Id"), "payload": None if revisit else payload}


def plan(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest (hex SHA-1) and refers_to of every row of ``pages``, whose null html is empty.

    Of equal payloads of ``least`` bytes or more, the row of the smallest page_id is the response. Only (page_id, digest)
    is grouped and joined by digest; rows join by page_id what they refer to.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    keys = rows.where(F.length("payload") >= least).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    revisits = keys.join(first, "digest").where("NOT page_id <=> first").select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "first").distinct()
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left")
    return joined.select("page_id", "url", "payload", "digest", F.col("first").alias("refers_to"))


def sharded(rows: DataFrame, shard_bytes: int) -> DataFrame:
    return _sharded(rows, shard_bytes)[0]


def _sharded(rows: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """Add ``shard``: a number that rises with page_id (null last), with about ``shard_bytes`` of payload each, or more where
    that would make over ``GRID`` / 4 shards. Also returns the number of shards.

    Payload bytes are summed over a grid of ``GRID`` cells of the ids' range; cells above the target, ``GRID`` / 4 at most, are summed again over a
    grid of their own. The sums are counted, and sent to all tasks only up to ``MOST_CELLS`` rows. A range of ids that the second grid can't part stays one shard.
    """
    spans = rows.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.sum(F.length("payload")).alias("n")).first()
    shard_bytes = max(shard_bytes, 4 * (spans.n or 0) // GRID)
    low, span = spans.low or 0, (spans.high or 0) - (spans.low or 0) + 1
    wide = -(-span // GRID)
    fine = max(1, -(-wide // GRID))
    step = F.when(F.col("page_id").isNotNull(), F.col("page_id").cast("decimal(38,0)") - F.lit(low).cast("decimal(38,0)"))
    rows = rows.withColumn("_cell", F.coalesce(F.floor(step / F.lit(wide)).cast("int"), F.lit(GRID)))
    rows = rows.withColumn("_sub", F.coalesce(F.floor((step - F.col("_cell") * F.lit(wide).cast("decimal(20,0)")) / F.lit(fine)).cast("int"), F.lit(0)))
    coarse = rows.groupBy("_cell").agg(F.sum(F.length("payload")).alias("n"))
    heavy = coarse.where(F.col("n") > shard_bytes).select("_cell")
    part = rows.join(F.broadcast(heavy), "_cell").groupBy("_cell", "_sub").agg(F.sum(F.length("payload")).alias("n"))
    cells = coarse.where(F.col("n") <= shard_bytes).select("_cell", F.lit(-1).alias("_sub"), "n").union(part.select("_cell", "_sub", "n"))
    upto = F.sum("n").over(Window.orderBy("_cell", "_sub")) - F.col("n")
    cells = cells.select(F.col("_cell").alias("_c"), F.col("_sub").alias("_s"), F.floor(upto / shard_bytes).cast("int").alias("shard"))
    cells = Scratch(rows.sparkSession, "warc-cells").table("cells", cells)
    n, last = cells.agg(F.count(F.lit(1)), F.max("shard")).first()
    cells = F.broadcast(cells) if n <= MOST_CELLS else cells
    return rows.join(cells, (F.col("_cell") == F.col("_c")) & F.col("_s").isin(-1) | (F.col("_cell") == F.col("_c")) & (F.col("_sub") == F.col("_s"))).drop("_cell", "_sub", "_c", "_s"), (last or 0) + 1


def write(pages: DataFrame, path: str, roll: int = ROLL_BYTES, least: int = LEAST_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all rows of ``pages`` (page_id, url, html) under ``path`` and return the manifest (file, records, bytes, sha256).

    Order: page_id, null last, then url and payload digest. Equal rows are written as often as they occur; of rows with one page_id and
    one payload all but none are responses if it is the smallest. No rows: no files, an empty manifest.
    """
    sort = [F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_last(), F.col("digest")]
    run_dir = Scratch(pages.sparkSession, "warc-plan")
    rows, shards = _sharded(run_dir.table("plan", plan(pages, least)), shard_bytes)
    rows = rows.repartition(shards, F.col("shard")).sortWithinPartitions("shard", *sort)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(path)
        attempt, shard = TaskContext.get().taskAttemptId(), None
        number, n, size, out, sha, same, last = 0, 0, 0, None, None, 0, None
        done = []

        def close():
            out.close()
            name = f"part-{shard:06d}-{number:05d}.warc.gz"
            store.move(temporary, f"{root}/{name}")
            done.append((name, n, size, sha.hexdigest()))

        for batch in batches:
            for p, url, payload, digest, to, own in batch.itertuples(index=False, name=None):
                if own != shard:
                    if out is not None:
                        close()
                    out, number, shard = None, 0, own
                p, to = (None if x is None or pd.isna(x) else int(x) for x in (p, to))
                same = same + 1 if (p, url, digest) == last else 0
                last = (p, url, digest)
                data = record(p, url, bytes(payload), b32(digest), to, f"{url}/{same}")
                if out is None:
                    store.create_dir(root, recursive=True)
                    temporary, n, size, sha = f"{root}/.tmp-{shard:06d}-{number:05d}-{attempt}-{uuid.uuid4().hex}", 0, 0, hashlib.sha256()
                    out = store.open_output_stream(temporary)
                out.write(data)
                sha.update(data)
                n, size = n + 1, size + len(data)
                if size >= roll:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["file", "records", "bytes", "sha256"])

    at = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")}).mapInPandas(run, MANIFEST)
    at.write.mode("error").parquet(f"{path}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives that the manifest under ``path`` lists. Sizes, file digests and record digests are verified.

    A revisit has no payload of its own; its payload_bytes and payload_digest are those of the full payload.
    """
    listed = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, records, size, sha in batch.itertuples(index=False, name=None):
                seen = hashlib.sha256()
                with store.open_input_stream(f"{root}/{name}", compression=None) as raw:

                    class Tap:
                        total = 0

                        def read(self, n):
                            piece = raw.read(n)
                            seen.update(piece)
                            self.total += len(piece)
                            return piece

                    tap, rows, count = Tap(), [], 0
                    for m in members(tap):
                        rows.append(parse(m))
                        count += 1
                        if len(rows) == 500:
                            yield _frame(rows)
                            rows = []
                if (count, tap.total, seen.hexdigest()) != (records, size, sha):
                    raise ValueError(f"{name} isn't what the manifest lists")
                yield _frame(rows)

    # A task for each file or so; the number is given, as else all of the small manifest would be read in one task.
    files = listed.repartition(max(1, listed.count()), F.col("file"))
    return files.mapInPandas(run, RECORD)


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")])
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def round_trip(pages: DataFrame, roll: int = ROLL_BYTES, least: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` to the shared folder and read the archives back."""
    run = Scratch(pages.sparkSession, "warc")
    write(pages, run.path, roll, least)
    return read(pages.sparkSession, run.path)
