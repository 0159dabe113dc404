"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

1. A shingle (five words) weighs its count in the text times the mean inverse document frequency of its words; shingles
   themselves occur once nearly always, so their own frequency says nothing. Document frequencies are counted over
   all documents, for 2 ** 16 hash buckets of words, so that the table has one size whatever the input.
2. Texts of equal words are one node. Each node gets 64 samples by improved consistent weighted sampling, of which two nodes
   share each with probability equal to their weighted Jaccard similarity, in 16 bands of 4: at 0.8 a pair meets in
   a band with probability 0.9998.
3. Nodes that share a band are candidates. Each bucket is linked as a star to its most central node (the one that meets
   most others over all bands). Links are verified by the exact weighted Jaccard similarity of the whole texts; connected
   components of the links follow.
4. Where a bucket's nodes are still in different components, all pairs between these but the star's are verified in blocks, so that
   no link is lost: nodes of the smaller components against the blocks of all others of the bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.llm.text import WordHashes, mix, shingles_of, words_of
from marlstone.scratch import Scratch

N = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
DF_BITS = 16
BLOCK = 256  # nodes of a bucket that one block holds
CHUNK = 16_384  # shingles sampled at once


class Weights:
    """TF-IDF weights from the table of document frequencies."""

    def __init__(self, n_docs: int, df: np.ndarray):
        self.idf = np.log1p(n_docs / np.maximum(df, 1)).astype(np.float32)

    def sets(self, hashes: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingles of a text of these word hashes, and their weights."""
        if not len(hashes):
            return np.empty(0, np.uint64), np.empty(0, np.float32)
        k = min(n, len(hashes))
        idf = self.idf[(hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)]
        run = np.cumsum(np.concatenate([[0.0], idf]))
        mean = (run[k:] - run[:-k]) / k
        s, first, tf = np.unique(shingles_of(hashes, n), return_index=True, return_counts=True)
        return s, (tf * mean[first]).astype(np.float32)


def _gamma_table() -> tuple[np.ndarray, np.ndarray]:
    """4096 equally likely values of a Gamma(2, 1) variable and their logarithms, found by bisection of its distribution."""
    u = (np.arange(4096) + 0.5) / 4096
    lo, hi = np.zeros(4096), np.full(4096, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < u
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return lo.astype(np.float32), np.log(lo).astype(np.float32)


GAMMA, LOG_GAMMA = _gamma_table()
ODDS = [int(hashlib.blake2b(b"icws%d" % i, digest_size=8).hexdigest(), 16) | 1 for i in range(BANDS * ROWS)]


def samples(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The consistent weighted samples, one column for each of ``ODDS``, of the texts whose sets begin at ``starts``.

    For each shingle and sample a hash gives r, c ~ Gamma(2, 1) and beta ~ U(0, 1); t = floor(ln w / r + beta); ln a = ln c - r (t - beta + 1).
    The sample is the shingle of least a, together with t.
    """
    out = np.empty((len(starts), len(ODDS)), np.uint64)
    log_w = np.log(weights)
    size = np.diff(np.append(starts, len(shingles)))
    for k, odd in enumerate(ODDS):
        h = shingles * np.uint64(odd)
        h ^= h >> np.uint64(32)
        r = GAMMA[(h & np.uint64(4095)).astype(np.int32)]
        beta = ((h >> np.uint64(24)) & np.uint64(0xFFFFF)).astype(np.float32) * np.float32(2.0**-20)
        t = np.floor(log_w / r + beta)
        a = LOG_GAMMA[((h >> np.uint64(12)) & np.uint64(4095)).astype(np.int32)] - r * (t - beta + 1)
        a += (h >> np.uint64(44)).astype(np.float32) * np.float32(2.0**-34)  # parts equal values
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == np.repeat(least, size))
        # Of equal values, the largest shingle.
        key = shingles[at] ^ (t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        doc = np.searchsorted(starts, at, side="right") - 1
        out[doc, k] = key
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sig), BANDS), np.uint64)
    for i in range(ROWS):
        out = mix(out * np.uint64(0x100000001B3) + sig[:, i::ROWS][:, :BANDS])
    return out.view(np.int64)


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Sum of least over sum of greatest weights of two sorted sets."""
    whole = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    if not whole:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return both / (whole - both)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents with words, and how many of them have a word of each bucket; 2 ** 16 sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, df, n = WordHashes(), np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if words := words_of(t):
                    h = hashes.of(list(set(words)))
                    df[np.unique((h >> np.uint64(64 - DF_BITS)).astype(np.int64))] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], ["bucket", "n"])

    df = np.zeros(1 << DF_BITS, np.int64)
    n = 0
    for r in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r.bucket < 0:
            n = r.n
        else:
            df[r.bucket] = r.n
    return n, df


def key_of(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def signatures(docs: DataFrame, weights) -> DataFrame:
    """doc_id, hash (of the text), node (digest of the words) and bands of every row; texts without words have no bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, hashes = weights.value, WordHashes()
        for batch in batches:
            nodes, found, wait, size = [], [None] * len(batch), [], 0
            seen: dict[bytes, list[int]] = {}

            def flush():
                if wait:
                    sets = [s for _, s in wait]
                    starts = np.cumsum([0] + [len(s[0]) for s in sets[:-1]])
                    got = bands_of(samples(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), starts))
                    for (node, _), b in zip(wait, got):
                        for i in seen[node]:
                            found[i] = b
                    wait.clear()

            for i, t in enumerate(batch["text"]):
                words = words_of(t)
                node = key_of(words)
                nodes.append(node)
                if not words:
                    continue
                if node in seen:
                    seen[node].append(i)
                    if found[seen[node][0]] is not None:
                        found[i] = found[seen[node][0]]
                    continue
                seen[node] = [i]
                wait.append((node, w.sets(hashes.of(words))))
                size += len(wait[-1][1][0])
                if size >= CHUNK:
                    flush()
                    size = 0
            flush()
            yield pd.DataFrame({"doc_id": batch["doc_id"], "hash": batch["hash"], "node": nodes, "bands": found})

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    return rows.mapInPandas(run, f"doc_id {kind}, hash long, node binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are at least ``threshold`` alike. ``texts``: node, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, hashes = weights.value, WordHashes()
        last, own = None, None
        for batch in batches:
            keep = []
            for b, t, u in zip(batch["b"], batch["text"], batch["text_b"]):
                if b != last:
                    last, own = b, w.sets(hashes.of(words_of(u)))
                keep.append(weighted_jaccard(w.sets(hashes.of(words_of(t))), own) >= threshold)
            yield batch.loc[keep, ["a", "b"]]

    left = pairs.join(texts.withColumnRenamed("node", "a"), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text", "text_b").mapInPandas(run, "a binary, b binary")


def across(members: DataFrame, weights, threshold: float) -> DataFrame:
    """Links between different components of one bucket, found in blocks.

    ``members``: bucket, block (-1: of a smaller component, to be held against block ``against``), node, root, text. Rows of a bucket and block are together, the block's own first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, hashes = weights.value, WordHashes()
        group, block = None, []
        for batch in batches:
            out = []
            for bucket, number, small, node, root, text in batch.itertuples(index=False, name=None):
                if (bucket, number) != group:
                    group, block = (bucket, number), []
                own = w.sets(hashes.of(words_of(text)))
                if not small:
                    block.append((node, root, own))
                    continue
                mine = float(own[1].sum(dtype=np.float64))
                for n, r, other in block:
                    size = float(other[1].sum(dtype=np.float64))
                    if r != root and min(mine, size) >= threshold * max(mine, size) and weighted_jaccard(own, other) >= threshold:
                        out.append((node, n))
            yield pd.DataFrame(out, columns=["a", "b"])

    return members.mapInPandas(run, "a binary, b binary")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id of every row of ``docs`` (doc_id, text).

    class_id is the least doc_id of the class (null if all are null). Case and punctuation don't count. Texts of fewer than five words
    are one shingle of all their words; null, empty and wordless texts are one class. Repeated rows, and rows of one
    doc_id with different texts, each get the class of their text. No rows, no classes. Other columns are ignored.
    """
    return _classes(docs, threshold).select("doc_id", "class_id")


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, hash, class_id, root (which names the class) and wordless (whether the text has no word) of every row."""
    spark = docs.sparkSession
    run = Scratch(spark, "near")
    docs = docs.select("doc_id", "text")
    weights = spark.sparkContext.broadcast(Weights(*document_frequencies(docs)))  # 256 kB
    sig = run.table("signatures", signatures(docs, weights))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash"))  # the row whose text stands for the node
    nodes = run.table("nodes", sig.groupBy("node").agg(F.min("doc_id").alias("least"), one.alias("one"), F.any_value("bands").alias("bands")))
    rows = nodes.where("bands IS NOT NULL").select("node", F.posexplode("bands").alias("band", "value"))
    shared = rows.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = run.table("met", rows.join(shared, ["band", "value"]).select(F.xxhash64("band", "value").alias("bucket"), "node", "n"))
    central = met.groupBy("node").agg(F.sum("n").alias("rank"))
    ranked = met.select("bucket", "node").join(central, "node")
    star = ranked.groupBy("bucket").agg(F.max(F.struct("rank", "node"))["node"].alias("b"))
    pairs = run.table("pairs", met.select("bucket", F.col("node").alias("a")).join(star, "bucket").where("a <> b").select("a", "b").distinct())
    ids = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", F.col("one.doc_id").alias("_d"), F.col("one.hash").alias("_h"))
    # By id and text: rows of a null or repeated id meet the nodes of their own text only.
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h"))).select("node", "text")
    texts = run.table("texts", _of_node(texts).dropDuplicates(["node"]))
    links = run.table("links", verified(pairs, texts, weights, threshold))
    roots = components(links, run, "star")
    # Buckets of three nodes or more that are still in several components.
    named = met.where("n > 2").select("bucket", "node").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    counts = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    open_ = counts.groupBy("bucket").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    rest = run.table("open", named.join(open_, "bucket").join(star, "bucket").where("node <> b").select("bucket", "node", "root", (F.col("root") != F.col("main")).alias("small"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    if rest.limit(1).count():
        own = rest.select("bucket", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("number"), F.lit(False).alias("small"), "node", "root")
        guests = rest.where("small").select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("number"), F.lit(True).alias("small"), "node", "root")
        members = own.union(guests).join(texts, "node").select("bucket", "number", "small", "node", "root", "text")
        members = members.repartition("bucket", "number").sortWithinPartitions("bucket", "number", "small", "node")
        more = run.table("more", across(members, weights, threshold).distinct())
        roots = components(links.union(more), run, "all")
    least = nodes.select("node", "least").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    named = run.table("classes", least.join(least.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("node", "class_id", "root"))
    wordless = F.col("node") == F.lit(bytes(key_of([])))
    return sig.select("doc_id", "hash", "node").join(named, "node").select("doc_id", "hash", "class_id", "root", wordless.alias("wordless"))


def _of_node(rows: DataFrame) -> DataFrame:
    """Keep the rows whose text is the node's; rows of one doc_id may hold several texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[key_of(words_of(t)) == bytes(n) for n, t in zip(batch["node"], batch["text"])]]

    return rows.mapInPandas(run, "node binary, text string")


def clean(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class: that of least doc_id, null last; of repeated rows one. Columns stay.

    Wordless documents are no copies of each other and all stay.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash"))
    found = _classes(docs, threshold)
    empty = found.where("wordless").select(F.col("doc_id").alias("_d"), F.col("hash").alias("_h")).distinct()
    found = found.where("NOT wordless").groupBy("root").agg(first.alias("f")).select(F.col("f.doc_id").alias("_d"), F.col("f.hash").alias("_h"))
    # A row travels as one column, so that none of its own can be taken for one of this operator.
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("doc"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    same = F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h"))
    kept = rows.join(found, same, "left_semi").dropDuplicates(["_id", "_hash"]).unionByName(rows.join(empty, same, "left_semi"))
    return kept.select("doc.*")
