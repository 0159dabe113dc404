"""Packing token sequences: first-fit decreasing in randomised groups of documents.

Documents become token ids and are cut every ``length`` ids. Whole pieces are sequences already and are never shuffled. What is left of each document, less than a sequence, is
dealt to a group by hash of a key that every written row has of its own, so that a group holds about ``group`` rests whatever ids, texts or lengths repeat. Within a group the rests
go by decreasing length to the first bin that still has room; a tournament tree over the bins' room, in which each inner node holds the most room below it, finds that bin in
log(bins) steps. Bins that first-fit leaves with a hole of more than ``slack`` ids, as where all rests are long, are then filled up with ids of the least filled bins, whose pieces are
cut for that. At most one bin of a group stays short; it is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import tokens
from marlstone.scratch import Scratch

LENGTH = 2048
END = 1
GROUP = 1024
SLACK = 8


class Bins:
    """Tournament tree over the room of ``n`` bins of one size."""

    def __init__(self, n: int, size: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.room = [size] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """The first bin with room for ``need``, which is taken from it."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < need:
                i += 1
        found = i - self.leaves
        room[i] -= need
        while i > 1:
            i //= 2
            most = max(room[2 * i], room[2 * i + 1])
            if room[i] == most:
                break
            room[i] = most
        return found


def first_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of places in ``lengths``, which are taken in decreasing order, equal ones by place."""
    tree, out = Bins(len(lengths), size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = tree.first(lengths[i])
        if at == len(out):
            out.append([])
        out[at].append(i)
    return out


def filled(bins: list[list[tuple[int, int, int]]], size: int, slack: int) -> list[list[tuple[int, int, int]]]:
    """Bins of pieces (item, begin, end), after the fuller ones have been filled up from the emptier ones; the last one short is split at powers of two."""
    load = lambda b: sum(e - s for _, s, e in b)
    done = [b for b in bins if size - load(b) <= slack]
    short = sorted((b for b in bins if size - load(b) > slack), key=load, reverse=True)
    lo, hi = 0, len(short) - 1
    while lo < hi:
        hole = size - load(short[lo])
        while hole and lo < hi:
            item, s, e = short[hi].pop()
            take = min(hole, e - s)
            short[lo].append((item, s, s + take))
            hole -= take
            if s + take < e:
                short[hi].append((item, s + take, e))
            if not short[hi]:
                hi -= 1
        lo += hole == 0
    done += short[:lo]
    rest = short[lo] if lo <= hi else []
    left = load(rest)
    while left:
        part, room = [], 1 << (left.bit_length() - 1)
        left -= room
        while room:
            item, s, e = rest.pop(0)
            take = min(room, e - s)
            part.append((item, s, s + take))
            room -= take
            if s + take < e:
                rest.insert(0, (item, s + take, e))
        done.append(part)
    return done


PIECE = "start long, length int, doc_tokens long, ids binary"


def cut(docs: DataFrame, length: int = LENGTH, end: int = END, name: str = tokens.BYTE_BPE, ranks: str | None = tokens.BYTE_RANKS) -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (little-endian unsigned 32-bit) of the pieces of each row of ``docs`` (doc_id, text), cut every ``length`` ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.byte_bpe(name, ranks).ids
        for b in batches:
            for low in range(0, len(b), 512):
                part, rows = b.iloc[low : low + 512], []
                for key, text in enumerate(part["text"]):
                    ids = np.array([*(encode(text) if text else ()), end], "<u4")
                    rows += [(key, s, min(length, len(ids) - s), len(ids), ids[s : s + length].tobytes()) for s in range(0, len(ids), length)]
                at, start, size, n, ids = zip(*rows)
                yield pd.DataFrame({"doc_id": part["doc_id"].iloc[list(at)].to_numpy(), "start": start, "length": size, "doc_tokens": n, "ids": ids})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {PIECE}")


def pack(docs: DataFrame, length: int = LENGTH, end: int = END, group: int = GROUP, slack: int = SLACK, name: str = tokens.BYTE_BPE, ranks: str | None = tokens.BYTE_RANKS) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text): doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A row's tokens are those of its text and ``end``; null and empty texts have ``end`` alone. Repeated rows are packed each; a null id is carried along. A sequence holds ``length`` ids at
    most and its offsets are gapless from 0. Other columns are ignored; an empty table gives an empty one.
    """
    run = Scratch(docs.sparkSession, "packing")
    pieces = run.table("pieces", cut(docs, length, end, name, ranks).withColumn("key", F.monotonically_increasing_id()))
    rests = pieces.where(F.col("length") < length)
    groups = max(1, -(-rests.count() // group))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", ignore_index=True)
        size = rows["length"].tolist()
        bins = filled([[(i, 0, size[i]) for i in b] for b in first_fit(size, length)], length, slack)
        item, begin, stop, seq = np.array([(i, s, e, k) for k, b in enumerate(bins) for i, s, e in b]).T
        span = stop - begin
        upto = np.cumsum(span)
        first = np.append(True, seq[1:] != seq[:-1])
        offset = upto - span
        offset = offset - np.maximum.accumulate(np.where(first, offset, 0))
        ids = rows["ids"].tolist()
        took = rows.iloc[item]
        return pd.DataFrame(
            {"doc_id": took["doc_id"].to_numpy(), "start": took["start"].to_numpy() + begin, "length": span, "ids": [ids[i][4 * s : 4 * e] for i, s, e in zip(item, begin, stop)], "doc_tokens": took["doc_tokens"].to_numpy()}
            | {"sequence_id": (int(rows["group"].iloc[0]) << 21 | seq) * 2 + 1, "offset": offset}
        )

    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    mixed = rests.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("group").applyInPandas(packed, schema)
    whole = pieces.where(F.col("length") == length).select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids", "doc_tokens", (F.col("key") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(mixed)


def report(docs: DataFrame, **options) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack(docs, **options).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
