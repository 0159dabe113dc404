"""Exact nearest neighbours of a stated query set among all rows, by pivots and blocks.

Rows go to the nearest of a few pivots and, within a pivot's cell, by their distance to it into blocks of consecutive distances, so a block is known by its cell and the least and greatest distance in it; the directory
of all blocks has ``BLOCKS`` entries and one for each pivot at most. By the triangle inequality a query is at least |its distance to the pivot - that range| away from every row of a block. Each query first looks through the
block that it would be in itself, which bounds its k-th distance; then it goes only to blocks that can hold something nearer. A block meets its queries in one task, chunk by chunk, and gives its k best
for each of them. A cell that holds a third of all rows, or many equal rows, is many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.placing import placed
from marlstone.scratch import Scratch

PIVOTS = 64
BLOCK = 2048  # rows, at least
BLOCKS = 1 << 16  # whatever the input
CHUNK = 512  # queries
DIGITS = 9  # of a squared distance; equal ones go by the least id


class Directory(NamedTuple):
    """Of all blocks: their cell, least and greatest distance to its pivot, and rows."""

    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of two matrices."""
    out = np.empty((len(a), len(b)))
    for j, row in enumerate(b):
        d = a - row
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float, copy=False)


def pivots(rows: DataFrame, count: int) -> np.ndarray:
    """Different vectors of the rows of the least hash; ``count`` at most."""
    near = rows.select("v", F.xxhash64("id", "v").alias("h")).distinct().orderBy("h", "v").limit(count)
    return np.array([r.v for r in near.collect()], float)


def blocked(rows: DataFrame, run: Scratch, count: int, least: int) -> tuple[DataFrame, Directory]:
    """(block, rows: array of id, label, v) and the directory; blocks are numbered from 0."""
    p = pivots(rows, count)
    known = rows.sparkSession.sparkContext.broadcast(p)
    kind = rows.schema["label"].dataType.simpleString()

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = distances(_matrix(b["v"]), known.value)
                at = d.argmin(axis=1)
                yield b.assign(cell=at.astype(np.int32), r=d[np.arange(len(b)), at])

    found = rows.select("id", "label", "v").mapInPandas(nearest, f"id long, label {kind}, v array<double>, cell int, r double")
    found = placed(found, ["cell"], ["r", "id"], run)
    found = run.table("cells", found)
    size = max(least, -(-found.count() // BLOCKS))
    part = F.floor(F.col("place") / size).cast("int")
    told = found.groupBy("cell", part.alias("part")).agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("cell", "part").collect()  # BLOCKS + count at most
    first = dict.fromkeys(range(len(p)), 0)
    for i, t in reversed(list(enumerate(told))):
        first[t.cell] = i
    begin = F.create_map(*[x for c, i in first.items() for x in (F.lit(c), F.lit(i))])[F.col("cell")] if first else F.lit(0)
    # Places are numbered without gaps, so the parts of a cell are too.
    packed = found.groupBy((begin + part).alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "label", "v"))).alias("rows"))
    return run.table("blocks", packed), Directory(p, *[np.array([t[c] for t in told], float if c in ("low", "high") else np.int64) for c in ("cell", "low", "high", "n")])


def _look(blocks: DataFrame, asked: DataFrame, k: int, chunks: int, kind: str) -> DataFrame:
    """(qid, best) for each (block, qid, v) that is asked: the block's k best. A row never meets itself (of equal id)."""
    group = F.pmod(F.xxhash64("qid"), F.lit(chunks))
    packed = asked.groupBy("block", group.alias("chunk")).agg(F.collect_list(F.struct("qid", F.col("v").alias("q"))).alias("queries"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rows, queries in zip(b["rows"], b["queries"]):
                ids = np.array([r["id"] for r in rows], np.int64)
                labels = [r["label"] for r in rows]
                x = np.array([r["v"] for r in rows], float)
                out, own = [], np.array([q["qid"] for q in queries], np.int64)
                v = np.array([q["q"] for q in queries], float)
                xx, vv = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", v, v)
                about = xx[None, :] + vv[:, None] - 2 * (v @ x.T)  # one product; what may be near by it is then measured exactly
                about[own[:, None] == ids[None, :]] = np.inf
                slack = 1e-9 * (1 + vv + xx.max())
                last = np.partition(about, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
                for i, q in enumerate(own):
                    near = np.flatnonzero((about[i] <= last[i] + slack[i]) & (ids != q))
                    diff = x[near] - v[i]
                    d = np.round(np.einsum("ij,ij->i", diff, diff), DIGITS)
                    best = np.lexsort((ids[near], d))[:k]
                    out.append((q, [{"d": float(d[j]), "id": int(ids[near[j]]), "label": labels[near[j]]} for j in best], len(x)))
                yield pd.DataFrame(out, columns=["qid", "best", "compared"])

    return blocks.join(packed, "block").select("rows", "queries").mapInPandas(run, f"qid long, best array<struct<d:double,id:bigint,label:{kind}>>, compared long")


def _best(parts: DataFrame, k: int) -> DataFrame:
    """The k best of each query, of the k best of each block that it went to."""
    return parts.groupBy("qid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"), F.sum("compared").alias("compared"))


def nearest(queries: DataFrame, rows: DataFrame, k: int, count: int = PIVOTS, least: int = BLOCK) -> DataFrame:
    """(id, best, compared) of each query (id, v): its ``k`` nearest rows (id, label, v) as structs (d: squared distance, id, label) in order, and with how many rows it was compared.

    Vectors are arrays of doubles of one length without nulls; ids are unique, and a row of a query's own id isn't its neighbour. Fewer rows than ``k`` give fewer neighbours.
    """
    spark, kind = rows.sparkSession, rows.schema["label"].dataType.simpleString()
    run = Scratch(spark, "neighbours")
    none = queries.select("id", F.array().cast(f"array<struct<d:double,id:bigint,label:{kind}>>").alias("best"), F.lit(0).cast("long").alias("compared"))
    blocks, directory = blocked(rows, run, count, least)
    if not len(directory.cell):
        return none
    known = spark.sparkContext.broadcast(directory)
    asked = queries.select(F.col("id").cast("long").alias("qid"), "v")
    chunks = max(1, -(-asked.count() // CHUNK))

    def gaps(v: np.ndarray) -> np.ndarray:
        """The least distance that each query may have to a row of each block."""
        d = known.value
        at = distances(v, d.pivots)[:, d.cell]
        return np.maximum(0, np.maximum(d.low - at, at - d.high))

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for low in range(0, len(b), CHUNK):
                part = b.iloc[low : low + CHUNK]
                v, d = _matrix(part["v"]), known.value
                own = distances(v, d.pivots).argmin(axis=1)
                gap = np.where(d.cell[None, :] == own[:, None], gaps(v), np.inf)
                yield pd.DataFrame({"qid": part["qid"], "v": part["v"], "block": gap.argmin(axis=1).astype(np.int32)})

    homes = run.table("homes", asked.mapInPandas(home, "qid long, v array<double>, block int"))
    first = run.table("first", _best(_look(blocks, homes, k, chunks, kind), k))
    bound = F.when(F.size("best") == k, F.sqrt(F.element_at("best", -1)["d"] + 10.0**-DIGITS)).otherwise(F.lit(float("inf")))

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for low in range(0, len(b), CHUNK):
                part = b.iloc[low : low + CHUNK].reset_index(drop=True)
                open_ = gaps(_matrix(part["v"])) <= part["bound"].to_numpy(float)[:, None] * (1 + 1e-9)
                open_[np.arange(len(part)), part["block"].to_numpy()] = False
                at, block = np.nonzero(open_)
                yield pd.DataFrame({"qid": part["qid"].to_numpy()[at], "v": part["v"].to_numpy()[at], "block": block.astype(np.int32)})

    rest = homes.join(first.select("qid", bound.alias("bound")), "qid").mapInPandas(further, "qid long, v array<double>, block int")
    whole = _best(first.unionByName(_look(blocks, rest, k, chunks, kind)), k)
    return queries.select("id").join(whole, F.col("id") == F.col("qid")).select("id", "best", "compared")


def vote(best: Column) -> Column:
    """The most frequent label; the least of equally frequent ones."""
    labels = F.transform(best, lambda b: b["label"])
    n = lambda x: F.size(F.filter(labels, lambda y: y == x))
    top = F.array_max(F.transform(F.array_distinct(labels), n))
    return F.array_min(F.filter(F.array_distinct(labels), lambda x: n(x) == top))
