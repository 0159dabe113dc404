"""Exponentially weighted means over series of any length, cell by cell.

One step of such a mean, s -> a s + b v, is an affine map, and maps compose: whatever a cell of rows does to the mean that it finds is again one map. So each cell is first
read by itself for its map; the maps of a series' cells, a row each, are composed in order, which tells the mean that every cell begins with; then each cell is read again and goes on from
there. Means of means take another round. No task holds more than a few cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.placing import placed
from marlstone.scratch import Scratch

CELL = 8192  # rows


def cells(bars: DataFrame, size: int, halo: int) -> DataFrame:
    """Rows of (series, ts, ...) with their place in the series, dealt to cells of ``size`` rows (``_cell``); the last ``halo`` rows of a cell are copied to the next (``_own`` false). Gaps are counted in rows."""
    if halo > size:
        raise ValueError("a halo may not be larger than a cell")
    at, last = F.floor(F.col("place") / size), F.floor((F.col("n") - 1) / size)
    copied = (F.pmod("place", F.lit(size)) >= size - halo) & (at < last)
    rows = placed(bars, ["series"], ["ts"]).withColumn("_c", F.when(copied, F.array(at, at + 1)).otherwise(F.array(at)))
    return rows.withColumn("_cell", F.explode("_c")).withColumn("_own", F.col("_cell") == at).drop("_c", "n")


def ewm(x: np.ndarray, alpha: float, s: float = np.nan, gap: int = 0) -> np.ndarray:
    """Exponentially weighted mean by recurrence, going on from ``s`` after ``gap`` missing values; without one it starts at the first value. A gap of missing values ages the mean."""
    out, w, keep = np.full(len(x), np.nan), (1 - alpha) ** gap, 1 - alpha
    for i, v in enumerate(x.tolist()):
        if s != s:
            s, w = v, 1.0
        else:
            w *= keep
            if v == v:
                s, w = (w * s + alpha * v) / (w + alpha), 1.0
        out[i] = s
    return out


def summary(x: np.ndarray, alpha: float) -> tuple[int, float, float, float, int]:
    """(lead, value, a, b, gap): missing values before the first, the first value, the map s -> a s + b of all after it, and missing values after the last. Without a value, lead is -1."""
    there = np.flatnonzero(~np.isnan(x))
    if not len(there):
        return -1, np.nan, 1.0, 0.0, len(x)
    w = (1 - alpha) ** np.diff(there)
    share = w / (w + alpha)
    after = np.append(np.cumprod(share[::-1])[::-1][1:], 1.0) if len(share) else share  # what later steps leave of each
    return int(there[0]), float(x[there[0]]), float(np.prod(share)), float(((1 - share) * x[there[1:]] * after).sum()), int(len(x) - 1 - there[-1])


def begins(parts: list[tuple[int, float, float, float, int]], alpha: float) -> list[tuple[float, int]]:
    """(mean, gap) that each cell of a series begins with, from the summaries of those before it."""
    out, s, gap = [], np.nan, 0
    for lead, value, a, b, tail in parts:
        out.append((s, gap))
        if lead < 0:
            gap += tail
            continue
        if s == s:
            w = (1 - alpha) ** (gap + lead + 1)
            value = (w * s + alpha * value) / (w + alpha)
        s, gap = a * value + b, tail
    return out


SUMMARY = "array<struct<lead:int,value:double,a:double,b:double,gap:int>>"


def _rounds(rows: DataFrame, run: Scratch, name: str, alphas: list[float], inputs: Callable[[dict], list[np.ndarray]]) -> DataFrame:
    """(series, _cell, the state that each cell begins with, for each of the inputs)."""
    kind = dict(rows.dtypes)["series"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [[summary(x, a) for x, a in zip(inputs(r), alphas)] for r in b.to_dict("records")]
            yield pd.DataFrame({"series": b["series"], "_cell": b["_cell"], "parts": [[dict(zip(("lead", "value", "a", "b", "gap"), p)) for p in g] for g in got]})

    def compose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_cell")
        found = [begins([tuple(p[i][k] for k in ("lead", "value", "a", "b", "gap")) for p in g["parts"]], a) for i, a in enumerate(alphas)]
        return pd.DataFrame({"series": g["series"], "_cell": g["_cell"], f"{name}_s": [[f[j][0] for f in found] for j in range(len(g))], f"{name}_gap": [[f[j][1] for f in found] for j in range(len(g))]})

    parts = rows.mapInPandas(read, f"series {kind}, _cell long, parts {SUMMARY}")
    made = parts.groupBy("series").applyInPandas(compose, f"series {kind}, _cell long, {name}_s array<double>, {name}_gap array<int>")  # a row for each cell
    return run.table(name, made)


def over_cells(bars: DataFrame, columns: list[str], first: tuple[list[float], Callable[[dict], list[np.ndarray]]], second: tuple[list[float], Callable[[dict, list[np.ndarray]], list[np.ndarray]]], finish: Callable[[dict, list[np.ndarray], list[np.ndarray]], dict[str, np.ndarray]], schema: str, size: int = CELL) -> DataFrame:
    """series, ts and what ``finish`` gives of two layers of means.

    ``first``: weights and the inputs by a cell's ``columns`` as arrays, in which the first value is that of the row before the cell (missing at the start of a series); inputs are
    of the cell's own rows. ``second``: likewise, by the means of the first layer.
    """
    run = Scratch(bars.sparkSession, "recurrences")
    row = F.struct("ts", *[F.col(c).cast("double").alias(c) for c in columns])
    packed = cells(bars.select("series", "ts", *columns), size, 1).groupBy("series", "_cell").agg(F.sort_array(F.collect_list(row)).alias("r"), F.count_if("_own").alias("own"))
    packed = run.table("cells", packed.select("series", "_cell", "own", *[F.col(f"r.{c}").alias(c) for c in ("ts", *columns)]))

    def arrays(r: dict) -> dict:
        n = r["own"]
        for c in columns:
            x = np.array(r[c], float)
            r[c] = x if len(x) > n else np.append(np.nan, x)
        r["ts"] = r["ts"][-n:]
        return r

    def layer(values: list[np.ndarray], alphas: list[float], s: list[float], gap: list[int]) -> list[np.ndarray]:
        return [ewm(x, a, np.nan if m is None else m, int(g)) for x, a, m, g in zip(values, alphas, s, gap)]

    def one(r: dict) -> list[np.ndarray]:
        return first[1](arrays(r))

    def two(r: dict) -> list[np.ndarray]:
        r = arrays(r)
        return second[1](r, layer(first[1](r), first[0], r["one_s"], r["one_gap"]))

    kind = bars.schema["series"].dataType.simpleString()

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                r = arrays(r)
                low = layer(first[1](r), first[0], r["one_s"], r["one_gap"])
                high = layer(second[1](r, low), second[0], r["two_s"], r["two_gap"])
                out = pd.DataFrame({"series": r["series"], "ts": r["ts"], **finish(r, low, high)})
                yield out.replace([np.inf, -np.inf, np.nan], None).astype({k: "Float64" for k in out.columns[2:]})

    with_one = packed.join(_rounds(packed, run, "one", first[0], one), ["series", "_cell"])
    with_two = with_one.join(_rounds(with_one, run, "two", second[0], two), ["series", "_cell"])
    return with_two.mapInPandas(last, f"series {kind}, ts {bars.schema['ts'].dataType.simpleString()}, {schema}")
