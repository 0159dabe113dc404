"""Interval masks: window membership with embargo and exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources.tables import EMBARGO_LEFT, EMBARGO_RIGHT, EXCLUSIONS, WINDOWS


def mask(pop: DataFrame, windows=tuple(WINDOWS), exclusions=tuple(EXCLUSIONS), left: int = EMBARGO_LEFT, right: int = EMBARGO_RIGHT) -> DataFrame:
    """Add ``win_id`` (0: in none; the last of several) and ``train``.

    End days are inclusive. Rows from ``left`` days before a window to ``right`` days after it aren't for training; an
    exclusion takes a row out of its window but doesn't make it a training row. The intervals are a handful
    of constants, so they are folded into one expression and the population is neither joined nor shuffled.
    """
    t = F.col("entry_ts")
    at = lambda d, n=0: F.lit(d).cast("date").cast("timestamp_ntz") + F.expr(f"INTERVAL {n} DAYS")
    win, purged = F.lit(0), F.lit(False)
    for i, (_, start, end, _) in enumerate(windows, 1):
        win = F.when((t >= at(start)) & (t < at(end, 1)), i).otherwise(win)
        purged = purged | ((t >= at(start, -left)) & (t < at(end, 1 + right)))
    for start, end in exclusions:
        win = F.when((t >= at(start)) & (t < at(end, 1)), 0).otherwise(win)
    return pop.withColumns({"win_id": win, "train": ~purged})


def thin_windows(masked: DataFrame, least: int, n_windows: int) -> DataFrame:
    """(side, win_id, n) of the windows with fewer than ``least`` rows of a side; such a mask is refused."""
    grid = masked.select("side").distinct().select("side", F.explode(F.sequence(F.lit(1), F.lit(n_windows))).alias("win_id"))
    counts = masked.where("win_id > 0").groupBy("side", "win_id").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["side", "win_id"], "left").select("side", "win_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def mask_sql() -> str:
    """The same mask for DuckDB, as a range join."""
    rows = ", ".join(f"({i}, DATE '{s}', DATE '{e}')" for i, (_, s, e, _) in enumerate(WINDOWS, 1))
    out = " OR ".join(f"(entry_ts >= DATE '{s}' AND entry_ts < DATE '{e}' + INTERVAL 1 DAY)" for s, e in EXCLUSIONS)
    return f"""win(ord, s, e) AS (VALUES {rows}),
masked AS (SELECT pop.*, CASE WHEN {out} THEN 0 ELSE coalesce((SELECT max(ord) FROM win WHERE entry_ts >= s AND entry_ts < e + INTERVAL 1 DAY), 0) END::INTEGER AS win_id,
 NOT EXISTS (SELECT 1 FROM win WHERE entry_ts >= s - INTERVAL {EMBARGO_LEFT} DAY AND entry_ts < e + INTERVAL {1 + EMBARGO_RIGHT} DAY) AS train FROM pop)"""
