"""Permutation gates and verdicts: circular twins, null-of-max, five clauses, robust scaling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.semantics import profit_factor
from marlstone.operators.placing import neighbour, placed, points


CELL = 8192  # places
TASK_ROWS = 100_000  # about, so that a task's rows are sorted in memory


def circular_twins(pop: DataFrame, by: str, order: list[str], shifts: dict[int, int]) -> DataFrame:
    """For every twin (id: shift) the rows with the profit of the row ``shift`` places before, circularly within a group; columns of ``order`` don't come back.

    ``place`` numbers the rows of a group. Groups of two rows or fewer have no twin, nor has a null. A row goes to its cell of consecutive places, and to the next one if a shift reaches
    back to it from there; a group of one cell holds all it needs. Twins are made inside a cell, so the rows of all twins are never dealt.
    """
    back, on = max(0, *shifts.values()), -min(0, *shifts.values())
    size = max(CELL, back, on)
    own = [c for c in pop.columns if c not in (by, *order)]
    pop = pop.where(F.col(by).isNotNull())
    tasks = pop.count() // TASK_ROWS + 2
    rows = placed(pop, [by], order, keep=own, ranges=tasks).where("n > 2")
    n, at = F.col("n"), F.col("place")
    cell, last = F.floor(at / size), F.floor((n - 1) / size)
    to = lambda c, place: F.struct(c.cast("long").alias("cell"), place.alias("at"))
    after = [F.when((cell < last) & (at >= (cell + 1) * size - back), to(cell + 1, at)), F.when((last > 0) & (at - n >= -back), to(F.lit(0), at - n))]
    before = [F.when((cell > 0) & (at < cell * size + on), to(cell - 1, at)), F.when((last > 0) & (at < on), to(last, at + n)), F.when((last > 0) & (at + n < last * size + on), to(last - 1, at + n))]
    spots = F.filter(F.array(to(cell, at), *after, *before), lambda x: x.isNotNull())
    dealt = rows.select(by, "n", *own, F.explode(spots).alias("_s")).select(by, "n", *own, "_s.*")
    others = [c for c in own if c != "profit"]
    schema = T.StructType([pop.schema[by], T.StructField("place", T.LongType()), *[pop.schema[c] for c in others], T.StructField("twin", T.IntegerType()), pop.schema["profit"]])

    def twins(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        n, c = rows["n"][0].as_py(), rows["cell"][0].as_py()
        order = np.argsort(rows["at"].to_numpy())
        places = rows["at"].to_numpy()[order]
        mine = (places >= c * size) & (places < min((c + 1) * size, n))
        place, one = places[mine], order[mine]
        sources = [order[(place - s) % n if n <= size else place - s - places[0]] for s in shifts.values()]
        same = np.tile(one, len(shifts))
        columns = [rows[by].take(same), np.tile(place, len(shifts)), *[rows[k].take(same) for k in others], np.repeat(np.array([*shifts], np.int32), len(place)), rows["profit"].take(np.concatenate(sources))]
        return pa.table(columns, schema.names)

    return dealt.repartition(tasks, by, "cell").groupBy(by, "cell").applyInArrow(twins, schema)


def twin_verdict(real: DataFrame, twins: DataFrame, by: str, at: int = 4) -> DataFrame:
    """How many twins reach the real profit factor; ``at`` or more make the group LEAKY."""
    r = real.groupBy(by).agg(profit_factor(F.col("profit"), least=1e-9).alias("real_pf"))
    t = twins.groupBy(by, "twin").agg(profit_factor(F.col("profit"), least=1e-9).alias("pf"))
    out = t.join(r, by).groupBy(by).agg(F.count(F.lit(1)).alias("n_twins"), F.count_if(F.col("pf") >= F.col("real_pf")).alias("beats"))
    return out.withColumn("verdict", F.when(F.col("beats") >= at, "LEAKY").otherwise("CLEAN"))


def battery(runs: DataFrame, by: str, order: str, at: int = 4) -> DataFrame:
    """(by, verdict, n_run, passes) of twins (by, order, beats) that are run in order until ``at`` of them have passed: then LEAKY, and later ones don't count; else SILENT. Twins of a group are few."""
    upto = F.sum(F.col("beats").cast("int")).over(Window.partitionBy(by).orderBy(order))
    run = runs.withColumn("_k", F.coalesce(upto, F.lit(0))).where((F.col("_k") < at) | ((F.col("_k") == at) & F.col("beats")))
    out = run.groupBy(by).agg(F.count(F.lit(1)).alias("n_run"), F.count_if("beats").alias("passes"))
    return out.select(by, F.when(F.col("passes") >= at, "LEAKY").otherwise("SILENT").alias("verdict"), "n_run", "passes")


def null_of_max(nulls: DataFrame) -> DataFrame:
    """(shuffle, z): the greatest of all configs' standardised null scores; deviation is the sample's, 1e-12 at least. ``nulls``: config, shuffle, x."""
    stats = nulls.groupBy("config").agg(F.avg("x").alias("_m"), F.greatest(F.coalesce(F.stddev_samp("x"), F.lit(0.0)), F.lit(1e-12)).alias("_s"))
    return nulls.join(stats, "config").groupBy("shuffle").agg(F.max((F.col("x") - F.col("_m")) / F.col("_s")).alias("z"))


def gate(maxima: DataFrame, q: float = 0.95) -> DataFrame:
    """The q point of the maxima under both conventions."""
    hazen = points(maxima.select(F.lit(0).alias("_g"), "z"), ["_g"], "z", [q]).select(F.col("q0").alias("gate_hazen"))
    return maxima.agg(F.count(F.lit(1)).alias("n"), F.percentile("z", q).alias("gate_linear")).join(F.broadcast(hazen), how="left")  # one row each


def batch_gate(nulls: DataFrame, q: float = 0.95) -> DataFrame:
    """The gate of a batch of arms: the q point of the place by place greatest of their null scores, null for one arm or none. ``nulls``: arm, null_z (array)."""
    long = nulls.where(F.size("null_z") > 1).select("arm", F.posexplode("null_z").alias("pos", "z"))
    top = long.groupBy("pos").agg(F.max("z").alias("z"), F.count_distinct("arm").alias("k"))
    return top.agg(F.max("k").alias("n_arms"), F.percentile("z", q).alias("_q")).select(F.coalesce("n_arms", F.lit(0)).cast("long").alias("n_arms"), F.when(F.col("n_arms") > 1, F.col("_q")).alias("batch_gate"))


def arm_verdict(own: Column, z: Column, bar: Column) -> Column:
    """An arm can't be certified unless it beats the batch's gate, where there is one."""
    return F.when((own == "CERTIFIED") & bar.isNotNull() & (F.coalesce(z, F.lit(0.0)) <= bar), "CANDIDATE").otherwise(own)


def five_clauses(c: dict[str, Column]) -> list[Column]:
    """Three-valued clauses: size and factor of the carrier's last window; three good windows; factor kept; both halves good; all reseeds good.

    A missing number fails its clause. The third and the fourth are unknown only where ``has_pool`` or ``has_halves`` is false: results that were made before these
    fields were. ``reseeds``: array of (jaccard, selected, pooled); each must keep half of the members, be selected and reach ``s0``; none at all is good.
    """
    sure = lambda x: F.coalesce(x, F.lit(False))
    c1 = sure((c["last_n"] >= 30) & (c["last_pf"] >= 1.3))
    c2 = sure(c["good_windows"] >= 3)
    c3 = F.when(c.get("has_pool", F.lit(True)), sure((c["pooled_pf"] >= 0) & (c["train_pf"] >= 1e-9) & (F.try_divide(c["pooled_pf"], c["train_pf"]) >= 0.70)))
    c4 = F.when(c.get("has_halves", F.lit(True)), sure((c["half1_n"] >= 15) & (c["half2_n"] >= 15) & (c["half1_pf"] >= 1.0) & (c["half2_pf"] >= 1.0)))
    c5 = F.forall(c["reseeds"], lambda r: sure((r["jaccard"] >= 0.50) & r["selected"] & (r["pooled"] >= c["s0"])))
    return [c1, c2, c3, c4, c5]


def verdict(clauses: list[Column]) -> Column:
    """FAILED if any clause is false, else CANDIDATE if any is unknown, else CERTIFIED."""
    all_ = F.array(*clauses)
    return F.when(F.exists(all_, lambda x: ~x), "FAILED").when(F.exists(all_, lambda x: x.isNull()), "CANDIDATE").otherwise("CERTIFIED")


def robust_fit(train: DataFrame, by: list[str], x: str) -> DataFrame:
    """Median, 1 % and 99 % points and quartile range (1 if tiny) of each group, by plotting positions."""
    p = points(train, by, x, [0.5, 0.01, 0.99, 0.75, 0.25])
    iqr = F.col("q3") - F.col("q4")
    return p.select(*by, F.col("q0").alias("med"), F.col("q1").alias("p1"), F.col("q2").alias("p99"), F.when(iqr < 1e-10, 1.0).otherwise(iqr).alias("iqr"))


def robust_apply(rows: DataFrame, fit: DataFrame, by: list[str], x: str) -> DataFrame:
    """Impute the median, clamp to 1 % .. 99 %, centre and scale."""
    v = F.coalesce(F.col(x), F.col("med"))
    return rows.join(fit, by).withColumn("scaled", (F.greatest(F.col("p1"), F.least(F.col("p99"), v)) - F.col("med")) / F.col("iqr"))


def mutation_audit(rows: DataFrame, by: list[str], order: list[str], col: str, keep: Column, score=F.sum, least: float = 1e-9) -> DataFrame:
    """Whether a score notices a planted leak: the score of ``col`` over the kept rows, the same with each value taken from the next row, and whether these
    differ by more than ``least``. ``score`` makes an aggregate of a column."""
    leak = neighbour(placed(rows.select(*by, *order, col, keep.alias("_keep")), by, order), by, col, "_leak").where("_keep")
    s, k = score(F.col(col)), score(F.col("_leak"))
    return leak.groupBy(*by).agg(F.round(s, 2).alias("score"), F.round(k, 2).alias("leaked"), (F.abs(s - k) > least).alias("changed"))


def arms(entries: DataFrame, run: str, key: str, bar: Column, most: int) -> DataFrame:
    """(run, arm): a run's best ``most`` entries (z, ok) that beat the bar and can be selected; where there is none, its best entry of all."""
    good = (F.col("z") > bar) & F.col("ok")
    best = F.struct("z", -F.col(key))
    w = Window.partitionBy(run).orderBy(F.col("z").desc(), key)
    top = entries.where(good).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select(run, F.col(key).alias("arm"))
    alone = entries.groupBy(run).agg(F.max_by(key, best).alias("arm"), F.count_if(good).alias("_n")).where("_n = 0").select(run, "arm")
    return top.unionByName(alone)


def r_multiples(trades: DataFrame, stop: float) -> DataFrame:
    """Adds ``r``: (exit - entry) by side (1 or -1) over ``stop`` times the range at entry ``atr``; the median of finite positive ranges, or 1, stands in for a missing one. Without an exit r is 0."""
    from marlstone.operators.placing import points

    good = F.when((F.col("atr") > 0) & ~F.isnan("atr"), F.col("atr"))
    # The median by plotting positions is the usual one: the middle value, or the mean of the two.
    med = points(trades.select(good.alias("_a")), [], "_a", [0.5]).select(F.col("q0").alias("_med"))
    out = trades.join(F.broadcast(med), how="left")  # one row
    risk = stop * F.coalesce(good, "_med", F.lit(1.0))
    return out.withColumn("r", F.when(F.col("exit").isNull() | (risk <= 0), 0.0).otherwise((F.col("exit") - F.col("entry")) * F.col("side") / risk)).drop("_med")


def on_menu(values: dict[str, tuple[Column, list]], features: Column, catalog: list[str], least: int = 2, most: int = 12) -> Column:
    """Whether every value is on its menu and the features, where there are any, are ``least`` to ``most`` different ones of the catalog."""
    ok = F.lit(True)
    for value, menu in values.values():
        ok = ok & F.coalesce(value.isin(*menu), F.lit(False))
    n = F.size(features)
    known = (n >= least) & (n <= most) & (F.size(F.array_distinct(features)) == n) & (F.size(F.array_except(features, F.array(*map(F.lit, catalog)))) == 0)
    return ok & (features.isNull() | known)


def digest_line() -> Column:
    """What a proposer may read of an event (type, side, reason, verdict, clauses): verdicts and names of failing clauses, no magnitude out of sample."""
    failing = F.array_join(F.sort_array(F.map_keys(F.map_filter("clauses", lambda k, v: ~v))), ", ")
    told = F.format_string("  -> READOUT VERDICT=%s (failing clauses: %s)", "verdict", F.when(failing == "", "none").otherwise(failing))
    return F.when(F.col("type") == "cycle.open", F.concat(F.lit("cycle: "), "side")).when(F.col("type") == "cycle.no_candidate", "  -> KILLED AT GATE (chance-level)").when(F.col("type") == "cycle.parked", F.concat(F.lit("  -> PARKED: "), F.substring("reason", 1, 70))).when(F.col("type") == "readout.failed", "  -> READOUT FAILED (engine error; spend recorded)").when(F.col("type") == "readout.record", told)
