"""Quantiles, deals and keyed streams against plain versions."""

import json
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import scalar
from marlstone.operators import gates, lookups, placing, scoring
from marlstone.operators import projections as P
from marlstone.plans import views
from marlstone.streaming import lineages


def test_quantiles_are_exact(spark):
    r = random.Random(3)
    odd = [0.0, -0.0, 1e300, -1e300, 5e-324, -5e-324, 1.5, None]
    rows = [("a", r.choice(odd)) for _ in range(500)] + [(None, r.gauss(0, 1)) for _ in range(333)] + [("one", 2.5), ("none", None)] + [("hot", 7.0)] * 400
    qs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {x.k: x for x in scoring.quantiles(spark.createDataFrame(rows, "k string, x double").repartition(3), ["k"], "x", qs).collect()}
    for k in ("a", None, "one", "hot"):
        x = sorted(v for g, v in rows if g == k and v is not None)
        assert got[k].n == len(x)
        for i, q in enumerate(qs):
            at = (len(x) - 1) * q
            lo, hi = x[int(at)], x[min(len(x) - 1, int(at) + 1)]
            assert got[k][f"q{i}"] == pytest.approx(lo + (hi - lo) * (at - int(at)), rel=1e-12, abs=1e-300), (k, q)
    assert "none" not in got
    assert scoring.quantiles(spark.createDataFrame([], "k string, x double"), ["k"], "x", [0.5]).count() == 0


def walked(ins, outs):
    free, out = iter(sorted(outs)), []
    for pos, d in sorted(ins):
        out.append((pos, d, next((o for o in free if o > d), None)))
    return out


def test_greedy_deals(spark):
    r = random.Random(8)
    ins = [("hot", i, r.randrange(600)) for i in range(300)] + [("b", 1, 5), ("b", 2, 1), ("c", 0, 3)]
    outs = [("hot", r.randrange(700)) for _ in range(310)] + [("b", 5), ("b", 6), ("b", 2), ("d", 1)]
    a, b = spark.createDataFrame(ins, "side string, pos long, deal long").repartition(3), spark.createDataFrame(outs, "side string, deal long").repartition(2)
    got = sorted(map(tuple, lookups.greedy(a, b, "side", "deal").collect()), key=repr)
    assert got == sorted([(s, *x) for s in ("hot", "b", "c") for x in walked([i[1:] for i in ins if i[0] == s], [o for k, o in outs if k == s])], key=repr)
    with pytest.raises(ValueError, match="ins but"):
        lookups.greedy_pairs(a, b, "side", "deal")
    one, other = a.where("side = 'c'"), spark.createDataFrame([("c", 3)], "side string, deal long")
    with pytest.raises(ValueError, match="no out after deal 3"):
        lookups.greedy_pairs(one, other, "side", "deal")
    assert lookups.greedy_pairs(one, other.withColumn("deal", F.col("deal") + 1), "side", "deal").first().deal_out == 4


def test_stream_of_lineages_goes_on_after_a_crash(spark, tmp_path):
    r, files = random.Random(6), []
    seq = 0
    for f in range(6):
        out = []
        for _ in range(40):
            kind = r.choices(["request", "void", "budget"], [6, 3, 1])[0]
            e = {"lineage": f"l{r.randrange(3)}", "seq": seq, "kind": kind, "readout": kind != "budget"}
            e |= {"generation": r.randrange(1, 3), "initial": 9, "alarm_at": 3, "diagnostic_at": 1} if kind == "budget" else {"readout_id": f"r{r.randrange(8)}"}
            e |= {"month": f"2024-0{r.randrange(1, 4)}", "keys": [f"k{r.randrange(6)}", f"k{r.randrange(6)}"]} if kind == "request" else {}
            out.append(e)
            seq += 1
        files.append(out)
    src = tmp_path / "in"
    src.mkdir()
    seen = {}

    def run(fail_at=None):
        def batch(df, n):
            rows = df.collect()
            if n == fail_at:
                raise RuntimeError("killed")
            seen.update({x.lineage: x for x in rows})

        q = lineages.stream_lineages(lineages.events(spark, str(src), 1)).writeStream.option("checkpointLocation", str(tmp_path / "ck")).outputMode("update").foreachBatch(batch).trigger(availableNow=True).start()
        q.awaitTermination(200)

    provider, shuffles = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:

        def put(names):
            for i in names:
                f = src / f"{i}.json"
                f.write_text("\n".join(map(json.dumps, files[i])))
                os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))

        put(range(3))
        with pytest.raises(Exception, match="killed"):
            run(fail_at=1)
        put(range(3, 6))
        run()
        (src / "again.json").write_text("\n".join(map(json.dumps, files[2])))  # comes twice
        run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider) if provider else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    df = spark.read.schema(lineages.EVENT).json([str(src / f"{i}.json") for i in range(6)])
    want = P.lineages(P.slots(df), P.shots(df), P.shot_voids(df), P.months(df)).collect()
    assert len(want) == len(seen) == 3
    for w in want:
        g = seen[w.lineage]
        assert {k: g[k] for k in w.asDict()} == w.asDict()


def test_spearman_of_rows_that_change_when_computed_again(spark):
    """Sums of doubles differ in their last digits from one computation to the next; each row has its ranks all the same."""
    noise = F.udf(lambda x: x + os.urandom(1)[0] * 1e-6, "double").asNondeterministic()
    rows = spark.range(60).select(noise(F.col("id").cast("double")).alias("x"), noise((F.col("id") * 7 % 60).cast("double")).alias("y"))
    got = scoring.spearman(rows, "x", "y").first()
    want = np.corrcoef(np.arange(60), np.arange(60) * 7 % 60)[0, 1]
    assert got.n == 60 and abs(got.spearman - want) < 1e-9


def test_rows_of_a_tiny_file_stay_where_they_are(spark, monkeypatch):
    """A column of few values is a small file of many rows; what comes before a range is sent to the rows, never the rows."""
    rows = spark.range(300_000).select((F.col("id") % 3).cast("double").alias("x"))
    plan = placing.placed(rows, [], ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan
    got = placing.points(rows.union(spark.range(2).select(F.lit(None).cast("double"))), [], "x", [0.5, 1.0]).first()
    assert (got.n, got.q0, got.q1) == (300_000, 1.0, 2.0)
    monkeypatch.setattr(placing, "AHEAD_ROWS", 0)
    many = placing.placed(spark.range(500).select((F.col("id") % 9).alias("g"), "id"), ["g"], ["id"])
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()
    assert {(r.g, r.id, r.place, r.n) for r in many.collect()} == {(i % 9, i, i // 9, 56 if i % 9 < 5 else 55) for i in range(500)}


def test_asof_of_a_long_cell(spark):
    """A cell of many rows takes one pass (read forwards, each row would look at all that follow it: minutes here); of right rows of one time it is the least."""
    t = spark.range(600_000).select("id", F.timestamp_seconds(F.floor(F.col("id") / 60)).alias("ts"), F.lit("a").alias("k"))
    left, right = t.where("id % 3 = 0"), t.where("id % 3 <> 0 AND id < 480000").select(F.col("id").alias("rid"), F.col("ts").alias("rts"), "k")
    began = time.monotonic()
    got = lookups.asof_forward(left, "ts", right, "rts", "k").select("id", F.col("hit.rid").alias("rid"))
    wrong = got.where(~F.col("rid").eqNullSafe(F.when(F.col("id") < 480_000, F.floor(F.col("id") / 60) * 60 + 1)))
    assert got.count() == 200_000 and wrong.count() == 0 and time.monotonic() - began < 60


def test_circular_twins_by_cells(spark, monkeypatch):
    """Shifts either way and longer than a group, in groups of one cell and of many, against lists; rows of all twins are never dealt."""
    monkeypatch.setattr(gates, "CELL", 16)
    r, shifts = random.Random(4), {1: 1, 2: 15, 3: -7, 4: 0, 5: 16}
    groups = {"a": 3, "b": 2, "c": 16, "d": 17, "e": 32, "f": 33, "g": 150, None: 5}
    rows = [(g, i, r.choice([None, r.random()]), i % 3 == 0) for g, n in groups.items() for i in range(n)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "g string, o int, profit double, train boolean")
    twins = gates.circular_twins(df, "g", ["o"], shifts)
    plan = twins._jdf.queryExecution().executedPlan().toString()
    profits = {(g, o): p for g, o, p, _ in rows}
    want = {(g, t, i, i % 3 == 0, profits[g, (i - s) % n]) for g, n in groups.items() if g and n > 2 for i in range(n) for t, s in shifts.items()}
    got = [(x.g, x.twin, x.place, x.train, x.profit) for x in twins.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "SortMergeJoin" not in plan and plan.count("Exchange hash") == 1 and plan.index("FlatMapGroupsInArrow") < plan.index("Exchange hash")


def test_twin_battery_deals_rows_once(spark, sf):
    """No join or shuffle meets the rows of all twins: they come out of the cells and go into sums."""
    plan = views.twin_battery(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    above = [line for line in plan[: plan.index("FlatMapGroupsInArrow")].splitlines() if "twin" in line]
    assert above and not any("Join" in line for line in above)


def test_twins_of_many_rows_are_sorted_in_parts(spark, monkeypatch):
    """Tasks grow with the rows, and small ones aren't put together, so that no task's sort goes to disk."""
    monkeypatch.setattr(gates, "TASK_ROWS", 100)
    rows = spark.range(5000).select((F.col("id") % 2).cast("string").alias("g"), "id", F.col("id").cast("double").alias("profit"))
    twins = gates.circular_twins(rows, "g", ["id"], {1: 3})
    plan = twins._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g" in plan and ", 52), REPARTITION_BY_NUM" in plan
    placed = gates.placed(rows, ["g"], ["id"], ranges=52)
    assert len(placed.inputFiles()) > 40
    assert {(r.g, r.place, r.profit) for r in twins.collect()} == {(str(i % 2), i // 2, float((i // 2 - 3) % 2500 * 2 + i % 2)) for i in range(5000)}


def test_packed_keys(spark):
    """Equal and ordered as the keys are, whatever their lengths, and shorter."""
    r = random.Random(13)
    part = lambda: r.choice(["null", f"{r.randrange(-(10**6), 10**6):012d}", f"{r.choice([0, 1, 9, 10**12, 10**14 + 7]):012d}"])
    keys = ["", "0", "00", "-", *("-".join(part() for _ in range(r.randrange(1, 5))) for _ in range(400))]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", scalar.packed_key(F.col("k")).alias("p")).collect()
    packed = {x.k: bytes(x.p) for x in got}
    assert sorted(packed, key=packed.get) == sorted(set(keys)) and len(set(packed.values())) == len(packed)
    assert all(len(p) <= (len(k) + 1) // 2 for k, p in packed.items())


def test_nearest_of_many_rows_and_copies(spark, monkeypatch):
    """Against all distances, in several blocks, with copies and ties; arrays that are measured pair by pair in the driver's language would take minutes."""
    monkeypatch.setattr(lookups, "NEIGHBOUR_BYTES", 100_000)
    rng = np.random.default_rng(9)
    v = np.round(rng.normal(size=(6000, 32)), 1)
    v[1000:2500], v[2500:2600] = v[0], v[3]
    label = rng.integers(0, 4, 6000)
    t = spark.createDataFrame([(i, int(label[i]), v[i].tolist()) for i in range(6000)], "id long, label int, v array<double>")
    began = time.monotonic()
    got = {r.id: r.label for r in lookups.nearest(t, t.where("id % 2 = 0"), 11).collect()}
    assert time.monotonic() - began < 60 and len(got) == 6000
    for i in [*range(0, 6000, 61), 1, 3, 1500, 2550]:
        d = np.round(((v[::2] - v[i]) ** 2).sum(axis=1), 9)
        n = np.bincount(label[::2][np.lexsort((np.arange(3000), d))[:11]])
        assert got[i] == n.argmax(), i
