"""Edge cases of conventions, masks, promotion, folds and gates."""

import datetime as dt
import hashlib
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.functions import catalog, scalar
from marlstone.functions.semantics import hazen
from marlstone.operators import eventlog, gates, lookups, masking, predicates, ranking, scoring


def test_profit_factor_rules(spark):
    rows = [("win", 1.0), ("win", 2.0), ("lose", -1.0), ("zero", 0.0), ("both", 3.0), ("both", -2.0), ("none", None)]
    got = {r.g: r for r in scoring.pf_variants(spark.createDataFrame(rows, "g string, profit double"), ["g"]).collect()}
    assert (got["win"].pf_capped, got["win"].pf_open, got["win"].pf_zero) == (10.0, None, 10.0) and got["win"].pf_floored == pytest.approx(3e9)
    assert got["lose"].pf_capped == 0 and got["both"].pf_open == 1.5
    assert (got["zero"].pf_capped, got["zero"].pf_zero, got["none"].pf_capped) == (None, 0.0, None)


def test_windows_end_inclusive_purge_and_exclusions(spark):
    w, ex = [("A", "2020-01-10", "2020-01-20", "x"), ("B", "2020-01-20", "2020-01-31", "y")], [("2020-01-25", "2020-01-25")]
    times = ["2020-01-07 23:59:59", "2020-01-08 00:00:00", "2020-01-10 00:00:00", "2020-01-19 12:00:00", "2020-01-20 23:59:59", "2020-01-25 12:00:00", "2020-01-31 23:59:59", "2020-02-01 00:00:00", "2020-02-04 23:59:59", "2020-02-05 00:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "s string").select(F.to_timestamp_ntz("s").alias("entry_ts"), F.lit("buy").alias("side"))
    got = masking.mask(df, w, ex, left=2, right=4).orderBy("entry_ts").collect()
    assert [r.win_id for r in got] == [0, 0, 1, 1, 2, 0, 2, 0, 0, 0]
    assert [r.train for r in got] == [True] + [False] * 8 + [True]
    assert [(r.win_id, r.n) for r in masking.thin_windows(masking.mask(df, w, ex), 3, 2).orderBy("win_id").collect()] == [(1, 2), (2, 2)]


def test_us_dst(spark):
    times = ["2024-03-09 23:59:59", "2024-03-10 00:00:00", "2024-11-02 23:59:59", "2024-11-03 00:00:00", "2026-03-08 00:00:00", "2026-10-31 12:00:00", "2026-11-01 00:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "s string").select(scalar.us_dst_hours(F.to_timestamp_ntz("s")).alias("h"))
    assert [r.h for r in df.collect()] == [2, 3, 3, 2, 3, 3, 2]


def test_ewm_same_as_pandas():
    rng = np.random.default_rng(0)
    for gap in (0.0, 0.3):
        x = rng.normal(size=200)
        x[rng.random(200) < gap] = np.nan
        x[:2] = np.nan if gap else x[:2]
        assert np.allclose(catalog.ewm(x, 1 / 14), pd.Series(x).ewm(alpha=1 / 14, adjust=False).mean(), equal_nan=True, atol=1e-12)


def test_features_same_as_pandas(spark):
    rng = np.random.default_rng(1)
    n = 260
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    o, h, low = c * np.exp(rng.normal(0, 0.003, n)), c * 1.01, c * 0.99
    b = pd.DataFrame({"series": "s", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "o": o, "h": np.maximum(h, o), "l": np.minimum(low, o), "c": c, "volume": rng.integers(0, 9, n), "quote_volume": rng.random(n), "taker_buy": rng.integers(0, 3, n)})
    got = catalog.catalog(spark.createDataFrame(b).withColumn("ts", F.col("ts").cast("timestamp_ntz"))).orderBy("ts").toPandas()
    s = pd.Series(c)
    lr = np.log(s / s.shift())
    want = {"rv_20": lr.rolling(20).std(), "skew_50": lr.rolling(50).skew(), "kurt_50": lr.rolling(50).kurt(), "tsrank_50": s.rolling(50).rank(pct=True), "autocorr_5": lr.rolling(50).corr(lr.shift(5)), "var_ratio_2": lr.rolling(2).sum().rolling(50).var() / (2 * lr.rolling(50).var()), "ema_dist_20": s / s.ewm(span=20, adjust=False).mean() - 1}
    for k, v in want.items():
        assert np.allclose(got[k].astype(float), v, equal_nan=True, atol=1e-9), k
    assert len(got.columns) == 42 and got["fracdiff_d04"].first_valid_index() == 199 and got["fracdiff_d06"].first_valid_index() == 139


def test_promotion(spark):
    rows = [("a", 5.0, [1, 2]), ("b", 5.0, [9]), ("c", 4.0, [1, 2]), ("d", 1.0, [7]), ("e", 2.0, [2, 8]), ("f", None, []), ("g", 9.0, [])]
    df = spark.createDataFrame(rows, "key string, score double, ids array<int>")
    how = lambda cap, share: {r.key: r.how for r in ranking.promote(df, cap, share).collect()}
    assert how(4, 0.5) == {"g": "score", "a": "score", "d": "novelty", "b": "novelty", "c": "parked", "e": "parked", "f": "parked"}
    assert set(how(0, 0.5).values()) == {"parked"}
    assert how(3, 0.0) == {"g": "score", "a": "score", "b": "score", "c": "parked", "d": "parked", "e": "parked", "f": "parked"}
    few = spark.createDataFrame([("a", 5.0, [1, 2]), ("b", 4.0, [2, 3]), ("c", 3.0, [])], "key string, score double, ids array<int>")
    how = lambda df: {r.key: r.how for r in ranking.promote(df, 2, 0.5).collect()}
    assert how(few) == {"a": "score", "c": "novelty", "b": "parked"}  # no ids, no overlap
    assert how(few.withColumn("ids", F.when(F.col("key") != "c", F.col("ids")))) == {"a": "score", "c": "novelty", "b": "parked"}
    none = few.withColumn("ids", F.lit(None).cast("array<int>"))
    assert how(none) == {"a": "score", "b": "parked", "c": "parked"}  # nobody has ids
    assert ranking.cut_score(ranking.promote(few, 2, 0.5)) == 5.0 and ranking.cut_score(ranking.promote(few, 1, 1.0)) == 5.0
    empty = spark.range(1).select(ranking.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("j"))
    assert empty.first().j == 0.0


def test_spend_order_and_placebo(spark):
    code = lambda *a: spark.range(1).select(eventlog.spend_code(*a).alias("c")).first().c
    t, f, n = F.lit(True), F.lit(False), F.lit(None)
    assert code(F.lit("postmortem"), t, t, F.lit(9), F.lit(1), F.lit(0)) == "OK"
    assert code(F.lit("readout"), t, t, F.lit(9), F.lit(1), F.lit(0)) == "WINDOWS_SPENT"
    assert code(F.lit("readout"), f, t, F.lit(9), F.lit(1), F.lit(0)) == "EMISSION_CAP"
    assert code(F.lit("readout"), f, n.cast("boolean"), F.lit(1), F.lit(1), F.lit(0)) == "VELOCITY_EXCEEDED"
    assert code(F.lit("readout"), f, f, F.lit(0), n.cast("int"), n.cast("int")) == "LOOK_BUDGET_ZERO"
    assert code(F.lit("readout"), f, f, F.lit(0), n.cast("int"), F.lit(1)) == "OK"
    cls = lambda z, shot=False: spark.range(1).select(eventlog.placebo_class(F.lit(z).cast("double"), F.lit(2.0), F.lit(3.0), F.lit(shot)).alias("c")).first().c
    assert [cls(2.0), cls(2.1), cls(3.0), cls(3.1), cls(None), cls(1.0, True)] == ["none", "L1", "L1", "L2", "none", "L2"]


def test_verdicts(spark):
    cols = lambda *v: [F.lit(x).cast("boolean") for x in v]
    got = spark.range(1).select(*[gates.verdict(cols(*v)).alias(str(i)) for i, v in enumerate([(True, True), (True, None), (False, None)])]).first()
    assert tuple(got) == ("CERTIFIED", "CANDIDATE", "FAILED")


def test_hazen_quantiles(spark):
    q = lambda v, p: spark.range(1).select(hazen(F.array(*map(F.lit, v)), p).alias("q")).first().q
    assert q([1.0, 2.0, 3.0, 4.0], 0.25) == 1.5 and q([1.0, 2.0, 3.0, 4.0], 0.5) == 2.5 and q([7.0], 0.95) == 7.0 and q([1.0, 2.0], 0.99) == 2.0


def test_chain_verification(spark):
    drafts = spark.createDataFrame([(i, f"e{i}", "note.record", '{"title": "é", "n": %d}' % i, "[]") for i in range(6)], "_order long, event_id string, type string, payload string, cites string")
    lines = [r.line for r in eventlog.chain(drafts, 0, eventlog.GENESIS, ["event_id", "type", "payload", "cites"]).collect()]
    first = json.loads(lines[0])
    told = first.pop("event_hash")
    plain = json.dumps(first, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    assert first["prev_hash"] == "0" * 64 and told == hashlib.sha256(plain).hexdigest()
    schema = "log string, line_no long, raw string"
    run = lambda r: tuple(eventlog.verify(spark.createDataFrame([("x", i, x) for i, x in enumerate(r)], schema)).select("n", "first_bad_seq", "torn_tail").first())
    assert run(lines) == (6, None, False)
    assert run(lines[:3] + [lines[3].replace('"n":3', '"n":4')] + lines[4:]) == (6, 3, False)
    assert run(lines[:2] + lines[3:]) == (5, 2, False)
    assert run(lines[:5] + [lines[5][:40]]) == (5, None, True)
    assert run(lines[:2] + [lines[2][:40]] + lines[3:])[1:] == (2, False)


def test_digest_does_not_depend_on_order(spark):
    rows = [(1, 2.5, "a", dt.datetime(2024, 1, 1)), (None, None, None, None), (2, -0.0, "é", dt.datetime(2020, 5, 5, 1, 2, 3, 4)), (1, 2.5, "a", dt.datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "i long, d double, s string, t timestamp")
    kinds = {"i": "int64", "d": "float64", "s": "string", "t": "timestamp_us"}
    a = scalar.content_digest(df, kinds, ["i"])
    assert a == scalar.content_digest(df.repartition(5).orderBy(F.rand(3)), kinds, ["i"]) != scalar.content_digest(df.limit(3), kinds, ["i"])
    cell = df.where("i = 2").select(scalar.cell(F.col("i"), "int64").alias("i"), scalar.cell(F.col("s"), "string").alias("s")).first()
    assert bytes(cell.i) == b"\x01\x02" + bytes(7) and bytes(cell.s) == b"\x01\x02\0\0\0\xc3\xa9"


def test_predicates(spark):
    assert predicates.PREDICATES["cert_gate_green"].version == "1"
    with pytest.raises(ValueError):
        predicates.predicate("cert_gate_green", "1")(lambda: F.lit(True))
    full = dict.fromkeys(predicates.CLAUSES, "measured_pass")
    df = spark.createDataFrame([({**full, "persistence": "pre_authorized", "other": "x"},), ({k: v for k, v in full.items() if k != "degradation"},), ({**full, "degradation": "measured_fail"},), (dict.fromkeys(predicates.CLAUSES, "pass"),)], "clauses map<string,string>")
    assert [r[0] for r in df.select(predicates.cert_gate_green()).collect()] == [True, False, False, False]
    stamps = spark.createDataFrame([([("parity", True)], [("counts", True)]), ([("verified", True)], [("verified", True)]), ([("g2", True)], [("alignment", True)]), ([("parity", False)], [("counts", True)]), (None, [("counts", True)])], "g2 array<struct<kind:string,passed:boolean>>, alignment array<struct<kind:string,passed:boolean>>")
    assert [r[0] for r in stamps.select(predicates.g2_and_alignment_green()).collect()] == [True, True, False, False, False]
    mark = lambda c, v=False: (c, v)
    marks = spark.createDataFrame([([mark("L2")] + [mark("none")] * 20, False), ([mark("L1")] * 2 + [mark("none")] * 3, False), ([mark("L1")] * 3, False), ([mark("L1")] * 3 + [mark("none")] * 10, False), ([mark("L1"), mark("L1"), mark("L1", True)], False), ([], True)], "marks array<struct<class:string,voided:boolean>>, flagged boolean")
    assert [r[0] for r in marks.select(predicates.extended_suspend_alarm()).collect()] == [True, False, True, False, False, True]
    e = spark.createDataFrame([([(0.2, 0.0)] * 3 + [(0.0, 1.0)],), ([(0.2, 1.0)] * 3,), ([(0.2, -1.0)] + [(0.2, 1.0)] * 3,)], "epochs array<struct<spearman:double,yield:double>>")
    assert [r[0] for r in e.select(predicates.shadow_qualification()).collect()] == [True, False, False]


def test_nearest_ties_and_bound(spark, monkeypatch):
    t = spark.createDataFrame([(1, 5, [0.0]), (2, 3, [0.0]), (3, 3, [2.0]), (4, 5, [9.0])], "id long, label int, v array<double>")
    got = {r.id: r.label for r in lookups.nearest(t, t, 2).collect()}
    assert got[1] == 3 and got[4] == 3
    monkeypatch.setattr(lookups, "NEIGHBOUR_BYTES", 10)  # several blocks
    assert {r.id: r.label for r in lookups.nearest(t, t, 2).collect()} == got


def test_robust_scaling(spark):
    rows = [("g", float(x)) for x in [1, 2, 3, 4, 100]] + [("h", 1.0), ("h", 1.0)]
    train = spark.createDataFrame(rows, "g string, x double")
    fit = gates.robust_fit(train, ["g"], "x")
    got = {r.x: r.scaled for r in gates.robust_apply(spark.createDataFrame([("g", None), ("g", 1e9)], "g string, x double"), fit, ["g"], "x").collect()}
    assert got[None] == 0.0 and got[1e9] == pytest.approx((100 - 3) / (28.0 - 1.75)) and math.isclose(fit.where("g = 'h'").first().iqr, 1.0)


def test_five_clauses_fail_closed(spark):
    """A missing number fails its clause; only missing fields leave the third and fourth open."""
    ddl = "last_n int, last_pf double, good_windows int, pooled_pf double, train_pf double, half1_n int, half2_n int, half1_pf double, half2_pf double, has_pool boolean, has_halves boolean, reseeds array<struct<jaccard:double,selected:boolean,pooled:double>>, s0 double"
    ok = (30, 1.3, 3, 0.7, 1.0, 15, 15, 1.0, 1.0, True, True, [(0.5, True, 1.0)], 1.0)
    put = lambda **kw: tuple(kw.get(n.split()[0], v) for n, v in zip(ddl.split(", "), ok))
    cases = {"TTTTT": put(), "FTTTT": put(last_pf=None), "TFTTT": put(good_windows=2), "TTFTT": put(train_pf=None), "TT?TT": put(has_pool=False, pooled_pf=None), "TTTFT": put(half1_pf=None), "TTT?T": put(has_halves=False), "TTTTF": put(s0=None)}
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()] + [("TTTTT", *put(reseeds=[], s0=None)), ("TTTTF", *put(reseeds=[(0.4, True, 2.0)])), ("TTTTF", *put(reseeds=[(0.9, None, 2.0)]))], "want string, " + ddl)
    text = F.concat(*[F.when(c, "T").when(~c, "F").otherwise("?") for c in gates.five_clauses({c: F.col(c) for c in df.columns})])
    assert all(r.want == r.got for r in df.select("want", text.alias("got")).collect())


def test_snapshot_digest(spark):
    """Against the definition over one frame: scheme, count, each column's name and bytes in order of ts, range."""
    rng = np.random.default_rng(1)
    n = 500
    pdf = pd.DataFrame({c: (rng.integers(0, 99, n) if k == "<i8" else rng.normal(size=n)) for c, k in scalar.SNAPSHOT.items()})
    pdf["ts"] = pd.date_range("2024-01-01", periods=n, freq="1min")
    h = hashlib.sha256(b"snap_digest_v1" + b"n=500")
    for c, k in scalar.SNAPSHOT.items():
        h.update(c.encode() + pdf[c].to_numpy().astype(k).tobytes())
    h.update(b"2024-01-01 00:00:00|2024-01-01 08:19:00")
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=2)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert scalar.snapshot_digest(df.repartition(5)) == (h.hexdigest(), n, ("2024-01-01 00:00:00", "2024-01-01 08:19:00"))


def test_places_against_windows(spark):
    from pyspark.sql import Window

    from marlstone.operators import placing

    rows = spark.range(2000).select((F.col("id") % 7 * F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 > 0, F.col("id") * 37 % 1999).alias("o"), "id")
    w = Window.partitionBy("g").orderBy("o", "id")
    want = {tuple(r) for r in rows.select("g", "id", (F.row_number().over(w) - 1).alias("place"), F.count(F.lit(1)).over(Window.partitionBy("g")).alias("n")).collect()}
    assert {(r.g, r.id, r.place, r.n) for r in placing.placed(rows, ["g"], ["o", "id"]).collect()} == want
    vals = sorted(r.o for r in rows.where("o IS NOT NULL").collect())
    got = placing.points(rows, [], "o", [0.5, 0.01, 1.0]).first()
    at = len(vals) * 0.01 + 0.5
    assert got.n == len(vals) and got.q2 == vals[-1] and math.isclose(got.q1, vals[int(at) - 1] + (vals[int(at)] - vals[int(at) - 1]) * (at - int(at)))
