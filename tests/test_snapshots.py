"""Snapshots, merges of later events, and recovery of the ledger, against cold replays."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import admission, ledger
from marlstone.operators import projections as P
from tests.test_ledger import BLOCK, REQUEST, SET, STEPS, draft, logged, rows

NAMES = ["lineages", "blocks", "batches", "stamps", "populations", "windowsets", "readouts", "spends", "incumbents", "conditionals", "artifacts", "placebo_history", "tip"]


def many(seed, n=90):
    """A log that starts objects again, supersedes, voids, grants anew, displaces and revokes."""
    r, out = random.Random(seed), []
    pick = lambda k: str(r.randrange(k))

    def add(kind, actor="human:operator", /, **p):
        out.append(draft(f"e{len(out)}", kind, actor, **p))

    for i in range(3):
        add("windowset.register", **{**SET, "windowset_id": f"w{i}"})
    for _ in range(n):
        k = r.randrange(17)
        if k < 2:
            e = {"lineage_id": f"lin::w{pick(3)}", "initial_budget": r.randrange(1, 5), "alarm_remaining": 1, "diagnostic_remaining": 0, "generation": r.randrange(1, 3)}
            add("constants.register", series="look_budget", doc_id=f"d{len(out)}", version=1, entries=[{"key": a, "value": b} for a, b in e.items()])
        elif k < 6:
            add("readout.request", **{**REQUEST, "readout_id": f"r{pick(6)}", "windowset_id": f"w{pick(4)}", "scope_id": f"s{pick(3)}", "purpose": r.choice(["readout", "readout", "rehearsal"])})
        elif k < 8:
            add("readout.void", readout_id=f"r{pick(6)}", evidence={"unmask_artifact_absent": True})
        elif k == 8:
            add("readout.record", "loop:geometry", readout_id=f"r{pick(6)}", result_artifact_ref="a", five_clause={"c1": bool(r.randrange(2))}, placebo_result={"max_z": 3.0, "gate_ref": 2.0, "extended_max": r.choice([2.5, 4.0])}, info_rows_present=True)
        elif k == 9:
            add("block.register", **{**BLOCK, "block_id": f"b{pick(3)}"})
        elif k == 10:
            frozen = r.randrange(2)
            add("block.freeze" if frozen else "block.close", block_id=f"b{pick(3)}", **({"declared_width": r.randrange(9)} if frozen else {}))
        elif k == 11:
            add("trials.open_batch", "loop:geometry", batch_id=f"t{pick(3)}", block_id=f"b{pick(3)}", n_planned=2)
        elif k == 12:
            add("cert.displace", "scheduler:daemon", lineage_id=f"l{pick(2)}", new_incumbent=f"c{pick(4)}", citing_readouts=["r"], five_clause_ref="f")
        elif k == 13:
            add("cert.revoke", lineage_id=f"l{pick(2)}", candidate_id=f"c{pick(4)}", reason="x")
        elif k == 14:
            add("artifact.register", artifact_id=f"a{pick(3)}", role=r.choice(["log", "population"]))
        elif k == 15:
            add("artifact.stamp", artifact_id=f"a{pick(3)}", stamp_kind=r.choice(["counts", "mutation_audit"]), passed=True, detail={"windowset_id": "w1", "population_ref": "p1"})
        else:
            add("conditional.arm", cond_id=f"q{pick(3)}", kind="budget_floor_alarm", predicate={"name": "budget_floor_alarm", "version": "1", "params": {"lineage_id": "x"}}, event_body={"type": "note.record", "payload": {"title": "t", "body": "b"}}) if r.randrange(2) else add("note.record", "scheduler:daemon", title="t", body="b", cites=[f"e{pick(len(out))}"])
    return out


def serial(log, sets):
    """The slots of each lineage by one transition after the other."""
    by = {}
    for e in P.lineage_events(log, sets).orderBy("seq").collect():
        by[e.lineage] = P.lineage_step(by.get(e.lineage, P.NEW_LINEAGE), e.kind, e.asDict())
    return by


def events_of(spark, drafts):
    text = spark.createDataFrame([(i, d["event_id"], "2024-03-05", d["type"], d["actor"], d["cites"], json.dumps(d["payload"])) for i, d in enumerate(drafts)], "seq long, event_id string, ts string, type string, actor string, cites array<string>, payload string")
    return text.withColumn("ts", F.col("ts").cast("timestamp"))


def test_merged_state_is_that_of_a_cold_replay(spark, tmp_path):
    log = events_of(spark, many(2))
    cold = P.State(log)
    want = {n: sorted(map(repr, getattr(cold, n).collect())) for n in NAMES}
    for r in cold.lineages.collect():
        s = serial(log, cold.windowsets)[r.lineage]
        b = s["budget"] or {}
        assert (r.k_cumulative, list(r.months), list(r.one_shot)) == (s["k_cumulative"], sorted(set(s["months"])), sorted(s["one_shot"]))
        assert [r[k] for k in ("generation", "initial", "consumed", "remaining", "alarm", "diagnostic")] == [b.get(k) for k in ("generation", "initial", "consumed", "remaining", "alarm", "diagnostic")], r.lineage
    old = P.State(log.where("seq < 30"))
    for step, (low, high) in enumerate(((30, 60), (60, 999))):
        for n in P.CARRIED:
            getattr(old, n).write.parquet(f"{tmp_path}/{step}/{n}")
        old = P.State(log.where(f"seq >= {low} AND seq < {high}"), lambda n, step=step: spark.read.parquet(f"{tmp_path}/{step}/{n}"))
    for n in NAMES:
        assert sorted(map(repr, getattr(old, n).collect())) == want[n], n


def test_long_lineage_in_many_ranges(spark):
    """A hot lineage of many events against its serial fold."""
    r = random.Random(9)
    kinds = [r.choices(["request", "void", "budget"], [5, 4, 0.01])[0] for _ in range(20_000)]
    kinds[3] = "budget"
    ev = [("hot", i, k, r.randrange(1, 3), 40, 5, 2, "2024-01", f"r{r.randrange(50)}", [f"k{r.randrange(9)}"] if k == "request" else None, k != "budget") for i, k in enumerate(kinds)]
    df = spark.createDataFrame(ev, "lineage string, seq long, kind string, generation long, initial long, alarm_at long, diagnostic_at long, month string, readout_id string, keys array<string>, readout boolean").repartition(7)
    s = P.NEW_LINEAGE
    for e in ev:
        s = P.lineage_step(s, e[2], dict(zip(df.columns, e))) | {"months": []}
    got = P.lineages(P.slots(df), P.shots(df), P.shot_voids(df), P.months(df)).first()
    b = s["budget"]
    assert [got[k] for k in ("generation", "initial", "consumed", "remaining", "alarm", "diagnostic", "k_cumulative")] == [*[b[k] for k in ("generation", "initial", "consumed", "remaining", "alarm", "diagnostic")], s["k_cumulative"]]
    assert list(got.one_shot) == sorted(s["one_shot"])


def test_incumbents_in_many_ranges(spark):
    r = random.Random(4)
    ev = [(f"l{r.randrange(2)}", i, f"c{r.randrange(3)}", r.random() < 0.55) for i in range(400)]
    stacks = {}
    for lin, _, who, push in ev:
        s = stacks.setdefault(lin, [])
        s.append(who) if push else s and s[-1] == who and s.pop()
    df = spark.createDataFrame(ev, "lineage_id string, seq long, who string, push boolean")
    for per in (3, 1000):
        got = {x.lineage_id: (x.incumbent, x.n_before) for x in P.incumbents(df, per).collect()}
        assert got == {k: (s[-1] if s else None, max(0, len(s) - 1)) for k, s in stacks.items()}


def test_crashes_leave_a_ledger_that_appends_on(spark, tmp_path, monkeypatch):
    log = ledger.Ledger(spark, str(tmp_path / "log"))
    note = lambda i: draft(f"n{i}", "note.record", title=f"t{i}", body="b")
    add = lambda i: log.append(rows(spark, [note(i)])).first().accepted
    assert add(0)
    (tmp_path / "log" / "batch-000000000001").mkdir()  # a folder that a crashed writer of another kind left
    assert add(1) and log.head()[0] == 2 and log.folder.names("_abandoned")
    for broken in ("commit", "move"):  # before the batch is written, and before it is renamed
        with monkeypatch.context() as m:
            if broken == "commit":
                m.setattr(log, "commit", lambda *a: 1 / 0)
                error = ZeroDivisionError
            else:
                m.setattr(log.folder, "move", lambda *a: (_ for _ in ()).throw(OSError("killed")))
                error = OSError
            with pytest.raises(error):
                add(2)
        assert log.head()[0] == 2
    assert add(2) and not log.folder.names("_attempts")
    with monkeypatch.context() as m:  # while a snapshot is written
        m.setattr(log.folder, "move", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        m.setattr(P, "CARRIED", ["tip"])
        with pytest.raises(OSError):
            log.snapshot()
    assert log.snapshots() == [] and add(3) and log.snapshot() == 4 and add(4)
    assert log.verify() == {"ok": True, "n_events": 5, "first_bad_seq": None, "torn_tail": False}
    assert log.append(rows(spark, [note(1)])).first().noop  # which only the snapshot has


def test_allowlist_and_velocity_of_the_log(spark, tmp_path):
    seed = [d for d, w in STEPS if w is None]
    seed += [draft("al", "constants.register", series="autonomy_constants", doc_id="ac1", version=1, entries=[{"key": "allowlist:loop", "value": ["block.close"]}, {"key": "allowlist:agent:x/operator", "value": ["scope.mint"]}, {"key": "readout_velocity", "value": 0}])]
    log = logged(spark, str(tmp_path / "log"), seed)
    late = [draft("x1", "note.record", "loop:geometry", title="t", body="b"), draft("x2", "note.record", "agent:x/operator", title="t", body="b"), draft("x3", "note.record", "agent:y/operator", title="t", body="b"), draft("x4", "readout.request", **{**REQUEST, "readout_id": "r7", "scope_id": "s7"})]
    late[3]["ts"] = "2024-07-01T00:00:00Z"
    log.snapshot()
    got = {r.event_id: r.code for r in admission.decide(ledger.enrich(rows(spark, late)), log.state(), {"note.record", "readout.request"}, False).collect()}
    assert got == {"x1": "ACTOR_FORBIDDEN", "x2": "ACTOR_FORBIDDEN", "x3": None, "x4": "VELOCITY_EXCEEDED"}


def test_inbox_in_order_of_names(spark, tmp_path):
    """Files that depend on one another, written in another order than that of their names."""
    import os

    by = {d["event_id"]: d for d, _ in STEPS}
    (tmp_path / "in").mkdir()
    for at, (name, e) in enumerate((("b", "e3"), ("a", "e1"))):
        f = tmp_path / "in" / f"{name}.json"
        f.write_text(json.dumps(by[e]))
        os.utime(f, (1_700_000_000 + at, 1_700_000_000 + at))
    log = ledger.Ledger(spark, str(tmp_path / "log"), every=2)
    log.follow(str(tmp_path / "in"), str(tmp_path / "ck"), str(tmp_path / "ok"), str(tmp_path / "no")).awaitTermination(300)
    assert [r.event_id for r in log.events().orderBy("seq").collect()] == ["e1", "e3"]
    assert len(log.snapshots()) == 1 and log.verify()["ok"]
    live, cold = log.state(), log.state(cold=True)
    names = ("features", "featuresets", "tip")
    assert P.state_hash({n: getattr(live, n) for n in names}) == P.state_hash({n: getattr(cold, n) for n in names})


def test_promotion_over_the_state(spark):
    key = {"key_scheme_version": "1", "matrix_digest": "m", "featureset_hash": "f", "scorer_version": "s", "predicate_version": "1", "cost_model_version": "c"}
    card = lambda i, stage, **m: draft(f"s{i}{stage}", "scorecard.emit", "scheduler:daemon", cycle_id="y1", scorecard={"scorecard_id": f"sc{i}", "eval_key": {**key, "config_key": f"k{i}", "stage": stage}, "metrics": {"stage": stage, **m}, "payload_sha256": "x"})
    rule = [draft("p1", "rules.propose", rule_kind="dial_budget_rule", proposed={"novelty_quota_share": 0.5}), draft("p2", "rules.adopt", proposal_ref="p1", rule_kind="dial_budget_rule", adopted_version="2")]
    cards = [card(i, 1, net_pf_proxy=float(9 - i)) for i in range(5)] + [card(9, 3, sep_z=2.0, gate_ref=0.5), card(8, 3, sep_z=1.5)]
    s = P.State(events_of(spark, [draft("o1", "cycle.open", "scheduler:daemon", cycle_id="y1", score_fn_version="score_v1"), *rule, *cards]))
    hashes = {r.config_key: r.key_hash for r in s.scorecards.collect()}
    ids = spark.createDataFrame([(hashes["k0"], ["1", "2"]), (hashes["k1"], ["1", "3"]), (hashes["k2"], ["1", "2"])], "key string, ids array<string>")
    how = lambda *a: {r.key: (r.score, r.how) for r in ledger.promotion(s, "y1", *a).collect()}
    got = how(1, 2, ids)
    assert {k: got[hashes[k]] for k in ("k0", "k1", "k2", "k3", "k4")} == {"k0": (9.0, "score"), "k1": (8.0, "parked"), "k2": (7.0, "parked"), "k3": (6.0, "novelty"), "k4": (5.0, "parked")}
    assert sorted(how(3, 1).values()) == [(1.5, "parked"), (1.5, "score")]  # equal scores by the key's text: k8 before k9
    assert how(3, 1)[hashes["k8"]][1] == "score" and how(2, 4) == {}
    with pytest.raises(ValueError, match="stage"):
        how(4, 1)
    old = P.State(events_of(spark, [draft("o1", "cycle.open", "scheduler:daemon", cycle_id="y1", score_fn_version="score_v0")]))
    with pytest.raises(ValueError, match="score_v0"):
        ledger.promotion(old, "y1", 1, 1)


def test_constants_file_by_tokens():
    import hashlib

    from marlstone.operators import assignments

    text = "function PC = f()\n PC.a = -3; PC.not_at_a_line_start = 1;\nPC.b = 2e-3;  % why\nPC.v = [1 -2, +3.5];\nPC.w = [1, 2-1];\nPC.open = 4\nPC.t = 'x;y';\nPC.e = PC.a + 1;\n"
    rows = text + "PC.windows = { 'W1', '2020-01-01', '2020-02-01', 'held; backward' ; ... % first\n  'X', '2021-01-01', '2021-02-01' };\nPC.window_exclusions = {'2020-01-05', ...\n '2020-01-06'; 'a', 'b'}; % gap\n"
    doc = assignments.read(rows)
    assert doc["scalars"] == {"a": -3, "b": 0.002, "v": [1.0, -2.0, 3.5], "t": "x;y"}
    assert doc["unparsed"] == ["PC.w = [1, 2-1];", "PC.open = 4", "PC.e = PC.a + 1;"]
    assert [(w["name"], w["role"]) for w in doc["windows"]] == [("W1", "backward_only"), ("X", "middle")]
    assert doc["exclusions"] == [{"range": ["2020-01-05", "2020-01-06"], "rationale": "gap"}, {"range": ["a", "b"], "rationale": "gap"}]
    named = assignments.read("PC.windows.W4.start = '2020-01-01';\nPC.windows.W4.end = '2020-02-01';\nPC.windows.W2.start = '2020-01-01';\nPC.embargo_right_days = 55;\n")
    assert named["windows"] == [{"name": "W4", "start": "2020-01-01", "end": "2020-02-01", "role": "forward_certifier"}] and named["embargo"] == {"left_days": 0, "right_days": 55}
    for bad, why in (("PC.a = 1;\n", "no windows"), ("PC.windows = {'W1', 'soon', '2020-02-01', ''};\n", "no dates")):
        with pytest.raises(ValueError, match=why):
            assignments.read(bad)
    data = rows.encode()
    pin = hashlib.sha256(data).hexdigest()
    assert assignments.read_pinned(data, pin)["precommit_sha256"] == pin
    for p in (None, "", "0" * 64):
        with pytest.raises(ValueError, match="pinned"):
            assignments.read_pinned(data, p)
