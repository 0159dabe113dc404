"""The log as a whole, on a small one, against plain Python."""

import hashlib
import json

from pyspark.sql import functions as F

from marlstone.operators import cards, converters, eventlog, ledger, payloads
from marlstone.operators import projections as P

HUMAN = {"provenance": "discretionary", "hypothesis": "h", "reasoning": "r", "expected_outcome": "e"}


def draft(event_id, kind, actor="human:operator", /, **payload):
    cites = payload.pop("cites", [])
    return {"event_id": event_id, "type": kind, "actor": actor, "cites": cites, "payload": payload, **(HUMAN if actor.startswith("human") else {"provenance": "scheduled"}), "ts": "2024-03-05T00:00:00Z"}


BLOCK = {"block_id": "b1", "kind": "readout", "family_id": "m1", "featureset_hash": "f1", "arms": [{"arm_id": "a", "role": "real", "budget": 5, "config_keys": ["k2", "k1"], "seeds_declared": [1]}]}
WINDOWS = [{"wiv_id": "v1", "data_contract": "c", "start": "2020", "end": "2021", "role": "middle"}, {"wiv_id": "v2", "data_contract": "c", "start": "2021", "end": "2022", "role": "forward_certifier"}]
SET = {"windowset_id": "w1", "data_contract": "c", "windows": WINDOWS, "embargo": {"left_days": 2, "right_days": 55}, "anchor_field": "entry", "clock": "utc"}
REQUEST = {"readout_id": "r1", "block_id": "b1", "windowset_id": "w1", "scope_id": "s1", "population_ref": "p1", "gate_table_template_ref": "g", "rehearsal_artifact_ref": "x", "counts_stamp_ref": "art_c"}
BUDGET = [{"key": k, "value": v} for k, v in {"lineage_id": "lin::w1", "initial_budget": 3, "alarm_remaining": 2, "diagnostic_remaining": 1}.items()]
STEPS = [
    (draft("e1", "feature.register", feature_id="x1", family="f", definition="d", dtype="f8", lookback_bars=1, causality_class="audited", status="core"), None),
    (draft("e2", "featureset.freeze", featureset_id="f1", columns=["x1", "x9"], definitions_sha256="s", causality_class="audited"), "REF_UNRESOLVED"),
    (draft("e3", "featureset.freeze", featureset_id="f1", columns=["x1"], definitions_sha256="s", causality_class="audited"), None),
    (draft("e4", "block.register", **BLOCK), "REF_UNRESOLVED"),
    (draft("e5", "family.register", family_id="m1", kind="geometry", param_schema="sgl_soft", key_scheme_version="1"), None),
    (draft("e6", "block.register", **BLOCK), None),
    (draft("e7", "trials.open_batch", "loop:geometry", batch_id="t1", block_id="b1", n_planned=2), "ORDER_VIOLATION"),
    (draft("e8", "block.freeze", block_id="b1", declared_width=3), None),
    (draft("e8", "block.freeze", block_id="b1", declared_width=3), "noop"),
    (draft("e9", "trials.open_batch", "loop:geometry", batch_id="t1", block_id="b1", n_planned=2), None),
    (draft("e10", "trials.open_batch", "loop:geometry", batch_id="t2", block_id="b1", n_planned=4), "BUDGET_EXCEEDED"),
    (draft("e11", "windowset.register", **SET), None),
    (draft("e12", "constants.register", series="look_budget", doc_id="lb1", version=1, entries=BUDGET), None),
    (draft("e13", "artifact.register", artifact_id="art_c", role="log"), None),
    (draft("e14", "readout.request", **REQUEST), "NO_COUNTS_STAMP"),
    (draft("e15", "artifact.stamp", artifact_id="art_c", stamp_kind="counts", passed=True, detail={"windowset_id": "w1", "population_ref": "p1"}), None),
    (draft("e16", "conditional.arm", cond_id="c1", kind="budget_floor_alarm", predicate={"name": "budget_floor_alarm", "version": "1", "params": {"lineage_id": "lin::w1"}}, event_body={"type": "note.record", "payload": {"title": "floor", "body": "b"}}), None),
    (draft("e17", "readout.request", **REQUEST), None),
    (draft("e18", "readout.request", **{**REQUEST, "readout_id": "r2"}), "WINDOWS_SPENT"),
    (draft("e19", "readout.request", **{**REQUEST, "readout_id": "r2", "scope_id": "s2"}), "EMISSION_CAP"),
    (draft("e20", "readout.record", "loop:geometry", readout_id="r1", result_artifact_ref="a", five_clause={"c1": True, "c2": {"pass": False, "n": 3}}, placebo_result={"max_z": 3.0, "gate_ref": 2.0, "extended_max": 4.0}, info_rows_present=True), None),
    (draft("e21", "readout.record", "loop:geometry", readout_id="r1", result_artifact_ref="a", five_clause={}, info_rows_present=True), "ORDER_VIOLATION"),
    (draft("e22", "note.record", "agent:x/shadow", title="t", body="b"), "ACTOR_FORBIDDEN"),
    (draft("e23", "note.record", "scheduler:daemon", title="floor", body="b", cites=["e16"]), None),
    (draft("e24", "readout.void", readout_id="r1", evidence={"unmask_artifact_absent": True}), None),
    (draft("e25", "block.kill_axis", axis="m1", rationale="r"), None),
]


def rows(spark, drafts):
    text = spark.createDataFrame([(json.dumps({**d, "payload": d["payload"]}),) for d in drafts], "t string")
    return text.select(F.from_json("t", ledger.DRAFT).alias("d")).select("d.*")


def logged(spark, path, drafts):
    """A ledger of drafts as if they had been accepted."""
    d = rows(spark, drafts).withColumns({"_order": F.element_at(F.create_map(*[F.lit(x) for i, e in enumerate(drafts) for x in (e["event_id"], i)]), F.col("event_id")), "payload": payloads.validate("type", "payload")["payload"], "ts": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), "cites": F.to_json("cites"), "imported": F.lit(False)})
    eventlog.chain(d, 0, eventlog.GENESIS, ledger.ENVELOPE).select("line").write.text(f"{path}/batch-{0:012d}")
    return ledger.Ledger(spark, path)


def test_state_answers_and_replay(spark, tmp_path):
    """The state after all accepted steps, answers from it, the rendered text and a cold replay; and late drafts decided against it."""
    log = logged(spark, str(tmp_path / "log"), [d for d, w in STEPS if w is None])
    n = sum(w is None for _, w in STEPS)
    assert log.verify() == {"ok": True, "n_events": n, "first_bad_seq": None, "torn_tail": False}
    s = log.state()
    lin = s.lineages.first()
    assert (lin.lineage, lin.k_cumulative, list(lin.months), list(lin.one_shot), lin.remaining, lin.consumed, lin.alarm) == ("lin::w1", 1, ["2024-03"], [], 3, 0, True)
    b = s.blocks.first()
    assert (b.frozen, b.closed, b.budget_remaining, b.declared_width) == (True, False, 3, 3)
    assert {r.event_id: r.status for r in log.query("conditionals").collect()} == {"e16": "fired"}
    assert [(r.lineage, r["class"], r.voided) for r in log.query("placebo").collect()] == [("lin::w1", "L1", True)]
    assert {(r.wiv_id, r.spent) for r in log.query("spent").collect()} == {("v1", False), ("v2", True)}
    assert [(r.axis, r.rationale) for r in log.query("failures").collect()] == [("m1", "r")]
    assert log.query("constants").first().doc_id == "lb1" and log.query("budget").first().remaining == 3 and log.query("incumbent").count() == 0
    assert ledger.point(s, "blocks", "b1").count() == 1 and ledger.point(s, "blocks", "zz").count() == 0
    h = ledger.health(s).first()
    assert h.as_of_seq == n - 1 and h.open_cycle is None and h.suspended is False
    card = cards.separation(s).first()
    assert json.loads(card.payload) == {"card_type": "separation", "readout_id": "r1", "clause_passfail": {"c1": True, "c2": False}, "placebo_classification": "L1", "cert_ineligible": True, "coarseness_applied": True}
    assert card.k_stamp == "look 1 of budget" and card.budget_state.remaining == 3 and list(card.provisional_flags) == ["provisional:look_budget"]
    text = [r.text for r in log.render().orderBy("seq").collect()]
    assert text[0].startswith("\n## [0] 2024-03-05T00:00:00+00:00 · feature.register · human:operator\n**Hypothesis:** h\n**Expected:** e\n`causality_class=audited · ")
    assert "cites: e16\n**floor**\nb\n" in text[[d["event_id"] for d, w in STEPS if w is None].index("e23")]
    assert ledger.daily_digest(s, "2024-03-06").startswith("# Daily digest — 2024-03-06\n\n## Budgets\n- lin::w1: k=1 remaining=3 alarm=FIRED diagnostic=off\n")
    names = ("features", "blocks", "lineages", "readouts")
    live = P.state_hash({k: getattr(s, k).repartition(3) for k in names})
    assert ledger.replay_check(log, live, names) == (live, True)
    made = {r.type: r for r in ledger.open_cycle(s, "y1").collect()}
    assert json.loads(made["cycle.open"].payload)["score_fn_version"] == "score_v1"


def test_append_and_fire(spark, tmp_path):
    """Batches against the log before them, an inbox, and a conditional that fires."""
    log = ledger.Ledger(spark, str(tmp_path / "log"))
    assert log.verify() == {"ok": True, "n_events": 0, "first_bad_seq": None, "torn_tail": False}
    few = draft("e12", "constants.register", series="look_budget", doc_id="lb1", version=1, entries=[{**e, "value": 1} if e["key"] == "initial_budget" else e for e in BUDGET])
    by = {d["event_id"]: d for d, _ in STEPS}
    assert {r.event_id: r.code for r in log.append(rows(spark, [few, by["e5"], by["e16"], by["e8"]])).collect()} == {"e12": None, "e5": None, "e16": None, "e8": "REF_UNRESOLVED"}
    (tmp_path / "in").mkdir()
    for i, e in enumerate(("e22", "e5")):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(by[e]))
    log.follow(str(tmp_path / "in"), str(tmp_path / "ck"), str(tmp_path / "ok"), str(tmp_path / "no")).awaitTermination(120)
    assert [(r.event_id, r.noop) for r in spark.read.json(str(tmp_path / "ok")).collect()] == [("e5", True)]
    assert [(r.event_id, r.code) for r in spark.read.json(str(tmp_path / "no")).collect()] == [("e22", "ACTOR_FORBIDDEN")]
    ledger.fire(log, str(tmp_path / "in2"))
    fired = spark.read.schema(ledger.DRAFT).json(str(tmp_path / "in2"))
    assert [(r.type, list(r.cites)) for r in fired.collect()] == [("note.record", ["e16"])]
    assert log.append(fired).first().fired == "e16" and {r.status for r in log.query("conditionals").collect()} == {"fired"}
    assert log.verify() == {"ok": True, "n_events": 4, "first_bad_seq": None, "torn_tail": False}


def test_enrich_and_integrity(spark, tmp_path):
    f = tmp_path / "a.bin"
    f.write_bytes(b"abc")
    files = ledger.file_hashes(spark, str(f))
    sha = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    d = rows(spark, [draft("a1", "artifact.register", artifact_id="x", role="log", path=str(f), declared_sha256="other"), draft("a2", "artifact.register", artifact_id="y", role="log", path=str(f), declared_sha256=sha)])
    log = ledger.Ledger(spark, str(tmp_path / "log"))
    assert {r.event_id: r.code for r in log.append(d, files).collect()} == {"a1": "HASH_MISMATCH", "a2": None}
    f.write_bytes(b"abd")
    p = json.loads(ledger.integrity(log.state(), ledger.file_hashes(spark, str(f)), "d").first().payload)
    assert p["artifact_id"] == "y" and p["ok"] is False


def test_converters(spark):
    result = {"job_hash_echo": "j", "block_id": "b", "candidate_id": "c", "lineage_id": "l", "engine_stamp": {"git": "abc"}, "pc_echo": {"a": 1}, "artifacts": [{"name": "n", "path": "/p", "sha256": "0123456789abcdef"}], "trial_batches": [{"batch_id": "t", "n_rows": 2, "n_distinct_keys": 2, "rows_file": "f", "dataset_ref": "d"}], "five_clause": {"degradation": True, "persistence": False}}
    got = converters.geometry_drafts(spark.createDataFrame([(json.dumps(result),)], "text string")).withColumn("v", payloads.validate("type", "payload")).collect()
    assert sorted((r.type, r.v.error) for r in got) == [("artifact.register", None), ("cert.clause_stamp", None), ("cert.clause_stamp", None), ("trials.record", None)]
    trial = next(json.loads(r.payload) for r in got if r.type == "trials.record")
    assert trial["engine_stamp"] == {"git": "abc"} and trial["pc_echo"] == {"a": 1} and len({r.event_id for r in got}) == 4
    doc = converters.constants_file("PC.a = 1.5;\nPC.b = 'x';\nPC.c = [1, 2];\nPC.d = 2*PC.a;\nPC.embargo_left_d = 2;\nPC.windows = {'W1', '2020-01-01', '2020-02-01', ''; ...\n'W9', '2021-01-01', '2021-02-01', 'the certifier'};\nPC.window_exclusions = {'2020-01-05', '2020-01-06'}; % gap\n")
    assert doc["scalars"] == {"a": 1.5, "b": "x", "c": [1.0, 2.0], "embargo_left_d": 2} and doc["unparsed"] == ["PC.d = 2*PC.a;"] and doc["embargo"] == {"left_days": 2, "right_days": 0}
    assert [w["role"] for w in doc["windows"]] == ["backward_only", "forward_certifier"] and doc["exclusions"] == [{"range": ["2020-01-05", "2020-01-06"], "rationale": "gap"}]
    assert converters.constants_source("d1", [{"key": "a", "value": 1.5}, {"key": "b", "value": True}, {"key": "c", "value": [1, 2]}, {"key": "e", "value": None}]).splitlines()[2:] == ["PC.a = 1.5;", "PC.b = true;", "PC.c = [1 2];", "end"]
    ws = converters.seed_windowset(doc, "w", "c", "utc", spark).withColumn("v", payloads.validate("type", "payload")).first()
    assert ws.v.error is None and json.loads(ws.payload)["windows"][0]["wiv_id"].startswith("wiv_")
    pc = {"windows": {"names": [], "starts": [], "ends": []}, "exclusions": [], "embargo": {}, "min_window_side": 1, "fit": {}, "search_space": {}, "null": {}, "select": {"sel_pf": 1.3, "sel_min_tr": 30, "knn_k": 11}, "budget": {"trials_soft": 200, "seed_soft": 40, "runs_per_k": 5}, "_provenance": {"source_sha256": "s"}}
    j = converters.search_job(pc, {"population_parquet": "p"}, "sell", "z", "r", featureset=["a", "b"])
    assert j["K_values"] == [2, 3, 4, 5, 6, 7, 8, 9] and j["featureset"]["mode"] == "seats" and j["job_hash"] == hashlib.sha256(json.dumps({k: v for k, v in j.items() if k != "job_hash"}, sort_keys=True).encode()).hexdigest()[:12]
    assert converters.readout_job(pc, {"population_parquet": "p"}, {"K": 2}, "t", "r")["select"]["knn_k"] == 11


def test_legacy_pair(spark):
    texts = spark.createDataFrame([("f", "BUY", 0, 3, 4.0), ("f", "BUY", 1, 3, 12.0), ("f", "SELL", 0, 5, 7.0)], "file string, section string, pos long, cluster long, hour double")
    for c in ("ema", "mom", "dv", "iv", "hurst"):
        texts = texts.withColumn(c, F.lit(1.0))
    deals = [("2024-01-02 02:00:00", 1, "buy", "in", 1.0, 10.0, None, None), ("2024-01-02 03:00:00", 2, "sell", "out", 1.0, 11.0, 1.0, "tp"), ("2024-01-02 05:00:00", 3, "sell", "in", 1.0, 9.0, None, None), ("2024-01-02 06:00:00", 4, "buy", "out", 1.0, 8.0, 2.0, ""), ("2024-07-02 09:00:00", 5, "buy", "in", 1.0, 10.0, None, None), ("2024-07-02 10:00:00", 6, "sell", "out", 1.0, 12.0, 3.0, "")]
    df = spark.createDataFrame(deals, "ts string, deal long, side string, direction string, volume double, price double, profit double, comment string").withColumn("ts", F.to_timestamp_ntz("ts"))
    pop = converters.legacy_pair(texts, df, {"buy": [2], "sell": [1]})
    assert sorted((r.trade_id, r.side, r.mt5_deal_in, r.mt5_deal_out, r.profit) for r in pop.collect()) == [("t000000", "buy", 1, 2, 1.0), ("t000001", "buy", 5, 6, 3.0), ("t000002", "sell", 3, 4, 2.0)]
    assert converters.manifest(pop, clock="utc")["n_trades"] == 3
    for bad, why in ((df.where("deal < 6"), "outs"), (df.union(df.where("deal = 1")), "twice|times"), (df.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")), "clock")):
        try:
            converters.legacy_pair(texts, bad).count()
            raise AssertionError(why)
        except ValueError as e:
            assert __import__("re").search(why, str(e))


def test_energy_distance(spark):
    a, b = [1.0, 4.0, 2.5, 2.5], [0.0, 7.0, 3.0]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "population_ref string, x double")
    mean = lambda p, q: sum(abs(x - y) for x in p for y in q) / len(p) / len(q)
    got = cards.energy_distances(df, "x").first()
    assert abs(got.distance - (2 * mean(a, b) - mean(a, a) - mean(b, b))) < 1e-9
