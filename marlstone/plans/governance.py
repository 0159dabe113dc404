"""Queries of admission: drafts made of events, decided against a state made of parts, by each handler and by the whole chain of rules.

A draft's references are numbers dealt by event_id; an object is there if the part of that number meets a condition. So each rule has drafts that break it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import admission, payloads
from marlstone.operators import projections as P
from marlstone.plans.registry import query
from marlstone.sources import tables

E = "WITH e AS (SELECT event_id, value AS v, ts, (event_id * 7) % 97 AS r, (event_id * 5) % 89 AS q FROM events), p AS (SELECT p_partkey AS k, p_size AS s FROM part), x AS (SELECT e.*, a.s AS s, b.s AS t FROM e LEFT JOIN p a ON a.k = r LEFT JOIN p b ON b.k = q) "
CODE = E + "SELECT event_id, CASE {} ELSE 'ACCEPTED' END AS code FROM x"


def _name(prefix: str, c: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "events")
    return e.select("event_id", F.col("value").alias("v"), "ts", ((F.col("event_id") * 7) % 97).alias("r"), ((F.col("event_id") * 5) % 89).alias("q"))


def _objects(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))


def _doc(**fields) -> Column:
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def _codes(rows: DataFrame, kind: str, payload: Column, actor: str | Column = "human:operator", **given: DataFrame) -> DataFrame:
    """The handler's code for each row's draft."""
    d = rows.select(F.col("event_id").cast("string").alias("event_id"), F.lit(kind).alias("type"), (F.lit(actor) if isinstance(actor, str) else actor).alias("actor"), F.lit(False).alias("imported"), "ts", payload.alias("_p"))
    d = d.withColumn("_v", payloads.validate("type", "_p")).select("event_id", "type", "actor", "imported", "ts", F.coalesce("_v.payload", F.raise_error(F.concat(F.lit("invalid draft: "), "_v.error"))).alias("payload"))
    out = admission.HANDLERS[kind](d, P.State(**given)).select(F.col("event_id").cast("long").alias("_e"), "code")
    return rows.select("event_id").join(out, F.col("event_id") == F.col("_e"), "left").select("event_id", F.coalesce("code", F.lit("ACCEPTED")).alias("code"))


@query(CODE.format("WHEN s > 25 AND r % 3 <> event_id % 3 THEN 'FROZEN_MUTATION' WHEN event_id % 5 = 0 THEN 'HASH_MISMATCH'"))
def admission_dataset_register(spark, d):
    r = _rows(spark, d)
    sha = _name("h", F.col("event_id") % 3)
    doc = _doc(snapshot_id=_name("s", "r"), source_kind="mt3_csv", raw_sha256=sha, computed_raw_sha256=F.when(F.col("event_id") % 5 == 0, "other").otherwise(sha), n_rows=1, ts_range=F.array(F.lit("a"), F.lit("b")), path="p")
    return _codes(r, "dataset.register", doc, snapshots=_objects(spark, d).where("s > 25").select(_name("s", "k").alias("snapshot_id"), _name("h", F.col("k") % 3).alias("raw_sha256")))


@query(CODE.format("WHEN s > 40 THEN 'FROZEN_MUTATION' WHEN coalesce(s, 0) <= 20 OR coalesce(t, 0) <= 20 THEN 'REF_UNRESOLVED'"))
def admission_featureset_freeze(spark, d):
    o = _objects(spark, d)
    doc = _doc(featureset_id=_name("f", "r"), columns=F.array(_name("c", "r"), _name("c", "q")), definitions_sha256="x", causality_class="audited")
    return _codes(_rows(spark, d), "featureset.freeze", doc, featuresets=o.where("s > 40").select(_name("f", "k").alias("featureset_id")), features=o.where("s > 20").select(_name("c", "k").alias("feature_id")))


@query(CODE.format("""WHEN coalesce(s, 0) <= 10 OR coalesce(t, 0) <= 5 THEN 'REF_UNRESOLVED' WHEN s > 45 THEN 'QUOTABLE_ONLY_INPUT' WHEN event_id % 4 = 0 AND s <= 30 AND s % 2 = 1 THEN 'PREDICATE_RED' WHEN event_id % 11 = 0 THEN 'BUDGET_EXCEEDED' WHEN t > 44 THEN 'KILLED_AXIS'"""))
def admission_block_register(spark, d):
    o = _objects(spark, d)
    arm = lambda name, budget: F.struct(F.lit(name).alias("arm_id"), F.lit("real").alias("role"), budget.cast("long").alias("budget"))
    doc = _doc(block_id=_name("b", "event_id"), kind="rescore", family_id=_name("m", "q"), featureset_hash=_name("f", "r"), population_ref=_name("p", "r"), arms=F.array(arm("a", F.lit(2)), arm("z", F.when(F.col("event_id") % 11 == 0, 0).otherwise(3))), gates_required=F.when(F.col("event_id") % 4 == 0, F.array(F.lit("mutation_audit"))).otherwise(F.array().cast("array<string>")))
    pops = o.select(_name("p", "k").alias("artifact_id"), F.when(F.col("s") > 45, "quotable_only").otherwise("usable").alias("status"), F.when(F.col("s") % 2 == 0, "legacy_attested").otherwise("audited").alias("causality_class"), (F.col("s") > 30).alias("mutation_audit_pass"))
    return _codes(_rows(spark, d), "block.register", doc, featuresets=o.where("s > 10").select(_name("f", "k").alias("featureset_id")), families=o.where("s > 5").select(_name("m", "k").alias("family_id")), populations=pops, kill_list=o.where("s > 44").select(_name("m", "k").alias("axis")))


def _blocks(o: DataFrame) -> DataFrame:
    seeds = F.when(F.col("s") % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(1).cast("bigint")))
    arms = F.array(F.struct(F.lit("a").alias("arm_id"), F.lit("real").alias("role"), F.array().cast("array<string>").alias("config_keys"), F.lit(1).cast("long").alias("budget"), seeds.alias("seeds_declared")))
    return o.where("s > 5").select(_name("b", "k").alias("block_id"), (F.col("s") > 15).alias("frozen"), arms.alias("arms"), F.when(F.col("s") % 3 > 0, _name("n", F.col("s") % 3)).alias("frozen_null"), F.when(F.col("s") % 2 == 0, F.col("s").cast("long")).alias("budget_remaining"))


@query(CODE.format("WHEN coalesce(s, 0) <= 5 THEN 'REF_UNRESOLVED' WHEN s > 15 THEN 'FROZEN_MUTATION' WHEN s > 10 THEN 'RESULT_BEFORE_FREEZE'"))
def admission_block_freeze(spark, d):
    o = _objects(spark, d)
    return _codes(_rows(spark, d), "block.freeze", _doc(block_id=_name("b", "r"), declared_width=3), blocks=_blocks(o), readouts=o.where("s > 10").select(_name("b", "k").alias("block_id")))


@query(CODE.format("WHEN coalesce(s, 0) <= 5 THEN 'REF_UNRESOLVED' WHEN s <= 15 THEN 'ORDER_VIOLATION' WHEN s % 2 = 0 AND event_id % 60 > s THEN 'BUDGET_EXCEEDED'"))
def admission_trials_open_batch(spark, d):
    return _codes(_rows(spark, d), "trials.open_batch", _doc(batch_id="t", block_id=_name("b", "r"), n_planned=F.col("event_id") % 60), blocks=_blocks(_objects(spark, d)))


@query(CODE.format("""WHEN coalesce(t, 0) <= 15 OR t > 40 THEN 'ORDER_VIOLATION' WHEN event_id % 6 = 0 THEN 'DUPLICATE_KEY' WHEN s > 5 AND s % 3 > 0 AND event_id % 3 > 0 AND s % 3 <> event_id % 3 THEN 'CRN_MISMATCH'
 WHEN event_id % 7 < 4 THEN 'GIT_DIRTY' WHEN event_id % 8 = 1 THEN 'PC_ECHO_MISMATCH'"""))
def admission_trials_record(spark, d):
    from marlstone.functions.scalar import canonical_sha256

    o = _objects(spark, d)
    e = F.col("event_id")
    git = F.when(e % 7 == 0, "").when(e % 7 == 1, "nogit").when(e % 7 == 2, "dirty").when(e % 7 == 3, "abc-dirty").otherwise("abc")
    doc = _doc(batch_id=_name("t", "q"), block_id=_name("b", "r"), n_rows=5, n_distinct_keys=F.when(e % 6 == 0, 4).otherwise(5), rows_file="f", dataset_ref="x", engine_stamp=F.struct(git.alias("git")), null_spec_hash=F.when(e % 3 > 0, _name("n", e % 3)), pc_echo=F.struct(F.when(e % 8 == 1, 2).otherwise(1).alias("a")))
    batches = o.where("s > 15").select(_name("t", "k").alias("batch_id"), (F.col("s") > 40).alias("closed"))
    pc = spark.range(1).select(F.lit("pc").alias("series"), canonical_sha256(F.lit('{"a":1}')).alias("expected"))
    return _codes(_rows(spark, d), "trials.record", doc, batches=batches, blocks=_blocks(o), pc_echo=pc)


@query(CODE.format("WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'ACTOR_FORBIDDEN' WHEN event_id % 5 = 0 THEN 'HASH_MISMATCH'"))
def admission_artifact_register(spark, d):
    e = F.col("event_id")
    doc = _doc(artifact_id="a", role=F.when(e % 2 == 0, "log").otherwise("session_capture"), declared_sha256="x", computed_sha256=F.when(e % 5 == 0, "y").when(e % 7 == 0, "x"))
    return _codes(_rows(spark, d), "artifact.register", doc, F.when(e % 3 == 0, "scheduler:daemon").otherwise("loop:geometry"))


def _sets(o: DataFrame) -> DataFrame:
    role = lambda name: F.lit(name).alias("role")
    window = lambda i, r: F.struct(F.concat(F.lit(f"v{i}_"), F.col("k").cast("string")).alias("wiv_id"), F.lit("c").alias("data_contract"), F.lit("a").alias("start"), F.lit("b").alias("end"), role(r))
    return o.where("s > 8").select(_name("w", "k").alias("windowset_id"), _name("l", F.col("k") % 10).alias("lineage_id"), F.array(window(1, "middle"), window(2, "forward_certifier")).alias("windows"))


@query(CODE.format("WHEN coalesce(s, 0) <= 8 THEN 'REF_UNRESOLVED' WHEN s > 30 AND event_id % 2 = 0 THEN 'CARRYOVER_MISSING'"))
def admission_windowset_supersede(spark, d):
    o = _objects(spark, d)
    carry = F.when(F.col("event_id") % 2 == 0, F.array(F.struct(_name("v1_", "r").alias("wiv_id")))).otherwise(F.array(F.struct(_name("v2_", "r").alias("wiv_id"))))
    new = F.struct(F.lit("n").alias("windowset_id"), F.lit("c").alias("data_contract"), F.array().cast("array<struct<wiv_id:string>>").alias("windows"), F.struct(F.lit(1).alias("left_days"), F.lit(2).alias("right_days")).alias("embargo"), F.lit("entry").alias("anchor_field"), F.lit("utc").alias("clock"))
    doc = _doc(old_windowset_id=_name("w", "r"), new_windowset_id="n", new_windowset=new, carryover=carry, rationale="x")
    return _codes(_rows(spark, d), "windowset.supersede", doc, windowsets=_sets(o), spends=o.where("s > 30").select(_name("v2_", "k").alias("wiv_id")))


@query(CODE.format("WHEN coalesce(s, 0) <= 8 THEN 'REF_UNRESOLVED'"))
def admission_scope_mint(spark, d):
    return _codes(_rows(spark, d), "scope.mint", _doc(scope_id="c", windowset_id=_name("w", "r"), purpose="x"), windowsets=_sets(_objects(spark, d)))


@query(E + """, l AS (SELECT x.*, CASE WHEN t > 8 THEN q % 10 END AS lin FROM x), o AS (SELECT l.*, event_id % 9 AS z, CASE WHEN lin <= 5 THEN lin * 2 END AS remaining FROM l)
SELECT event_id, CASE WHEN coalesce(s, 0) <= 5 THEN 'REF_UNRESOLVED' WHEN s <= 15 THEN 'ORDER_VIOLATION' WHEN z = 0 AND (lin IS NULL OR lin NOT IN (3, 4)) THEN 'POSTMORTEM_BEFORE_SPEND' WHEN z > 1 AND event_id % 13 = 0 THEN 'NO_REHEARSAL' WHEN z > 1 AND s % 7 = 0 THEN 'SEEDS_UNDECLARED'
 WHEN z > 1 AND event_id % 17 = 0 THEN 'NO_COUNTS_STAMP' WHEN z > 1 AND lin = 3 AND q = 13 AND event_id % 2 = 0 THEN 'WINDOWS_SPENT' WHEN z > 1 AND lin = 4 AND strftime(ts, '%Y-%m') = (SELECT max(strftime(ts, '%Y-%m')) FROM events) THEN 'EMISSION_CAP' WHEN z > 1 AND coalesce(remaining, 0) <= 0 THEN 'LOOK_BUDGET_ZERO' ELSE 'ACCEPTED' END AS code FROM o""")
def admission_readout_request(spark, d):
    o, rows = _objects(spark, d), _rows(spark, d)
    e = F.col("event_id")
    purpose = F.when(e % 9 == 0, "postmortem").when(e % 9 == 1, "rehearsal").otherwise("readout")
    stamped = F.when(e % 17 == 0, "none").otherwise("stamp")
    doc = _doc(readout_id=_name("r", "event_id"), block_id=_name("b", "r"), windowset_id=_name("w", "q"), scope_id=_name("c", e % 2), population_ref="pop", purpose=purpose, gate_table_template_ref="g", rehearsal_artifact_ref=F.when(e % 13 > 0, "a"), counts_stamp_ref=stamped)
    stamps = spark.range(97).select(F.lit("stamp").alias("artifact_id"), F.lit("counts").alias("stamp_kind"), F.lit(True).alias("passed"), _name("w", "id").alias("windowset_id"), F.lit("pop").alias("population_ref"))
    last = tables.table(spark, d, "events").groupBy().agg(F.max(F.date_format("ts", "yyyy-MM")).alias("_m"))
    none = F.array().cast("array<string>")
    lin = spark.range(10).join(F.broadcast(last), how="left")  # one row
    lin = lin.select(_name("l", "id").alias("lineage"), F.when(F.col("id").isin(3, 4), F.array(F.lit("v2_13::c0"))).otherwise(none).alias("one_shot"), F.when(F.col("id") == 4, F.array("_m")).otherwise(none).alias("months"), F.when(F.col("id") <= 5, F.col("id") * 2).alias("remaining"))
    return _codes(rows, "readout.request", doc, blocks=_blocks(o), windowsets=_sets(o), stamps=stamps, lineages=lin)


@query(CODE.format("WHEN coalesce(s, 0) <= 5 OR s > 35 THEN 'ORDER_VIOLATION' WHEN event_id % 4 = 0 THEN 'PREDICATE_RED'"))
def admission_readout_record(spark, d):
    doc = _doc(readout_id=_name("r", "r"), result_artifact_ref="a", five_clause=F.struct(F.lit(True).alias("c1")), info_rows_present=F.col("event_id") % 4 > 0)
    return _codes(_rows(spark, d), "readout.record", doc, readouts=_objects(spark, d).where("s > 5").select(_name("r", "k").alias("readout_id"), (F.col("s") > 35).alias("recorded")))


@query(CODE.format("WHEN coalesce(s, 0) <= 5 THEN 'REF_UNRESOLVED' WHEN s > 35 THEN 'ORDER_VIOLATION' WHEN event_id % 4 <> 1 THEN 'PREDICATE_RED'"))
def admission_readout_void(spark, d):
    doc = _doc(readout_id=_name("r", "r"), evidence=F.struct(F.when(F.col("event_id") % 4 == 1, True).when(F.col("event_id") % 4 == 2, False).alias("unmask_artifact_absent")))
    return _codes(_rows(spark, d), "readout.void", doc, readouts=_objects(spark, d).where("s > 5").select(_name("r", "k").alias("readout_id"), (F.col("s") > 35).alias("voided")))


def _dust(o: DataFrame) -> DataFrame:
    return o.where("s > 40").select(_name("k", "k").alias("candidate_id"))


def _stamped(o: DataFrame) -> DataFrame:
    """Five clauses for each candidate: those of a size over 20 all pass, others lack or fail some."""
    clause = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("clause")) for i, c in enumerate(P.CLAUSES)]))
    rows = o.select(_name("k", "k").alias("candidate_id"), "s", clause.alias("c")).where("s > 10 OR c.i < 4")
    return rows.select("candidate_id", "c.clause", F.when(F.col("s") > 20, F.when(F.col("c.i") == 0, "pre_authorized").otherwise("measured_pass")).when(F.col("c.i") == 2, "measured_fail").otherwise("measured_pass").alias("stamp"))


@query(CODE.format("WHEN s > 40 THEN 'DUST_PROMOTION'"))
def admission_cert_clause_stamp(spark, d):
    return _codes(_rows(spark, d), "cert.clause_stamp", _doc(candidate_id=_name("k", "r"), lineage_id="l", clause="degradation", stamp="measured_pass"), dust=_dust(_objects(spark, d)))


@query(CODE.format("WHEN s > 40 THEN 'DUST_PROMOTION' WHEN coalesce(s, 0) <= 20 THEN 'PREDICATE_RED'"))
def admission_cert_certify(spark, d):
    o = _objects(spark, d)
    return _codes(_rows(spark, d), "cert.certify", _doc(candidate_id=_name("k", "r"), lineage_id="l", gate_predicate_version="1", clause_state=F.struct(F.lit(1).alias("a"))), dust=_dust(o), clause_stamps=_stamped(o))


@query(CODE.format("WHEN coalesce(t, 0) <= 20 THEN 'PREDICATE_RED'"))
def admission_cert_displace(spark, d):
    return _codes(_rows(spark, d), "cert.displace", _doc(lineage_id="l", new_incumbent=_name("k", "q")), clause_stamps=_stamped(_objects(spark, d)))


@query(CODE.format("WHEN event_id % 5 = 0 THEN 'REF_UNRESOLVED' WHEN event_id % 5 = 1 THEN 'CONDITIONAL_STALE' WHEN event_id % 3 = 0 THEN 'SCHEMA_INVALID'"))
def admission_conditional_arm(spark, d):
    e = F.col("event_id")
    pred = F.struct(F.when(e % 5 == 0, "nope").otherwise("budget_floor_alarm").alias("name"), F.when(e % 5 == 1, "0").otherwise("1").alias("version"))
    body = F.struct(F.lit("block.close").alias("type"), F.struct(F.when(e % 3 > 0, "b").alias("block_id"), F.when(e % 3 == 0, "b").alias("blok_id")).alias("payload"))
    return _codes(_rows(spark, d), "conditional.arm", _doc(cond_id="c", kind="other", predicate=pred, event_body=body))


def _eval_key(n: Column) -> Column:
    text = lambda v: F.lit(v)
    return F.struct(n.alias("config_key"), text("v1").alias("key_scheme_version"), text("m").alias("matrix_digest"), text("f").alias("featureset_hash"), F.lit(1).alias("stage"), text("s").alias("scorer_version"), text("p").alias("predicate_version"), text("c").alias("cost_model_version"))


def _evaluated(o: DataFrame) -> DataFrame:
    from marlstone.functions.scalar import canonical_sha256

    key = F.to_json(_eval_key(_name("c", "k")))
    whole = F.concat(F.substring(key, 1, F.length(key) - 1), F.lit(',"geometry_ref":null}'))  # as validated
    return o.where("s > 20").select(canonical_sha256(whole).alias("key_hash"), _name("h", F.col("s") % 2).alias("payload_sha256"))


@query(CODE.format("WHEN s > 20 AND s % 2 = event_id % 2 THEN 'DEDUP' WHEN s > 20 THEN 'SCORECARD_CONFLICT'"))
def admission_scorecard_emit(spark, d):
    metrics = F.struct(F.lit(1).alias("stage"), F.lit(3).alias("n_trades"), F.lit(1.5).alias("gross_pf"), F.lit(1.25).alias("net_pf_proxy"), F.struct(F.lit(1).alias("a")).alias("kill_gate_results"), F.lit(True).alias("population_floor_pass"), F.lit("w").alias("mask_window_id"))
    card = F.struct(F.lit("sc").alias("scorecard_id"), _eval_key(_name("c", "r")).alias("eval_key"), F.array().cast("array<string>").alias("inputs"), metrics.alias("metrics"), _name("h", F.col("event_id") % 2).alias("payload_sha256"))
    return _codes(_rows(spark, d), "scorecard.emit", _doc(scorecard=card, cycle_id="y1"), scorecards=_evaluated(_objects(spark, d)))


def _open(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("y1").alias("open_cycle"))


@query(CODE.format("WHEN event_id % 2 = 0 AND s > 20 THEN 'RECOMPUTE_ON_CACHED' WHEN event_id % 3 <> 1 THEN 'ORDER_VIOLATION'"))
def admission_stage_dispatch(spark, d):
    key = _eval_key(_name("c", "r"))
    whole = F.struct(*[key[c].alias(c) for c in ("config_key", "cost_model_version", "featureset_hash", "key_scheme_version", "matrix_digest", "predicate_version", "scorer_version", "stage")], F.lit(None).cast("string").alias("geometry_ref"))
    inputs = F.struct(F.when(F.col("event_id") % 2 == 0, whole).alias("eval_key"))
    doc = F.to_json(F.struct(_name("y", F.col("event_id") % 3).alias("cycle_id"), F.lit("rehearsal").alias("job_kind"), F.lit("j").alias("job_id"), inputs.alias("inputs")), {"ignoreNullFields": "false"})
    return _codes(_rows(spark, d), "stage.dispatch", doc, "scheduler:daemon", scorecards=_evaluated(_objects(spark, d)), open_cycle=_open(spark))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ORDER_VIOLATION' ELSE 'ACCEPTED' END AS code FROM events")
def admission_cycle_open(spark, d):
    """Drafts of even ids meet a state with an open cycle, the others one without."""
    doc = _doc(cycle_id=_name("z", "r"), dial_budget_rule_version="1", score_fn_version="1", promotion_predicate_version="1", cost_model_version="1")
    rows = _rows(spark, d)
    at = lambda odd: _codes(rows.where(F.col("event_id") % 2 == odd), "cycle.open", doc, "scheduler:daemon", open_cycle=_open(spark).where(F.lit(not odd)))
    return at(0).unionByName(at(1))


@query(E + """, lack AS (SELECT k % 3 AS part, count(*) FILTER (WHERE s > 45) AS n FROM p GROUP BY ALL)
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ORDER_VIOLATION' WHEN event_id % 3 = 0 OR coalesce(n, 0) = 0 THEN 'ACCEPTED' ELSE 'COVERAGE_DEFICIT' END AS code FROM e LEFT JOIN lack ON part = event_id % 3""")
def admission_cycle_close(spark, d):
    """Three states, dealt by id: one whose keys are all covered, and two that lack those of the large parts of a remainder."""
    o, rows = _objects(spark, d), _rows(spark, d)

    def at(state: int) -> DataFrame:
        mine = o.where(F.col("k") % 3 == state).withColumn("cycle_id", F.lit("y1"))
        keys = mine.select("cycle_id", F.array(_name("c", "k")).alias("stage0_valid"))
        covered = mine.where("s <= 45" if state else "true").select("cycle_id", _name("c", "k").alias("config_key"))
        return _codes(rows.where(F.col("event_id") % 3 == state), "cycle.close", _doc(cycle_id=_name("y", F.col("event_id") % 2)), "scheduler:daemon", open_cycle=_open(spark), cycles=keys, covered=covered)

    return at(0).unionByName(at(1)).unionByName(at(2))


@query(CODE.format("WHEN event_id % 3 > 0 THEN 'ACTOR_FORBIDDEN'"))
def admission_rules_adopt(spark, d):
    doc = _doc(proposal_ref="e", rule_kind="x", adopted_version="1", probation_predicate=F.struct(F.lit("n").alias("name")))
    return _codes(_rows(spark, d), "rules.adopt", doc, F.when(F.col("event_id") % 3 == 0, "scheduler:daemon").otherwise("human:operator"))


@query(CODE.format("WHEN s > 10 AND event_id % 2 = 1 THEN 'ORDER_VIOLATION'"))
def admission_constants_amend(spark, d):
    doc = _doc(series=_name("c", "r"), old_doc_id=F.when(F.col("event_id") % 2 == 0, _name("d", "r")).otherwise("other"), new_doc_id="n", version=2, entries=F.array().cast("array<struct<key:string>>"), rationale="x")
    return _codes(_rows(spark, d), "constants.amend", doc, constants=_objects(spark, d).where("s > 10").select(_name("c", "k").alias("series"), _name("d", "k").alias("doc_id")))


ACTORS = ["human:operator", "agent:x/boundary", "agent:x/shadow", "loop:geometry", "scheduler:daemon", "nobody"]
_ACTOR = "CASE event_id % 6 WHEN 0 THEN 'human' WHEN 1 THEN 'boundary' WHEN 2 THEN 'shadow' WHEN 3 THEN 'loop' WHEN 4 THEN 'scheduler' END"
_KIND = "CASE event_id % 5 WHEN 0 THEN 'note.record' WHEN 1 THEN 'block.close' WHEN 2 THEN 'cert.revoke' WHEN 3 THEN 'cycle.close' ELSE 'scope.mint' END"


@query(E + f""", w AS (SELECT *, {_ACTOR} AS who, {_KIND} AS kind, event_id % 7 = 0 AS disc, event_id % 4 = 0 AS cites, s > 25 AS armed_ok, event_id % 9 > 0 AS said FROM x),
f AS (SELECT *, who = 'scheduler' AND cites AND s IS NOT NULL AS met, kind = 'block.close' AS same FROM w), g AS (SELECT *, met AND armed_ok AND same AS fired FROM f)
SELECT event_id, CASE WHEN event_id % 19 = 0 THEN 'ACCEPTED' WHEN event_id % 23 = 0 OR who IS NULL THEN 'SCHEMA_INVALID' WHEN met AND NOT armed_ok THEN 'ORDER_VIOLATION' WHEN met AND NOT same THEN 'ORDER_VIOLATION'
 WHEN NOT fired AND (who IN ('boundary', 'shadow', 'loop') AND kind IN ('cert.revoke', 'cycle.close') OR who = 'scheduler' AND kind <> 'cycle.close' OR who = 'human' AND kind = 'cycle.close') THEN 'ACTOR_FORBIDDEN'
 WHEN NOT fired AND (who = 'boundary' AND kind NOT IN ('note.record', 'block.close', 'scope.mint') OR who = 'shadow' OR who = 'loop' AND kind <> 'block.close') THEN 'ACTOR_FORBIDDEN'
 WHEN disc AND NOT fired AND NOT (who = 'human' AND kind = 'cert.revoke') THEN 'CYCLE_OPEN_DISCRETIONARY' WHEN disc AND NOT said THEN 'NO_HYPOTHESIS'
 WHEN kind = 'scope.mint' AND coalesce(s, 0) <= 8 THEN 'REF_UNRESOLVED' WHEN kind = 'cycle.close' AND event_id % 2 = 0 THEN 'ORDER_VIOLATION' ELSE 'ACCEPTED' END AS code,
 event_id % 19 = 0 AS noop, CASE WHEN fired AND event_id % 19 > 0 AND event_id % 23 > 0 THEN 'arm' || r END AS fired FROM g""")
def admission_decide(spark, d):
    """The whole chain: repeats, payloads, fired conditionals, law, an allowlist that replaces the loop's, an open cycle, intent, handlers."""
    o, e = _objects(spark, d), F.col("event_id")
    kinds = {0: ("note.record", _doc(title="t", body="b")), 1: ("block.close", _doc(block_id="b")), 2: ("cert.revoke", _doc(candidate_id="k", lineage_id="l", reason="x")), 3: ("cycle.close", _doc(cycle_id=_name("y", e % 2))), 4: ("scope.mint", _doc(scope_id="c", windowset_id=_name("w", "r"), purpose="x"))}
    pick = lambda at: F.coalesce(*[F.when(e % 5 == i, v[at] if at else F.lit(v[0])) for i, v in kinds.items()])
    actor = F.coalesce(*[F.when(e % 6 == i, a) for i, a in enumerate(ACTORS)])
    bad = e % 23 == 0
    drafts = _rows(spark, d).select(e.cast("string").alias("event_id"), "ts", pick(0).alias("type"), actor.alias("actor"), F.when(e % 7 == 0, "discretionary").otherwise("scheduled").alias("provenance"), F.when(e % 9 > 0, "h").alias("hypothesis"), F.lit("r").alias("reasoning"), F.lit("x").alias("expected_outcome"), F.when(e % 4 == 0, F.array(_name("arm", "r"))).otherwise(F.array().cast("array<string>")).alias("cites"), F.when(bad, '{"no":1}').otherwise(pick(1)).alias("payload"), F.lit(False).alias("imported"))
    pred = F.struct(F.lit("budget_floor_alarm").alias("name"), F.lit("1").alias("version"))
    armed = o.select(_name("arm", "k").alias("event_id"), F.when(F.col("s") > 25, "armed").otherwise("fired").alias("status"), pred.alias("predicate"), F.struct(F.lit("block.close").alias("type"), F.lit('{"block_id": "b"}').alias("payload")).alias("event_body"))
    empty = lambda ddl: spark.createDataFrame([], ddl)
    state = {
        "seen": _rows(spark, d).where(e % 19 == 0).select(e.cast("string").alias("event_id")),
        "conditionals": armed,
        "open_cycle": _open(spark),
        "windowsets": _sets(o),
        "cycles": empty("cycle_id string, stage0_valid array<string>"),
        "covered": empty("cycle_id string, config_key string"),
        "allowlist": spark.createDataFrame([("loop", ["block.close"])], "actor string, types array<string>"),
    }
    rest = {"snapshots": "snapshot_id string, raw_sha256 string", "featuresets": "featureset_id string", "features": "feature_id string", "families": "family_id string", "populations": "artifact_id string, status string, causality_class string, mutation_audit_pass boolean", "kill_list": "axis string", "readouts": "readout_id string, block_id string, recorded boolean, voided boolean", "batches": "batch_id string, closed boolean", "stamps": "artifact_id string, stamp_kind string, passed boolean, windowset_id string, population_ref string", "lineages": "lineage string, one_shot array<string>, months array<string>, remaining long", "spends": "wiv_id string", "scorecards": "key_hash string, payload_sha256 string", "clause_stamps": "candidate_id string, clause string, stamp string", "constants": "series string, doc_id string", "suspended": "key string, suspended boolean"}
    state |= {k: empty(v) for k, v in rest.items()} | {"blocks": _blocks(o)}
    out = admission.decide(drafts, P.State(**state), {k for k, _ in kinds.values()})
    return out.select(F.col("event_id").cast("long").alias("event_id"), F.coalesce("code", F.lit("ACCEPTED")).alias("code"), "noop", "fired")
