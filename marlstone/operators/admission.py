"""Admission of drafts: the first rule a draft breaks, given a state.

``decide`` asks in a fixed order: repeats, payload, fired conditional, actor law, allowlist, open cycle, stated intent, then the handler of the
type. Each handler is a join of the drafts of its type with the projections it needs, and a chain of conditions; so a batch is
decided with a few joins on ids, and no state is collected. All drafts of a batch are decided against the state before it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.scalar import canonical_sha256
from marlstone.operators import payloads, predicates
from marlstone.operators import projections as P

# Event types by who may emit them.
APPARATUS = ["constants.register", "constants.amend", "windowset.register", "windowset.supersede", "readout.void", "cert.revoke", "conditional.arm", "conditional.disarm"]
MECHANICAL = ["replay.verified", "artifact.integrity_checked", "cert.certify", "cert.displace", "card.emit", "cycle.open", "cycle.close", "stage.dispatch", "scorecard.emit"]
ALLOWED = {
    "boundary": ["dataset.register", "feature.register", "feature.status_change", "featureset.freeze", "family.register", "family.activate", "block.register", "block.freeze", "block.supersede", "block.kill_axis", "block.close", "scope.mint", "rules.propose", "note.record"],
    "shadow": ["shadow_ranking"],
    "operator": ["artifact.register", "artifact.stamp", "artifact.attest_missing", "note.record"],
    "loop": ["trials.open_batch", "trials.record", "trials.close_batch", "artifact.register", "artifact.stamp", "dataset.register", "readout.record", "cert.clause_stamp", "note.record"],
}
ROLES = ["boundary", "shadow", "operator", "proposer"]  # of agents; the last may emit nothing new
HANDLERS: dict[str, Callable[[DataFrame, P.State], DataFrame]] = {}


def actor_class(actor: Column) -> Column:
    """human, scheduler, loop or an agent's role; null for an unknown actor. Names of people and products within an actor don't count."""
    role = F.regexp_extract(actor, r"^agent:(?:.*/)?(\w+)$", 1)
    return F.when(actor.rlike(r"^human:\w+$"), "human").when(actor == "scheduler:daemon", "scheduler").when(actor.isin("loop:population", "loop:geometry"), "loop").when(role.isin(*ROLES), role)


def rule(when: Column, code: str, detail: Column | None = None) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), (F.lit(None) if detail is None else detail).cast("string").alias("detail")))


def handler(kind: str, fields: str):
    """Register the handler of a type. It gets the drafts with their payload's ``fields`` as columns and gives (event_id, rules): the
    struct (code, detail) of the first broken rule, or null."""

    def add(f):
        def run(drafts: DataFrame, state: P.State) -> DataFrame:
            own = drafts.where(F.col("type") == kind)
            p = F.from_json("payload", fields).alias("p")
            out = f(own.select("event_id", "actor", "imported", "ts", "payload", p).select("event_id", "actor", "imported", "ts", "payload", "p.*"), state)
            return out

        HANDLERS[kind] = run
        run.plain, run.fields = f, fields
        return f

    return add


def broken(rows: DataFrame, *rules: Column) -> DataFrame:
    return rows.select("event_id", F.coalesce(*rules).alias("_b")).where(F.col("_b").isNotNull()).select("event_id", "_b.code", "_b.detail")


def known(rows: DataFrame, table: DataFrame, col: str, key: str, *cols: str) -> DataFrame:
    """Rows with ``cols`` of the object they refer to, and ``has_<key>``."""
    at = table.select(F.col(key).alias(f"_{key}"), *[F.col(c).alias(f"{key}_{c}") for c in cols]).withColumn(f"has_{key}", F.lit(True))
    return rows.join(at, F.col(col) == F.col(f"_{key}"), "left").withColumn(f"has_{key}", F.coalesce(f"has_{key}", F.lit(False))).drop(f"_{key}")


def differs(declared: str, computed: str) -> Column:
    """A declared hash that isn't the computed one; both must be there."""
    d, c = F.nullif(F.col(declared), F.lit("")), F.nullif(F.col(computed), F.lit(""))
    return d.isNotNull() & c.isNotNull() & (d != c)


@handler("dataset.register", "snapshot_id string, raw_sha256 string, computed_raw_sha256 string")
def dataset_register(d, s):
    d = known(d, s.snapshots, "snapshot_id", "snapshot_id", "raw_sha256")
    return broken(d, rule(F.col("has_snapshot_id") & ~F.col("snapshot_id_raw_sha256").eqNullSafe(F.col("raw_sha256")), "FROZEN_MUTATION"), rule(differs("raw_sha256", "computed_raw_sha256"), "HASH_MISMATCH"))


@handler("featureset.freeze", "featureset_id string, columns array<string>")
def featureset_freeze(d, s):
    gone = known(d.select("event_id", F.posexplode("columns").alias("_i", "_f")), s.features, "_f", "feature_id").where("NOT has_feature_id").groupBy("event_id").agg(F.min_by("_f", "_i").alias("_gone"))
    d = known(d, s.featuresets, "featureset_id", "featureset_id").join(gone, "event_id", "left")
    return broken(d, rule(F.col("has_featureset_id"), "FROZEN_MUTATION"), rule(F.col("_gone").isNotNull(), "REF_UNRESOLVED", F.col("_gone")))


@handler("block.register", f"block_id string, family_id string, featureset_hash string, population_ref string, arms {P.ARMS}, gates_required array<string>")
def block_register(d, s):
    d = known(d, s.featuresets, "featureset_hash", "featureset_id")
    d = known(d, s.families, "family_id", "family_id")
    d = known(d, s.populations, "population_ref", "artifact_id", "status", "causality_class", "mutation_audit_pass")
    d = known(d, P.ids(s.kill_list.where("axis <> ''"), "axis"), "family_id", "axis")
    unpriced = F.get(F.filter("arms", lambda a: a["budget"] <= 0), F.lit(0))["arm_id"]
    unaudited = F.array_contains("gates_required", "mutation_audit") & ~F.coalesce("artifact_id_mutation_audit_pass", F.lit(False)) & ~F.col("artifact_id_causality_class").eqNullSafe(F.lit("legacy_attested"))
    return broken(
        d,
        rule(~F.col("has_featureset_id") | ~F.col("has_family_id"), "REF_UNRESOLVED", F.when(F.col("has_featureset_id"), F.col("family_id")).otherwise(F.col("featureset_hash"))),
        rule(F.col("has_artifact_id") & (F.col("artifact_id_status") == "quotable_only"), "QUOTABLE_ONLY_INPUT"),
        rule(F.col("has_artifact_id") & unaudited, "PREDICATE_RED"),
        rule(unpriced.isNotNull(), "BUDGET_EXCEEDED", unpriced),
        rule(F.col("has_axis"), "KILLED_AXIS", F.col("family_id")),
    )


@handler("block.freeze", "block_id string")
def block_freeze(d, s):
    d = known(d, s.blocks, "block_id", "block_id", "frozen")
    d = known(d, P.ids(s.readouts.where("block_id IS NOT NULL").withColumnRenamed("block_id", "read_block"), "read_block"), "block_id", "read_block")
    return broken(d, rule(~F.col("has_block_id"), "REF_UNRESOLVED"), rule(F.col("block_id_frozen"), "FROZEN_MUTATION"), rule(F.col("has_read_block"), "RESULT_BEFORE_FREEZE"))


@handler("trials.open_batch", "batch_id string, block_id string, n_planned bigint")
def trials_open_batch(d, s):
    d = known(d, s.blocks, "block_id", "block_id", "frozen", "budget_remaining")
    return broken(d, rule(~F.col("has_block_id"), "REF_UNRESOLVED"), rule(~F.col("block_id_frozen"), "ORDER_VIOLATION"), rule(F.col("n_planned") > F.col("block_id_budget_remaining"), "BUDGET_EXCEEDED", F.col("block_id_budget_remaining")))


@handler("trials.record", "batch_id string, block_id string, n_rows bigint, n_distinct_keys bigint, null_spec_hash string, engine_stamp struct<git:string>")
def trials_record(d, s):
    d = known(d, s.batches, "batch_id", "batch_id", "closed")
    d = known(d, s.blocks, "block_id", "block_id", "frozen_null")
    d = d.withColumn("_echo", canonical_sha256(F.get_json_object("payload", "$.pc_echo"))).withColumn("_pc", F.lit("pc"))
    pc = s.held["pc_echo"] if "pc_echo" in s.held else d.sparkSession.createDataFrame([], "series string, expected string")
    d = known(d, pc, "_pc", "series", "expected")
    git = F.coalesce("engine_stamp.git", F.lit(""))
    return broken(
        d,
        rule(~F.col("has_batch_id") | F.col("batch_id_closed"), "ORDER_VIOLATION"),
        rule(F.col("n_distinct_keys") != F.col("n_rows"), "DUPLICATE_KEY"),
        rule((F.col("block_id_frozen_null") != "") & (F.col("null_spec_hash") != "") & (F.col("null_spec_hash") != F.col("block_id_frozen_null")), "CRN_MISMATCH"),
        rule(git.isin("", "nogit", "dirty") | git.endswith("-dirty"), "GIT_DIRTY"),
        rule((F.col("series_expected") != "") & (F.col("_echo") != F.col("series_expected")), "PC_ECHO_MISMATCH"),
    )


@handler("artifact.register", "role string, declared_sha256 string, computed_sha256 string")
def artifact_register(d, s):
    return broken(d, rule((actor_class(F.col("actor")) == "scheduler") & ~F.col("role").eqNullSafe(F.lit("session_capture")), "ACTOR_FORBIDDEN"), rule(differs("declared_sha256", "computed_sha256"), "HASH_MISMATCH"))


@handler("windowset.supersede", "old_windowset_id string, carryover array<struct<wiv_id:string>>")
def windowset_supersede(d, s):
    old = known(d, s.windowsets, "old_windowset_id", "windowset_id", "windows")
    held = old.select("event_id", F.explode("windowset_id_windows.wiv_id").alias("_w"), F.col("carryover.wiv_id").alias("_c")).distinct()
    lost = held.join(s.spends.select(F.col("wiv_id").alias("_w")).distinct(), "_w", "left_semi").where(~F.coalesce(F.array_contains("_c", F.col("_w")), F.lit(False)))
    lost = lost.groupBy("event_id").agg(F.array_join(F.sort_array(F.collect_set("_w")), ",").alias("_lost"))  # windows of one set, a handful
    return broken(old.join(lost, "event_id", "left"), rule(~F.col("has_windowset_id"), "REF_UNRESOLVED"), rule(F.col("_lost").isNotNull(), "CARRYOVER_MISSING", F.col("_lost")))


@handler("scope.mint", "windowset_id string")
def scope_mint(d, s):
    return broken(known(d, s.windowsets, "windowset_id", "windowset_id"), rule(~F.col("has_windowset_id"), "REF_UNRESOLVED"))


REQUEST = "readout_id string, block_id string, windowset_id string, scope_id string, population_ref string, purpose string, rehearsal_artifact_ref string, counts_stamp_ref string"


def spend_rule(d: DataFrame, s: P.State) -> tuple[DataFrame, Column]:
    """SPD-1 on requests: adds what their lineage allows, and gives the rule: windows spent, month used, velocity, budget."""
    d = known(d, s.lineages, "lineage", "lineage", "one_shot", "months", "remaining")
    certs = F.transform(F.filter("windowset_id_windows", lambda w: w["role"] == "forward_certifier"), lambda w: F.concat(w["wiv_id"], F.lit("::"), F.col("scope_id")))
    spent = F.array_intersect(certs, "lineage_one_shot")
    cap = s.maybe("velocity")  # (lineage, n, cap), where a cap is registered
    d = d.withColumn("_fast", F.lit(False)) if cap is None else known(d, cap.where("n >= cap").withColumnRenamed("lineage", "fast"), "lineage", "fast").withColumn("_fast", F.col("has_fast"))
    paid = F.coalesce(F.col("purpose"), F.lit("readout")) == "readout"
    month = F.date_format("ts", "yyyy-MM")
    code = F.coalesce(
        rule(paid & (F.size(spent) > 0), "WINDOWS_SPENT", F.get(spent, F.lit(0))),
        rule(paid & F.array_contains("lineage_months", month), "EMISSION_CAP", month),
        rule(paid & F.col("_fast"), "VELOCITY_EXCEEDED"),
        rule(paid & (F.col("lineage_remaining").isNull() | (F.col("lineage_remaining") <= 0)), "LOOK_BUDGET_ZERO"),
    )
    return d, code


@handler("readout.request", REQUEST)
def readout_request(d, s):
    d = known(d, s.blocks, "block_id", "block_id", "frozen", "arms")
    d = P.lineage_of(known(d, s.windowsets, "windowset_id", "windowset_id", "windows"), s.windowsets)
    counts = s.stamps.where("stamp_kind = 'counts' AND passed").select(F.col("artifact_id").alias("counts_stamp_ref"), "windowset_id", "population_ref").distinct().withColumn("_counted", F.lit(True))
    d = d.join(counts, ["counts_stamp_ref", "windowset_id", "population_ref"], "left")
    d, spend = spend_rule(d, s)
    purpose = F.coalesce(F.col("purpose"), F.lit("readout"))
    silent = F.get(F.filter("block_id_arms", lambda a: (a["role"] == "real") & (F.coalesce(F.size(a["seeds_declared"]), F.lit(0)) <= 0)), F.lit(0))["arm_id"]
    read = purpose == "readout"
    return broken(
        d,
        rule(~F.col("has_block_id"), "REF_UNRESOLVED"),
        rule(~F.col("block_id_frozen"), "ORDER_VIOLATION"),
        rule((purpose == "postmortem") & (F.coalesce(F.size("lineage_one_shot"), F.lit(0)) <= 0), "POSTMORTEM_BEFORE_SPEND"),
        rule(read & (F.coalesce("rehearsal_artifact_ref", F.lit("")) == ""), "NO_REHEARSAL"),
        rule(read & silent.isNotNull(), "SEEDS_UNDECLARED", silent),
        rule(read & F.col("_counted").isNull(), "NO_COUNTS_STAMP"),
        spend,
    )


@handler("readout.record", "readout_id string, info_rows_present boolean")
def readout_record(d, s):
    d = known(d, s.readouts, "readout_id", "readout_id", "recorded")
    return broken(d, rule(~F.col("has_readout_id") | F.col("readout_id_recorded"), "ORDER_VIOLATION"), rule(~F.coalesce("info_rows_present", F.lit(False)), "PREDICATE_RED"))


@handler("readout.void", "readout_id string, evidence struct<unmask_artifact_absent:boolean>")
def readout_void(d, s):
    d = known(d, s.readouts, "readout_id", "readout_id", "voided")
    return broken(d, rule(~F.col("has_readout_id"), "REF_UNRESOLVED"), rule(F.col("readout_id_voided"), "ORDER_VIOLATION"), rule(~F.coalesce("evidence.unmask_artifact_absent", F.lit(False)), "PREDICATE_RED"))


def dust(d: DataFrame, s: P.State, col: str) -> DataFrame:
    """ADM-30: whether the candidate is among the dust (candidate_id) of any readout; no log holds these, they are given."""
    return known(d, s.held["dust"], col, "candidate_id") if "dust" in s.held else d.withColumn("has_candidate_id", F.lit(False))


@handler("cert.clause_stamp", "candidate_id string")
def cert_clause_stamp(d, s):
    return broken(dust(d, s, "candidate_id"), rule(F.col("has_candidate_id"), "DUST_PROMOTION"))


@handler("cert.certify", "candidate_id string")
def cert_certify(d, s):
    d = known(dust(d, s, "candidate_id"), P.gate_green(s.clause_stamps).withColumnRenamed("candidate_id", "green"), "candidate_id", "green")
    live = ~F.col("imported")
    return broken(d, rule(live & F.col("has_candidate_id"), "DUST_PROMOTION"), rule(live & ~F.col("has_green"), "PREDICATE_RED"))


@handler("cert.displace", "new_incumbent string")
def cert_displace(d, s):
    d = known(d, P.gate_green(s.clause_stamps).withColumnRenamed("candidate_id", "green"), "new_incumbent", "green")
    return broken(d, rule(~F.col("imported") & ~F.col("has_green"), "PREDICATE_RED"))


def deployed(name: Column) -> Column:
    """The version in use of a named predicate, null if there is none."""
    pairs = [F.lit(x) for k, v in predicates.PREDICATES.items() for x in (k, v.version)]
    return F.create_map(*pairs)[name]


@handler("conditional.arm", "predicate struct<name:string,version:string>, event_body struct<type:string,payload:string>")
def conditional_arm(d, s):
    v = deployed(F.col("predicate.name"))
    d = d.withColumn("_e", payloads.validate(F.col("event_body.type"), F.coalesce("event_body.payload", F.lit("{}"))))
    return broken(d, rule(v.isNull(), "REF_UNRESOLVED"), rule(v != F.col("predicate.version"), "CONDITIONAL_STALE"), rule(F.col("event_body.type").isNull() | F.col("_e.error").isNotNull(), "SCHEMA_INVALID", F.col("_e.error")))


@handler("scorecard.emit", "scorecard struct<payload_sha256:string>")
def scorecard_emit(d, s):
    d = known(d.withColumn("_key", canonical_sha256(F.get_json_object("payload", "$.scorecard.eval_key"))), s.scorecards, "_key", "key_hash", "payload_sha256")
    same = F.col("key_hash_payload_sha256").eqNullSafe(F.col("scorecard.payload_sha256"))
    return broken(d, rule(F.col("has_key_hash") & same, "DEDUP"), rule(F.col("has_key_hash"), "SCORECARD_CONFLICT"))


@handler("stage.dispatch", "cycle_id string")
def stage_dispatch(d, s):
    d = known(d.withColumn("_key", canonical_sha256(F.get_json_object("payload", "$.inputs.eval_key"))), s.scorecards, "_key", "key_hash")
    d = d.join(F.broadcast(s.open_cycle), how="left")
    return broken(d, rule(F.col("has_key_hash"), "RECOMPUTE_ON_CACHED"), rule(~F.coalesce(F.col("open_cycle") == F.col("cycle_id"), F.lit(False)), "ORDER_VIOLATION"))


@handler("cycle.open", "cycle_id string")
def cycle_open(d, s):
    return broken(d.join(F.broadcast(s.open_cycle), how="left"), rule(F.col("open_cycle").isNotNull(), "ORDER_VIOLATION", F.col("open_cycle")))


@handler("cycle.close", "cycle_id string")
def cycle_close(d, s):
    valid = s.cycles.select("cycle_id", F.explode(F.array_distinct("stage0_valid")).alias("config_key"))
    gone = valid.join(s.covered, ["cycle_id", "config_key"], "left_anti")
    first = P.Window.partitionBy("cycle_id").orderBy("config_key")
    # Only the ten least are listed; a window keeps ten rows for each cycle and task before the shuffle.
    ten = gone.withColumn("_r", F.row_number().over(first)).where("_r <= 10").groupBy("cycle_id").agg(F.array_join(F.sort_array(F.collect_list("config_key")), ",").alias("_first"))
    lack = gone.groupBy("cycle_id").agg(F.count(F.lit(1)).alias("_n")).join(ten, "cycle_id").withColumnRenamed("cycle_id", "lacking")
    d = known(d.join(F.broadcast(s.open_cycle), how="left"), lack, "cycle_id", "lacking", "_n", "_first")
    return broken(d, rule(~F.col("open_cycle").eqNullSafe(F.col("cycle_id")), "ORDER_VIOLATION"), rule(F.col("has_lacking"), "COVERAGE_DEFICIT", F.concat_ws(":", "lacking__n", "lacking__first")))


@handler("rules.adopt", "proposal_ref string")
def rules_adopt(d, s):
    return broken(d, rule(~F.coalesce(actor_class(F.col("actor")) == "scheduler", F.lit(False)), "ACTOR_FORBIDDEN"))


@handler("constants.amend", "series string, old_doc_id string")
def constants_amend(d, s):
    d = known(d, s.constants, "series", "series", "doc_id")
    return broken(d, rule(F.col("has_series") & ~F.col("series_doc_id").eqNullSafe(F.col("old_doc_id")), "ORDER_VIOLATION", F.col("series_doc_id")))


def law(kind: Column, who: Column, imported: Column) -> Column:
    """ADM-3: what nobody but a human, or the scheduler, may ever emit."""
    agent = who.isin(*ROLES, "loop")
    barred = agent & kind.isin(*APPARATUS, *MECHANICAL, "queue_reorder", "readout.request")
    return barred | ((who == "scheduler") & ~kind.isin(*MECHANICAL)) | ((who == "human") & kind.isin(*MECHANICAL, "queue_reorder") & ~imported)


def allowed(kind: Column, who: Column, actor: Column, override: Column) -> Column:
    """ADM-4: whether the actor's list holds the type. ``override``: map of actor, or of a class of them, to a list that replaces the fixed one; humans and the scheduler have none."""
    seeded = F.create_map(*[x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    mine = F.when(who.isin(*ALLOWED), F.coalesce(override[actor], override[who], seeded[who]))
    return mine.isNull() | F.array_contains(mine, kind)


def fires(drafts: DataFrame, state: P.State) -> DataFrame:
    """ADM-2: drafts of the scheduler that cite a conditional: (event_id, fired, code). Of several known ones the first cited counts.

    It fires if it is armed, its predicate's version is the one in use, and type and validated payload are those that were armed.
    """
    cites = drafts.where(F.col("_who") == "scheduler").select("event_id", F.col("type").alias("_t"), F.col("_sha").alias("_mine"), F.posexplode("cites").alias("_i", "_c"))
    armed = state.conditionals.select(F.col("event_id").alias("_c"), "status", "predicate", F.col("event_body.type").alias("_bt"), F.coalesce("event_body.payload", F.lit("{}")).alias("_bp"))
    met = cites.join(armed, "_c")
    body = payloads.validate(F.col("_bt"), F.col("_bp"))
    met = met.withColumn("_body", F.coalesce(body["sha256"], canonical_sha256(F.col("_bp"))))
    if state.maybe("suspended") is not None:
        met = met.withColumn("_key", F.lit(P.CHANNEL)).join(state.suspended.select(F.col("key").alias("_key"), "suspended"), "_key", "left")
    else:
        met = met.withColumn("suspended", F.lit(False))
    stale = ~deployed(F.col("predicate.name")).eqNullSafe(F.col("predicate.version"))
    code = F.coalesce(
        rule(F.col("status") != "armed", "ORDER_VIOLATION", F.col("status")),
        rule(stale, "CONDITIONAL_STALE"),
        rule(~F.col("_bt").eqNullSafe(F.col("_t")) | ~F.col("_body").eqNullSafe(F.col("_mine")), "ORDER_VIOLATION"),
        rule((F.col("_t") == "readout.request") & F.col("suspended"), "CHANNEL_SUSPENDED"),
    )
    first = met.select("event_id", "_i", F.col("_c").alias("fired"), code.alias("_f"))
    return first.groupBy("event_id").agg(F.min_by(F.struct("fired", "_f"), "_i").alias("_m")).select("event_id", "_m.fired", F.col("_m._f").alias("_f"))


def decide(drafts: DataFrame, state: P.State, kinds: set[str] | None = None, scheduled: bool = True) -> DataFrame:
    """ADM-1: (event_id, accepted, noop, code, detail, fired) of drafts (event_id, type, actor, provenance, hypothesis, reasoning,
    expected_outcome, cites, payload, imported, ts).

    A draft whose event_id the log holds is accepted without effect. ``kinds`` are the types that occur, where the caller knows them, and ``scheduled`` whether any draft
    is the scheduler's: what needn't be asked isn't joined.
    """
    d = drafts.withColumn("_v", payloads.validate(F.col("type"), F.col("payload"))).withColumns({"_who": actor_class(F.col("actor")), "_sha": F.col("_v.sha256"), "_error": F.col("_v.error"), "payload": F.coalesce("_v.payload", "payload"), "imported": F.coalesce("imported", F.lit(False))})
    good = d.where("_error IS NULL AND _who IS NOT NULL")
    none = F.lit(None).cast("string")
    asked = [HANDLERS[k](good, state) for k in sorted(HANDLERS) if kinds is None or k in kinds]
    out = d.withColumns({"_hc": none, "_hd": none})
    if asked:
        found = reduce(DataFrame.unionByName, asked).groupBy("event_id").agg(F.min("code").alias("_hc"), F.min("detail").alias("_hd"))
        out = d.join(found, "event_id", "left")
    out = out.join(fires(good, state), "event_id", "left") if scheduled else out.withColumns({"fired": none, "_f": F.lit(None).cast("struct<code:string,detail:string>")})
    out = out.join(state.seen().distinct().withColumn("_seen", F.lit(True)), "event_id", "left")
    out = out.join(F.broadcast(state.open_cycle), how="left")  # one row
    over = state.maybe("allowlist")
    override = F.lit(None).cast("map<string,array<string>>")
    if over is not None:  # entries of one document, by actor
        out = out.join(F.broadcast(over.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("actor", "types"))).alias("_over"))), how="left")
        override = F.col("_over")
    fired = F.col("fired").isNotNull() & F.col("_f").isNull()
    who, kind = F.col("_who"), F.col("type")
    open_ = F.col("open_cycle").isNotNull() & (F.col("provenance") == "discretionary") & ~fired & ~((who == "human") & kind.isin(*APPARATUS))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    unsaid = (F.col("provenance") == "discretionary") & ~F.col("imported") & (blank("hypothesis") | blank("reasoning") | blank("expected_outcome"))
    handled = F.when(F.col("_hc").isNotNull() & (F.col("_hc") != "DEDUP"), F.struct(F.col("_hc").alias("code"), F.col("_hd").alias("detail")))
    seen = F.coalesce("_seen", F.lit(False))
    code = F.coalesce(
        rule(F.col("_error").isNotNull() | who.isNull() | ~F.col("provenance").isin("scheduled", "discretionary"), "SCHEMA_INVALID", F.coalesce("_error", F.lit("actor or provenance"))),
        F.col("_f"),
        rule(~fired & law(kind, who, F.col("imported")), "ACTOR_FORBIDDEN"),
        rule(~fired & ~allowed(kind, who, F.col("actor"), override), "ACTOR_FORBIDDEN"),
        rule(open_, "CYCLE_OPEN_DISCRETIONARY", F.col("open_cycle")),
        rule(unsaid, "NO_HYPOTHESIS"),
        handled,
    )
    code = F.when(~seen, code)
    noop = seen | F.coalesce((F.col("_hc") == "DEDUP") & code.isNull(), F.lit(False))
    return out.select("event_id", code.isNull().alias("accepted"), noop.alias("noop"), code["code"].alias("code"), code["detail"].alias("detail"), F.when(fired & ~seen, F.col("fired")).otherwise(none).alias("fired"))
