"""State as projections of an event log: one table for each kind of object, by id.

A log has seq, event_id, ts, type, actor, cites, payload (validated JSON). Of rows with one event_id the first counts. What an event sets is
the latest by seq; a registration starts its object afresh, so that only later events count for it. Replay applies every event of the log,
and never asks again whether it was admissible.

A projection is finished from bases. A base is a table by key that is made of a range of the log and merges with that of the range before, so a state may go on
from a written snapshot of its bases and read only the events since (``State.carried``); a cold replay makes them of the whole log.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.scalar import canonical, canonical_sha256
from marlstone.operators.eventlog import first_of_each
from marlstone.operators.placing import placed, running
from marlstone.operators.ranking import lex_key
from marlstone.scratch import Scratch

WINDOWS = "array<struct<wiv_id:string,data_contract:string,start:string,end:string,role:string>>"
ENTRIES = "array<struct<key:string,value:string,finality:string,unknown:boolean>>"
SUSPENDED = "SUSPENDED_pending_human_review"
CHANNEL = "readout_conditional_channel"


def parsed(log: DataFrame, kind: str, fields: str) -> DataFrame:
    """Events of one type with fields of their payload as columns."""
    return log.where(F.col("type") == kind).select("seq", "event_id", "ts", "actor", F.from_json("payload", fields).alias("_p")).select("seq", "event_id", "ts", "actor", "_p.*")


def last_by(rows: DataFrame, key: str, *cols: str) -> DataFrame:
    """The latest row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct("seq", *cols), "seq").alias("_l")).select(key, "_l.*")


def since(events: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Events after the last start of their object, or all where it was never started."""
    at = starts.groupBy(key).agg(F.max("seq").alias("_from"))
    return events.join(at, key, "left").where(F.col("_from").isNull() | (F.col("seq") > F.col("_from"))).drop("_from")


def ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key).distinct()


class Base:
    """How a base is made of a range of events, and how it merges with that of the range before."""

    def __init__(self, make: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame]):
        self.make, self.merge = make, merge


BASES: dict[str, Base] = {}


def base(merge: Callable[[DataFrame, DataFrame], DataFrame]):
    """Register a function from events to a table as a base."""

    def add(f):
        BASES[f.__name__] = Base(f, merge)
        return f

    return add


def _same(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> Column:
    return reduce(Column.__and__, [left[k].eqNullSafe(right[k]) for k in keys])


def newest(*keys: str):
    """The later range's row of a key takes the place of the earlier one's."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        at = new.select(*keys).distinct()
        return old.join(F.broadcast(at), _same(old, at, keys), "left_anti").unionByName(new)  # the later range is the short one

    return merge


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new)


def started(starts: DataFrame, marks: DataFrame, key: str, *cols: str, **aggs: Column) -> DataFrame:
    """By key: ``from_seq`` and ``cols`` of the last start, and aggregates of the marks since then (of all, where it never started)."""
    reg = last_by(starts, key, *cols).withColumnRenamed("seq", "from_seq")
    after = since(marks, starts, key).groupBy(key).agg(*[a.alias(n) for n, a in aggs.items()])
    return reg.join(after, key, "full")


def restarted(key: str, any_of: tuple[str, ...] = (), total: tuple[str, ...] = (), last: tuple[str, ...] = ()):
    """Merge of ``started``: a start in the later range leaves nothing of the earlier; else flags are or-ed, sums added and the latest kept."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        o, n = old.alias("o"), new.alias("n")
        both = o.join(n, F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full")

        def one(c: str) -> Column:
            a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
            if c == key:
                return F.coalesce(b, a).alias(c)
            kept = a
            if c in any_of:
                kept = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a | b)
            elif c in total:
                kept = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
            elif c in last:
                kept = F.coalesce(b, a)
            return F.when(F.col("n.from_seq").isNotNull(), b).otherwise(kept).alias(c)

        return both.select(*[one(c) for c in old.columns])

    return merge


def latest_mark(value: Column, mark: Column) -> Column:
    """The value, wrapped as it may be null, of the last row that is such a mark."""
    return F.max_by(F.struct(value.alias("v")), F.when(mark, F.col("seq")))


def _own(f: Callable[[DataFrame], DataFrame], merge) -> Callable[[DataFrame], DataFrame]:
    """A projection that is its own base."""
    BASES[f.__name__] = Base(f, merge)
    return f


def snapshots(log: DataFrame) -> DataFrame:
    return last_by(parsed(log, "dataset.register", "snapshot_id string, raw_sha256 string, path string"), "snapshot_id", "raw_sha256", "path")


def features(log: DataFrame) -> DataFrame:
    """Status of each feature; one that another was swapped in for is extended."""
    change = parsed(log, "feature.status_change", "feature_id string, to_status string, swap_out string")
    rows = parsed(log, "feature.register", "feature_id string, status string").select("seq", "feature_id", "status")
    rows = rows.union(change.select("seq", "feature_id", "to_status")).union(change.where("swap_out <> ''").select("seq", "swap_out", F.lit("extended")))
    return last_by(rows, "feature_id", "status")


def featuresets(log: DataFrame) -> DataFrame:
    return last_by(parsed(log, "featureset.freeze", "featureset_id string, columns array<string>"), "featureset_id", "columns")


def families(log: DataFrame) -> DataFrame:
    rows = parsed(log, "family.register", "family_id string, status string").select("seq", "family_id", "status")
    return last_by(rows.union(parsed(log, "family.activate", "family_id string").select("seq", "family_id", F.lit("active"))), "family_id", "status")


ARMS = "array<struct<arm_id:string,role:string,config_keys:array<string>,budget:bigint,seeds_declared:array<bigint>>>"


@base(restarted("block_id", any_of=("frozen", "closed"), total=("planned",), last=("superseded_by", "declared_width")))
def block_base(log: DataFrame) -> DataFrame:
    reg = parsed(log, "block.register", f"block_id string, family_id string, featureset_hash string, population_ref string, arms {ARMS}, null_spec struct<shift_vector_sha256:string>")
    none = F.lit(None).cast("string")
    marks = parsed(log, "block.freeze", "block_id string, declared_width bigint").select("seq", "block_id", F.lit("frozen").alias("mark"), none.alias("to"), "declared_width", F.lit(0).cast("long").alias("n"))
    marks = marks.union(parsed(log, "block.close", "block_id string").select("seq", "block_id", F.lit("closed"), none, F.lit(None).cast("long"), F.lit(0).cast("long")))
    marks = marks.union(parsed(log, "block.supersede", "old_block_id string, new_block_id string").select("seq", "old_block_id", F.lit("superseded"), "new_block_id", F.lit(None).cast("long"), F.lit(0).cast("long")))
    marks = marks.union(parsed(log, "trials.open_batch", "block_id string, n_planned bigint").select("seq", "block_id", F.lit("batch"), none, F.lit(None).cast("long"), "n_planned"))
    is_ = lambda m: F.col("mark") == m
    return started(reg, marks, "block_id", "family_id", "featureset_hash", "population_ref", "arms", "null_spec", frozen=F.bool_or(is_("frozen")), closed=F.bool_or(is_("closed")), superseded_by=latest_mark(F.col("to"), is_("superseded")), declared_width=latest_mark(F.col("declared_width"), is_("frozen")), planned=F.sum("n"))


def blocks(block_base: DataFrame) -> DataFrame:
    """Blocks with their last registration, whether frozen, closed or superseded since, and the budget left of their arms'."""
    no, granted = F.lit(False), F.aggregate("arms", F.lit(0).cast("long"), lambda s, a: s + a["budget"])
    return block_base.select("block_id", "family_id", "featureset_hash", "population_ref", "arms", F.col("null_spec.shift_vector_sha256").alias("frozen_null"), F.coalesce("frozen", no).alias("frozen"), F.coalesce("closed", no).alias("closed"), F.col("superseded_by.v").alias("superseded_by"), F.col("declared_width.v").alias("declared_width"), (granted - F.coalesce("planned", F.lit(0))).alias("budget_remaining"))


def stage0(blocks: DataFrame) -> DataFrame:
    """(config_key) that the real arms of frozen blocks, which aren't closed, have in their lists, each once."""
    arm = blocks.where("frozen AND NOT closed").select(F.explode("arms").alias("a")).where("a.role = 'real'")
    return arm.select(F.explode("a.config_keys").alias("config_key")).distinct()


def kill_list(log: DataFrame) -> DataFrame:
    return parsed(log, "block.kill_axis", "axis string, rationale string").select("seq", "axis", "rationale")


@base(restarted("batch_id", any_of=("closed",), total=("n_rows", "n_records")))
def batch_base(log: DataFrame) -> DataFrame:
    opened = parsed(log, "trials.open_batch", "batch_id string, block_id string, n_planned bigint")
    rows = parsed(log, "trials.record", "batch_id string, n_rows bigint").select("seq", "batch_id", "n_rows", F.lit(False).alias("closes"))
    rows = rows.union(parsed(log, "trials.close_batch", "batch_id string").select("seq", "batch_id", F.lit(0).cast("long"), F.lit(True)))
    return started(opened, rows, "batch_id", "block_id", "n_planned", closed=F.bool_or("closes"), n_rows=F.sum("n_rows"), n_records=F.count_if(~F.col("closes")))


def batches(batch_base: DataFrame) -> DataFrame:
    """Batches of trials: their block, whether closed, and rows recorded, since they were last opened."""
    zero = F.lit(0).cast("long")
    return batch_base.select("batch_id", "block_id", "n_planned", F.coalesce("closed", F.lit(False)).alias("closed"), F.coalesce("n_rows", zero).alias("n_rows"), F.coalesce("n_records", zero).alias("n_records"))


def artifacts(log: DataFrame) -> DataFrame:
    reg = parsed(log, "artifact.register", "artifact_id string, role string, status string, path string, declared_sha256 string, computed_sha256 string, provenance struct<causality_class:string>")
    gone = parsed(log, "artifact.attest_missing", "name string, expected_role string")
    none = F.lit(None).cast("string")
    rows = reg.select("seq", "artifact_id", "role", "status", "path", F.coalesce("computed_sha256", "declared_sha256").alias("sha256"), F.col("provenance.causality_class").alias("causality_class"))
    rows = rows.union(gone.select("seq", F.concat(F.lit("missing::"), "name"), none, F.lit("attested_missing"), none, none, none))
    return last_by(rows, "artifact_id", "role", "status", "path", "sha256", "causality_class")


@base(newest("artifact_id"))
def registered(log: DataFrame) -> DataFrame:
    return last_by(parsed(log, "artifact.register", "artifact_id string"), "artifact_id")


@base(newest("artifact_id"))
def population_base(log: DataFrame) -> DataFrame:
    return last_by(parsed(log, "artifact.register", "artifact_id string, role string").where("role = 'population'"), "artifact_id")


@base(appended)
def stamped(log: DataFrame) -> DataFrame:
    rows = parsed(log, "artifact.stamp", "artifact_id string, stamp_kind string, passed boolean, detail struct<windowset_id:string,population_ref:string>")
    return rows.select("seq", "artifact_id", "stamp_kind", "passed", "detail.windowset_id", "detail.population_ref")


def stamps(stamped: DataFrame, registered: DataFrame) -> DataFrame:
    """Stamps of artifacts since these were last registered."""
    return since(stamped, registered, "artifact_id")


def populations(population_base: DataFrame, stamped: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifacts that are populations, with whether a mutation audit has passed since."""
    ok = since(stamped, population_base, "artifact_id").where("stamp_kind = 'mutation_audit' AND passed")
    known = artifacts.join(ids(population_base, "artifact_id"), "artifact_id", "left_semi").select("artifact_id", "status", "causality_class")
    out = known.join(ids(ok, "artifact_id").withColumn("_ok", F.lit(True)), "artifact_id", "full")
    return out.select("artifact_id", "status", "causality_class", F.coalesce("_ok", F.lit(False)).alias("mutation_audit_pass"))


EVAL_KEY = ["config_key", "cost_model_version", "featureset_hash", "geometry_ref", "key_scheme_version", "matrix_digest", "predicate_version", "scorer_version", "stage"]


def scorecards(log: DataFrame) -> DataFrame:
    """The evaluated map: the latest scorecard of each evaluation key, by the key's hash; ``lex`` orders keys by their fields' text."""
    key = ",".join(f"{k}:{'int' if k == 'stage' else 'string'}" for k in EVAL_KEY)
    rows = parsed(log, "scorecard.emit", f"scorecard struct<eval_key:struct<{key}>,payload_sha256:string,metrics:string>, cycle_id string")
    hashes = log.where("type = 'scorecard.emit'").select("seq", canonical_sha256(F.get_json_object("payload", "$.scorecard.eval_key")).alias("key_hash"))
    e = F.col("scorecard.eval_key")
    rows = rows.select("seq", "cycle_id", "scorecard.payload_sha256", e["config_key"].alias("config_key"), e["stage"].alias("stage"), "scorecard.metrics", lex_key(*[e[k] for k in EVAL_KEY]).alias("lex")).join(hashes, "seq")
    return last_by(rows, "key_hash", "payload_sha256", "config_key", "stage", "cycle_id", "metrics", "lex")


@base(newest("windowset_id"))
def windowset_rows(log: DataFrame) -> DataFrame:
    reg = parsed(log, "windowset.register", f"windowset_id string, lineage_id string, windows {WINDOWS}, status string").select("seq", "windowset_id", F.coalesce(F.when(F.col("lineage_id") != "", F.col("lineage_id")), F.concat(F.lit("lin::"), "windowset_id")).alias("lineage_id"), "windows", "status", F.lit(None).cast("string").alias("old"))
    sup = parsed(log, "windowset.supersede", f"old_windowset_id string, new_windowset struct<windowset_id:string,windows:{WINDOWS},status:string>")
    rows = reg.unionByName(sup.select("seq", F.col("new_windowset.windowset_id").alias("windowset_id"), F.lit(None).cast("string").alias("lineage_id"), "new_windowset.windows", "new_windowset.status", F.col("old_windowset_id").alias("old")))
    return last_by(rows, "windowset_id", "lineage_id", "windows", "status", "old")


@base(newest("windowset_id"))
def windowset_over(log: DataFrame) -> DataFrame:
    sup = parsed(log, "windowset.supersede", "old_windowset_id string, new_windowset struct<windowset_id:string>")
    return sup.groupBy(F.col("old_windowset_id").alias("windowset_id")).agg(F.max_by("new_windowset.windowset_id", "seq").alias("superseded_by"), F.max("seq").alias("_s"))


def windowsets(windowset_rows: DataFrame, windowset_over: DataFrame) -> DataFrame:
    """Windowsets with the lineage that they pass on to their successors, and whether they are live.

    Lineages go along chains of supersessions, by pointer jumping: a written table for each doubling of the longest chain, none where nothing was superseded.
    """
    run, step, one = Scratch(windowset_rows.sparkSession, "windowsets"), 0, windowset_rows
    while one.where("old IS NOT NULL AND lineage_id IS NULL").limit(1).count():
        step += 1
        up = one.select(F.col("windowset_id").alias("_o"), F.col("lineage_id").alias("_l"), F.col("old").alias("_oo"))
        one = one.join(up, F.col("old") == F.col("_o"), "left").select("windowset_id", "seq", F.coalesce("lineage_id", "_l").alias("lineage_id"), "windows", "status", F.when(F.coalesce("lineage_id", "_l").isNull(), F.when(F.col("_o").isNotNull(), F.col("_oo"))).alias("old"))
        one = run.table(str(step), one)
    out = one.join(windowset_over, "windowset_id", "left")
    later = F.col("_s") > F.col("seq")
    return out.select("windowset_id", F.coalesce("lineage_id", F.concat(F.lit("lin::"), "windowset_id")).alias("lineage_id"), "windows", F.when(later, "historical").otherwise(F.col("status")).alias("status"), F.when(later, F.col("superseded_by")).alias("superseded_by"))


@base(restarted("readout_id", any_of=("recorded", "voided"), last=("placebo", "five_clause", "recorded_seq")))
def readout_base(log: DataFrame) -> DataFrame:
    from marlstone.operators.eventlog import placebo_class

    req = parsed(log, "readout.request", "readout_id string, block_id string, windowset_id string, scope_id string, population_ref string, purpose string")
    rec = parsed(log, "readout.record", "readout_id string, five_clause string, placebo_result struct<max_z:double,gate_ref:double,extended_max:double,at_shot_clause_pass:boolean>")
    p = F.col("placebo_result")
    rec = rec.select("seq", "readout_id", "five_clause", placebo_class(p["max_z"], p["gate_ref"], p["extended_max"], p["at_shot_clause_pass"]).alias("placebo"), F.lit(True).alias("recorded"), F.lit(False).alias("voided"))
    void = parsed(log, "readout.void", "readout_id string").select("seq", "readout_id", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False), F.lit(True))
    done = F.col("recorded")
    return started(req, rec.union(void), "readout_id", "block_id", "windowset_id", "scope_id", "population_ref", "purpose", recorded=F.bool_or("recorded"), voided=F.bool_or("voided"), placebo=latest_mark(F.col("placebo"), done), five_clause=latest_mark(F.col("five_clause"), done), recorded_seq=F.max(F.when(done, F.col("seq"))))


def readouts(readout_base: DataFrame) -> DataFrame:
    """Readouts since their last request: what was asked, whether recorded and voided, and the placebo class of the record."""
    no, placebo = F.lit(False), F.col("placebo.v")
    return readout_base.select("readout_id", "block_id", "windowset_id", "scope_id", "population_ref", "purpose", F.coalesce("recorded", no).alias("recorded"), F.coalesce("voided", no).alias("voided"), placebo.alias("placebo"), F.coalesce(placebo == "L1", no).alias("cert_ineligible"), F.col("five_clause.v").alias("five_clause"), "recorded_seq")


def lineage_of(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds the lineage of each row's windowset, which is the windowset itself where that is unknown."""
    at = sets.select(F.col("windowset_id").alias("_w"), F.col("lineage_id").alias("_lin"))
    return rows.join(at, F.col("windowset_id") == F.col("_w"), "left").withColumn("lineage", F.coalesce("_lin", "windowset_id")).drop("_w", "_lin")


NEW_LINEAGE = {"k_cumulative": 0, "months": [], "one_shot": {}, "budget": None}


def lineage_step(state: dict, kind: str, e: dict) -> dict:
    """One transition of a lineage: what its budget allows, which windows are spent, in which months it was read.

    ``budget`` sets the grant; consumption starts anew with another generation. ``request`` takes a slot. ``void`` gives the slot and the
    one-shot windows back, but neither the running count, the month nor an alarm that was raised.
    """
    b = state["budget"]
    if kind == "budget":
        used = b["consumed"] if b and b["generation"] == e["generation"] else 0
        return state | {"budget": {"generation": e["generation"], "initial": e["initial"], "alarm_at": e["alarm_at"], "diagnostic_at": e["diagnostic_at"], "consumed": used, "remaining": max(0, e["initial"] - used), "alarm": False, "diagnostic": False}}
    if kind == "request":
        if b:
            left = max(0, b["remaining"] - 1)
            b = b | {"consumed": b["consumed"] + 1, "remaining": left, "alarm": left <= b["alarm_at"], "diagnostic": left <= b["diagnostic_at"]}
        return state | {"budget": b, "k_cumulative": state["k_cumulative"] + 1, "months": [*state["months"], e["month"]], "one_shot": state["one_shot"] | dict.fromkeys(e["keys"], e["readout_id"])}
    if kind == "void":
        if b and e["readout"]:
            b = b | {"remaining": b["remaining"] + 1, "consumed": max(0, b["consumed"] - 1)}
        return state | {"budget": b, "one_shot": {k: v for k, v in state["one_shot"].items() if v != e["readout_id"]}}
    return state


def budget_events(log: DataFrame) -> DataFrame:
    """(seq, lineage, generation, initial, alarm_at, diagnostic_at) of the documents that grant a lineage its looks."""
    docs = constants_all(log).where("series = 'look_budget'")
    at = lambda k: F.get(F.filter("entries", lambda e: e["key"] == k), F.lit(0))["value"]
    whole = lambda k, d: F.coalesce(at(k).try_cast("long"), F.lit(d).cast("long"))
    return docs.select("seq", at("lineage_id").alias("lineage"), whole("generation", 1).alias("generation"), whole("initial_budget", 0).alias("initial"), whole("alarm_remaining", 0).alias("alarm_at"), whole("diagnostic_remaining", 0).alias("diagnostic_at")).where("lineage <> ''")


def lineage_events(log: DataFrame, sets: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The events of each lineage that its slots depend on: budgets, requests for a readout, voids of one, and registrations.

    A void is of its readout's last request until then, which may be one of an earlier range: ``before`` is the ``readout_base`` of that.
    """
    none, text, keys = F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    budgets = budget_events(log).select("seq", "lineage", F.lit("budget").alias("kind"), "generation", "initial", "alarm_at", "diagnostic_at", text.alias("month"), text.alias("readout_id"), keys.alias("keys"), F.lit(False).alias("readout"))
    mine = lineage_of(parsed(log, "readout.request", "readout_id string, windowset_id string, scope_id string, purpose string"), sets).where("purpose = 'readout' OR purpose IS NULL")
    certs = sets.select(F.col("windowset_id").alias("_w"), F.transform(F.filter("windows", lambda w: w["role"] == "forward_certifier"), lambda w: w["wiv_id"]).alias("wivs"))
    mine = mine.join(certs, F.col("windowset_id") == F.col("_w"), "left")
    spent = F.transform(F.coalesce("wivs", F.array().cast("array<string>")), lambda w: F.concat(w, F.lit("::"), F.col("scope_id")))
    requests = mine.select("seq", "lineage", F.lit("request"), none, none, none, none, F.date_format("ts", "yyyy-MM"), "readout_id", spent, F.lit(True))
    asked = parsed(log, "readout.request", "readout_id string, windowset_id string, purpose string").select("readout_id", "seq", F.struct("windowset_id", "purpose").alias("q"))
    if before is not None:
        asked = asked.unionByName(before.where("from_seq IS NOT NULL").select("readout_id", F.col("from_seq").alias("seq"), F.struct("windowset_id", "purpose").alias("q")))
    gone = parsed(log, "readout.void", "readout_id string").select("readout_id", "seq", F.lit(None).cast("struct<windowset_id:string,purpose:string>").alias("q"))
    upto = F.last("q", ignorenulls=True).over(Window.partitionBy("readout_id").orderBy("seq"))
    gone = asked.unionByName(gone).withColumn("_of", upto).where("q IS NULL AND _of IS NOT NULL").select("seq", "readout_id", "_of.*")
    voids = lineage_of(gone, sets).select("seq", "lineage", F.lit("void"), none, none, none, none, text, "readout_id", keys, F.coalesce(F.col("purpose") == "readout", F.lit(True)))
    starts = parsed(log, "windowset.register", "windowset_id string").join(sets.select("windowset_id", "lineage_id"), "windowset_id").select("seq", "lineage_id", F.lit("start"), none, none, none, none, text, text, keys, F.lit(False))
    return budgets.union(requests).union(voids).union(starts)


SLOTS = "lineage string, k_cumulative long, generation long, initial long, consumed long, remaining long, alarm_at long, diagnostic_at long, alarm boolean, diagnostic boolean"


def slots(events: DataFrame, before: DataFrame | None = None, run: Scratch | None = None) -> DataFrame:
    """SLOTS of each lineage after its events (``lineage_events``), which go on from those of an earlier range.

    Taking a slot is r -> max(0, r - 1) and giving it back r -> r + 1. With S the running sum of these steps, any run of them is r -> S + max(r, -min S), the least over
    requests; what is consumed is c -> -S + max(c, max S), the greatest over voids. So no event waits for another: running sums are made over ranges of a
    lineage, and a lineage is a few sums. Only its budgets, a document each, are looked at in order: consumption goes on through those that keep the generation.
    """
    spark = events.sparkSession
    before = spark.createDataFrame([], SLOTS) if before is None else before
    prior = before.select(F.col("lineage").alias("_l"), *[F.col(c).alias(f"p_{c}") for c in before.columns if c != "lineage"])
    grants = events.where("kind = 'budget'").select("lineage", "seq", "generation", "initial", "alarm_at", "diagnostic_at").join(prior.select("_l", "p_generation"), F.col("lineage") == F.col("_l"), "left")
    last = F.coalesce(F.lag("generation").over(Window.partitionBy("lineage").orderBy("seq")), "p_generation")
    grants = grants.withColumn("anew", ~F.coalesce(last == F.col("generation"), F.lit(False)))
    grants = grants.groupBy("lineage").agg(F.max(F.when(F.col("anew"), F.col("seq"))).alias("run_seq"), F.max("seq").alias("grant_seq"), F.max_by(F.struct("generation", "initial", "alarm_at", "diagnostic_at"), "seq").alias("g"))
    step = F.when(F.col("kind") == "request", -1).when((F.col("kind") == "void") & F.col("readout"), 1).otherwise(0).cast("long")
    moves = events.where("kind <> 'budget'").select("lineage", "seq", "kind", step.alias("step"))
    moves = moves.join(grants.select(F.col("lineage").alias("_g"), "run_seq", "grant_seq"), F.col("lineage") == F.col("_g"), "left").drop("_g")
    moves = running(moves, ["lineage"], ["seq"], "step", run=run)  # adds total, the running sum
    is_req, is_void = F.col("kind") == "request", F.col("step") > 0
    in_run, past = F.coalesce(F.col("seq") > F.col("run_seq"), F.lit(True)), F.coalesce(F.col("seq") > F.col("grant_seq"), F.lit(True))
    early = in_run & ~past
    of = lambda w, x: F.when(w, x)
    t, zero = F.col("total"), F.lit(0).cast("long")
    sums = moves.groupBy("lineage").agg(
        F.count_if(is_req).alias("k"),
        F.coalesce(F.sum(of(~in_run, F.col("step"))), zero).alias("ahead"),  # S where the generation began
        F.coalesce(F.sum(of(~past, F.col("step"))), zero).alias("granted"),  # S at the last budget
        F.coalesce(F.sum("step"), zero).alias("end"),
        F.max(of(early & is_void, t)).alias("void_early"),
        F.max(of(in_run & is_void, t)).alias("void_run"),
        F.min(of(past & is_req, t)).alias("req_past"),
        F.max_by("total", of(past & is_req, F.col("seq"))).alias("at_req"),
    )
    every = events.select("lineage").unionByName(before.select("lineage")).distinct()
    x = every.join(sums.withColumnRenamed("lineage", "_m"), F.col("lineage") == F.col("_m"), "left").join(grants.withColumnRenamed("lineage", "_g"), F.col("lineage") == F.col("_g"), "left").join(prior, F.col("lineage") == F.col("_l"), "left").na.fill(0, ["k", "ahead", "granted", "end"])
    fresh, given = F.col("run_seq").isNotNull(), F.col("grant_seq").isNotNull()
    begun = F.when(fresh, zero).otherwise(F.coalesce("p_consumed", zero))
    used = lambda upto, most: F.col("ahead") - upto + F.greatest(begun, F.coalesce(most - F.col("ahead"), begun))
    has = given | F.col("p_remaining").isNotNull()
    start = F.when(given, F.greatest(zero, F.col("g.initial") - used(F.col("granted"), F.col("void_early")))).otherwise(F.col("p_remaining"))
    left = lambda at: at - F.col("granted") + F.greatest(start, F.coalesce(F.col("granted") - F.col("req_past"), start))
    pick = lambda c: F.coalesce(F.col(f"g.{c}"), F.col(f"p_{c}"))
    flag = lambda at, c: F.when(has, F.when(F.col("at_req").isNotNull(), left(F.col("at_req")) <= pick(at)).when(given, F.lit(False)).otherwise(F.col(f"p_{c}")))
    return x.select(
        "lineage",
        (F.coalesce("p_k_cumulative", zero) + F.col("k")).alias("k_cumulative"),
        pick("generation").alias("generation"),
        pick("initial").alias("initial"),
        F.when(has, used(F.col("end"), F.col("void_run"))).alias("consumed"),
        F.when(has, left(F.col("end"))).alias("remaining"),
        pick("alarm_at").alias("alarm_at"),
        pick("diagnostic_at").alias("diagnostic_at"),
        flag("alarm_at", "alarm").alias("alarm"),
        flag("diagnostic_at", "diagnostic").alias("diagnostic"),
    )


def shots(events: DataFrame) -> DataFrame:
    """(lineage, key, seq, readout_id): the last request that took each one-shot window."""
    rows = events.where("kind = 'request'").select("lineage", "seq", "readout_id", F.explode("keys").alias("key"))
    return rows.groupBy("lineage", "key").agg(F.max_by(F.struct("seq", "readout_id"), "seq").alias("l")).select("lineage", "key", "l.*")


def shot_voids(events: DataFrame) -> DataFrame:
    """(lineage, readout_id, seq): the last void of each readout."""
    return events.where("kind = 'void'").groupBy("lineage", "readout_id").agg(F.max("seq").alias("seq"))


def months(events: DataFrame) -> DataFrame:
    """(lineage, month) in which a lineage was read."""
    return events.where("kind = 'request'").select("lineage", "month").distinct()


def lineages(slots: DataFrame, shots: DataFrame, shot_voids: DataFrame, months: DataFrame) -> DataFrame:
    """Slots, months (in order, each once) and one-shot windows of each lineage."""
    v = shot_voids.select(F.col("lineage").alias("_l"), F.col("readout_id").alias("_r"), F.col("seq").alias("_v"))
    live = shots.join(v, (F.col("lineage") == F.col("_l")) & F.col("readout_id").eqNullSafe(F.col("_r")), "left").where("_v IS NULL OR _v < seq")
    none = F.array().cast("array<string>")
    taken = live.groupBy(F.col("lineage").alias("_s")).agg(F.array_sort(F.collect_set("key")).alias("_shots"))
    read = months.groupBy(F.col("lineage").alias("_m")).agg(F.array_sort(F.collect_set("month")).alias("_months"))
    out = slots.join(taken, F.col("lineage") == F.col("_s"), "left").join(read, F.col("lineage") == F.col("_m"), "left")
    return out.select("lineage", "k_cumulative", F.coalesce("_months", none).alias("months"), F.coalesce("_shots", none).alias("one_shot"), *[c for c in slots.columns if c not in ("lineage", "k_cumulative")])


def spend_rows(log: DataFrame, events: DataFrame) -> DataFrame:
    """(wiv_id, seq, spent): what last told of each window, a request or a carry-over."""
    carried = parsed(log, "windowset.supersede", "carryover array<struct<wiv_id:string,spends:array<string>>>").select("seq", F.explode("carryover").alias("c")).where("c.spends IS NOT NULL").select("seq", "c.wiv_id", (F.size("c.spends") > 0).alias("spent"))
    asked = events.where("kind = 'request'").select("seq", F.explode("keys").alias("_k")).select("seq", F.substring_index("_k", "::", 1).alias("wiv_id"), F.lit(True).alias("spent"))
    return last_by(carried.unionByName(asked), "wiv_id", "spent")


def spends(spend_rows: DataFrame) -> DataFrame:
    """Windows (wiv_id) that are spent: by a request since the last carry-over, or by what that carried over."""
    return spend_rows.where("spent").select("wiv_id")


def constants_all(log: DataFrame) -> DataFrame:
    """Every version of every constants document."""
    reg = parsed(log, "constants.register", f"series string, doc_id string, version bigint, entries {ENTRIES}").select("seq", "series", "doc_id", "version", "entries", F.lit("register").alias("how"))
    return reg.union(parsed(log, "constants.amend", f"series string, new_doc_id string, version bigint, entries {ENTRIES}").select("seq", "series", "new_doc_id", "version", "entries", F.lit("amend")))


def constants(log: DataFrame) -> DataFrame:
    return last_by(constants_all(log), "series", "doc_id", "version", "entries")


AUTONOMY = "autonomy_constants"


def _entry(constants: DataFrame, key: Column) -> DataFrame:
    return constants.where(F.col("series") == AUTONOMY).select(F.posexplode("entries").alias("_i", "e")).where(key)


def allowlist(constants: DataFrame) -> DataFrame:
    """(actor, types): lists that the autonomy constants in force give an actor (``loop`` for all loops) in place of the fixed one. Of several the first counts; what is no list doesn't."""
    rows = _entry(constants, F.col("e.key").startswith("allowlist:")).select("_i", F.substring_index("e.key", "allowlist:", -1).alias("actor"), F.from_json("e.value", "array<string>").alias("types"))
    return rows.where("types IS NOT NULL AND (actor = 'loop' OR actor LIKE '%:%')").groupBy("actor").agg(F.min_by("types", "_i").alias("types"))


def velocity(constants: DataFrame, slots: DataFrame) -> DataFrame:
    """(lineage, n, cap) where the autonomy constants in force have a cap on readouts; no event raises a lineage's count in the window, so n is 0."""
    cap = _entry(constants, (F.col("e.key") == "readout_velocity") & ~F.coalesce("e.unknown", F.lit(False))).groupBy().agg(F.min_by("e.value", "_i").try_cast("double").alias("cap")).where("cap IS NOT NULL")
    return slots.select("lineage", F.lit(0).cast("long").alias("n")).join(F.broadcast(cap))  # one row


def suspended(log: DataFrame) -> DataFrame:
    """(key, suspended): whether the last amendment of the channel's flag suspends it."""
    e = constants_all(log).where("how = 'amend'").select("seq", F.posexplode("entries").alias("_i", "e")).where(F.col("e.key") == CHANNEL)
    return e.groupBy(F.col("e.key").alias("key")).agg((F.max_by("e.value", F.struct("seq", "_i")).eqNullSafe(F.lit(SUSPENDED))).alias("suspended"))


@base(newest("one"))
def tip(log: DataFrame) -> DataFrame:
    """The last event: its seq and, where the log has hashes, its hash."""
    sha = F.col("event_hash") if "event_hash" in log.columns else F.lit(None).cast("string")
    return last_by(log.select("seq", sha.alias("event_hash"), F.lit(1).alias("one")), "one", "event_hash")


@base(appended)
def seen_ids(log: DataFrame) -> DataFrame:
    return log.select("event_id")


for _f, _key in ((snapshots, "snapshot_id"), (features, "feature_id"), (featuresets, "featureset_id"), (families, "family_id"), (artifacts, "artifact_id"), (scorecards, "key_hash"), (constants, "series"), (suspended, "key")):
    _own(_f, newest(_key))
_own(kill_list, appended)


def _ended(armed: DataFrame, log: DataFrame) -> DataFrame:
    """Armed conditionals with what ended them in the log."""
    off = parsed(log, "conditional.disarm", "cond_id string").select(F.col("seq").alias("_end"), F.col("cond_id").alias("_c"))
    off = armed.join(off, (F.col("cond_id") == F.col("_c")) & (F.col("_end") > F.col("seq"))).select("event_id", "_end", F.lit("disarmed").alias("_how"))
    cites = log.where("actor = 'scheduler:daemon'").select(F.col("seq").alias("_end"), F.col("type").alias("_t"), F.explode("cites").alias("_c"))
    fired = armed.join(cites, (F.col("event_id") == F.col("_c")) & (F.col("_t") == F.col("event_body.type")) & (F.col("_end") > F.col("seq"))).select("event_id", "_end", F.lit("fired"))
    end = off.union(fired).groupBy("event_id").agg(F.min_by("_how", "_end").alias("_how"), F.min("_end").alias("ended_seq"))
    return armed.join(end, "event_id", "left").select("event_id", "seq", "cond_id", "kind", "predicate", "event_body", F.coalesce("_how", F.lit("armed")).alias("status"), "ended_seq")


def conditionals(log: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Armed conditionals by the id of the arming event, with what ended them: the first disarming of their name, or the first
    event of the scheduler that cites them and has their body's type. Those still armed ``before`` may be ended by the log."""
    armed = parsed(log, "conditional.arm", "cond_id string, kind string, predicate struct<name:string,version:string,params:string>, event_body struct<type:string,payload:string>")
    armed = armed.select("event_id", "seq", "cond_id", "kind", "predicate", "event_body")
    if before is None:
        return _ended(armed, log)
    return before.where("status <> 'armed'").unionByName(_ended(armed.unionByName(before.where("status = 'armed'").select(*armed.columns)), log))


@base(restarted("cycle_id", any_of=("closed",), total=("n_dispatched",), last=("stage0_valid",)))
def cycle_base(log: DataFrame) -> DataFrame:
    opened = parsed(log, "cycle.open", "cycle_id string, dial_budget_rule_version string, score_fn_version string, promotion_predicate_version string, cost_model_version string")
    none = F.lit(None).cast("array<string>")
    marks = parsed(log, "cycle.close", "cycle_id string").select("seq", "cycle_id", F.lit("close").alias("mark"), none.alias("valid"))
    sent = parsed(log, "stage.dispatch", "cycle_id string, job_kind string, inputs struct<stage0_valid:array<string>>")
    marks = marks.union(sent.select("seq", "cycle_id", F.lit("dispatch"), F.when((F.col("job_kind") == "stage0_enumerate") & (F.size("inputs.stage0_valid") > 0), F.col("inputs.stage0_valid"))))
    return started(opened, marks, "cycle_id", "score_fn_version", "promotion_predicate_version", "cost_model_version", "dial_budget_rule_version", closed=F.bool_or(F.col("mark") == "close"), n_dispatched=F.count_if(F.col("mark") == "dispatch"), stage0_valid=F.max_by("valid", F.when(F.col("valid").isNotNull(), F.col("seq"))))


def cycles(cycle_base: DataFrame) -> DataFrame:
    """Cycles with their pinned versions, status, configs that must be covered and first-stage scorecards, since they were last opened."""
    out = cycle_base.withColumnRenamed("from_seq", "seq").withColumns({"status": F.when(F.col("closed"), "closed").otherwise("open"), "n_dispatched": F.coalesce("n_dispatched", F.lit(0).cast("long"))})
    return out.select("cycle_id", "seq", "score_fn_version", "promotion_predicate_version", "cost_model_version", "dial_budget_rule_version", "n_dispatched", "stage0_valid", "status")


@base(newest("one"))
def cycle_marks(log: DataFrame) -> DataFrame:
    marks = parsed(log, "cycle.open", "cycle_id string").select("seq", "cycle_id").union(parsed(log, "cycle.close", "cycle_id string").select("seq", F.lit(None).cast("string")))
    return last_by(marks.withColumn("one", F.lit(1)), "one", "cycle_id")


def open_cycle(cycle_marks: DataFrame) -> DataFrame:
    """The cycle that is open: one row, null if the last mark closed one, or before any."""
    return cycle_marks.groupBy().agg(F.max_by("cycle_id", "seq").alias("open_cycle"))


@base(newest("cycle_id", "config_key"))
def covered_rows(log: DataFrame) -> DataFrame:
    cards = parsed(log, "scorecard.emit", "scorecard struct<eval_key:struct<config_key:string,stage:int>>, cycle_id string").where("scorecard.eval_key.stage = 1")
    return cards.groupBy("cycle_id", F.col("scorecard.eval_key.config_key").alias("config_key")).agg(F.max("seq").alias("seq"))


def covered(covered_rows: DataFrame, cycle_base: DataFrame) -> DataFrame:
    """(cycle_id, config_key) of first-stage scorecards that were emitted while their cycle was known, since its last opening."""
    return covered_rows.join(cycle_base.select("cycle_id", "from_seq"), "cycle_id").where("seq > from_seq").select("cycle_id", "config_key")


def clause_stamps(log: DataFrame) -> DataFrame:
    """The last stamp of each candidate's clause."""
    rows = parsed(log, "cert.clause_stamp", "candidate_id string, clause string, stamp string")
    return rows.groupBy("candidate_id", "clause").agg(F.max_by("stamp", "seq").alias("stamp"))


_own(clause_stamps, newest("candidate_id", "clause"))


CLAUSES = ["w4_per_blob", "regime_consistency", "degradation", "persistence", "seed_survival"]


def gate_green(stamped: DataFrame) -> DataFrame:
    """Candidates all of whose five clauses are measured to pass or authorised before."""
    ok = F.col("stamp").isin("measured_pass", "pre_authorized") & F.col("clause").isin(*CLAUSES)
    return stamped.groupBy("candidate_id").agg(F.count_if(ok).alias("_n")).where(F.col("_n") == len(CLAUSES)).select("candidate_id")


@base(appended)
def incumbent_events(log: DataFrame) -> DataFrame:
    """(lineage_id, seq, who, push): displacements and revocations."""
    rows = parsed(log, "cert.displace", "lineage_id string, new_incumbent string").select("lineage_id", "seq", F.col("new_incumbent").alias("who"), F.lit(True).alias("push"))
    return rows.union(parsed(log, "cert.revoke", "lineage_id string, candidate_id string").select("lineage_id", "seq", "candidate_id", F.lit(False)))


def stacked(pops: list[str], pushes: list[str], who: str, push: bool) -> None:
    """One event on the summary of a range: what it pops off the stack that it finds (each only if it stands on top), then what it leaves on it."""
    if push:
        pushes.append(who)
    elif not pushes:
        pops.append(who)
    elif pushes[-1] == who:
        pushes.pop()


def stack_ranges(rows: DataFrame, by: str, per: int, run: Scratch | None = None) -> DataFrame:
    """(by, range, pops, pushes) of every ``per`` events of each stack."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        pops: list[str] = []
        pushes: list[str] = []
        for who, push in g.sort_values("place")[["who", "push"]].itertuples(index=False):
            stacked(pops, pushes, who, push)
        return pd.DataFrame({by: [g[by].iloc[0]], "range": [g["range"].iloc[0]], "pops": [pops], "pushes": [pushes]})

    cells = placed(rows, [by], ["seq"], run).withColumn("range", F.floor(F.col("place") / per).cast("long"))
    return cells.select(by, "range", "place", "who", "push").groupBy(by, "range").applyInPandas(one, f"{by} {dict(rows.dtypes)[by]}, range long, pops array<string>, pushes array<string>")


def incumbents(incumbent_events: DataFrame, per: int = 4096, run: Scratch | None = None) -> DataFrame:
    """The incumbent of each lineage: displacements push, the revocation of the one that stands restores the one before.

    A range of ``per`` events is folded by itself to the revocations that reach below it and the displacements that stand at its end; ranges are composed in pairs of neighbours, a round for
    each doubling, so a lineage's events pass through many tasks. What stands on a stack is its state and has the size that it has.
    """
    run = run or Scratch(incumbent_events.sparkSession, "incumbents")
    one, n = run.table("ranges", stack_ranges(incumbent_events, "lineage_id", per, run)), 0

    def join(g: pd.DataFrame) -> pd.DataFrame:
        pops, pushes = [], []
        for r in g.sort_values("range").itertuples(index=False):
            for who in r.pops:
                stacked(pops, pushes, who, False)
            pushes.extend(r.pushes)
        return pd.DataFrame({"lineage_id": [g["lineage_id"].iloc[0]], "range": [g["range"].iloc[0] // 8], "pops": [pops], "pushes": [pushes]})

    while one.where("range > 0").limit(1).count():
        n += 1
        one = run.table(f"joined-{n}", one.withColumn("_to", F.floor(F.col("range") / 8)).groupBy("lineage_id", "_to").applyInPandas(lambda g: join(g.drop(columns="_to")), one.schema))
    depth = F.size("pushes")
    return one.select("lineage_id", F.when(depth > 0, F.element_at("pushes", -1)).alias("incumbent"), F.greatest(F.lit(0), depth - 1).cast("long").alias("n_before"))


@base(appended)
def proposals(log: DataFrame) -> DataFrame:
    return parsed(log, "rules.propose", "rule_kind string, proposed string").select("seq", "event_id", "rule_kind", "proposed")


@base(appended)
def rule_events(log: DataFrame) -> DataFrame:
    adopt = parsed(log, "rules.adopt", "proposal_ref string, rule_kind string, adopted_version string").select("seq", "rule_kind", F.lit(True).alias("adopts"), F.col("adopted_version").alias("version"), "proposal_ref")
    return adopt.union(parsed(log, "rules.revert", "rule_kind string, to_version string").select("seq", "rule_kind", F.lit(False), "to_version", F.lit(None).cast("string")))


def rules(rule_events: DataFrame, proposals: DataFrame) -> DataFrame:
    """(rule_kind, version, body): the live rule. An adoption takes its proposal's body; a reversion restores the last one of that version that was live before."""
    made = proposals.select(F.col("event_id").alias("_e"), F.col("rule_kind").alias("_k"), F.col("seq").alias("_s"), "proposed")
    rows = rule_events.join(made, (F.col("proposal_ref") == F.col("_e")) & (F.col("rule_kind") == F.col("_k")) & (F.col("_s") < F.col("seq")), "left")
    rows = rows.select("seq", "rule_kind", "adopts", "version", F.when(F.col("adopts"), F.coalesce("proposed", F.lit("{}"))).alias("body"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        live, before = None, {}
        for adopts, version, body in g.sort_values("seq")[["adopts", "version", "body"]].itertuples(index=False):
            if adopts:
                if live:
                    before[live[0]] = live
                live = (version, body)
            else:
                live = before.get(version, live)
        return pd.DataFrame({"rule_kind": [g["rule_kind"].iloc[0]], "version": [live and live[0]], "body": [live and live[1]], "n_before": [len(before)]})

    return rows.groupBy("rule_kind").applyInPandas(run, "rule_kind string, version string, body string, n_before long")


def placebo_history(readouts: DataFrame, sets: DataFrame) -> DataFrame:
    """(lineage, seq, readout_id, class, voided) of recorded readouts; rehearsals and postmortems leave no mark."""
    rows = lineage_of(readouts.where("recorded AND (purpose = 'readout' OR purpose IS NULL)"), sets)
    return rows.select("lineage", F.col("recorded_seq").alias("seq"), "readout_id", F.col("placebo").alias("class"), "voided")


def suspend_alarm(marks: DataFrame, flags: DataFrame, span: int = 12, at: int = 3) -> DataFrame:
    """(lineage, n_l1, l2, alarm): any L2 ever, or ``at`` L1 among the last ``span`` marks that aren't void, or a flag (lineage) of a void, contested
    or forensically failed readout."""
    w = Window.partitionBy("lineage").orderBy(F.col("seq").desc())
    live = marks.where("NOT voided").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= span)
    n1 = live.groupBy("lineage").agg(F.count_if(F.col("class") == "L1").alias("_n1"))
    out = marks.groupBy("lineage").agg(F.bool_or(F.col("class") == "L2").alias("_l2")).join(n1, "lineage", "left")
    out = out.join(flags.select("lineage").distinct().withColumn("_f", F.lit(True)), "lineage", "full")
    n, l2 = F.coalesce("_n1", F.lit(0).cast("long")), F.coalesce("_l2", F.lit(False))
    return out.select("lineage", n.alias("n_l1"), l2.alias("l2"), (l2 | (n >= at) | F.coalesce("_f", F.lit(False))).alias("alarm"))


def cards(log: DataFrame) -> DataFrame:
    return last_by(parsed(log, "card.emit", "card_id string, card_type string, payload string"), "card_id", "card_type", "payload")


def notes(log: DataFrame) -> DataFrame:
    return parsed(log, "note.record", "title string, body string").select("seq", "event_id", "title", "body")


_own(cards, newest("card_id"))
_own(notes, appended)


def table_hash(df: DataFrame) -> DataFrame:
    """(n, lanes): a hash of the rows of a table whatever their order. Four lanes of each row's sha256 are added up, so parts combine before the shuffle."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    lane = lambda i: F.sum(F.conv(F.substring("_h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).cast("string")
    return df.select(row.alias("_h")).agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", *[lane(i) for i in range(4)]).alias("lanes"))


def state_hash(tables: dict[str, DataFrame]) -> str:
    """sha256 over the hashes of projections: equal states have equal hashes, live or replayed."""
    whole = {name: list(table_hash(tables[name]).first()) for name in sorted(tables)}
    return hashlib.sha256(canonical(whole)).hexdigest()


#: Bases that are folded from the events of lineages: how each goes on from the one before.
FOLDS: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame, DataFrame], DataFrame]]] = {
    "shots": (shots, newest("lineage", "key")),
    "shot_voids": (shot_voids, newest("lineage", "readout_id")),
    "months": (months, newest("lineage", "month")),
}
#: Projections and what they are finished from.
FINISHED: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "blocks": (blocks, ("block_base",)),
    "batches": (batches, ("batch_base",)),
    "stamps": (stamps, ("stamped", "registered")),
    "populations": (populations, ("population_base", "stamped", "artifacts")),
    "windowsets": (windowsets, ("windowset_rows", "windowset_over")),
    "readouts": (readouts, ("readout_base",)),
    "lineages": (lineages, ("slots", "shots", "shot_voids", "months")),
    "spends": (spends, ("spend_rows",)),
    "cycles": (cycles, ("cycle_base",)),
    "open_cycle": (open_cycle, ("cycle_marks",)),
    "covered": (covered, ("covered_rows", "cycle_base")),
    "incumbents": (incumbents, ("incumbent_events",)),
    "rules": (rules, ("rule_events", "proposals")),
    "placebo_history": (placebo_history, ("readouts", "windowsets")),
    "allowlist": (allowlist, ("constants",)),
    "velocity": (velocity, ("constants", "slots")),
}
CARRIED = sorted([*BASES, *FOLDS, "slots", "spend_rows", "conditionals"])


class State:
    """The projections of a log by name, each made when it is first asked for; ``given`` ones take their place.

    With ``carried``, a function from a base's name to its table as of some seq, ``log`` has only the events since.
    """

    def __init__(self, log: DataFrame | None = None, carried: Callable[[str], DataFrame] | None = None, **given: DataFrame):
        self.held, self.carried, self.log = dict(given), carried, None
        if log is not None:
            # Written once, as every projection reads it.
            self.run = Scratch(log.sparkSession, "state")
            fresh = first_of_each(log)
            if carried:
                fresh = fresh.join(carried("seen_ids"), "event_id", "left_anti").select(*log.columns)
            self.log = self.run.table("log", fresh)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name in ("held", "run"):
            raise AttributeError(name)
        if name not in self.held:
            made = self._make(name)
            if name in ("slots", "incumbents"):  # asked for often, and dear to make anew
                made = self.run.table(name, made)
            self.held[name] = made
        return self.held[name]

    def _make(self, name: str) -> DataFrame:
        if name in FINISHED and self.log is not None:
            f, needs = FINISHED[name]
            if name == "incumbents":
                return f(self.incumbent_events, run=self.run)
            return f(*[getattr(self, n) for n in needs])
        if self.log is None:
            raise AttributeError(name)
        old = self.carried(name) if self.carried and name in CARRIED else None
        if name == "events_of_lineages":
            return lineage_events(self.log, self.windowsets, self.carried("readout_base") if self.carried else None)
        if name == "slots":
            return slots(self.events_of_lineages, old, self.run)
        if name == "conditionals":
            return conditionals(self.log, old)
        if name in FOLDS:
            make, merge = FOLDS[name]
            new = make(self.events_of_lineages)
        elif name == "spend_rows":
            new, merge = spend_rows(self.log, self.events_of_lineages), newest("wiv_id")
        elif name in BASES:
            new, merge = BASES[name].make(self.log), BASES[name].merge
        elif name in globals():
            return globals()[name](self.log)
        else:
            raise AttributeError(name)
        return new if old is None else merge(old, new)

    def maybe(self, name: str) -> DataFrame | None:
        """A projection, or None if it is neither given nor can be made of a log."""
        return getattr(self, name) if name in self.held or self.log is not None else None

    def seen(self) -> DataFrame:
        return self.held["seen"] if "seen" in self.held else self.seen_ids

    def close(self) -> None:
        """Delete what the state wrote; its projections can't be read afterwards."""
        if self.log is not None:
            self.run.drop()
