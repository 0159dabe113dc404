"""Folds of an append-only event log into state, admission rules, spends and the hash chain.

A log has seq, event_id, type, lineage, ts, value. State is a query over the log, not a loop: upserts are latest-by-seq
aggregates, budgets are sums since the last registration. Only what clamps or restores (stacks, slots) is folded row by row, a lineage at a time.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.scalar import canonical

TYPES = {"signup": "register", "purchase": "request", "view": "record", "error": "void", "click": "note"}


def log_of(events: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[F.col("event_type")]
    return events.select(F.col("event_id").alias("seq"), F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("event_id"), kind.alias("type"), F.col("user_id").alias("lineage"), "ts", "value")


def first_of_each(log: DataFrame) -> DataFrame:
    """Replays are idempotent: of rows with one event_id the first counts. A min_by combines before the shuffle."""
    one = log.groupBy("event_id").agg(F.min_by(F.struct(*log.columns), "seq").alias("e"))
    return one.select("e.*")


def latest(log: DataFrame, by: str = "lineage") -> DataFrame:
    """The last event of each key."""
    return log.groupBy(by).agg(F.max_by(F.struct("seq", "type", "value"), "seq").alias("e"), F.count(F.lit(1)).alias("n_events")).select(by, "e.*", "n_events")


def lifecycle(log: DataFrame) -> DataFrame:
    """Whether a key was ever frozen, by type, and the value it was last registered with."""
    reg = F.when(F.col("type") == "register", F.col("value"))
    return log.groupBy("lineage").agg(F.bool_or(F.col("type") == "request").alias("requested"), F.bool_or(F.col("type") == "void").alias("voided"), F.max_by(reg, F.when(reg.isNotNull(), F.col("seq"))).alias("registered_value"))


def budget(log: DataFrame, grant: int = 8) -> DataFrame:
    """What is left of each lineage's budget: ``grant`` at the last registration, less requests since then."""
    since = log.where("type = 'register'").groupBy("lineage").agg(F.max("seq").alias("from_seq"))
    used = log.where("type = 'request'").join(since, "lineage").where("seq > from_seq").groupBy("lineage").agg(F.count(F.lit(1)).alias("used"))
    return since.join(used, "lineage", "left").select("lineage", F.coalesce("used", F.lit(0)).alias("used"), F.greatest(F.lit(0), grant - F.coalesce("used", F.lit(0))).alias("remaining"))


def append_lists(log: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` notes of each lineage, in order, as text."""
    w = Window.partitionBy("lineage").orderBy("seq")
    notes = log.where("type = 'note'").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return notes.groupBy("lineage").agg(F.array_join(F.transform(F.sort_array(F.collect_list("seq")), lambda s: s.cast("string")), ",").alias("notes"))


def stack_step(stack: list, kind: str, seq: int) -> list:
    """One transition of the incumbent stack: a request displaces, a void restores the one before."""
    return [*stack, seq] if kind == "request" else stack[:-1] if kind == "void" else stack


def incumbents(log: DataFrame) -> DataFrame:
    """lineage, incumbent (seq), depth after all displacements and revocations, in order."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        stack: list = []
        for kind, seq in g.sort_values("seq")[["type", "seq"]].itertuples(index=False):
            stack = stack_step(stack, kind, seq)
        return pd.DataFrame({"lineage": [g["lineage"].iloc[0]], "incumbent": pd.array([stack[-1] if stack else None], "Int64"), "depth": [len(stack)]})

    return log.where("type IN ('request', 'void')").select("lineage", "type", "seq").groupBy("lineage").applyInPandas(run, "lineage long, incumbent long, depth long")


def conditionals(log: DataFrame) -> DataFrame:
    """Armed conditionals (registrations) with the first later request of the lineage (fired) or void (disarmed), whichever is first."""
    w = Window.partitionBy("lineage").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    end = F.when(F.col("type").isin("request", "void"), F.struct("seq", "type"))
    rows = log.withColumn("e", F.first(end, ignorenulls=True).over(w)).where("type = 'register'")
    return rows.select("lineage", "seq", F.coalesce(F.when(F.col("e.type") == "request", "fired").when(F.col("e.type") == "void", "disarmed"), F.lit("armed")).alias("status"), F.col("e.seq").alias("ended_seq"))


def placebo_class(z: Column, gate: Column, extended: Column, at_shot: Column) -> Column:
    """none, L1 or L2, by strict comparisons; L2 is tested first, and nothing is told without both numbers."""
    return F.when(z.isNull() | gate.isNull(), "none").when((z > extended) | at_shot, "L2").when(z > gate, "L1").otherwise("none")


def spend_code(purpose: Column, spent: Column, month_used: Column, velocity: Column, cap: Column, remaining: Column) -> Column:
    """The first objection to a spend, else OK."""
    return F.when(purpose.isin("postmortem", "rehearsal"), "OK").when(spent, "WINDOWS_SPENT").when(F.coalesce(month_used, F.lit(False)), "EMISSION_CAP").when(F.coalesce(velocity >= cap, F.lit(False)), "VELOCITY_EXCEEDED").when(remaining.isNull() | (remaining <= 0), "LOOK_BUDGET_ZERO").otherwise("OK")


def spend_checks(log: DataFrame, grant: int = 8, cap: int = 6) -> DataFrame:
    """The code of every request, from what its lineage's log holds before it: earlier requests of the window (quarter), of the month, of the last ``cap`` rows, and the budget."""
    lin = Window.partitionBy("lineage").orderBy("seq")
    before = lin.rowsBetween(Window.unboundedPreceding, -1)
    is_req = (F.col("type") == "request").cast("long")
    gen = F.sum(F.when(F.col("type") == "register", 1).otherwise(0)).over(lin)
    rows = log.withColumns({"gen": gen, "month": F.date_format("ts", "yyyy-MM"), "req": is_req})
    same_month = Window.partitionBy("lineage", "month").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    used = F.sum("req").over(Window.partitionBy("lineage", "gen").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"month_used": F.coalesce(F.sum("req").over(same_month), F.lit(0)) > 1, "velocity": F.coalesce(F.sum("req").over(lin.rowsBetween(-cap, -1)), F.lit(0)), "remaining": F.when(F.col("gen") > 0, grant - F.coalesce(used, F.lit(0))), "spent": F.coalesce(F.max(F.col("value")).over(before), F.lit(0.0)) > 150})
    purpose = F.when(F.col("value") < 5, "rehearsal").otherwise("readout")
    code = spend_code(purpose, F.col("spent"), F.col("month_used"), F.col("velocity"), F.lit(4), F.col("remaining"))
    return rows.where("type = 'request'").select("seq", "lineage", code.alias("code"))


def admission(log: DataFrame, known: DataFrame) -> DataFrame:
    """The first rule each draft breaks, in order: duplicate, unknown type, actor law, missing reasoning, unresolved reference, unregistered lineage; else ACCEPTED."""
    seen = Window.partitionBy("event_id").orderBy("seq")
    reg = F.min(F.when(F.col("type") == "register", F.col("seq"))).over(Window.partitionBy("lineage"))
    rows = log.withColumns({"n": F.row_number().over(seen), "reg": reg}).join(known.withColumn("known", F.lit(True)), "lineage", "left")
    agent = F.col("seq") % 3 == 0
    code = F.when(F.col("n") > 1, "DUPLICATE").when(F.col("type").isNull(), "SCHEMA_INVALID").when(agent & (F.col("type") == "void"), "ACTOR_LAW").when(agent & (F.col("value") < 1), "INTENT_MISSING").when(F.col("known").isNull(), "REF_UNRESOLVED").when((F.col("type") == "request") & (F.col("reg").isNull() | (F.col("reg") > F.col("seq"))), "NOT_REGISTERED").otherwise("ACCEPTED")
    return rows.select("seq", code.alias("code"))


GENESIS = "0" * 64


def chained(log: DataFrame) -> DataFrame:
    """Each lineage's chain head: sha256 of the head before and the event, folded in order of seq."""
    line = F.concat_ws("|", F.col("seq").cast("string"), "type", "event_id")
    rows = log.groupBy("lineage").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))).alias("e"))
    head = F.aggregate("e", F.lit(GENESIS), lambda h, x: F.sha2(F.concat(h, x["line"]).cast("binary"), 256))
    return rows.select("lineage", F.size("e").cast("long").alias("n"), head.alias("head"))


def event_hash(body: dict) -> str:
    """Hash of an event without its own hash; the hash of the event before is part of it."""
    return hashlib.sha256(canonical({k: v for k, v in body.items() if k != "event_hash"})).hexdigest()


def verify(lines: DataFrame, genesis: str = GENESIS) -> DataFrame:
    """(log, n, first_bad_seq, torn_tail) of logs of raw JSON lines (log, line_no from 0, raw).

    A line is bad if it isn't JSON, its seq isn't its number, its prev_hash isn't the hash told by the line before (``genesis`` for the first), or its hash isn't
    that of its content. A last line that isn't JSON is a torn tail, which can be cut off. Each line is rehashed by itself; a lag tells the links.
    """

    @F.pandas_udf(T.StructType([T.StructField("seq", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("prev", "told", "made")]]))
    def read(raw: pd.Series) -> pd.DataFrame:
        def one(text):
            try:
                d = json.loads(text)
                return int(d["seq"]), str(d["prev_hash"]), str(d["event_hash"]), event_hash(d)
            except (ValueError, TypeError, KeyError):
                return None, None, None, None

        return pd.DataFrame([one(t) for t in raw], columns=["seq", "prev", "told", "made"]).astype({"seq": "Int64"})

    w = Window.partitionBy("log").orderBy("line_no")
    rows = lines.select("log", "line_no", read("raw").alias("e")).withColumns({"_link": F.coalesce(F.lag("e.told").over(w), F.when(F.col("line_no") == 0, F.lit(genesis))), "_last": F.lead("line_no").over(w).isNull()})
    torn = F.col("e.made").isNull() & F.col("_last")
    good = (F.col("e.seq") == F.col("line_no")) & (F.col("e.prev") == F.col("_link")) & (F.col("e.told") == F.col("e.made"))
    return rows.groupBy("log").agg(F.count_if(~torn).alias("n"), F.min(F.when(~torn & ~F.coalesce(good, F.lit(False)), F.col("line_no"))).alias("first_bad_seq"), F.bool_or(torn).alias("torn_tail"))


def chain(rows: DataFrame, seq: int, head: str, fields: list[str]) -> DataFrame:
    """Accepted drafts as events (seq, prev_hash, event_hash, line): each hash covers the one before, so the rows pass one task as a stream, in order of ``_order``.

    ``fields`` are columns of the envelope; ``payload`` and ``cites`` hold JSON. The written line is what was hashed.
    """

    def run(batches):
        n, prev = seq, head
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                body = {k: None if v is None or v != v else v for k, v in ((k, row[k]) for k in fields if k not in ("payload", "cites"))}
                body |= {k: json.loads(row[k]) for k in ("payload", "cites") if k in fields}
                body |= {"seq": n, "prev_hash": prev}
                body["event_hash"] = event_hash(body)
                out.append((n, row["event_id"], prev, body["event_hash"], canonical(body).decode()))
                n, prev = n + 1, body["event_hash"]
            yield pd.DataFrame(out, columns=["seq", "event_id", "prev_hash", "event_hash", "line"])

    return rows.orderBy("_order").coalesce(1).mapInPandas(run, "seq long, event_id string, prev_hash string, event_hash string, line string")


def slot_step(state: dict, kind: str, month: str, grant: int) -> dict:
    """One transition of a lineage's slots.

    A registration starts a generation: the budget is full and nothing is consumed. A request consumes a slot, never below 0. A void gives back the
    slot and the consumption, but neither the running count nor the month.
    """
    s = dict(state)
    if kind == "register":
        s |= {"generation": s["generation"] + 1, "remaining": grant, "consumed": 0}
    elif kind == "request":
        s |= {"remaining": max(0, s["remaining"] - 1), "consumed": s["consumed"] + 1, "k_cumulative": s["k_cumulative"] + 1, "months": s["months"] | {month}}
    elif kind == "void" and s["consumed"] > 0:
        s |= {"remaining": s["remaining"] + 1, "consumed": s["consumed"] - 1}
    return s


EMPTY_SLOTS = {"generation": 0, "remaining": 0, "consumed": 0, "k_cumulative": 0, "months": frozenset()}


def slots(log: DataFrame, grant: int = 8) -> DataFrame:
    """The slots of each lineage after all its events in order; order matters, so a lineage is one group."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        s = EMPTY_SLOTS
        for kind, month in g.sort_values("seq")[["type", "month"]].itertuples(index=False):
            s = slot_step(s, kind, month, grant)
        return pd.DataFrame([{"lineage": g["lineage"].iloc[0], **s, "months": len(s["months"])}])

    rows = log.where("type IN ('register', 'request', 'void')").select("lineage", "seq", "type", F.date_format("ts", "yyyy-MM").alias("month"))
    return rows.groupBy("lineage").applyInPandas(run, "lineage long, generation long, remaining long, consumed long, k_cumulative long, months long")


def versions(log: DataFrame) -> DataFrame:
    """(lineage, live, n_adopted): the live proposal after adoptions (of the latest proposal) and reverts (to the one live before), in order."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        proposal, live = None, [None]
        adopted = 0
        for kind, seq in g.sort_values("seq")[["type", "seq"]].itertuples(index=False):
            if kind == "register":
                proposal = seq
            elif kind == "request" and proposal is not None:
                live.append(proposal)
                adopted += 1
            elif kind == "void" and len(live) > 1:
                live.pop()
        return pd.DataFrame({"lineage": [g["lineage"].iloc[0]], "live": pd.array([live[-1]], "Int64"), "n_adopted": [adopted]})

    rows = log.where("type IN ('register', 'request', 'void')").select("lineage", "seq", "type")
    return rows.groupBy("lineage").applyInPandas(run, "lineage long, live long, n_adopted long")


def deduplicated_spends(log: DataFrame, grant: int = 8) -> DataFrame:
    """Each signature (lineage, rounded value) spends once, at its first request; what is left after each in order of arrival."""
    first = log.where("type = 'request'").groupBy("lineage", F.round("value").alias("signature")).agg(F.min("seq").alias("seq"))
    n = F.row_number().over(Window.partitionBy("lineage").orderBy("seq"))
    return first.select("lineage", "seq", F.greatest(F.lit(0), grant - n).cast("long").alias("remaining"))
