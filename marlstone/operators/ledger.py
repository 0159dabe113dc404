"""The log as a whole: enrich, decide, append, replay, answer, render and export.

A ledger is a folder of text files, one for each appended batch, named by the seq it begins with; every line is the canonical JSON that was hashed. There is one writer.

A batch is written under the name of an attempt and renamed once it is whole, so a crash at any step leaves a ledger that appends on: what an attempt left behind is
deleted by the next append, and a batch that isn't whole is set aside. Every ``SNAPSHOT`` batches the bases of the state are written beside the log, with the seq they reach; a state reads the
last snapshot and the batches since. Hidden folders: ``_attempts``, ``_snapshots``, ``_abandoned``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import admission, eventlog, payloads, predicates, ranking
from marlstone.operators import projections as P
from marlstone.scratch import Scratch
from marlstone.sources.files import Folder

DRAFT = "event_id string, ts timestamp, type string, actor string, provenance string, hypothesis string, reasoning string, expected_outcome string, cites array<string>, payload string, imported boolean"
ENVELOPE = ["event_id", "ts", "type", "actor", "provenance", "hypothesis", "reasoning", "expected_outcome", "cites", "payload", "imported"]
HASHED = {"dataset.register": ("path", "computed_raw_sha256"), "artifact.register": ("path", "computed_sha256")}
SNAPSHOT = 50  # batches
KEPT = 2  # snapshots
HEADER = "# LEDGER — derived, prefix-stable render of the event log. DO NOT EDIT.\n"


def enrich(drafts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Drafts with a time, the validated payload where it is valid, and the computed hash of the file that a payload names, if ``files`` (path, sha256) has it."""
    d = drafts.withColumns({"ts": F.coalesce("ts", F.current_timestamp()), "payload": F.coalesce(payloads.validate("type", "payload")["payload"], "payload")})
    if files is None:
        return d
    names = F.create_map(*[F.lit(x) for k, (_, c) in HASHED.items() for x in (k, c)])[F.col("type")]
    at = files.select(F.col("path").alias("_path"), F.col("sha256").alias("_sha"))
    d = d.withColumn("_p", F.when(names.isNotNull(), F.get_json_object("payload", "$.path"))).join(at, F.col("_p") == F.col("_path"), "left")
    put = F.concat(F.substring("payload", F.lit(1), F.length("payload") - 1), F.lit(',"'), names, F.lit('":"'), F.col("_sha"), F.lit('"}'))
    d = d.withColumn("payload", F.when(F.col("_sha").isNotNull(), payloads.validate("type", F.regexp_replace(put, F.concat(F.lit('"'), names, F.lit('":null,')), F.lit("")))["payload"]).otherwise(F.col("payload")))
    return d.drop("_p", "_path", "_sha")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files by their bytes, a file in a task."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.sha2("content", 256).alias("sha256"))


class Ledger:
    def __init__(self, spark: SparkSession, path: str, genesis: str = eventlog.GENESIS, every: int = SNAPSHOT):
        self.spark, self.path, self.genesis, self.every = spark, path.rstrip("/"), genesis, every
        self.folder = Folder(spark, self.path)
        self._decided: Scratch | None = None

    def exists(self) -> bool:
        return self.folder.has()

    def batches(self, since: int = 0) -> list[str]:
        """Names of the batches that begin at a seq of ``since`` or more, in order."""
        return [n for n in self.folder.names() if n.startswith("batch-") and int(n[6:]) >= since]

    def lines(self, since: int = 0) -> DataFrame:
        """(log, line_no, raw): the files of batches in order of their names, which is that of their seqs."""
        names = self.batches(since)
        if not names:
            return self.spark.createDataFrame([], "log string, line_no long, raw string")
        where = [f"{self.path}/{n}" for n in names] if since else [self.path]
        files = self.spark.read.text(where, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("_f"), F.posexplode(F.split(F.rtrim("value"), "\n")).alias("_i", "raw")).where(F.col("raw") != "")
        counts = files.groupBy("_f").agg(F.count(F.lit(1)).alias("_n"))  # one row for each batch
        ahead = counts.select(F.col("_f").alias("_g"), F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_a"))
        return files.join(ahead, F.col("_f") == F.col("_g")).select(F.lit(self.path).alias("log"), (F.col("_a") + F.col("_i")).cast("long").alias("line_no"), "raw")

    def events(self, since: int = 0) -> DataFrame:
        """The log's events, or those of the batches from ``since`` on; a line that isn't JSON is left out, as ``verify`` tells of it."""
        names = self.batches(since)
        fields = f"seq long, {DRAFT}, prev_hash string, event_hash string"
        if not names:
            return self.spark.createDataFrame([], fields)
        where = [f"{self.path}/{n}" for n in names] if since else self.path
        rows = self.spark.read.text(where, recursiveFileLookup=True)
        return rows.select(F.from_json("value", fields).alias("e")).where("e.seq IS NOT NULL").select("e.*")

    def verify(self) -> dict:
        r = eventlog.verify(self.lines(), self.genesis).first()
        return {"ok": r is None or r.first_bad_seq is None, "n_events": r.n if r else 0, "first_bad_seq": r.first_bad_seq if r else None, "torn_tail": bool(r and r.torn_tail)}

    def head(self) -> tuple[int, str]:
        """The next seq and the hash it goes on, from the last batch."""
        names = self.batches()
        r = self.events(int(names[-1][6:])).groupBy().agg(F.max("seq").alias("s"), F.max_by("event_hash", "seq").alias("h")).first() if names else None
        return (r.s + 1, r.h) if r and r.s is not None else (0, self.genesis)

    def snapshots(self) -> list[int]:
        """The seqs that written snapshots reach: each has all events before."""
        return [int(n) for n in self.folder.names("_snapshots")]

    def state(self, cold: bool = False, **given: DataFrame) -> P.State:
        """The state of all events: the last snapshot, merged with the events since; or, ``cold``, of all events anew."""
        at = max(self.snapshots(), default=0)
        if cold or not at or self._rewrites(at):
            return P.State(self.events(), **given)
        return P.State(self.events(at), self._carried(at), **given)

    def _carried(self, at: int) -> Callable[[str], DataFrame]:
        return lambda name: self.spark.read.parquet(f"{self.path}/_snapshots/{at:012d}/{name}")

    def _rewrites(self, at: int) -> bool:
        """Whether an event since the snapshot registers a windowset that it has: earlier events would then belong to another lineage."""
        if not self.batches(at):
            return False
        again = P.windowset_rows(self.events(at)).select("windowset_id")
        return again.join(self._carried(at)("windowset_rows").select("windowset_id"), "windowset_id").limit(1).count() > 0

    def snapshot(self) -> int:
        """Write the bases of the state as of the head, and return the seq they reach. A snapshot that isn't whole stays under the name of its attempt."""
        seq, _ = self.head()
        name = f"{seq:012d}"
        if seq and not self.folder.has(f"_snapshots/{name}"):
            attempt, s = f"_attempts/{uuid.uuid4().hex}", self.state()
            for base in P.CARRIED:
                getattr(s, base).coalesce(1).write.parquet(f"{self.path}/{attempt}/{base}")
            s.close()
            self.folder.move(attempt, f"_snapshots/{name}")
            for old in self.snapshots()[:-KEPT]:
                self.folder.drop(f"_snapshots/{old:012d}")
        return seq

    def recover(self) -> list[str]:
        """Delete what unfinished attempts left, and set aside batches that aren't whole (without the mark that Spark's writer leaves last). Returns the names of these."""
        self.folder.drop("_attempts")
        torn = [n for n in self.batches() if not self.folder.has(f"{n}/_SUCCESS")]
        for n in torn:
            self.folder.move(n, f"_abandoned/{n}-{uuid.uuid4().hex}")
        return torn

    def commit(self, made: DataFrame, seq: int) -> None:
        """Write the lines of events (seq, line) as the batch that begins at ``seq``: all of it appears at once."""
        attempt = f"_attempts/{uuid.uuid4().hex}"
        made.orderBy("seq").coalesce(1).select("line").write.text(f"{self.path}/{attempt}")
        self.folder.move(attempt, f"batch-{seq:012d}")

    def append(self, drafts: DataFrame, files: DataFrame | None = None, **given: DataFrame) -> DataFrame:
        """Decide a batch of drafts against the log so far and append those that are accepted, in order of ``_order`` or else of ts and event_id.

        Returns (event_id, accepted, noop, code, detail, fired), which can be read until the next append. Drafts of one batch don't see each other; of those with one event_id the first is
        taken. Drafts that depend on one another belong to batches of their own, as ``follow`` makes of the files of an inbox. Reads the last snapshot and the batches since it; every
        ``every`` batches a new one is written.
        """
        self.recover()
        if self._decided:
            self._decided.drop()
        run, self._decided = Scratch(self.spark, "append"), Scratch(self.spark, "decided")
        by = ["_order"] if "_order" in drafts.columns else ["ts", "event_id"]
        whole = run.table("enriched", enrich(drafts, files).withColumn("_order", F.struct(*by)))
        one = whole.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in whole.columns if c != "event_id"]), "_order").alias("e")).select("event_id", "e.*")
        occur = one.select("type", "actor").distinct().collect()  # types and actors, not drafts
        state = self.state(**given)
        decided = self._decided.table("decided", admission.decide(one, state, {r.type for r in occur}, any(r.actor == "scheduler:daemon" for r in occur)))
        state.close()
        seq, head = self.head()
        taken = one.join(decided.where("accepted AND NOT noop").select("event_id"), "event_id", "left_semi")
        made = eventlog.chain(taken.withColumns({"ts": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), "cites": F.to_json(F.coalesce("cites", F.array().cast("array<string>"))), "imported": F.coalesce("imported", F.lit(False))}), seq, head, ENVELOPE)
        made = run.table("made", made)
        if made.limit(1).count():
            self.commit(made, seq)
            if len(self.batches(max(self.snapshots(), default=0))) >= self.every:
                self.snapshot()
        run.drop()
        return decided

    def follow(self, inbox: str, checkpoint: str, accepted: str, rejected: str, hooks: tuple[Callable, ...] = (), every: str | None = None):
        """Take the files of an inbox as they come. All that are pending make a batch, in which they are decided one after the other in order of their names, as one draft may depend on
        the one before; then decisions are written to two folders and the hooks called. Without ``every``, a trigger's interval, the stream ends once the inbox is empty. A batch that is run
        again after a crash changes nothing: the log has its drafts already.
        """
        rows = self.spark.readStream.schema(DRAFT).option("multiLine", True).json(inbox).withColumn("_file", F.col("_metadata.file_name"))

        def batch(df: DataFrame, n: int) -> None:
            run = Scratch(self.spark, "inbox")
            pending = run.table("drafts", df)
            for name in [r[0] for r in pending.select("_file").distinct().orderBy("_file").collect()]:
                got = self.append(pending.where(F.col("_file") == name).drop("_file", "_metadata")).withColumns({"file": F.lit(name), "batch": F.lit(n)})
                got.where("accepted").write.mode("append").json(accepted)
                got.where("NOT accepted").write.mode("append").json(rejected)
            run.drop()
            for hook in hooks:
                hook(self, n)

        out = rows.writeStream.option("checkpointLocation", checkpoint)
        return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).foreachBatch(batch).start()

    def render(self) -> DataFrame:
        return render(self.events())

    def query(self, what: str) -> DataFrame:
        return ANSWERS[what](self.state())


def answer_spent(s: P.State) -> DataFrame:
    """(wiv_id, role, spent) of every window of any windowset."""
    w = s.windowsets.select(F.explode("windows").alias("w")).groupBy("w.wiv_id").agg(F.min("w.role").alias("role"))
    return w.join(s.spends.distinct().withColumn("_s", F.lit(True)), "wiv_id", "left").select("wiv_id", "role", F.coalesce("_s", F.lit(False)).alias("spent"))


def answer_constants(s: P.State) -> DataFrame:
    """(series, doc_id, provisional): the document in force and the keys of its provisional entries."""
    keys = F.transform(F.filter("entries", lambda e: e["finality"] == "provisional"), lambda e: e["key"])
    return s.constants.select("series", "doc_id", F.array_join(keys, ",").alias("provisional"))


#: Golden answers by name, and point reads: a projection, to be filtered by its id.
ANSWERS: dict[str, Callable[[P.State], DataFrame]] = {
    "incumbent": lambda s: s.incumbents.select("lineage_id", "incumbent"),
    "spent": answer_spent,
    "budget": lambda s: s.lineages.select("lineage", "generation", "consumed", "remaining", "alarm", "diagnostic"),
    "constants": answer_constants,
    "conditionals": lambda s: s.conditionals.select("event_id", "kind", "status"),
    "placebo": lambda s: s.placebo_history,
    "failures": lambda s: s.kill_list,
}
POINTS = {"blocks": "block_id", "lineages": "lineage", "cards": "card_id", "constants": "series", "readouts": "readout_id", "cycles": "cycle_id"}


def point(s: P.State, kind: str, key: str) -> DataFrame:
    """The object of a kind with the id, as one row or none."""
    return getattr(s, kind).where(F.col(POINTS[kind]) == key)


def health(s: P.State) -> DataFrame:
    """One row: last seq, head of the chain, open cycle, whether the channel is suspended."""
    e = s.tip.groupBy().agg(F.max("seq").alias("as_of_seq"), F.max_by("event_hash", "seq").alias("head"))
    quiet = s.suspended.groupBy().agg(F.coalesce(F.bool_or("suspended"), F.lit(False)).alias("suspended"))
    return e.join(F.broadcast(s.open_cycle), how="left").join(F.broadcast(quiet), how="left")  # one row each


def render(log: DataFrame) -> DataFrame:
    """(seq, text) of events; each renders by itself, so that the text of a longer log begins with that of a shorter one."""
    p = F.from_json("payload", "map<string,string>")
    member = lambda k: F.coalesce(F.try_element_at(p, F.lit(k)), F.lit(""))
    is_scalar = lambda v: v.isNotNull() & ~v.startswith("{") & ~v.startswith("[")
    cased = lambda v: F.when(v.isin("true", "false"), F.initcap(v)).otherwise(v)
    keys = F.slice(F.sort_array(F.map_keys(p)), 1, 8)
    pairs = F.array_join(F.transform(F.filter(keys, lambda k: is_scalar(F.element_at(p, k))), lambda k: F.concat(k, F.lit("="), cased(F.element_at(p, k)))), " · ")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format("ts", "SSSSSS") == "000000", F.lit("")).otherwise(F.concat(F.lit("."), F.date_format("ts", "SSSSSS"))), F.lit("+00:00"))
    head = F.concat(F.lit("\n## ["), F.col("seq").cast("string"), F.lit("] "), stamp, F.lit(" · "), "type", F.lit(" · "), "actor")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    told = (F.col("provenance") == "discretionary") & filled("hypothesis")
    note = F.col("type") == "note.record"
    lines = [
        head,
        F.when(F.col("imported"), "*(imported pre-registry act — the original prose ledger stays authoritative)*"),
        F.when(told, F.concat(F.lit("**Hypothesis:** "), "hypothesis")),
        F.when(told & filled("expected_outcome"), F.concat(F.lit("**Expected:** "), "expected_outcome")),
        F.when(F.size("cites") > 0, F.concat(F.lit("cites: "), F.array_join("cites", ", "))),
        F.when(note, F.concat(F.lit("**"), member("title"), F.lit("**"))),
        F.when(note, member("body")).when(F.length(pairs) > 0, F.concat(F.lit("`"), pairs, F.lit("`"))),
        F.concat(F.lit("`event "), "event_id", F.lit(" · hash "), F.substring("event_hash", 1, 12), F.lit("`")),
    ]
    return log.select("seq", F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("text"))


def daily_digest(s: P.State, date: str) -> str:
    """The day's report: budgets, suspension, the last twenty cards, the open cycle. Lineages are as many as windowset families; they are listed in order of their name."""
    shown = lambda v: "None" if v is None else v
    out = [f"# Daily digest — {date}\n", "## Budgets"]
    for r in s.lineages.orderBy("lineage").toLocalIterator():
        out.append(f"- {r.lineage}: k={r.k_cumulative} remaining={shown(r.remaining)} alarm={'FIRED' if r.alarm else 'ok'} diagnostic={'ON' if r.diagnostic else 'off'}")
    h = health(s).first()
    out += ["\n## Suspensions", f"- {P.CHANNEL}: {'SUSPENDED' if h.suspended else 'active'}", "\n## Cards emitted"]
    out += [f"- {r.card_id} ({r.card_type})" for r in sorted(s.cards.orderBy(F.col("seq").desc()).limit(20).collect(), key=lambda r: r.seq)]
    return "\n".join([*out, "\n## Open cycle", f"- {h.open_cycle or 'none'}"]) + "\n"


def green(s: P.State) -> DataFrame:
    """(event_id) of armed conditionals whose predicate's version is the one in use and which holds, by the parameters they were armed with."""
    armed = s.conditionals.where("status = 'armed'").select("event_id", "cond_id", "event_body", F.col("predicate.name").alias("name"), F.col("predicate.version").alias("version"), F.from_json("predicate.params", "map<string,string>").alias("params"))
    at = lambda k: F.col("params")[k]
    of = lambda name: armed.where(F.col("name") == name)
    lin = s.lineages.select(F.col("lineage").alias("_l"), "remaining", F.col("alarm_at").alias("floor"))
    floor = of("budget_floor_alarm").join(lin, at("lineage_id") == F.col("_l"))
    voids = P.lineage_of(s.readouts.where("voided"), s.windowsets).select("lineage").distinct()
    alarms = P.suspend_alarm(s.placebo_history, voids).where("alarm").select(F.col("lineage").alias("_l"))
    alarm = of("extended_suspend_alarm").join(alarms, at("lineage_id") == F.col("_l"))
    ok = s.stamps.where("passed").groupBy("artifact_id").agg(F.collect_set(F.struct(F.col("stamp_kind").alias("kind"), "passed")).alias("kinds"))  # six kinds
    both = of("g2_and_alignment_green").join(ok.select(F.col("artifact_id").alias("_g"), F.col("kinds").alias("g2")), at("g2_artifact") == F.col("_g"), "left").join(ok.select(F.col("artifact_id").alias("_h"), F.col("kinds").alias("alignment")), at("alignment_artifact") == F.col("_h"), "left")
    hits = [
        floor.where(predicates.fired("budget_floor_alarm", F.col("version"))),
        alarm.where(~predicates.stale(F.col("version"), "extended_suspend_alarm")),
        both.where(predicates.fired("g2_and_alignment_green", F.col("version"))),
    ]
    asked = of("readout_battery_green").where(~predicates.stale(F.col("version"), "readout_battery_green")).select("event_id", "cond_id", "event_body", "name", "version", "params", F.from_json(F.col("params")["readout_request"], admission.REQUEST).alias("q")).select("*", "q.*").withColumn("ts", F.lit(None).cast("timestamp"))
    asked = P.lineage_of(admission.known(asked, s.windowsets, "windowset_id", "windowset_id", "windows"), s.windowsets)
    asked, no = admission.spend_rule(asked, s)
    hits.append(asked.where(no.isNull()))
    out = [h.select("event_id", "cond_id", "event_body") for h in hits]
    whole = out[0]
    for h in out[1:]:
        whole = whole.unionByName(h)
    return whole


def fire(ledger: Ledger, inbox: str) -> None:
    """After a commit: write a draft to the inbox for every armed conditional that is green; it cites its arming, by which the log marks it fired."""
    rows = green(ledger.state())
    if rows.limit(1).count() == 0:
        return
    body = F.coalesce("event_body.payload", F.lit("{}"))
    d = rows.select(payloads.event_id(F.col("event_body.type"), F.lit("scheduler:daemon"), body, F.concat(F.lit("fire:"), "cond_id")).alias("event_id"), F.col("event_body.type").alias("type"), F.lit("scheduler:daemon").alias("actor"), F.lit("scheduled").alias("provenance"), F.array("event_id").alias("cites"), body.alias("payload"))
    d.write.mode("append").json(inbox)


def replay_check(ledger: Ledger, live: str, names: tuple[str, ...] = ("features", "blocks", "lineages", "readouts", "constants", "cycles")) -> tuple[str, bool]:
    """The hash of the state that a cold replay gives, and whether it is the live one."""
    s = ledger.state(cold=True)
    cold = P.state_hash({n: getattr(s, n) for n in names})
    s.close()
    return cold, cold == live


def integrity(s: P.State, files: DataFrame, date: str) -> DataFrame:
    """Drafts that tell, for every artifact whose file is there, whether its bytes still have the hash it was registered with."""
    rows = s.artifacts.where("path IS NOT NULL AND sha256 IS NOT NULL").join(files.select("path", F.col("sha256").alias("_now")), "path")
    doc = F.to_json(F.struct("artifact_id", (F.col("sha256") == F.col("_now")).alias("ok"), F.col("_now").alias("recomputed_sha256")))
    return payloads.drafts_of(rows, "artifact.integrity_checked", "scheduler:daemon", doc, F.concat_ws(":", F.lit("sweep"), F.lit(date), "artifact_id"))


def _pinned(s: P.State, series: str, default: str) -> str:
    r = s.constants.where(F.col("series") == series).select(predicates.constant(F.col("entries"), "version").alias("v")).first()
    return r.v if r and r.v is not None else default


def open_cycle(s: P.State, cycle_id: str) -> DataFrame:
    """The draft that opens a cycle, with the versions in force pinned."""
    live = s.rules.where("rule_kind = 'dial_budget_rule'").select("version").first()
    doc = {"cycle_id": cycle_id, "dial_budget_rule_version": live.version if live and live.version else "seed", "score_fn_version": _pinned(s, "score_function", "score_v1"), "promotion_predicate_version": _pinned(s, "promotion_predicate", "1"), "cost_model_version": _pinned(s, "cost_model", "cost_model_v0_flat")}
    return _one(s, "cycle.open", doc, cycle_id)


def dispatch(s: P.State, cycle_id: str, job_kind: str, job_id: str, inputs: dict) -> DataFrame:
    return _one(s, "stage.dispatch", {"cycle_id": cycle_id, "job_kind": job_kind, "job_id": job_id, "inputs": inputs}, job_id)


def close_cycle(s: P.State, cycle_id: str) -> DataFrame:
    return _one(s, "cycle.close", {"cycle_id": cycle_id}, f"close:{cycle_id}")


def _one(s: P.State, kind: str, doc: dict, intent: str) -> DataFrame:
    return payloads.drafts_of(s.log.sparkSession.range(1), kind, "scheduler:daemon", F.lit(json.dumps(doc)), F.lit(intent))


def quota(rules: DataFrame) -> Column:
    """The share for novelty of the live budget rule, 0 without one."""
    return F.coalesce(F.get_json_object("body", "$.novelty_quota_share").cast("double"), F.lit(0.0))


def register_snapshot(spark: SparkSession, snapshot_id: str, path: str, source_kind: str = "binance_export", variants: tuple = ()) -> DataFrame:
    """The draft that registers a snapshot in place: the hash of its file, the digest of its content, its rows and range."""
    from marlstone.functions.scalar import snapshot_digest

    digest, n, ends = snapshot_digest(spark.read.parquet(path))
    sha = file_hashes(spark, path).agg(F.when(F.count(F.lit(1)) == 1, F.max("sha256")).otherwise(F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), ""), 256)).alias("s")).first().s
    doc = {"snapshot_id": snapshot_id, "source_kind": source_kind, "raw_sha256": sha, "n_rows": n, "canonical_content_digest": digest, "digest_scheme_version": "snap_digest_v1", "ts_range": list(ends), "variants": list(variants), "path": path}
    return payloads.drafts_of(spark.range(1), "dataset.register", "human:operator", F.lit(json.dumps(doc)), F.lit(f"snapshot:{snapshot_id}"))


def emit_cards(made: DataFrame, out: str) -> None:
    """Card files (side, card_id, payload), a file each, named by their content."""
    names = F.concat(F.lit("descriptor_"), "side", F.lit("_"), "card_id")
    made.select(names.alias("name"), "payload").repartition("name").write.partitionBy("name").mode("overwrite").text(out)


METRICS = "stage int, net_pf_proxy double, per_blob array<struct<contrib:double>>, coverage double, sep_z double, gate_ref double, fidelity_haircut double"


def promotion(s: P.State, cycle_id: str, stage: int, capacity: int, ids: DataFrame | None = None) -> DataFrame:
    """(key, score, how) of the scorecards of a stage (1 to 3), promoted to the next.

    Scores are by the function that the cycle has pinned, an error where it isn't deployed; the share for novelty is that of the live budget rule. ``ids`` (key, ids): the trades of
    a scorecard's population, by its key's hash; a scorecard that isn't there has none.
    """
    if stage not in (1, 2, 3):
        raise ValueError("promotion is from stage 1, 2 or 3; stage 0 is covered whole")
    pin = s.cycles.where(F.col("cycle_id") == cycle_id).select("score_fn_version").first()
    name = pin.score_fn_version if pin and pin.score_fn_version else "score_v1"
    if name not in predicates.SCORES:
        raise ValueError(f"cycle {cycle_id} pins score function {name}, of {sorted(predicates.SCORES)}")
    live = s.rules.where("rule_kind = 'dial_budget_rule'").select(quota(s.rules).alias("q")).first()
    m = s.scorecards.where(F.col("stage") == stage).select("key_hash", "lex", F.from_json("metrics", METRICS).alias("m")).select("key_hash", "lex", "m.*")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("net_pf_proxy", "coverage", "sep_z", "gate_ref")}
    m = m.withColumns(zero | {"per_blob": F.coalesce(F.transform("per_blob", lambda b: F.coalesce(b["contrib"], F.lit(0.0))), F.array().cast("array<double>"))})
    cards = m.select(F.col("key_hash").alias("key"), "lex", predicates.SCORES[name].build().alias("score"))
    none = F.lit(None).cast("array<string>")
    cards = cards.withColumn("ids", none) if ids is None else cards.join(ids.select("key", "ids"), "key", "left")
    return ranking.promote(cards, capacity, live.q if live else 0.0, tie="lex")
