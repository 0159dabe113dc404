"""Converters: legacy pairs to populations, results of engines to drafts, documents to jobs, seeds to drafts."""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import scalar
from marlstone.operators import assignments, lookups
from marlstone.operators.payloads import drafts_of, short_sha

SIDES = {"BUY": "buy", "SELL": "sell"}
POPULATION_KINDS = {"trade_id": "string", "side": "string", "entry_ts": "string", "exit_ts": "string", "entry_price": "float64", "exit_price": "float64", "volume": "float64", "profit": "float64", "profit_usd": "float64", "exit_reason": "string", "f_hour": "float64", "f_ema": "float64", "f_mom": "float64", "f_dv": "float64", "f_iv": "float64", "f_hurst": "float64", "incumbent_cluster_id": "int64", "legacy_row_index": "int64", "mt5_deal_in": "int64", "mt5_deal_out": "int64"}


def fingerprint(rows: DataFrame, side: str, cluster: str) -> DataFrame:
    """(side, sizes): sizes of a side's clusters, largest first. Clusters are few."""
    n = rows.groupBy(side, cluster).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(side).agg(F.sort_array(F.collect_list("_n"), asc=False).alias("sizes"))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that aren't unique."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def clock_mismatches(texts: DataFrame, ins: DataFrame) -> DataFrame:
    """(side, n_rows, mismatches): rows, by position, whose hour isn't the server hour of the deal's time."""
    server = F.pmod(F.hour("ts") + scalar.us_dst_hours(F.col("ts")), F.lit(24))
    both = texts.select("side", "pos", "hour").join(ins.select("side", "pos", server.alias("_h")), ["side", "pos"])
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("hour").cast("int") != F.col("_h")).alias("mismatches"))


def legacy_pair(texts: DataFrame, deals: DataFrame, sizes: dict[str, list[int]] | None = None) -> DataFrame:
    """The population of a pair of files: sectioned rows (section, pos, cluster, features) and deals.

    Refused are: other numbers of rows than ins, other cluster sizes than ``sizes``, repeated deals, hours that disagree with the clock, ins without an out.
    """
    from pyspark.sql import Window

    side = F.create_map(*[F.lit(x) for kv in SIDES.items() for x in kv])
    texts = texts.withColumn("side", side[F.col("section")]).where("side IS NOT NULL")
    if bad := repeated(deals, "deal").first():
        raise ValueError(f"deal {bad[0]} occurs {bad.n} times")
    ins = deals.where("direction = 'in'").withColumn("pos", (F.row_number().over(Window.partitionBy("side").orderBy("deal")) - 1).cast("long"))
    for r in texts.groupBy("side").count().join(ins.groupBy("side").agg(F.count(F.lit(1)).alias("n")), "side", "full").collect():  # two sides
        if r["count"] != r.n:
            raise ValueError(f"{r.side}: {r['count']} rows but {r.n} ins")
    if sizes is not None and (got := {r.side: list(r.sizes) for r in fingerprint(texts, "side", "cluster").collect()}) != sizes:
        raise ValueError(f"cluster sizes are {got}")
    for r in clock_mismatches(texts, ins).where("mismatches > 0").collect():
        raise ValueError(f"{r.side}: {r.mismatches} hours disagree with the clock")
    outs = deals.where("direction = 'out'").withColumn("side", F.when(F.col("side") == "buy", "sell").otherwise("buy"))
    pairs = lookups.greedy_pairs(ins, outs, "side", "deal")
    a = ins.select("side", "pos", F.col("ts").alias("_in"), F.col("price").alias("entry_price"), "volume", F.col("deal").alias("mt5_deal_in"))
    b = outs.select(F.col("deal").alias("mt5_deal_out"), F.col("ts").alias("_out"), F.col("price").alias("exit_price"), "profit", F.col("comment").alias("exit_reason"))
    rows = texts.join(a, ["side", "pos"]).join(pairs.select("side", "pos", F.col("deal_out").alias("mt5_deal_out")), ["side", "pos"]).join(b, "mt5_deal_out")
    text = lambda c: F.date_format(c, "yyyy.MM.dd HH:mm:ss")
    before = F.when(F.col("side") == "sell", F.lit(texts.where("side = 'buy'").count())).otherwise(0)
    return rows.select(F.format_string("t%06d", before + F.col("pos")).alias("trade_id"), "side", text("_in").alias("entry_ts"), text("_out").alias("exit_ts"), "entry_price", "exit_price", "volume", "profit", F.lit(None).cast("double").alias("profit_usd"), "exit_reason", *[F.col(f).alias(f"f_{f}") for f in ("hour", "ema", "mom", "dv", "iv", "hurst")], F.col("cluster").alias("incumbent_cluster_id"), F.col("pos").cast("long").alias("legacy_row_index"), "mt5_deal_in", "mt5_deal_out")


def manifest(pop: DataFrame, **given) -> dict:
    """What is told of a population: its size and the digest of its rows, with the given references."""
    return given | {"n_trades": pop.count(), "content_digest": scalar.content_digest(pop, POPULATION_KINDS, ["entry_ts", "trade_id"]), "digest_scheme_version": scalar.SCHEME}


RESULT = "block_id string, candidate_id string, lineage_id string, evidence_ref string, job_hash_echo string, env_hash string, pc_echo string, engine_stamp string, artifacts array<struct<name:string,path:string,role:string,sha256:string>>, trial_batches array<struct<batch_id:string,n_rows:bigint,n_distinct_keys:bigint,rows_file:string,null_max_file:string,gate_ref_q95:double,dataset_ref:string,null_spec_hash:string>>, five_clause map<string,boolean>"


def _json(**fields: Column | str) -> Column:
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def _with(doc: Column, **raw: Column) -> Column:
    """A JSON object with further members, given as JSON."""
    more = F.concat_ws(",", *[F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in raw.items()])
    return F.when(F.length(more) > 0, F.concat(F.substring(doc, F.lit(1), F.length(doc) - 1), F.lit(","), more, F.lit("}"))).otherwise(doc)


def geometry_drafts(results: DataFrame, actor: str = "loop:geometry") -> DataFrame:
    """Drafts of engine results (text): one for each artifact, batch of trials and clause. A result without the echo of its job's hash is an error."""
    r = results.select(F.from_json("text", RESULT).alias("r")).select("r.*")
    r = r.withColumn("job_hash_echo", F.when(F.coalesce("job_hash_echo", F.lit("")) != "", F.col("job_hash_echo")).otherwise(F.raise_error(F.lit("a result without job_hash_echo"))))
    intent = lambda x: F.concat("job_hash_echo", F.lit(":"), x)
    a = r.select("*", F.explode("artifacts").alias("a"))
    art = _json(artifact_id=F.coalesce(F.concat(F.lit("art_"), F.substring("a.sha256", 1, 12)), F.concat(F.lit("art_missing_"), "a.name")), role=F.coalesce("a.role", F.lit("engine_cache")), path=F.col("a.path"), declared_sha256=F.col("a.sha256"), provenance=F.struct(F.lit("matlab_sgl").alias("engine"), F.col("job_hash_echo").alias("job_hash")))
    b = r.select("*", F.explode("trial_batches").alias("b"))
    trial = _with(_json(block_id=F.col("block_id"), env_hash=F.col("env_hash"), **{k: F.col(f"b.{k}") for k in ("batch_id", "n_rows", "n_distinct_keys", "rows_file", "null_max_file", "gate_ref_q95", "dataset_ref", "null_spec_hash")}), engine_stamp=F.coalesce("engine_stamp", F.lit("{}")), pc_echo=F.col("pc_echo"))
    c = r.select("*", F.explode("five_clause").alias("clause", "ok"))
    clause = _json(candidate_id=F.col("candidate_id"), lineage_id=F.col("lineage_id"), clause=F.col("clause"), stamp=F.when(F.col("ok"), "measured_pass").otherwise("measured_fail"), evidence_ref=F.col("evidence_ref"))
    return drafts_of(a, "artifact.register", actor, art, intent(F.col("a.name"))).unionByName(drafts_of(b, "trials.record", actor, trial, intent(F.col("b.batch_id")))).unionByName(drafts_of(c, "cert.clause_stamp", actor, clause, intent(F.col("clause"))))


def population_drafts(results: DataFrame, actor: str = "loop:population") -> DataFrame:
    """The artifact and its mutation-audit stamp for each population result (sha256, path, content_digest, job_hash_echo, env_hash, causality_class, passed, caught, leaks)."""
    art = F.concat(F.lit("art_"), F.substring("sha256", 1, 12))
    prov = F.struct(F.lit("vbt").alias("engine"), F.col("job_hash_echo").alias("job_hash"), "env_hash", F.coalesce("causality_class", F.lit("audited")).alias("causality_class"))
    doc = _json(artifact_id=art, role="population", path=F.col("path"), declared_sha256=F.col("sha256"), content_digest=F.col("content_digest"), digest_scheme_version=scalar.SCHEME, provenance=prov)
    stamp = _json(artifact_id=art, stamp_kind="mutation_audit", passed=F.coalesce("passed", F.lit(False)), detail=F.struct(F.col("caught").alias("positive_control_caught"), F.col("leaks").alias("leaks_found")))
    return drafts_of(results, "artifact.register", actor, doc, F.concat(F.lit("pop:"), art)).unionByName(drafts_of(results, "artifact.stamp", actor, stamp, F.concat(F.lit("audit:"), art)))


def wiv_id(contract: Column, start: Column, end: Column) -> Column:
    """A window's identity: its data contract and dates."""
    return short_sha(_json(data_contract=contract, start=start, end=end), 8, "wiv_")


def seed_windowset(doc: dict, windowset_id: str, contract: str, clock: str, spark: SparkSession) -> DataFrame:
    """The draft that registers a parsed document's windows, exclusions and embargo."""
    rows = spark.createDataFrame([(w["start"], w["end"], w["role"]) for w in doc["windows"]], "start string, end string, role string")
    one = rows.withColumn("wiv_id", wiv_id(F.lit(contract), F.col("start"), F.col("end"))).agg(F.sort_array(F.collect_list(F.struct("start", "end", "wiv_id", "role", F.lit(contract).alias("data_contract")))).alias("windows"))
    e = doc["embargo"]
    gone = F.from_json(F.lit(scalar.canonical(doc.get("exclusions", [])).decode()), "array<struct<range:array<string>,rationale:string>>")
    body = _json(windowset_id=windowset_id, data_contract=contract, windows=F.col("windows"), exclusions=gone, embargo=F.struct(F.lit(e["left_days"]).alias("left_days"), F.lit(e["right_days"]).alias("right_days"), F.lit(True).alias("right_provisional")), anchor_field="exit", clock=clock, status="live")
    return drafts_of(one, "windowset.register", "human:operator", body, F.lit(f"seed:{windowset_id}"))


def seed_constants(docs: DataFrame) -> DataFrame:
    """Drafts that register documents (doc_id, text)."""
    return drafts_of(docs, "constants.register", "human:operator", F.col("text"), F.concat(F.lit("seed:"), "doc_id"))


def seed_artifacts(pins: DataFrame, found: DataFrame) -> DataFrame:
    """Drafts for pinned files (rel, role, sha256): those that are found (rel, path, sha256) are registered, others attested as missing. Another hash than the pinned one is an error."""
    both = pins.join(found.select("rel", "path", F.col("sha256").alias("_got")), "rel", "left")
    both = both.withColumn("sha256", F.when(F.col("_got").isNull() | (F.col("_got") == F.col("sha256")), F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("another hash than the pinned one: "), "rel"))))
    here = _json(artifact_id=F.concat(F.lit("art_"), F.substring("sha256", 1, 12)), role=F.col("role"), path=F.col("path"), declared_sha256=F.col("sha256"))
    gone = _json(name=F.col("rel"), expected_role=F.col("role"), why="absent at seed time")
    one = drafts_of(both.where("_got IS NOT NULL"), "artifact.register", "human:operator", here, F.concat(F.lit("pin:"), "rel"))
    return one.unionByName(drafts_of(both.where("_got IS NULL"), "artifact.attest_missing", "human:operator", gone, F.concat(F.lit("missing:"), "rel")))


def supersession(windows: DataFrame, spends: DataFrame) -> DataFrame:
    """One row: the carry-over of a windowset's windows (wiv_id), each with what was spent on it (wiv_id, scope) and the count of looks."""
    s = spends.groupBy("wiv_id").agg(F.sort_array(F.collect_set("scope")).alias("spends"), F.count(F.lit(1)).alias("k_cumulative"))
    rows = windows.join(s, "wiv_id", "left").select("wiv_id", F.coalesce("spends", F.array().cast("array<string>")).alias("spends"), F.coalesce("k_cumulative", F.lit(0)).alias("k_cumulative"))
    return rows.agg(F.sort_array(F.collect_list(F.struct("wiv_id", "spends", "k_cumulative"))).alias("carryover"))


class Field(NamedTuple):
    """A field of a job: which jobs have it, the constant that fills it, and the option that may, or the value that does, where there is no constant."""

    name: str
    jobs: str
    constant: str = ""
    option: str = ""
    default: object = None


#: The fields of job contracts. Names with a dot are members of an object.
JOB = [
    Field("windows.names", "search readout", "windows.names"),
    Field("windows.starts", "search readout", "windows.starts"),
    Field("windows.ends", "search readout", "windows.ends"),
    Field("exclusions", "search readout", "exclusions"),
    Field("embargo", "search readout", "embargo"),
    Field("min_window_side", "search readout", "min_window_side"),
    Field("fit", "search readout", "fit"),
    Field("null", "search readout", "null"),
    Field("pc_source_sha256", "search readout", "_provenance.source_sha256"),
    Field("search", "search", "search_space"),
    Field("budget.n_trials", "search", "budget.trials_soft", "trials"),
    Field("budget.n_seed", "search", "budget.seed_soft", "seed_points"),
    Field("budget.runs_per_k", "search", "budget.runs_per_k", "runs_per_k"),
    Field("K_values", "search", "", "k_values", (2, 3, 4, 5, 6, 7, 8, 9)),
    Field("objective", "search", "", "objective", "z"),
    Field("rng_seed", "search", "", "rng_seed", 42),
    Field("select.sel_pf", "readout", "select.sel_pf"),
    Field("select.sel_min_tr", "readout", "select.sel_min_tr"),
    Field("select.knn_k", "readout", "select.knn_k"),
]
SEATS = range(2, 13)


def _contract(kind: str, constants: dict, source: dict, given: dict, options: dict) -> dict:
    """A job's fields: those of the table, the ``source`` of its trades (a population, or both files of a legacy pair), what is ``given`` and, where told, the seats."""
    if not (source.get("population_parquet") or (source.get("legacy_txt") and source.get("legacy_csv"))):
        raise ValueError(f"a {kind} needs a population or a legacy pair")
    out: dict = {**source, **{k: v for k, v in given.items() if v is not None}}
    for f in JOB:
        if kind not in f.jobs.split():
            continue
        value = options.get(f.option) if f.option else None
        if value is None:
            value = reduce(lambda d, k: d[k], f.constant.split("."), constants) if f.constant else f.default
        *above, last = f.name.split(".")
        reduce(lambda d, k: d.setdefault(k, {}), above, out)[last] = list(value) if isinstance(value, (tuple, range)) else value
    seats = options.get("featureset")
    if seats:
        if len(seats) not in SEATS:
            raise ValueError(f"{SEATS[0]} to {SEATS[-1]} seats")
        out["featureset"] = {"mode": "seats", "features": list(seats)}
    return out


def job_hash(fields: dict) -> str:
    """Twelve digits of the hash of the fields as JSON with sorted keys and spaces after commas and colons."""
    return hashlib.sha256(json.dumps(fields, sort_keys=True).encode()).hexdigest()[:12]


def search_job(pc: dict, source: dict, side: str, selector: str, result: str, paths: dict | None = None, **options) -> dict:
    """A search's contract from the constants in force, with its hash. ``options``: trials, seed_points, runs_per_k, k_values, rng_seed, objective, featureset (seats); ``paths``: further
    fields as the engine names them, such as its own path and that of its progress."""
    made = _contract("search", pc, source, {"side": side, "selector": selector, "result_path": result, **(paths or {})}, options)
    return made | {"job_hash": job_hash(made)}


def readout_job(pc: dict, source: dict, config: dict, tag: str, result: str, side: str = "sell", seats: list[str] | None = None, paths: dict | None = None) -> dict:
    """A readout's contract of a configuration; it has no hash."""
    return _contract("readout", pc, source, {"side": side, "tag": tag, "config": config, "result_path": result, **(paths or {})}, {"featureset": seats})


def constants_in_force(base: dict, override: dict | None) -> dict:
    """An override document, where there is one, replaces the whole."""
    return override if override is not None else base


constants_file, pinned_constants = assignments.read, assignments.read_pinned


def constants_source(doc_id: str, entries: list[dict], name: str = "precommit_generated") -> str:
    """Source text of a function that sets every entry's value."""

    def shown(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        return f"'{v}'" if isinstance(v, str) else f"[{' '.join(map(str, v))}]" if isinstance(v, list) else str(v)

    head = [f"function PC = {name}()", f"% GENERATED from the registry constants doc {doc_id} — DO NOT EDIT (PC-echo will catch drift)"]
    return "\n".join([*head, *[f"PC.{e['key']} = {shown(e['value'])};" for e in entries if e.get("value") is not None], "end"]) + "\n"


def mask_table(doc: Column) -> Column:
    """Array of (ord, name, start, end) of a document's lists of names, starts and ends."""
    zipped = F.arrays_zip(doc["names"].alias("names"), doc["starts"].alias("starts"), doc["ends"].alias("ends"))
    return F.transform(zipped, lambda w, i: F.struct((i + 1).alias("ord"), w["names"].alias("name"), w["starts"].alias("start"), w["ends"].alias("end")))
