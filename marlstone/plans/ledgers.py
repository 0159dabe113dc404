"""Queries of folds over a log with payloads, of card parts, gates, lookups and validations, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.scalar import canonical_sha256
from marlstone.operators import cards, converters, gates, lookups
from marlstone.operators import projections as P
from marlstone.plans.governance import _doc, _name
from marlstone.plans.registry import POP, _masked, query, rounded
from marlstone.sources import tables

L = "WITH l AS (SELECT event_id AS seq, user_id AS u, value AS v, ts, event_id % 6 AS m FROM events) "


def _log(spark: SparkSession, d: str, kinds: dict[int, tuple[str, Column]], n: int = 6, actor: str = "human:operator") -> DataFrame:
    """Events as a log: the remainder of event_id by ``n`` tells the type and its payload; others are notes."""
    e = tables.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("u"), F.col("value").alias("v"), "ts")
    m = F.col("seq") % n
    pick = lambda i, other: F.coalesce(*[F.when(m == k, F.lit(x[i]) if isinstance(x[i], str) else x[i]) for k, x in kinds.items()], F.lit(other))
    return e.select("seq", _name("e", "seq").alias("event_id"), "ts", pick(0, "note.record").alias("type"), F.lit(actor).alias("actor"), F.array().cast("array<string>").alias("cites"), pick(1, '{"title":"t","body":"b"}').alias("payload"))


@query(L + """, r AS (SELECT seq, 'f' || u AS id, 'pending' AS s FROM l WHERE m = 0 UNION ALL SELECT seq, 'f' || u, 'core' FROM l WHERE m = 1 UNION ALL SELECT seq, 'f' || u, 'dormant' FROM l WHERE m = 2 UNION ALL SELECT seq, 'f' || (u + 1), 'extended' FROM l WHERE m = 2)
SELECT id AS feature_id, max(seq) AS seq, arg_max(s, seq) AS status FROM r GROUP BY id""")
def fold_features(spark, d):
    f = _name("f", "u")
    return P.features(_log(spark, d, {0: ("feature.register", _doc(feature_id=f, status="pending")), 1: ("feature.status_change", _doc(feature_id=f, to_status="core")), 2: ("feature.status_change", _doc(feature_id=f, to_status="dormant", swap_out=_name("f", F.col("u") + 1)))}))


@query(L + """, g AS (SELECT u, max(seq) FILTER (WHERE m = 0) AS s, arg_max(seq % 5 + 11, seq) FILTER (WHERE m = 0) AS granted FROM l GROUP BY u), a AS (SELECT l.* FROM l JOIN g USING (u) WHERE s IS NULL OR seq > s)
SELECT 'b' || g.u AS block_id, coalesce(bool_or(m = 1), false) AS frozen, coalesce(bool_or(m = 2), false) AS closed, 'c' || max(seq) FILTER (WHERE m = 3) AS superseded_by, (granted - coalesce(sum(seq % 3) FILTER (WHERE m = 4), 0))::BIGINT AS budget_remaining FROM g LEFT JOIN a ON a.u = g.u GROUP BY g.u, granted, s HAVING s IS NOT NULL OR count(*) FILTER (WHERE m BETWEEN 1 AND 4) > 0""")
def fold_blocks(spark, d):
    b = _name("b", "u")
    arm = lambda name, n: F.struct(F.lit(name).alias("arm_id"), n.cast("long").alias("budget"))
    log = _log(spark, d, {0: ("block.register", _doc(block_id=b, family_id="m", featureset_hash="f", arms=F.array(arm("a", F.col("seq") % 5 + 1), arm("b", F.lit(10))))), 1: ("block.freeze", _doc(block_id=b, declared_width=3)), 2: ("block.close", _doc(block_id=b)), 3: ("block.supersede", _doc(old_block_id=b, new_block_id=_name("c", "seq"))), 4: ("trials.open_batch", _doc(batch_id="t", block_id=b, n_planned=F.col("seq") % 3))})
    return P.blocks(P.block_base(log)).select("block_id", "frozen", "closed", "superseded_by", "budget_remaining")


@query(L + """, g AS (SELECT u, max(seq) FILTER (WHERE m = 0) AS s FROM l WHERE m < 4 GROUP BY u), a AS (SELECT l.* FROM l JOIN g USING (u) WHERE m IN (1, 2) AND (s IS NULL OR seq > s))
SELECT 'y' || g.u AS cycle_id, CASE WHEN bool_or(m = 1) THEN 'closed' ELSE 'open' END AS status, count(*) FILTER (WHERE m = 2)::BIGINT AS n_dispatched, 'k' || max(seq) FILTER (WHERE m = 2 AND seq % 4 = 0) AS valid FROM g LEFT JOIN a ON a.u = g.u GROUP BY g.u, s HAVING s IS NOT NULL OR count(a.m) > 0""")
def fold_cycles(spark, d):
    y = _name("y", "u")
    kind = F.when(F.col("seq") % 4 == 0, "stage0_enumerate").otherwise("rehearsal")
    log = _log(spark, d, {0: ("cycle.open", _doc(cycle_id=y, score_fn_version="1")), 1: ("cycle.close", _doc(cycle_id=y)), 2: ("stage.dispatch", _doc(cycle_id=y, job_kind=kind, job_id="j", inputs=F.struct(F.array(_name("k", "seq")).alias("stage0_valid"))))})
    return P.cycles(P.cycle_base(log)).select("cycle_id", "status", "n_dispatched", F.array_join("stage0_valid", ",").alias("valid"))


@query(L + " SELECT 'readout_conditional_channel' AS key, arg_max(seq % 4 < 2, seq) AS suspended FROM l WHERE m = 0")
def fold_suspended(spark, d):
    value = F.when(F.col("seq") % 4 < 2, P.SUSPENDED).otherwise("active")
    entry = F.array(F.struct(F.lit(P.CHANNEL).alias("key"), value.alias("value")))
    return P.suspended(_log(spark, d, {0: ("constants.amend", _doc(series="autonomy_constants", new_doc_id=_name("d", "seq"), version=2, entries=entry))}))


@query(L + """, g AS (SELECT u, max(seq) FILTER (WHERE m = 0) AS s, arg_max(seq % 7, seq) FILTER (WHERE m = 0) AS blk FROM l GROUP BY u), a AS (SELECT l.* FROM l JOIN g USING (u) WHERE s IS NOT NULL AND seq > s AND m = 1)
SELECT 'b' || blk AS block_id, count(DISTINCT g.u)::BIGINT AS n_batches, coalesce(sum(a.seq % 10), 0)::BIGINT AS n_rows FROM g LEFT JOIN a ON a.u = g.u WHERE s IS NOT NULL GROUP BY blk""")
def deflation_by_block(spark, d):
    """Batches, also those without a record, and recorded rows of each block."""
    t = _name("t", "u")
    log = _log(spark, d, {0: ("trials.open_batch", _doc(batch_id=t, block_id=_name("b", F.col("seq") % 7), n_planned=1)), 1: ("trials.record", _doc(batch_id=t, block_id="x", n_rows=F.col("seq") % 10))})
    b = P.batches(P.batch_base(log)).where("block_id IS NOT NULL")
    return b.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_batches"), F.sum("n_rows").alias("n_rows"))


@query(L + """, q AS (SELECT u, max(seq) AS s FROM l WHERE m = 0 GROUP BY u), a AS (SELECT l.*, s FROM l JOIN q USING (u) WHERE seq > s AND m IN (1, 2))
SELECT 'r' || u AS readout_id, max(seq) FILTER (WHERE m = 1) AS seq, arg_max(CASE WHEN v > 200 OR seq % 17 = 0 THEN 'L2' WHEN v > 60 THEN 'L1' ELSE 'none' END, seq) FILTER (WHERE m = 1) AS class, bool_or(m = 2) AS voided, 'w' || (s % 5) AS lineage FROM a WHERE (s // 6) % 3 > 0 GROUP BY u, s HAVING bool_or(m = 1)""")
def fold_placebo_history(spark, d):
    """Recorded readouts with their class; those for rehearsal leave no mark. Windowsets are unknown, so each is its own lineage."""
    r = _name("r", "u")
    result = F.struct(F.col("v").alias("max_z"), F.lit(60.0).alias("gate_ref"), F.lit(200.0).alias("extended_max"), (F.col("seq") % 17 == 0).alias("at_shot_clause_pass"))
    log = _log(spark, d, {0: ("readout.request", _doc(readout_id=r, windowset_id=_name("w", F.col("seq") % 5), purpose=F.when(F.floor(F.col("seq") / 6) % 3 == 0, "rehearsal").otherwise("readout"))), 1: ("readout.record", _doc(readout_id=r, five_clause=F.struct(F.lit(True).alias("c")), placebo_result=result)), 2: ("readout.void", _doc(readout_id=r))})
    return P.placebo_history(P.readouts(P.readout_base(log)), spark.createDataFrame([], "windowset_id string, lineage_id string"))


@query(L + """, s AS (SELECT u, v, seq, m FROM l) SELECT 'c' || u AS series, 'd' || max(seq) AS doc_id, array_to_string(list_filter([CASE WHEN arg_max(seq % 2, seq) = 0 THEN 'a' END, 'b'], lambda x: x IS NOT NULL), ',') AS provisional FROM s WHERE m < 2 GROUP BY u""")
def answer_constants(spark, d):
    from marlstone.operators import ledger

    entry = lambda k, fin: F.struct(F.lit(k).alias("key"), fin.alias("finality"))
    entries = F.array(entry("a", F.when(F.col("seq") % 2 == 0, "provisional").otherwise("final")), entry("b", F.lit("provisional")), entry("c", F.lit("final")))
    log = _log(spark, d, {0: ("constants.register", _doc(series=_name("c", "u"), doc_id=_name("d", "seq"), version=1, entries=entries)), 1: ("constants.amend", _doc(series=_name("c", "u"), new_doc_id=_name("d", "seq"), version=2, entries=entries))})
    return ledger.answer_constants(P.State(constants=P.constants(log)))


@query("WITH c AS (SELECT p_brand AS s, bool_or(p_size % 5 = 0 AND p_size % 2 = 1) AS f FROM part GROUP BY p_brand) SELECT array_to_string(list_sort(list('provisional:' || s)), ',') AS flags FROM c WHERE f")
def card_flags(spark, d):
    """Series with a known provisional entry."""
    e = F.struct(F.lit("k").alias("key"), F.lit("1").alias("value"), F.when(F.col("p_size") % 5 == 0, "provisional").otherwise("final").alias("finality"), (F.col("p_size") % 2 == 0).alias("unknown"))
    docs = tables.table(spark, d, "part").groupBy(F.col("p_brand").alias("series")).agg(F.collect_list(e).alias("entries"))  # a document's entries
    return cards.provisional_flags(docs).select(F.array_join("provisional_flags", ",").alias("flags"))


@query("SELECT event_type AS population_ref, round(avg((value < 20)::INTEGER), 9) AS abstain_fraction, count(*) FILTER (WHERE value >= 0 AND value < 10)::BIGINT AS n1, count(*) FILTER (WHERE value >= 10 AND value < 50)::BIGINT AS n2 FROM events GROUP BY event_type")
def card_novelty(spark, d):
    e = tables.table(spark, d, "events").select(F.col("event_type").alias("population_ref"), F.col("value").alias("affinity"))
    n = cards.novelty_payload(e, 20.0, [0.0, 10.0, 50.0])
    h = F.col("affinity_histogram")
    return n.select("population_ref", F.round("abstain_fraction", 9).alias("abstain_fraction"), h[0]["n"].alias("n1"), h[1]["n"].alias("n2"))


@query("WITH n AS (SELECT event_type AS side, user_id, count(*) AS n FROM events GROUP BY ALL) SELECT side, array_to_string(list_sort(list(n), 'DESC'), ',') AS sizes FROM n GROUP BY side")
def cluster_fingerprint(spark, d):
    f = converters.fingerprint(tables.table(spark, d, "events"), "event_type", "user_id")
    return f.select(F.col("event_type").alias("side"), F.array_join(F.transform("sizes", lambda x: x.cast("string")), ",").alias("sizes"))


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, d):
    rows = tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber").alias("k"))
    return converters.repeated(rows, "k").select("k.*", "n")


@query("""WITH y AS (SELECT event_id, event_type AS side, ts, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos, CAST(date_trunc('year', ts) AS DATE) AS y FROM events), m AS (SELECT *, y + INTERVAL 2 MONTH AS m3, y + INTERVAL 10 MONTH AS m11 FROM y),
s AS (SELECT *, m3 + to_days((7 - dayofweek(m3)::INTEGER) % 7 + 7) AS a, m11 + to_days((7 - dayofweek(m11)::INTEGER) % 7) AS b FROM m)
SELECT side, count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE (hour(ts) + CASE WHEN ts >= a AND ts < b THEN 3 ELSE 2 END) % 24 <> (hour(ts) + 2) % 24)::BIGINT AS mismatches FROM s GROUP BY side""")
def clock_law(spark, d):
    """Rows that always tell winter's hour against the clock."""
    pos = (F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1).alias("pos")
    e = tables.table(spark, d, "events").select(F.col("event_type").alias("side"), "ts", pos)
    return converters.clock_mismatches(e.select("side", "pos", ((F.hour("ts") + 2) % 24).alias("hour")), e)


@query("""WITH f AS (SELECT DISTINCT ON (k) strftime(ts, '%Y-%m-%dT%H:%M:%S') AS k, event_id AS x FROM events ORDER BY k, event_id), f2 AS (SELECT CASE WHEN x % 3 = 0 THEN k || '.500' ELSE k END AS k, x FROM f),
e AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 2 = 0 THEN '.500' ELSE '' END AS t FROM events) SELECT event_id, coalesce(a.x, b.x) AS fc_x FROM e LEFT JOIN f2 a ON a.k = e.t LEFT JOIN f2 b ON b.k = substr(e.t, 1, 19)""")
def attach_features(spark, d):
    """By the whole text of a time, else by its seconds."""
    e = tables.table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("k"))
    f = e.groupBy("k").agg(F.min("event_id").alias("x")).select(F.when(F.col("x") % 3 == 0, F.concat("k", F.lit(".500"))).otherwise(F.col("k")).alias("k"), "x")
    rows = e.select("event_id", F.concat("k", F.when(F.col("event_id") % 2 == 0, ".500").otherwise("")).alias("at"))
    return lookups.attach(rows, "at", f, "k").select("event_id", "fc_x")


@query("""WITH z AS (SELECT l_partkey % 6 AS arm, l_suppkey % 8 AS pos, sum(l_quantity) AS z FROM lineitem GROUP BY ALL), t AS (SELECT pos, max(z) AS z, count(DISTINCT arm) AS k FROM z GROUP BY pos) SELECT max(k)::BIGINT AS n_arms, round(quantile_cont(z, 0.95), 6) AS batch_gate FROM t""")
def batch_gate(spark, d):
    z = tables.table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 6).alias("arm"), (F.col("l_suppkey") % 8).alias("pos")).agg(F.sum("l_quantity").cast("double").alias("z"))
    nulls = z.groupBy("arm").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "z"))), lambda x: x["z"]).alias("null_z"))  # eight places
    return rounded(gates.batch_gate(nulls))


@query("WITH k AS (SELECT p_brand AS run, p_partkey AS k, p_retailprice AS z, p_size > 10 AS ok FROM part), a AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY z DESC, k) AS r FROM k WHERE z > 1000 AND ok), f AS (SELECT run, arg_max(k, (z, -k)) AS k FROM k GROUP BY run) SELECT run, k AS arm FROM a WHERE r <= 4 UNION ALL SELECT run, k FROM f WHERE run NOT IN (SELECT run FROM a)")
def batch_arms(spark, d):
    """The best four of a run's entries that beat the gate and can be selected, else its selected one."""
    k = tables.table(spark, d, "part").select(F.col("p_brand").alias("run"), F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("z"), (F.col("p_size") > 10).alias("ok"))
    return gates.arms(k, "run", "k", F.lit(1000.0), 4)


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS side, l_extendedprice AS p, CASE WHEN l_quantity > 10 THEN l_quantity - 15 END AS atr, CASE WHEN l_discount < 0.08 THEN l_extendedprice * (1 + l_tax) END AS x FROM lineitem), m AS (SELECT coalesce(median(atr) FILTER (WHERE atr > 0), 1.0) AS med FROM t)
SELECT side, count(*)::BIGINT AS n, round(sum(CASE WHEN x IS NULL THEN 0 ELSE (x - p) * side / (2.0 * CASE WHEN atr > 0 THEN atr ELSE med END) END), 2) AS r FROM t, m GROUP BY side""")
def r_multiples(spark, d):
    """Price moves in units of the stop's distance; without a range at entry its median stands in, without an exit the move is 0."""
    q = F.col("l_quantity").cast("double")
    t = tables.table(spark, d, "lineitem").select(F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("side"), F.col("l_extendedprice").alias("entry"), F.when(F.col("l_discount") < 0.08, F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("exit"), F.when(q > 10, q - 15).alias("atr"))
    return gates.r_multiples(t, 2.0).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r"), 2).alias("r"))


@query(POP + " SELECT l_partkey % 100 AS config, round(avg(profit) FILTER (WHERE train AND side = 'buy'), 6) AS expectancy FROM masked GROUP BY ALL ORDER BY expectancy DESC NULLS LAST, config LIMIT 40")
def sweep_rank(spark, d):
    """Configs by expectancy in training, those without one last."""
    m = _masked(spark, d).groupBy((F.col("l_partkey") % 100).alias("config")).agg(F.avg(F.when(F.col("train") & (F.col("side") == "buy"), F.col("profit"))).alias("expectancy"))
    return rounded(m).orderBy(F.col("expectancy").desc_nulls_last(), "config").limit(40)


@query("SELECT p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS best FROM part GROUP BY p_brand")
def best_by_selector(spark, d):
    """The candidate of the highest selector, the first of equal ones."""
    return tables.table(spark, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("best"))


@query("SELECT DISTINCT o_custkey AS set, o_orderkey AS wiv FROM orders WHERE o_totalprice > 200000 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def carryover_missing(spark, d):
    """Spent windows of a set that are not carried over."""
    o = tables.table(spark, d, "orders")
    old = o.select(F.col("o_custkey").alias("set"), F.col("o_orderkey").alias("wiv")).distinct()
    heavy = tables.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("wiv")).distinct()
    return lookups.spent_not_carried(old, o.where("o_totalprice > 200000").select(F.col("o_orderkey").alias("wiv")), old.join(heavy, "wiv", "left_semi"))


@query("SELECT event_id, coalesce('l' || p_size, 'w' || (event_id % 300)) AS lineage FROM events LEFT JOIN (SELECT * FROM part WHERE p_size > 20) ON p_partkey = event_id % 300")
def lineage_lookup(spark, d):
    sets = tables.table(spark, d, "part").where("p_size > 20").select(_name("w", "p_partkey").alias("windowset_id"), _name("l", "p_size").alias("lineage_id"))
    e = tables.table(spark, d, "events").select("event_id", _name("w", F.col("event_id") % 300).alias("windowset_id"))
    return P.lineage_of(e, sets).select("event_id", "lineage")


@query("SELECT r_regionkey, o AS ord, 'W' || o AS name, (2000 + o)::VARCHAR AS start, (2001 + o)::VARCHAR AS \"end\" FROM region, (SELECT unnest(range(1, 4)) AS o)")
def mask_windows(spark, d):
    """A document's lists of names, starts and ends as rows."""
    texts = lambda f: F.array(*[F.lit(f(i)) for i in range(1, 4)])
    doc = F.struct(texts(lambda i: f"W{i}").alias("names"), texts(lambda i: str(2000 + i)).alias("starts"), texts(lambda i: str(2001 + i)).alias("ends"))
    return tables.table(spark, d, "region").select("r_regionkey", F.explode(converters.mask_table(doc)).alias("w")).select("r_regionkey", F.col("w.ord").cast("long").alias("ord"), "w.name", "w.start", "w.end")


@query("SELECT p_partkey, p_size IN (1, 2, 3, 10, 20) AND p_brand <> 'Brand#11' AND (p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_size <> 2)) AS valid FROM part")
def menu_validation(spark, d):
    """Proposals whose values are on the menu and whose features, where given, are 2 to 12 different known ones."""
    p = tables.table(spark, d, "part")
    brands = p.where("p_brand <> 'Brand#11'").select("p_brand").distinct()
    given = F.when(F.col("p_partkey") % 3 == 1, F.when(F.col("p_size") == 2, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))).when(F.col("p_partkey") % 3 == 2, F.array(F.lit("a"), F.lit("zz")))
    known = p.join(F.broadcast(brands.withColumn("_on", F.lit(True))), "p_brand", "left")  # brands are a menu
    ok = gates.on_menu({"size": (F.col("p_size"), [1, 2, 3, 10, 20])}, given, ["a", "b", "c"])
    return known.select("p_partkey", (ok & F.coalesce("_on", F.lit(False))).alias("valid"))


@query("""SELECT p_partkey, substr(sha256('{"days":"all","size":' || p_size || '}'), 1, 12) AS tight, substr(sha256('{"days": "all", "size": ' || p_size || '}'), 1, 12) AS spaced, 'wiv_' || substr(sha256('{"data_contract":"c","end":"' || p_size || '","start":"' || p_partkey || '"}'), 1, 8) AS wiv_id FROM part""")
def config_keys(spark, d):
    """Short keys of configs: of canonical text, and of text with a space after each mark."""
    doc = F.to_json(F.struct(F.col("p_size").alias("size"), F.lit("all").alias("days")))
    spaced = F.concat(F.lit('{"days": "all", "size": '), F.col("p_size").cast("string"), F.lit("}"))
    wiv = converters.wiv_id(F.lit("c"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string"))
    return tables.table(spark, d, "part").select("p_partkey", F.substring(canonical_sha256(doc), 1, 12).alias("tight"), F.substring(F.sha2(spaced, 256), 1, 12).alias("spaced"), wiv.alias("wiv_id"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'cycle: side' || user_id WHEN 1 THEN '  -> KILLED AT GATE (chance-level)' WHEN 2 THEN '  -> PARKED: why' || user_id ELSE '  -> READOUT VERDICT=FAILED (failing clauses: ' || CASE WHEN user_id % 2 = 0 THEN 'c2' ELSE 'none' END || ')' END AS line FROM events""")
def verdict_digest(spark, d):
    """Verdicts without the numbers behind them."""
    e = tables.table(spark, d, "events")
    kind = F.element_at(F.array(*map(F.lit, ("cycle.open", "cycle.no_candidate", "cycle.parked", "readout.record"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = e.select("event_id", kind.alias("type"), _name("side", "user_id").alias("side"), _name("why", "user_id").alias("reason"), F.lit("FAILED").alias("verdict"), F.create_map(F.lit("c1"), F.lit(True), F.lit("c2"), F.col("user_id") % 2 == 1).alias("clauses"))
    return rows.select("event_id", gates.digest_line().alias("line"))
