"""Queries of projections and views: spends, deflation, cards, verdicts, blobs and clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import scalar
from marlstone.functions.semantics import profit_factor
from marlstone.operators import eventlog, gates, masking, ranking
from marlstone.operators.placing import placed
from marlstone.plans.registry import LOG, POP, TWINS, _log, _masked, _pf, _twins, query, rounded
from marlstone.sources import tables


@query("""WITH y AS (SELECT event_id, ts, CAST(date_trunc('year', ts) AS DATE) AS y FROM events), m AS (SELECT *, y + INTERVAL 2 MONTH AS m3, y + INTERVAL 10 MONTH AS m11 FROM y),
s AS (SELECT *, m3 + to_days((7 - dayofweek(m3)::INTEGER) % 7 + 7) AS a, m11 + to_days((7 - dayofweek(m11)::INTEGER) % 7) AS b FROM m)
SELECT event_id, (CASE WHEN ts >= a AND ts < b THEN 3 ELSE 2 END)::INTEGER AS offset_hours, hour(ts + to_hours(CASE WHEN ts >= a AND ts < b THEN 3 ELSE 2 END))::INTEGER AS server_hour FROM s""")
def us_dst_hour(spark: SparkSession, d: str) -> DataFrame:
    off = scalar.us_dst_hours(F.col("ts"))
    return tables.table(spark, d, "events").select("event_id", off.cast("int").alias("offset_hours"), F.pmod(F.hour("ts") + off, F.lit(24)).cast("int").alias("server_hour"))


@query("SELECT event_id, strftime(ts, '%Y-%m') AS month, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS band FROM events WHERE isodow(ts) BETWEEN 2 AND 5")
def weekday_bands(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "events").where(F.weekday("ts").isin(1, 2, 3, 4))
    return e.select("event_id", F.date_format("ts", "yyyy-MM").alias("month"), scalar.band(F.col("value"), [10.0, 50.0], ["low", "mid", "high"]).alias("band"))


@query(LOG + " SELECT lineage, count(*) FILTER (WHERE type = 'record')::BIGINT AS n_rows, count(DISTINCT CASE WHEN type = 'request' THEN seq END)::BIGINT AS n_batches FROM log GROUP BY lineage")
def deflation_view(spark: SparkSession, d: str) -> DataFrame:
    # A request opens a batch, once each, so that counting needs no distinct.
    return _log(spark, d).groupBy("lineage").agg(F.count_if(F.col("type") == "record").alias("n_rows"), F.count_if(F.col("type") == "request").alias("n_batches"))


@query(LOG + " SELECT lineage, strftime(ts, '%Y-%m') AS month, count(*)::BIGINT AS spent, min(seq) AS first_seq, max(seq) AS last_seq FROM log WHERE type = 'request' GROUP BY ALL")
def spend_view(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).where("type = 'request'").groupBy("lineage", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("spent"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


_TPF = "coalesce(sum(profit) FILTER (WHERE profit > 0), 0) / greatest(coalesce(-sum(profit) FILTER (WHERE profit <= 0), 0), 1e-9)"


@query(TWINS + f", p AS (SELECT component, twin, {_TPF} AS pf FROM t WHERE train GROUP BY ALL), q AS (SELECT component, {_TPF} AS real_pf FROM r WHERE train GROUP BY component) SELECT component, count(*)::BIGINT AS n_twins, count(*) FILTER (WHERE pf >= real_pf)::BIGINT AS beats, CASE WHEN count(*) FILTER (WHERE pf >= real_pf) >= 4 THEN 'LEAKY' ELSE 'CLEAN' END AS verdict FROM p JOIN q USING (component) GROUP BY component")
def twin_battery(spark: SparkSession, d: str) -> DataFrame:
    pop, twins = _twins(spark, d)
    return gates.twin_verdict(pop.where("train"), twins.where("train"), "component")


VERDICTS = "SELECT l_orderkey % 97 AS grp, CASE WHEN l_quantity > 45 THEN 'CERTIFIED' WHEN l_quantity > 20 THEN 'CANDIDATE' ELSE 'FAILED' END AS verdict, l_partkey * 100000 + l_suppkey AS arm FROM lineitem"


@query(f"SELECT grp, arg_max(verdict, (k, -arm)) AS verdict, -arg_max(-arm, (k, -arm)) AS arm FROM (SELECT *, CASE verdict WHEN 'CERTIFIED' THEN 2 WHEN 'CANDIDATE' THEN 1 ELSE 0 END AS k FROM ({VERDICTS})) GROUP BY grp")
def best_verdict(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    v = F.when(q > 45, "CERTIFIED").when(q > 20, "CANDIDATE").otherwise("FAILED")
    rows = tables.table(spark, d, "lineitem").select((F.col("l_orderkey") % 97).alias("grp"), v.alias("verdict"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("arm"))
    return ranking.best_by_rank(rows, ["grp"], {"CERTIFIED": 2, "CANDIDATE": 1, "FAILED": 0}, "verdict", "arm")


@query(POP + f", h AS (SELECT l_partkey % 200 AS config, side, {_pf('train')} AS pf, avg(profit) FILTER (WHERE train) AS e FROM masked GROUP BY ALL) SELECT config, side, round(pf, 6) AS train_pf FROM h WHERE e > 0 OR pf > 0.4 ORDER BY pf DESC, config, side LIMIT 15")
def stage1_top15(spark: SparkSession, d: str) -> DataFrame:
    m = _masked(spark, d).withColumn("config", F.col("l_partkey") % 200)
    p = F.when(F.col("train"), F.col("profit"))
    h = m.groupBy("config", "side").agg(profit_factor(p, F.lit(None).cast("double")).alias("train_pf"), F.avg(p).alias("e"))
    return rounded(h.where("e > 0 OR train_pf > 0.4").orderBy(F.col("train_pf").desc_nulls_last(), "config", "side").limit(15).drop("e"))


def _hz(q: float) -> str:
    at = f"(n * {q}::DOUBLE + 0.5)"
    lo = f"greatest(1, least(n, floor({at})::BIGINT))"
    return f"(v[{lo}] + (v[least(n, {lo} + 1)] - v[{lo}]) * greatest(0, least(1, {at} - {lo})))"


@query(f"""WITH t AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x FROM embeddings), l AS (SELECT label, list_sort(list(x)) AS v, count(*) AS n FROM t WHERE vec_id % 2 = 0 GROUP BY label),
f AS (SELECT label, {_hz(0.5)} AS med, {_hz(0.01)} AS p1, {_hz(0.99)} AS p99, {_hz(0.75)} - {_hz(0.25)} AS iqr FROM l)
SELECT vec_id, round((greatest(p1, least(p99, x)) - med) / CASE WHEN iqr < 1e-10 THEN 1 ELSE iqr END, 6) + 0 AS scaled FROM t JOIN f USING (label)""")
def robust_scale(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("x"))
    fit = gates.robust_fit(rows.where("vec_id % 2 = 0"), ["label"], "x")
    return rounded(gates.robust_apply(rows, fit, ["label"], "x").select("vec_id", "scaled"))


@query(POP + f", b AS (SELECT l_partkey % 50 AS blob, side, {_pf('train')} AS pf, count(*) FILTER (WHERE train) AS n FROM masked GROUP BY ALL) SELECT blob, side, round(pf, 6) AS pf, n::BIGINT AS n FROM b WHERE pf >= 0.45 AND n >= 30")
def blob_select(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("train"), F.col("profit"))
    b = _masked(spark, d).groupBy((F.col("l_partkey") % 50).alias("blob"), "side").agg(profit_factor(p, F.lit(None).cast("double")).alias("pf"), F.count(p).alias("n"))
    return rounded(b.where("pf >= 0.45 AND n >= 30"))


@query("WITH b AS (SELECT l_returnflag AS a, l_linestatus AS b, l_partkey AS k FROM lineitem), s AS (SELECT a || b AS seed, k FROM b GROUP BY ALL), n AS (SELECT seed, count(*) AS n FROM s GROUP BY seed), j AS (SELECT x.seed AS s1, y.seed AS s2, count(*) AS m FROM s x JOIN s y ON x.k = y.k AND x.seed < y.seed GROUP BY ALL) SELECT s1, s2, round(m::DOUBLE / (p.n + q.n - m), 6) AS jaccard FROM j JOIN n p ON p.seed = s1 JOIN n q ON q.seed = s2")
def reseed_jaccard(spark: SparkSession, d: str) -> DataFrame:
    # Members are counted by join, seeds being few; no set of members is gathered.
    s = tables.table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("seed"), F.col("l_partkey").alias("k")).distinct()
    n = s.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    j = s.select(F.col("seed").alias("s1"), "k").join(s.select(F.col("seed").alias("s2"), "k"), "k").where("s1 < s2").groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("m"))
    j = j.join(n.select(F.col("seed").alias("s1"), F.col("n").alias("n1")), "s1").join(n.select(F.col("seed").alias("s2"), F.col("n").alias("n2")), "s2")
    return j.select("s1", "s2", F.round(F.col("m") / (F.col("n1") + F.col("n2") - F.col("m")), 6).alias("jaccard"))


@query(POP + ", c AS (SELECT side, l_partkey % 20 AS blob, count(*) FILTER (WHERE win_id > 0) AS n FROM masked GROUP BY ALL), k AS (SELECT side, arg_max(blob, (n, -blob)) AS carrier, max(n) AS n FROM c GROUP BY side) SELECT side, carrier, n::BIGINT AS n FROM k")
def carrier_blob(spark: SparkSession, d: str) -> DataFrame:
    c = _masked(spark, d).groupBy("side", (F.col("l_partkey") % 20).alias("blob")).agg(F.count_if(F.col("win_id") > 0).alias("n"))
    return c.groupBy("side").agg(F.max_by("blob", F.struct(F.col("n"), -F.col("blob"))).alias("carrier"), F.max("n").alias("n"))


@query(POP + " SELECT side, max(entry_ts) AS last_ts, (date_diff('day', DATE '2000-09-01', max(entry_ts)::DATE) // 7)::INTEGER AS weeks, count(*)::BIGINT AS n FROM masked WHERE entry_ts >= DATE '2000-09-01' GROUP BY side")
def virgin_span(spark: SparkSession, d: str) -> DataFrame:
    m = _masked(spark, d).where(F.col("entry_ts") >= F.lit("2000-09-01").cast("date").cast("timestamp_ntz"))
    weeks = F.floor(F.datediff(F.max("entry_ts").cast("date"), F.lit("2000-09-01").cast("date")) / 7).cast("int")
    return m.groupBy("side").agg(F.max("entry_ts").alias("last_ts"), weeks.alias("weeks"), F.count(F.lit(1)).alias("n"))


@query(POP + ", g AS (SELECT s.side, w.ord AS win_id FROM (SELECT DISTINCT side FROM masked) s, win w), c AS (SELECT side, win_id, count(*) AS n FROM masked WHERE win_id > 0 GROUP BY ALL) SELECT g.side, g.win_id::INTEGER AS win_id, coalesce(n, 0)::BIGINT AS n FROM g LEFT JOIN c ON g.side = c.side AND g.win_id = c.win_id WHERE coalesce(n, 0) < 100000")
def thin_windows(spark: SparkSession, d: str) -> DataFrame:
    return masking.thin_windows(_masked(spark, d), 100_000, len(tables.WINDOWS))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, substr(sha256(coalesce(text, '')), 1, 2) || '/' || sha256(coalesce(text, '')) AS path FROM documents")
def content_addressed(spark: SparkSession, d: str) -> DataFrame:
    sha = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return tables.table(spark, d, "documents").select("doc_id", sha.alias("sha256"), F.concat_ws("/", F.substring(sha, 1, 2), sha).alias("path"))


# A log of canonical lines whose every 101st event is altered after it was hashed and every 173rd carries a false link.
def _body(head: str, of: str = "") -> str:
    return f"""'{{"payload":{{"v":' || {of}event_id || '}},"prev_hash":"' || {head} || '","seq":' || {of}i || '}}'"""


@query(f"""WITH RECURSIVE n AS (SELECT user_id AS lineage, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
f AS (SELECT lineage, event_id, i, sha256({_body("repeat('0', 64)")}) AS h FROM n WHERE i = 0
UNION ALL SELECT n.lineage, n.event_id, n.i, sha256({_body("f.h", "n.")}) FROM f JOIN n ON n.lineage = f.lineage AND n.i = f.i + 1)
SELECT lineage, count(*)::BIGINT AS n, min(i) FILTER (WHERE event_id % 101 = 0 OR event_id % 173 = 0) AS first_bad_seq, arg_max(h, i) AS head FROM f GROUP BY lineage""")
def hash_verify(spark: SparkSession, d: str) -> DataFrame:
    """Chains are made by SQL functions and walked by the verifier, which hashes every line anew."""
    rows = tables.table(spark, d, "events").groupBy(F.col("user_id").alias("lineage")).agg(F.sort_array(F.collect_list("event_id")).alias("ids"))  # a log's own events
    line = lambda prev, i, v: F.concat(F.lit('{"payload":{"v":'), v, F.lit('},"prev_hash":"'), prev, F.lit('","seq":'), i.cast("string"), F.lit("}"))
    step = lambda s, i: F.struct(s["h"].alias("prev"), F.sha2(line(s["h"], i, F.get("ids", i.cast("int")).cast("string")).cast("binary"), 256).alias("h"))
    chain = F.aggregate(F.sequence(F.lit(0).cast("long"), F.size("ids") - 1), F.array(F.struct(F.lit("").alias("prev"), F.lit(eventlog.GENESIS).alias("h"))), lambda a, i: F.concat(a, F.array(step(F.element_at(a, -1), i))))
    flat = rows.select("lineage", F.posexplode(F.arrays_zip("ids", F.slice(chain, F.lit(2), F.size("ids")).alias("links"))).alias("line_no", "x")).select("lineage", F.col("line_no").cast("long").alias("line_no"), F.col("x.ids").alias("id"), "x.links.prev", "x.links.h")
    told = F.when(F.col("id") % 173 == 0, F.lit("false")).otherwise(F.col("prev"))
    value = F.when(F.col("id") % 101 == 0, F.concat(F.lit("1"), F.col("id").cast("string"))).otherwise(F.col("id").cast("string"))
    raw = F.concat(F.lit('{"event_hash":"'), "h", F.lit('",'), F.substring(line(told, F.col("line_no"), value), 2, 10_000))
    got = eventlog.verify(flat.select(F.col("lineage").alias("log"), "line_no", raw.alias("raw")))
    heads = flat.groupBy("lineage").agg(F.max_by("h", "line_no").alias("head"))
    return got.join(heads, F.col("log") == F.col("lineage")).select("lineage", "n", "first_bad_seq", "head")


ORDERED = f"WITH RECURSIVE {LOG[5:]}, n AS (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY seq) AS i FROM log WHERE type IN ('register', 'request', 'void')), "


@query(ORDERED + """f AS (SELECT lineage, i, (type = 'register')::BIGINT AS g, CASE WHEN type = 'register' THEN 8 ELSE 0 END::BIGINT AS r, (type = 'request')::BIGINT AS c, (type = 'request')::BIGINT AS k FROM n WHERE i = 1
UNION ALL SELECT n.lineage, n.i, g + (type = 'register')::BIGINT, CASE type WHEN 'register' THEN 8 WHEN 'request' THEN greatest(0, r - 1) ELSE CASE WHEN c > 0 THEN r + 1 ELSE r END END::BIGINT,
 CASE type WHEN 'register' THEN 0 WHEN 'request' THEN c + 1 ELSE greatest(0, c - 1) END::BIGINT, k + (type = 'request')::BIGINT FROM f JOIN n ON n.lineage = f.lineage AND n.i = f.i + 1),
m AS (SELECT lineage, count(DISTINCT strftime(ts, '%Y-%m')) FILTER (WHERE type = 'request') AS months FROM n GROUP BY lineage)
SELECT f.lineage, arg_max(g, i) AS generation, arg_max(r, i) AS remaining, arg_max(c, i) AS consumed, arg_max(k, i) AS k_cumulative, any_value(months)::BIGINT AS months FROM f JOIN m USING (lineage) GROUP BY f.lineage""")
def slot_fold(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.slots(_log(spark, d))


@query(ORDERED + """f AS (SELECT lineage, i, CASE WHEN type = 'register' THEN seq END AS p, []::BIGINT[] AS st, 0::BIGINT AS a FROM n WHERE i = 1
UNION ALL SELECT n.lineage, n.i, CASE WHEN type = 'register' THEN seq ELSE p END, CASE WHEN type = 'request' AND p IS NOT NULL THEN list_append(st, p) WHEN type = 'void' THEN st[:-2] ELSE st END, a + (type = 'request' AND p IS NOT NULL)::BIGINT FROM f JOIN n ON n.lineage = f.lineage AND n.i = f.i + 1)
SELECT lineage, arg_max(st, i)[-1] AS live, arg_max(a, i) AS n_adopted FROM f GROUP BY lineage""")
def rule_versions(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.versions(_log(spark, d))


@query(LOG + ", s AS (SELECT lineage, round(value) AS g, min(seq) AS seq FROM log WHERE type = 'request' GROUP BY ALL) SELECT lineage, seq, greatest(0, 8 - row_number() OVER (PARTITION BY lineage ORDER BY seq))::BIGINT AS remaining FROM s")
def deduplicated_spends(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.deduplicated_spends(_log(spark, d))


@query(POP + """, l AS (SELECT component, profit, lead(profit) OVER (PARTITION BY component ORDER BY entry_ts, key, l_extendedprice) AS leak, train FROM masked)
SELECT component, round(sum(profit) FILTER (WHERE train), 2) AS score, round(sum(leak) FILTER (WHERE train), 2) AS leaked, abs(sum(profit) FILTER (WHERE train) - sum(leak) FILTER (WHERE train)) > 1e-6 AS changed FROM l GROUP BY component""")
def mutation_audit(spark: SparkSession, d: str) -> DataFrame:
    """A planted one-row leak must change the score."""
    return gates.mutation_audit(_masked(spark, d), ["component"], ["entry_ts", "key", "l_extendedprice"], "profit", F.col("train"), F.sum, 1e-6)


@query(POP + f""", q AS (SELECT side, profit, row_number() OVER (PARTITION BY side ORDER BY entry_ts, key, l_extendedprice) AS r, count(*) OVER (PARTITION BY side) AS n FROM masked WHERE win_id = 4)
SELECT side, count(*) FILTER (WHERE r <= n // 2)::BIGINT AS n1, count(*) FILTER (WHERE r > n // 2)::BIGINT AS n2, round({_pf('r <= n // 2')}, 6) AS pf1, round({_pf('r > n // 2')}, 6) AS pf2 FROM q GROUP BY side""")
def split_half(spark: SparkSession, d: str) -> DataFrame:
    q = placed(_masked(spark, d).where("win_id = 4").select("side", "profit", "entry_ts", "key", "l_extendedprice"), ["side"], ["entry_ts", "key", "l_extendedprice"]).withColumn("r", F.col("place") + 1)
    first = F.col("r") <= F.floor(F.col("n") / 2)
    pf = lambda c: profit_factor(F.when(c, F.col("profit")), F.lit(None).cast("double"))
    return rounded(q.groupBy("side").agg(F.count_if(first).alias("n1"), F.count_if(~first).alias("n2"), pf(first).alias("pf1"), pf(~first).alias("pf2")))


@query("SELECT DISTINCT p_brand || '/' || p_size AS config_key FROM part SEMI JOIN lineitem ON p_partkey = l_partkey WHERE p_size > 10 AND p_type IS NOT NULL")
def stage0_enumerate(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keys of blocks that are frozen and not closed."""
    p = tables.table(spark, d, "part").where("p_size > 10 AND p_type IS NOT NULL").join(tables.table(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    return p.select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("config_key")).distinct()


@query("SELECT event_type AS series, count(*)::BIGINT AS n, round(max(value) - min(value), 6) AS spread, count(DISTINCT user_id)::BIGINT AS n_users FROM events GROUP BY ROLLUP (event_type)")
def rollup_view(spark: SparkSession, d: str) -> DataFrame:
    users = F.count_distinct("user_id")
    return tables.table(spark, d, "events").rollup(F.col("event_type").alias("series")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value") - F.min("value"), 6).alias("spread"), users.alias("n_users"))


BATTERY = "SELECT user_id AS pop, event_id AS twin, value > 40 AS beats FROM events WHERE user_id % 3 = 0"


@query(f"WITH t AS ({BATTERY}), c AS (SELECT *, sum(beats::INTEGER) OVER (PARTITION BY pop ORDER BY twin) AS k FROM t), r AS (SELECT * FROM c WHERE k < 4 OR (k = 4 AND beats)) SELECT pop, CASE WHEN count(*) FILTER (WHERE beats) >= 4 THEN 'LEAKY' ELSE 'SILENT' END AS verdict, count(*)::BIGINT AS n_run, count(*) FILTER (WHERE beats)::BIGINT AS passes FROM r GROUP BY pop")
def battery_stops(spark: SparkSession, d: str) -> DataFrame:
    """Batteries of twins that stop at the fourth pass."""
    e = tables.table(spark, d, "events").where("user_id % 3 = 0")
    return gates.battery(e.select(F.col("user_id").alias("pop"), F.col("event_id").alias("twin"), (F.col("value") > 40).alias("beats")), "pop", "twin")
