"""All registered queries of the engine's own operators, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import catalog, scalar
from marlstone.operators import eventlog, gates, lookups, masking, ranking, scoring
from marlstone.sources import tables
from marlstone.sources.tables import BARS_SQL, POPULATION_SQL

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


POP = f"WITH {POPULATION_SQL}, {masking.mask_sql()} "
BARS = f"WITH {BARS_SQL} "
W = "PARTITION BY series ORDER BY ts"


def _masked(spark, d):
    return masking.mask(tables.population(spark, d))


# Bars and features


@query(BARS + "SELECT series, ts, o, h, l, c, volume, round(quote_volume, 6) AS quote_volume, taker_buy FROM bars")
def bars_ohlcv_1h(spark: SparkSession, d: str) -> DataFrame:
    return tables.bars(spark, d).select("series", "ts", "o", "h", "l", "c", "volume", F.round("quote_volume", 6).alias("quote_volume"), "taker_buy")


def _r(n: int) -> str:
    return f"OVER ({W} ROWS {n - 1} PRECEDING)"


def _full(agg: str, n: int, *over: str) -> str:
    return f"CASE WHEN count(*) FILTER (WHERE {' AND '.join(f'({x}) IS NOT NULL' for x in over)}) {_r(n)} = {n} THEN {agg} {_r(n)} END"


LAYERS = f"""{BARS}, b1 AS (SELECT *, lag(c) OVER ({W}) AS c1, ln(c) AS lnc, ln(c / lag(c) OVER ({W})) AS lr, row_number() OVER ({W})::DOUBLE AS idx, ln(h / l) AS hl, ln(c / o) AS co, volume::DOUBLE AS v FROM bars),
b2 AS (SELECT *, ln(o / c1) AS oc1, ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o) AS rs, c - c1 AS dc, nullif(quote_volume, 0) AS qv, 2 * taker_buy / nullif(v, 0) - 1 AS imb FROM b1),
b3 AS (SELECT *, lag(dc) OVER ({W}) AS dc1, lag(lr, 5) OVER ({W}) AS lr5, abs(lr) / qv AS illiq, {_full("sum(lr)", 2, "lr")} AS lr2, {_full("stddev_samp(lr)", 20, "lr")} AS std20, {_full("stddev_samp(lr)", 50, "lr")} AS std50, lag(h) OVER ({W}) AS h1, lag(l) OVER ({W}) AS l1 FROM b2)
"""


def _features_sql() -> str:
    out = {f"ret_{k}": f"ln(c / lag(c, {k}) OVER ({W}))" for k in (1, 5, 20, 50)}
    for name, dd in (("fracdiff_d04", 0.4), ("fracdiff_d06", 0.6)):
        w = catalog.fracdiff_weights(dd)
        out[name] = f"CASE WHEN count(lnc) {_r(len(w))} = {len(w)} THEN list_sum(list_transform(list_zip(list(lnc) {_r(len(w))}, [{', '.join(f'{x!r}::DOUBLE' for x in reversed(w))}]), lambda z: z[1] * z[2])) END"
    clip = lambda x: f"CASE WHEN ({x}) < 0 THEN 0 ELSE ({x}) END"
    avg = lambda x, n: _full(f"avg({x})", n, x)
    std = lambda x, n: _full(f"stddev_samp({x})", n, x)
    var = lambda x, n: _full(f"var_samp({x})", n, x)
    out |= {"rv_20": "std20", "rv_50": "std50"}
    for n in (20, 50):
        out[f"parkinson_{n}"] = f"sqrt({avg('hl * hl', n)}) / (2 * sqrt(ln(2)))"
        k = 0.34 / (1.34 + (n + 1) / (n - 1))
        out[f"yangzhang_{n}"] = f"sqrt({clip(f'({var("oc1", n)}) + {k!r}::DOUBLE * ({var("co", n)}) + {1 - k!r}::DOUBLE * ({avg("rs", n)})')})"
    out["garmanklass_20"] = f"sqrt({clip(avg('0.5 * hl * hl - (2 * ln(2) - 1) * co * co', 20))})"
    out["rogerssatchell_20"] = f"sqrt({clip(avg('rs', 20))})"
    out["vol_ratio_5_50"] = f"({std('lr', 5)}) / nullif(std50, 0)"
    out["vol_of_vol_20"] = std("std20", 20)
    out["roc_10"] = f"c / lag(c, 10) OVER ({W}) - 1"
    out["bb_pctb_20"] = f"(c - (({avg('c', 20)}) - 2 * ({std('c', 20)}))) / nullif(4 * ({std('c', 20)}), 0)"
    out["lr_slope_20"] = f"({_full('covar_samp(lnc, idx)', 20, 'lnc')}) / (399 / 12.0::DOUBLE)"
    out["skew_50"], out["kurt_50"] = _full("skewness(lr)", 50, "lr"), _full("kurtosis(lr)", 50, "lr")
    out["zscore_20"] = f"(c - ({avg('c', 20)})) / nullif({std('c', 20)}, 0)"
    out["tsrank_50"] = f"CASE WHEN count(c) {_r(50)} = 50 THEN (len(list_filter(list(c) {_r(50)}, lambda x: x < c)) + (len(list_filter(list(c) {_r(50)}, lambda x: x = c)) + 1) / 2.0::DOUBLE) / 50 END"
    out["clv"] = "(2 * c - h - l) / nullif(h - l, 0)"
    out["autocorr_5"] = _full("corr(lr, lr5)", 50, "lr", "lr5")
    out["var_ratio_2"] = f"({var('lr2', 50)}) / nullif(2 * ({var('lr', 50)}), 0)"
    out["amihud_20"] = avg("illiq", 20)
    out["vol_zscore_50"] = f"(v - ({avg('v', 50)})) / nullif({std('v', 50)}, 0)"
    out["vwap_dist"] = f"c / nullif(({_full('sum(c * v)', 20, 'c')}) / nullif({_full('sum(v)', 20, 'v')}, 0), 0) - 1"
    out["taker_imb"], out["taker_imb_ma20"] = "imb", avg("imb", 20)
    b, g, q = "(ln(h / l) ** 2 + ln(h1 / l1) ** 2)", "(ln(greatest(h, h1) / least(l, l1)) ** 2)", "(3 - 2 * sqrt(2))"
    a = f"((sqrt(2 * {b}) - sqrt({b})) / {q} - sqrt({g} / {q}))"
    out["corwin_schultz"] = f"CASE WHEN h1 IS NOT NULL THEN {clip(f'2 * (exp({a}) - 1) / (1 + exp({a}))')} END"
    roll = _full("covar_samp(dc, dc1)", 20, "dc", "dc1")
    out["roll_spread_20"] = f"2 * sqrt({clip(f'-({roll})')})"
    out |= {"hour_sin": "sin(2 * pi() * hour(ts) / 24)", "hour_cos": "cos(2 * pi() * hour(ts) / 24)", "dow": "(isodow(ts) - 1)::DOUBLE"}
    return f"{LAYERS} SELECT series, ts, {', '.join(f'round({e}, 6) + 0 AS {n}' for n, e in out.items())} FROM b3"


FEATURES_SQL = _features_sql()


@query(FEATURES_SQL)
def feature_catalog_windowed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(catalog.windowed(tables.bars(spark, d)))


@query(f"""WITH RECURSIVE {BARS_SQL}, n AS (SELECT series, ts, h, l, c, row_number() OVER ({W}) AS i, lag(c) OVER ({W}) AS c1, lag(h) OVER ({W}) AS h1, lag(l) OVER ({W}) AS l1 FROM bars),
m AS (SELECT *, greatest(c - c1, 0) AS u, greatest(c1 - c, 0) AS dn, CASE WHEN h - h1 > l1 - l AND h - h1 > 0 THEN h - h1 ELSE 0 END AS pl, CASE WHEN l1 - l > h - h1 AND l1 - l > 0 THEN l1 - l ELSE 0 END AS mi, greatest(h - l, abs(h - c1), abs(l - c1)) AS tr FROM n),
r AS (SELECT series, ts, i, NULL::DOUBLE AS eu, NULL::DOUBLE AS ed, c AS f, c AS s, 0.0::DOUBLE AS g, pl::DOUBLE AS ep, mi::DOUBLE AS em, tr AS et, NULL::DOUBLE AS ax, c AS e20, c FROM m WHERE i = 1
UNION ALL SELECT m.series, m.ts, m.i, coalesce(eu * (13 / 14.0::DOUBLE) + u / 14, u), coalesce(ed * (13 / 14.0::DOUBLE) + dn / 14, dn), f * (11 / 13.0::DOUBLE) + m.c * 2 / 13, s * (25 / 27.0::DOUBLE) + m.c * 2 / 27,
 g * 0.8::DOUBLE + 0.2::DOUBLE * (f * (11 / 13.0::DOUBLE) + m.c * 2 / 13 - s * (25 / 27.0::DOUBLE) - m.c * 2 / 27), ep * (13 / 14.0::DOUBLE) + pl / 14, em * (13 / 14.0::DOUBLE) + mi / 14, et * (13 / 14.0::DOUBLE) + tr / 14,
 coalesce(ax * (13 / 14.0::DOUBLE) + 100 * abs((ep - em) * 13 + pl - mi) / nullif((ep + em) * 13 + pl + mi, 0) / 14, 100 * abs((ep - em) * 13 + pl - mi) / nullif((ep + em) * 13 + pl + mi, 0), ax), e20 * (19 / 21.0::DOUBLE) + m.c * 2 / 21, m.c FROM r JOIN m ON m.series = r.series AND m.i = r.i + 1)
SELECT series, ts, round(100 - 100 / (1 + eu / nullif(ed, 0)), 6) AS rsi_14, round(f - s - g, 6) AS macd_hist, round(ax, 6) AS adx_14, round(c / e20 - 1, 6) AS ema_dist_20 FROM r""")
def feature_catalog_recursive(spark: SparkSession, d: str) -> DataFrame:
    return rounded(catalog.recursive(tables.bars(spark, d)))


@query(f"""{LAYERS}, f AS (SELECT series, ts, {_full('avg(c)', 20, 'c')} AS m, round((c - ({_full('avg(c)', 20, 'c')})) / nullif({_full('stddev_samp(c)', 20, 'c')}, 0), 6) AS z, round(std20, 6) AS rv, (isodow(ts) - 1)::DOUBLE AS dow FROM b3),
g AS (SELECT series, ts, lag(z) OVER ({W}) AS fc_zscore_20, lag(rv) OVER ({W}) AS fc_rv_20, dow AS fc_dow FROM f)
SELECT e.event_id, fc_zscore_20, fc_rv_20, fc_dow FROM events e LEFT JOIN g ON e.event_type = g.series AND time_bucket(INTERVAL 1 HOUR, e.ts) = g.ts""")
def feature_join_lagged(spark: SparkSession, d: str) -> DataFrame:
    f = catalog.lagged(catalog.windowed(tables.bars(spark, d)).select("series", "ts", F.round("zscore_20", 6).alias("zscore_20"), F.round("rv_20", 6).alias("rv_20"), "dow"))
    e = tables.table(spark, d, "events").select("event_id", F.col("event_type").alias("series"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
    return e.join(f, ["series", "ts"], "left").drop("series", "ts")


# Masks and scorecards

SCORE = """count(*)::BIGINT AS n, round(avg(CASE WHEN profit > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate, round(avg(profit), 6) AS expectancy,
round(CASE WHEN sum(profit) FILTER (WHERE profit <= 0) < 0 THEN coalesce(sum(profit) FILTER (WHERE profit > 0), 0) / -sum(profit) FILTER (WHERE profit <= 0) WHEN count(*) FILTER (WHERE profit > 0) > 0 THEN 10 END, 6) AS pf,
round(avg(profit) / nullif(stddev_pop(profit), 0), 6) AS sharpe, round(sum(profit), 2) AS total, round(avg(profit) FILTER (WHERE profit > 0), 6) AS avg_win, round(avg(profit) FILTER (WHERE profit <= 0), 6) AS avg_loss"""


@query(POP + "SELECT side, win_id, train, count(*)::BIGINT AS n, round(sum(profit), 2) AS total FROM masked GROUP BY ALL")
def interval_mask(spark: SparkSession, d: str) -> DataFrame:
    return _masked(spark, d).groupBy("side", "win_id", "train").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("profit"), 2).alias("total"))


@query(POP + f"SELECT side, {SCORE} FROM masked WHERE train GROUP BY side")
def masked_scorecard(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.scorecard(_masked(spark, d).where("train"), ["side"])
    return rounded(s.withColumn("total", F.round("total", 2)))


TRAIN_PF = "sum(profit) FILTER (WHERE train AND profit > 0) / nullif(-sum(profit) FILTER (WHERE train AND profit <= 0), 0)"


@query(POP + f"""SELECT side, component, count(*)::BIGINT AS n, count(*) FILTER (WHERE train)::BIGINT AS train_n, round({TRAIN_PF}, 6) AS train_pf, round(avg(profit) FILTER (WHERE train), 6) AS train_exp,
{", ".join(f"count(*) FILTER (WHERE win_id = {i})::BIGINT AS n_w{i}" for i in range(1, 5))},
coalesce({TRAIN_PF} >= 1.05 AND avg(profit) FILTER (WHERE train) > 0 AND count(*) FILTER (WHERE win_id = 4) >= 30, false) AS healthy FROM masked GROUP BY side, component""")
def baseline_health(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.baseline_health(_masked(spark, d), ["side", "component"], 4))


def _pf30(where: str) -> str:
    return f"CASE WHEN count(*) FILTER (WHERE {where}) > 30 THEN coalesce(sum(profit) FILTER (WHERE {where} AND profit > 0), 0) / greatest(coalesce(-sum(profit) FILTER (WHERE {where} AND profit <= 0), 0), 1e-9) END"


TRANSFER = POP + f", t AS (SELECT l_partkey % 200 AS config, {_pf30('train')} AS train_pf, {_pf30('win_id >= 2')} AS oos_pf, {_pf30('win_id = 4')} AS last_pf FROM masked GROUP BY 1)"


@query(TRANSFER + "SELECT config, round(train_pf, 6) AS train_pf, round(oos_pf, 6) AS oos_pf, round(last_pf, 6) AS last_pf FROM t")
def rank_transfer(spark: SparkSession, d: str) -> DataFrame:
    m = _masked(spark, d).withColumn("config", F.col("l_partkey") % 200)
    return rounded(scoring.rank_transfer_rows(m, ["config"], 4))


@query(TRANSFER + ", k AS (SELECT rank() OVER (ORDER BY train_pf) + (count(*) OVER (PARTITION BY train_pf) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY oos_pf) + (count(*) OVER (PARTITION BY oos_pf) - 1) / 2.0::DOUBLE AS y FROM t WHERE train_pf IS NOT NULL AND oos_pf IS NOT NULL) SELECT count(*)::BIGINT AS n, round(corr(x, y), 6) AS spearman FROM k")
def rank_transfer_spearman(spark: SparkSession, d: str) -> DataFrame:
    m = _masked(spark, d).withColumn("config", F.col("l_partkey") % 200)
    return rounded(scoring.spearman(scoring.rank_transfer_rows(m, ["config"], 4), "train_pf", "oos_pf"))


_G, _L = "coalesce(sum(profit) FILTER (WHERE profit > 0), 0)", "coalesce(-sum(profit) FILTER (WHERE profit <= 0), 0)"
_OPEN = f"CASE WHEN {_L} > 0 THEN {_G} / {_L}"


@query(f"WITH {POPULATION_SQL} SELECT l_orderkey, round({_OPEN} WHEN {_G} > 0 THEN 10 END, 6) AS pf_capped, round({_OPEN} END, 6) AS pf_open, round({_G} / greatest({_L}, 1e-9), 2) AS pf_floored, round({_OPEN} WHEN {_G} > 0 THEN 10 ELSE 0 END, 6) AS pf_zero FROM pop GROUP BY l_orderkey")
def pf_variants(spark: SparkSession, d: str) -> DataFrame:
    v = scoring.pf_variants(tables.population(spark, d), ["l_orderkey"])
    return rounded(v.withColumn("pf_floored", F.round("pf_floored", 2)))


def _q(x: str) -> str:
    return f"quantile_cont(x, {x})"


@query(f"""WITH {POPULATION_SQL}, u AS (SELECT side, component, 'l_quantity' AS feature, l_quantity::DOUBLE AS x FROM pop UNION ALL SELECT side, component, 'l_extendedprice', l_extendedprice FROM pop)
SELECT side, component, feature, count(x)::BIGINT AS n, round({_q('0.5')}, 6) AS median, round({_q('0.75')} - {_q('0.25')}, 6) AS iqr, round({_q('0.05')}, 6) AS p05, round({_q('0.95')}, 6) AS p95,
round(({_q('0.75')} + {_q('0.25')} - 2 * {_q('0.5')}) / nullif({_q('0.75')} - {_q('0.25')}, 0), 6) AS bowley FROM u GROUP BY ALL""")
def descriptor_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.descriptors(tables.population(spark, d), ["side", "component"], ["l_quantity", "l_extendedprice"]))


# Lookups


@query("""WITH t AS (SELECT event_id, event_type AS series, ts FROM events WHERE event_id % 3 = 0), r AS (SELECT event_id AS rid, event_type AS series, ts AS rts FROM events WHERE event_id % 3 <> 0)
SELECT event_id, rid FROM t ASOF LEFT JOIN r ON t.series = r.series AND t.ts <= r.rts""")
def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "events")
    left = e.where("event_id % 3 = 0").select("event_id", F.col("event_type").alias("series"), "ts")
    right = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("rid"), F.col("event_type").alias("series"), F.col("ts").alias("rts"))
    return lookups.asof_forward(left, "ts", right, "rts", "series").select("event_id", F.col("hit.rid").alias("rid"))


@query("""WITH a AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O'),
b AS (SELECT o_orderkey AS out_key, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'O')
SELECT o_custkey, k, o_orderkey AS in_key, out_key, out_key > o_orderkey AS valid FROM a JOIN b USING (o_custkey, k)""")
def deal_pairing(spark: SparkSession, d: str) -> DataFrame:
    o = tables.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    ins = o.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("in_key"))
    outs = o.where("o_orderstatus <> 'O'").select("o_custkey", F.col("o_orderkey").alias("out_key"))
    return lookups.positional(ins, outs, "o_custkey", ["in_key"], ["out_key"]).select("o_custkey", F.col("k").cast("long").alias("k"), "in_key", "out_key", (F.col("out_key") > F.col("in_key")).alias("valid"))


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey")
def fk_anti(spark: SparkSession, d: str) -> DataFrame:
    return lookups.missing(tables.table(spark, d, "customer"), tables.table(spark, d, "orders").where("o_totalprice > 400000"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT p_brand, count(*)::BIGINT AS n_missing, array_to_string(list_slice(list_sort(list(p_partkey)), 1, 10), ',') AS first_missing FROM part ANTI JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) ON p_partkey = l_partkey GROUP BY p_brand")
def coverage_deficit(spark: SparkSession, d: str) -> DataFrame:
    gone = lookups.missing(tables.table(spark, d, "part"), tables.table(spark, d, "lineitem").where("l_quantity > 45"), "p_partkey", "l_partkey")
    # The ten least by a window, as a list of all would grow with the deficit.
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    top = gone.withColumn("_r", F.row_number().over(w)).where("_r <= 10").groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",").alias("first_missing"))
    return gone.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_missing")).join(top, "p_brand")


@query("SELECT p_partkey, sha256(p_name || '|' || p_brand) AS key_hash FROM part SEMI JOIN lineitem ON p_partkey = l_partkey")
def cache_semi(spark: SparkSession, d: str) -> DataFrame:
    p = tables.table(spark, d, "part").join(tables.table(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    return p.select("p_partkey", F.sha2(F.concat_ws("|", "p_name", "p_brand").cast("binary"), 256).alias("key_hash"))


@query("""WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), t AS (SELECT * FROM e WHERE id % 7 = 0),
p AS (SELECT e.id, t.id AS tid, t.label, round(list_sum(list_transform(list_zip(e.v, t.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS dist FROM e, t),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, tid) AS r FROM p), c AS (SELECT id, label, count(*) AS n FROM k WHERE r <= 11 GROUP BY ALL)
SELECT id, arg_min(label, (-n, label)) AS label FROM c GROUP BY id""")
def knn_bridge(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return lookups.nearest(e, e.where("id % 7 = 0"), 11)


# Ranking


@query("""SELECT concat_ws('|', s, sl, tp, dn, a, y) AS key, s AS strategy, sl AS sl_atr_mult, tp AS tp_atr_mult, dn AS donchian, a AS atr_fast, y AS days
FROM (SELECT unnest(['A', 'B', 'C']) AS s), (SELECT unnest([1.0, 1.5, 2.0])::DOUBLE AS sl), (SELECT unnest([1.0, 1.5, 2.0, 2.5, 3.0])::DOUBLE AS tp), (SELECT unnest([20, 40, 60]) AS dn), (SELECT unnest([7, 14]) AS a), (SELECT unnest(['all', 'no_mon', 'no_fri', 'mid']) AS y)""")
def grid_cartesian(spark: SparkSession, d: str) -> DataFrame:
    return ranking.grid(spark)


@query("""WITH f AS (SELECT p_partkey, p_size <= 5 AS fam FROM part), r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM f WHERE NOT fam)
SELECT p_partkey FROM f WHERE fam UNION ALL SELECT p_partkey FROM r WHERE i % greatest(1, n // 110) = 0""")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return ranking.systematic_sample(tables.table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", F.col("p_size") <= 5, 110).select("p_partkey")


PROMOTE = """WITH c AS (SELECT lpad(l_partkey::VARCHAR, 9, '0') AS key, round(sum(l_extendedprice), 2) AS score, list_distinct(list(l_orderkey)) AS ids FROM lineitem GROUP BY l_partkey),
s AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS r FROM c), top AS (SELECT * FROM s WHERE r <= 15),
o AS (SELECT s.key, s.score, max(len(list_intersect(s.ids, top.ids))::DOUBLE / len(list_distinct(list_concat(s.ids, top.ids)))) AS ov FROM s, top WHERE s.r > 15 GROUP BY ALL),
n AS (SELECT key, row_number() OVER (ORDER BY ov, score DESC, key) AS q FROM o)
SELECT s.key, s.score, CASE WHEN r <= 15 THEN 'score' WHEN q <= 5 THEN 'novelty' ELSE 'parked' END AS how FROM s LEFT JOIN n USING (key)"""


@query(PROMOTE)
def promote_topk_novelty(spark: SparkSession, d: str) -> DataFrame:
    cards = tables.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("score"), F.collect_set("l_orderkey").alias("ids"))
    return ranking.promote(cards.select(F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("key"), "score", "ids"), 20, 0.25)


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)::INTEGER AS rank FROM events) WHERE rank <= 20")
def top_recent(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_recent(tables.table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 20)


@query("SELECT p_partkey, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 33 + c) % 2147483647) AS seed FROM part")
def djb2_seed(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "part").select("p_partkey", ranking.djb2(F.col("p_name")).alias("seed"))


@query("SELECT id, name, kind FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind) AS r FROM (SELECT c_custkey AS id, c_name AS name, 0 AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier)) WHERE r = 1")
def union_dedup(spark: SparkSession, d: str) -> DataFrame:
    c = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(0).alias("kind"))
    s = tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(1).alias("kind"))
    return c.unionByName(s).groupBy("id").agg(F.min_by(F.struct("name", "kind"), "kind").alias("e")).select("id", "e.*")


# Event log

LOG = "WITH log AS (SELECT event_id AS seq, 'evt_' || event_id AS event_id, CASE event_type WHEN 'signup' THEN 'register' WHEN 'purchase' THEN 'request' WHEN 'view' THEN 'record' WHEN 'error' THEN 'void' WHEN 'click' THEN 'note' END AS type, user_id AS lineage, ts, value FROM events)"


def _log(spark, d):
    return eventlog.log_of(tables.table(spark, d, "events"))


@query(LOG + " SELECT lineage, max(seq) AS seq, arg_max(type, seq) AS type, arg_max(value, seq) AS value, count(*)::BIGINT AS n_events FROM log GROUP BY lineage")
def replay_latest(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return eventlog.latest(eventlog.first_of_each(log.unionByName(log.withColumn("seq", F.col("seq") + 10**12))))


@query(LOG + " SELECT lineage, bool_or(type = 'request') AS requested, bool_or(type = 'void') AS voided, arg_max(value, seq) FILTER (WHERE type = 'register') AS registered_value FROM log GROUP BY lineage")
def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.lifecycle(_log(spark, d))


@query(LOG + ", s AS (SELECT lineage, max(seq) AS f FROM log WHERE type = 'register' GROUP BY lineage) SELECT s.lineage, count(seq)::BIGINT AS used, greatest(0, 8 - count(seq))::BIGINT AS remaining FROM s LEFT JOIN log ON log.lineage = s.lineage AND type = 'request' AND seq > f GROUP BY s.lineage")
def budget_running(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.budget(_log(spark, d))


@query(LOG + " SELECT lineage, string_agg(seq, ',' ORDER BY seq) AS notes FROM (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY seq) AS r FROM log WHERE type = 'note') WHERE r <= 5 GROUP BY lineage")
def append_lists(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.append_lists(_log(spark, d))


@query(f"WITH RECURSIVE {LOG[5:]}, " + """n AS (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY seq) AS i FROM log WHERE type IN ('request', 'void')),
f AS (SELECT lineage, i, CASE WHEN type = 'request' THEN [seq] ELSE []::BIGINT[] END AS st FROM n WHERE i = 1
UNION ALL SELECT n.lineage, n.i, CASE WHEN type = 'request' THEN list_append(st, seq) ELSE st[:-2] END FROM f JOIN n ON n.lineage = f.lineage AND n.i = f.i + 1)
SELECT lineage, arg_max(st, i)[-1] AS incumbent, len(arg_max(st, i))::BIGINT AS depth FROM f GROUP BY lineage""")
def incumbent_stack(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.incumbents(_log(spark, d))


@query(LOG + ", e AS (SELECT r.lineage, r.seq, min(x.seq) AS ended_seq FROM log r LEFT JOIN log x ON x.lineage = r.lineage AND x.seq > r.seq AND x.type IN ('request', 'void') WHERE r.type = 'register' GROUP BY ALL) SELECT e.lineage, e.seq, CASE x.type WHEN 'request' THEN 'fired' WHEN 'void' THEN 'disarmed' ELSE 'armed' END AS status, ended_seq FROM e LEFT JOIN log x ON x.seq = ended_seq")
def conditional_fired(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.conditionals(_log(spark, d))


@query(LOG + """, m AS (SELECT lineage, seq, CASE WHEN value > 250 THEN 'L2' WHEN value > 60 THEN 'L1' ELSE 'none' END AS class, seq % 7 = 3 AS voided FROM log WHERE type = 'record'),
w AS (SELECT lineage, class, row_number() OVER (PARTITION BY lineage ORDER BY seq DESC) AS r FROM m WHERE NOT voided), n AS (SELECT lineage, count(*) FILTER (WHERE class = 'L1' AND r <= 12) AS n1 FROM w GROUP BY lineage),
l AS (SELECT lineage, bool_or(class = 'L2') AS l2 FROM m GROUP BY lineage), f AS (SELECT DISTINCT lineage, true AS f FROM log WHERE type = 'void' AND value > 150)
SELECT lineage, coalesce(n1, 0)::BIGINT AS n_l1, coalesce(l2, false) AS l2, coalesce(l2, false) OR coalesce(n1, 0) >= 3 OR coalesce(f, false) AS alarm FROM l FULL JOIN n USING (lineage) FULL JOIN f USING (lineage)""")
def suspend_alarm(spark: SparkSession, d: str) -> DataFrame:
    """Marks of records, every seventh of them void, and lineages that are flagged by a large void."""
    from marlstone.operators import projections

    log, v = _log(spark, d), F.col("value")
    marks = log.where("type = 'record'").select("lineage", "seq", F.when(v > 250, "L2").when(v > 60, "L1").otherwise("none").alias("class"), (F.col("seq") % 7 == 3).alias("voided"))
    return projections.suspend_alarm(marks, log.where("type = 'void' AND value > 150"))


@query("SELECT event_id, CASE WHEN user_id % 11 = 0 THEN 'none' WHEN value > 100 OR event_id % 17 = 0 THEN 'L2' WHEN value > 50 THEN 'L1' ELSE 'none' END AS class FROM events")
def placebo_class(spark: SparkSession, d: str) -> DataFrame:
    gate = F.when(F.col("user_id") % 11 != 0, F.lit(50.0))
    return tables.table(spark, d, "events").select("event_id", eventlog.placebo_class(F.col("value"), gate, F.lit(100.0), F.col("event_id") % 17 == 0).alias("class"))


@query(LOG + """, g AS (SELECT *, strftime(ts, '%Y-%m') AS month, (type = 'request')::BIGINT AS req, count(*) FILTER (WHERE type = 'register') OVER (PARTITION BY lineage ORDER BY seq) AS gen FROM log),
h AS (SELECT *, coalesce(sum(req) OVER (PARTITION BY lineage, month ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m, coalesce(sum(req) OVER (PARTITION BY lineage ORDER BY seq ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) AS v,
 coalesce(sum(req) OVER (PARTITION BY lineage, gen ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u, coalesce(max(value) OVER (PARTITION BY lineage ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM g)
SELECT seq, lineage, CASE WHEN value < 5 THEN 'OK' WHEN x > 150 THEN 'WINDOWS_SPENT' WHEN m > 1 THEN 'EMISSION_CAP' WHEN v >= 4 THEN 'VELOCITY_EXCEEDED' WHEN gen = 0 OR 8 - u <= 0 THEN 'LOOK_BUDGET_ZERO' ELSE 'OK' END AS code FROM h WHERE type = 'request'""")
def spend_checks(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.spend_checks(_log(spark, d))


@query(LOG + """, g AS (SELECT *, min(seq) FILTER (WHERE type = 'register') OVER (PARTITION BY lineage) AS reg FROM log)
SELECT seq, CASE WHEN seq % 3 = 0 AND type = 'void' THEN 'ACTOR_LAW' WHEN seq % 3 = 0 AND value < 1 THEN 'INTENT_MISSING' WHEN lineage NOT IN (SELECT c_custkey FROM customer) THEN 'REF_UNRESOLVED' WHEN type = 'request' AND (reg IS NULL OR reg > seq) THEN 'NOT_REGISTERED' ELSE 'ACCEPTED' END AS code FROM g""")
def admission_codes(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.admission(_log(spark, d), tables.table(spark, d, "customer").select(F.col("c_custkey").alias("lineage")))


@query(LOG + ", g AS (SELECT lineage, list_prepend(repeat('0', 64), list(concat_ws('|', seq, type, event_id) ORDER BY seq)) AS e FROM log GROUP BY lineage) SELECT lineage, (len(e) - 1)::BIGINT AS n, list_reduce(e, lambda h, x: sha256(h || x)) AS head FROM g")
def hash_chain(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.chained(_log(spark, d))


# Gates

SHIFTS = {i: 37 * i + 11 for i in range(1, 21)}
TWINS = POP + """, r AS (SELECT component, profit, train, row_number() OVER (PARTITION BY component ORDER BY entry_ts, key, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY component) AS n FROM masked),
s AS (SELECT unnest(range(1, 21)) AS twin, 37 * unnest(range(1, 21)) + 11 AS shift), w AS MATERIALIZED (SELECT component, train, i, twin, (((i - shift) % n) + n) % n AS j FROM r, s WHERE n > 2),
t AS (SELECT w.component, w.train, w.i, twin, b.profit FROM w JOIN r b ON w.component = b.component AND b.i = w.j)"""


def _twins(spark, d):
    pop = _masked(spark, d).select("component", "entry_ts", scalar.packed_key(F.col("key")).alias("key"), "l_extendedprice", "train", "profit")
    return pop, gates.circular_twins(pop, "component", ["entry_ts", "key", "l_extendedprice"], SHIFTS)


@query(TWINS + " SELECT component, twin::INTEGER AS twin, count(*)::BIGINT AS n, round(sum(profit * (i % 10)), 2) AS checksum FROM t GROUP BY ALL")
def circular_shift_twin(spark: SparkSession, d: str) -> DataFrame:
    _, twins = _twins(spark, d)
    return twins.groupBy("component", "twin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("profit") * (F.col("place") % 10)), 2).alias("checksum"))


NULLS = "WITH x AS (SELECT l_partkey % 40 AS config, (l_orderkey % 200) AS shuffle, sum(l_quantity * l_discount) AS x FROM lineitem GROUP BY ALL), m AS (SELECT config, avg(x) AS m, greatest(coalesce(stddev_samp(x), 0), 1e-12) AS s FROM x GROUP BY config), z AS (SELECT shuffle, max((x - m) / s) AS z FROM x JOIN m USING (config) GROUP BY shuffle)"


@query(NULLS + ", l AS (SELECT list_sort(list(z)) AS v, count(*) AS n, quantile_cont(z, 0.95) AS q FROM z), p AS (SELECT *, n * 0.95::DOUBLE + 0.5 AS place FROM l), k AS (SELECT *, greatest(1, least(n, floor(place)::BIGINT)) AS lo FROM p) SELECT n::BIGINT AS n, round(q, 6) AS gate_linear, round(v[lo] + (v[least(n, lo + 1)] - v[lo]) * greatest(0, least(1, place - lo)), 6) AS gate_hazen FROM k")
def null_of_max_gate(spark: SparkSession, d: str) -> DataFrame:
    x = tables.table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 40).alias("config"), (F.col("l_orderkey") % 200).alias("shuffle")).agg(F.sum(F.col("l_quantity") * F.col("l_discount")).alias("x"))
    return rounded(gates.gate(gates.null_of_max(x)))


FIVE = POP + """, q AS (SELECT l_partkey % 100 AS config, win_id, train, profit, l_quantity AS qty, row_number() OVER (PARTITION BY l_partkey % 100, win_id = 4 ORDER BY entry_ts, key, l_extendedprice) AS r, count(*) FILTER (WHERE win_id = 4) OVER (PARTITION BY l_partkey % 100) AS n4 FROM masked)"""


def _pf(where: str) -> str:
    return f"(sum(profit) FILTER (WHERE ({where}) AND profit > 0) / nullif(-sum(profit) FILTER (WHERE ({where}) AND profit <= 0), 0))"


_RESEEDS = {1: 20, 2: 30}  # members of a reseeded carrier: rows over this quantity; of the carrier itself: over 10


@query(FIVE + f""", a AS (SELECT config, count(*) FILTER (WHERE win_id = 4) AS last_n, {_pf('win_id = 4')} AS last_pf, {" + ".join(f"coalesce({_pf(f'win_id = {i}')} >= 1.0, false)::INTEGER" for i in range(1, 5))} AS good, {_pf('win_id >= 2')} AS pooled, {_pf('train')} AS train_pf,
 count(*) FILTER (WHERE win_id = 4 AND r <= n4 // 2) AS h1n, count(*) FILTER (WHERE win_id = 4 AND r > n4 // 2) AS h2n, {_pf('win_id = 4 AND r <= n4 // 2')} AS h1, {_pf('win_id = 4 AND r > n4 // 2')} AS h2, count(*) FILTER (WHERE qty > 10) AS nc,
 {", ".join(f"count(*) FILTER (WHERE qty > {t}) AS j{k}, coalesce({_pf(f'train AND qty > {t}')} >= 0.4, false) AS s{k}, {_pf(f'win_id >= 2 AND qty > {t}')} AS p{k}" for k, t in _RESEEDS.items())} FROM q GROUP BY config),
c AS (SELECT config, [coalesce(last_n >= 30 AND last_pf >= 1.3, false), good >= 3, CASE WHEN config % 3 > 0 THEN coalesce(pooled >= 0 AND train_pf >= 1e-9 AND pooled / train_pf >= 0.7, false) END, CASE WHEN config % 4 > 0 THEN coalesce(h1n >= 15 AND h2n >= 15 AND h1 >= 1.0 AND h2 >= 1.0, false) END,
 {" AND ".join(f"coalesce(j{k}::DOUBLE / nullif(nc, 0) >= 0.5 AND s{k} AND p{k} >= pooled * 0.9, false)" for k in _RESEEDS)}] AS c FROM a)
SELECT config, array_to_string(list_transform(c, lambda x: CASE WHEN x THEN 'T' WHEN NOT x THEN 'F' ELSE '?' END), '') AS clauses, CASE WHEN list_contains(c, false) THEN 'FAILED' WHEN len(list_filter(c, lambda x: x IS NULL)) > 0 THEN 'CANDIDATE' ELSE 'CERTIFIED' END AS verdict FROM c""")
def five_clause(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of configs. Every third lacks the pooled fields and every fourth the halves; two reseeds of each carrier are held against it."""
    from marlstone.functions.semantics import profit_factor
    from marlstone.operators.placing import placed

    config = (F.col("l_partkey") % 100).alias("config")
    last = F.col("win_id") == 4
    q = _masked(spark, d).select(config, "win_id", "train", "profit", "entry_ts", "key", "l_extendedprice", F.col("l_quantity").alias("qty"))
    halves = placed(q.where(last), ["config"], ["entry_ts", "key", "l_extendedprice"])
    early = F.col("place") < F.floor(F.col("n") / 2)
    null = F.lit(None).cast("double")
    pf = lambda where: profit_factor(F.when(where, F.col("profit")), null)
    halves = halves.groupBy("config").agg(F.count_if(early).alias("half1_n"), F.count_if(~early).alias("half2_n"), pf(early).alias("half1_pf"), pf(~early).alias("half2_pf"))
    good = sum((F.coalesce(pf(F.col("win_id") == i) >= 1.0, F.lit(False)).cast("int") for i in range(1, 5)), F.lit(0))
    held = F.col("win_id") >= 2
    again = [F.struct((F.count_if(F.col("qty") > t) / F.nullif(F.count_if(F.col("qty") > 10), F.lit(0))).alias("jaccard"), F.coalesce(pf(F.col("train") & (F.col("qty") > t)) >= 0.4, F.lit(False)).alias("selected"), pf(held & (F.col("qty") > t)).alias("pooled")) for t in _RESEEDS.values()]
    a = q.groupBy("config").agg(F.count_if(last).alias("last_n"), pf(last).alias("last_pf"), good.alias("good_windows"), pf(held).alias("pooled_pf"), pf(F.col("train")).alias("train_pf"), F.array(*again).alias("reseeds"))
    a = a.join(halves, "config", "left").withColumns({"half1_n": F.coalesce("half1_n", F.lit(0)), "half2_n": F.coalesce("half2_n", F.lit(0)), "has_pool": F.col("config") % 3 > 0, "has_halves": F.col("config") % 4 > 0, "s0": F.col("pooled_pf") * 0.9})
    clauses = gates.five_clauses({c: F.col(c) for c in a.columns})
    text = F.concat(*[F.when(c, "T").when(~c, "F").otherwise("?") for c in clauses])
    return a.select("config", text.alias("clauses"), gates.verdict(clauses).alias("verdict"))
