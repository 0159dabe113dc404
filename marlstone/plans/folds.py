"""Queries of ordered folds over ranges and of exact neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import energy, lookups, neighbours
from marlstone.operators import projections as P
from marlstone.plans.registry import query
from marlstone.sources.tables import table

DEALS = """RECURSIVE ins AS (SELECT o_custkey % 3 AS side, o_orderkey AS deal, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O'),
outs AS MATERIALIZED (SELECT o_custkey % 3 AS side, o_orderkey AS deal, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey) AS i FROM orders WHERE o_orderstatus <> 'O'),
least AS MATERIALIZED (SELECT ins.side, ins.k, ins.deal, count(outs.deal) + 1 AS first FROM ins LEFT JOIN outs ON outs.side = ins.side AND outs.deal <= ins.deal GROUP BY ALL),
w AS (SELECT DISTINCT side, 0::BIGINT AS k, 0::BIGINT AS deal, 0::BIGINT AS i FROM ins UNION ALL SELECT l.side, l.k, l.deal, greatest(w.i + 1, l.first) FROM w JOIN least l ON l.side = w.side AND l.k = w.k + 1)"""


@query(f"WITH {DEALS} SELECT w.side, w.k AS pos, w.deal AS deal_in, outs.deal AS deal_out FROM w LEFT JOIN outs ON outs.side = w.side AND outs.i = w.i WHERE w.k > 0")
def greedy_deals(spark: SparkSession, d: str) -> DataFrame:
    """Each open order, in order of its key, takes the first later order of its side that isn't open and stands behind the one taken before."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 3).alias("side"), F.col("o_orderkey").alias("deal"), "o_orderstatus")
    ins = lookups.placed(o.where("o_orderstatus = 'O'"), ["side"], ["deal"]).select("side", (F.col("place") + 1).alias("pos"), "deal")
    return lookups.greedy(ins, o.where("o_orderstatus <> 'O'").select("side", "deal"), "side", "deal")


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Events as those of five lineages: sign-ups grant looks, purchases ask for a readout, errors void one."""
    e = table(spark, d, "events")
    n = lambda k: (F.col("event_id") % k).cast("string")
    kind = F.when(F.col("event_type") == "signup", "budget").when(F.col("event_type") == "purchase", "request").when(F.col("event_type") == "error", "void")
    grant = F.col("event_type") == "signup"
    return e.where(kind.isNotNull()).select(
        F.concat(F.lit("l"), (F.col("user_id") % 5).cast("string")).alias("lineage"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        F.when(grant, F.floor(F.col("event_id") / 64) % 2).alias("generation"),
        F.when(grant, 5 + F.col("event_id") % 4).alias("initial"),
        F.when(grant, 2).cast("long").alias("alarm_at"),
        F.when(grant, 1).cast("long").alias("diagnostic_at"),
        F.date_format("ts", "yyyy-MM").alias("month"),
        F.concat(F.lit("r"), n(23)).alias("readout_id"),
        F.when(kind == "request", F.array(F.concat(F.lit("v"), n(7), F.lit("::s"), n(3)))).alias("keys"),
        (~grant).alias("readout"),
    )


STEPS = """RECURSIVE s AS (SELECT 'l' || (user_id % 5) AS lineage, event_id AS seq, CASE event_type WHEN 'signup' THEN 'budget' WHEN 'purchase' THEN 'request' ELSE 'void' END AS kind, (event_id // 64) % 2 AS gen, 5 + event_id % 4 AS init,
 strftime(ts, '%Y-%m') AS month, 'r' || (event_id % 23) AS readout, 'v' || (event_id % 7) || '::s' || (event_id % 3) AS key, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS k FROM events WHERE event_type IN ('signup', 'purchase', 'error'))"""
SLOT_WALK = """, w AS (SELECT DISTINCT lineage, 0::BIGINT AS k, 0::BIGINT AS asked, NULL::BIGINT AS gen, NULL::BIGINT AS init, NULL::BIGINT AS used, NULL::BIGINT AS rest, NULL::BOOLEAN AS alarm, NULL::BOOLEAN AS diag FROM s
 UNION ALL SELECT w.lineage, s.k, w.asked + (s.kind = 'request')::BIGINT, CASE s.kind WHEN 'budget' THEN s.gen ELSE w.gen END, CASE s.kind WHEN 'budget' THEN s.init ELSE w.init END,
  CASE WHEN s.kind = 'budget' THEN CASE WHEN w.gen = s.gen THEN w.used ELSE 0 END WHEN w.gen IS NULL THEN NULL WHEN s.kind = 'request' THEN w.used + 1 ELSE greatest(0, w.used - 1) END,
  CASE WHEN s.kind = 'budget' THEN greatest(0, s.init - CASE WHEN w.gen = s.gen THEN w.used ELSE 0 END) WHEN w.gen IS NULL THEN NULL WHEN s.kind = 'request' THEN greatest(0, w.rest - 1) ELSE w.rest + 1 END,
  CASE WHEN s.kind = 'budget' THEN false WHEN s.kind = 'request' AND w.gen IS NOT NULL THEN greatest(0, w.rest - 1) <= 2 ELSE w.alarm END,
  CASE WHEN s.kind = 'budget' THEN false WHEN s.kind = 'request' AND w.gen IS NOT NULL THEN greatest(0, w.rest - 1) <= 1 ELSE w.diag END FROM w JOIN s ON s.lineage = w.lineage AND s.k = w.k + 1),
shot AS (SELECT lineage, key, max(seq) AS seq, arg_max(readout, seq) AS readout FROM s WHERE kind = 'request' GROUP BY ALL),
live AS (SELECT lineage, string_agg(key, ',' ORDER BY key) AS one_shot FROM shot WHERE NOT EXISTS (SELECT 1 FROM s v WHERE v.kind = 'void' AND v.lineage = shot.lineage AND v.readout = shot.readout AND v.seq > shot.seq) GROUP BY lineage),
read AS (SELECT lineage, string_agg(month, ',' ORDER BY month) AS months FROM (SELECT DISTINCT lineage, month FROM s WHERE kind = 'request') GROUP BY lineage)
SELECT lineage, asked AS k_cumulative, coalesce(months, '') AS months, coalesce(one_shot, '') AS one_shot, gen AS generation, init AS initial, used AS consumed, rest AS remaining, alarm, diag AS diagnostic
FROM (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY k DESC) AS r FROM w) LEFT JOIN live USING (lineage) LEFT JOIN read USING (lineage) WHERE r = 1"""


@query(f"WITH {STEPS}{SLOT_WALK}")
def lineage_state(spark: SparkSession, d: str) -> DataFrame:
    """Slots, months and one-shot windows of lineages after all their events."""
    e = _steps(spark, d)
    s = P.lineages(P.slots(e), P.shots(e), P.shot_voids(e), P.months(e))
    return s.select("lineage", "k_cumulative", F.array_join("months", ",").alias("months"), F.array_join("one_shot", ",").alias("one_shot"), "generation", "initial", "consumed", "remaining", "alarm", "diagnostic")


@query("""WITH RECURSIVE s AS (SELECT 'l' || (user_id % 5) AS lineage_id, 'c' || (event_id % 4) AS who, event_type = 'purchase' AS push, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS k FROM events WHERE event_type IN ('purchase', 'error')),
w AS (SELECT DISTINCT lineage_id, 0::BIGINT AS k, []::VARCHAR[] AS st FROM s
 UNION ALL SELECT s.lineage_id, s.k, CASE WHEN push THEN list_append(st, who) WHEN st[-1] = who THEN st[1:len(st) - 1] ELSE st END FROM w JOIN s ON s.lineage_id = w.lineage_id AND s.k = w.k + 1)
SELECT lineage_id, st[-1] AS incumbent, greatest(0, len(st) - 1)::BIGINT AS n_before FROM (SELECT *, row_number() OVER (PARTITION BY lineage_id ORDER BY k DESC) AS r FROM w) WHERE r = 1""")
def lineage_incumbents(spark: SparkSession, d: str) -> DataFrame:
    """The incumbent of each lineage: purchases displace, errors revoke the one they name if it stands."""
    e = table(spark, d, "events").where("event_type IN ('purchase', 'error')")
    rows = e.select(F.concat(F.lit("l"), (F.col("user_id") % 5).cast("string")).alias("lineage_id"), F.col("event_id").alias("seq"), F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string")).alias("who"), (F.col("event_type") == "purchase").alias("push"))
    return P.incumbents(rows, 256)


@query("""WITH v AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) = 64),
p AS (SELECT q.vec_id, x.vec_id AS neighbour, x.label, round(list_sum([(q.v[i] - x.v[i]) * (q.v[i] - x.v[i]) FOR i IN range(1, 65)]), 9) AS d FROM v q, v x WHERE q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS rank FROM p QUALIFY rank <= 5),
n AS (SELECT vec_id, label, count(*) AS n FROM r GROUP BY ALL), b AS (SELECT vec_id, label AS voted FROM n QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1)
SELECT vec_id, rank, neighbour, round(d, 6) AS d, voted FROM r JOIN b USING (vec_id)""")
def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of all vectors to each whose id is divisible by 20, and the label most frequent among them."""
    rows = table(spark, d, "embeddings").where(F.size("embedding") == 64).select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    near = neighbours.nearest(rows.where("id % 20 = 0").select("id", "v"), rows, 5).withColumn("voted", neighbours.vote(F.col("best")))
    near = near.select(F.col("id").alias("vec_id"), "voted", F.posexplode("best").alias("i", "b"))
    return near.select("vec_id", (F.col("i") + 1).cast("long").alias("rank"), F.col("b.id").alias("neighbour"), F.round("b.d", 6).alias("d"), "voted")


@query("""WITH v AS (SELECT label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) = 64),
s AS (SELECT x.label AS a, y.label AS b, sum(sqrt(list_sum([(x.v[i] - y.v[i]) * (x.v[i] - y.v[i]) FOR i IN range(1, 65)]))) AS s, count(*) AS n FROM v x, v y WHERE x.label <= y.label GROUP BY ALL),
m AS (SELECT a, b, s / n AS m FROM s), c AS (SELECT label, count(*) AS n FROM v GROUP BY label)
SELECT m.a::VARCHAR AS a, m.b::VARCHAR AS b, p.n AS n_a, q.n AS n_b, round(2 * m.m - x.m - y.m, 6) AS distance FROM m JOIN m x ON x.a = m.a AND x.b = m.a JOIN m y ON y.a = m.b AND y.b = m.b JOIN c p ON p.label = m.a JOIN c q ON q.label = m.b WHERE m.a < m.b""")
def label_energy(spark: SparkSession, d: str) -> DataFrame:
    """Energy distances between the vectors of each two labels."""
    points = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("population_ref"), F.col("embedding").cast("array<double>").alias("v"))
    return energy.energy_distances(points, 64).withColumn("distance", F.round("distance", 6))
