"""Queries of the readout of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import masking, readout, search
from marlstone.plans.registry import POP, query, rounded
from marlstone.scratch import Scratch
from marlstone.sources import tables

FACTOR = "CASE WHEN sum(-profit) FILTER (WHERE profit <= 0) > 0 THEN coalesce(sum(profit) FILTER (WHERE profit > 0), 0) / sum(-profit) FILTER (WHERE profit <= 0) WHEN max(profit) > 0 THEN 10 ELSE {} END"
CHOSEN = f"chosen AS (SELECT side, blob FROM r WHERE train AND blob > 0 GROUP BY ALL HAVING {FACTOR.format(0)} >= 0.42 AND count(*) >= 30)"
BLOBS = POP + f", r AS (SELECT *, l_partkey % 12 AS blob FROM masked), {CHOSEN}"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return masking.mask(tables.population(spark, d)).withColumn("blob", F.col("l_partkey") % 12).withColumn("id", F.col("key"))


@query(BLOBS + f", t AS (SELECT * FROM r SEMI JOIN chosen USING (side, blob) WHERE win_id > 0), u AS (SELECT side, win_id, profit FROM t UNION ALL SELECT side, 0, profit FROM t WHERE win_id >= 2) SELECT side, win_id::INTEGER AS win_id, count(*)::BIGINT AS n, round({FACTOR.format('NULL')}, 6) AS pf FROM u GROUP BY side, win_id")
def readout_windows(spark: SparkSession, d: str) -> DataFrame:
    """What the selected blobs earn in each window, and pooled from the second on."""
    r = _rows(spark, d)
    return rounded(readout.by_window(r, readout.selected(r, ["side"], 0.42, 30), ["side"])).select("side", F.col("win_id").cast("int").alias("win_id"), "n", "pf")


@query(BLOBS + """, k AS (SELECT side, arg_max(blob, (coalesce(n, 0), -blob)) AS carrier FROM chosen LEFT JOIN (SELECT side, blob, count(*) AS n FROM r WHERE win_id >= 2 GROUP BY ALL) USING (side, blob) GROUP BY side),
m AS (SELECT key FROM r JOIN k ON r.side = k.side AND r.blob = k.carrier WHERE train AND r.side = 'sell'),
f AS (SELECT s AS seed, key, profit, win_id, train, (l_partkey // 3 + s * (l_orderkey % 2)) % 5 AS blob FROM r, range(1, 4) g(s) WHERE side = 'sell'),
c AS (SELECT seed, blob FROM f WHERE train AND blob > 0 GROUP BY ALL HAVING """ + FACTOR.format(0) + """ >= 0.42 AND count(*) >= 30),
p AS (SELECT seed, """ + FACTOR.format("NULL") + """ AS pooled FROM f SEMI JOIN c USING (seed, blob) WHERE win_id >= 2 GROUP BY seed),
j AS (SELECT seed, blob, count(*) FILTER (WHERE key IN (SELECT key FROM m)) AS k, count(*) AS n FROM f WHERE train AND blob > 0 GROUP BY ALL HAVING k > 0),
b AS (SELECT seed, max(k / (n + (SELECT count(*) FROM m) - k)) AS jaccard, arg_max(blob, (k / (n + (SELECT count(*) FROM m) - k), -blob)) AS best FROM j GROUP BY seed)
SELECT seed::INTEGER AS seed, round(pooled, 6) AS pooled, round(coalesce(jaccard, 0), 6) AS jaccard, best, c.blob IS NOT NULL AS selected FROM (SELECT DISTINCT seed FROM f) LEFT JOIN p USING (seed) LEFT JOIN b USING (seed) LEFT JOIN c ON c.seed = b.seed AND c.blob = best""")
def reseed_report(spark: SparkSession, d: str) -> DataFrame:
    """Three other groupings of the sold rows against the carrier of the first."""
    r = _rows(spark, d)
    chosen = readout.selected(r, ["side"], 0.42, 30)
    members = r.where("train AND side = 'sell'").join(readout.carrier(r, chosen, ["side"]), ["side", "blob"], "left_semi").select("id")
    fits = r.where("side = 'sell'").withColumn("seed", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("blob", (F.floor(F.col("l_partkey") / 3) + F.col("seed") * (F.col("l_orderkey") % 2)) % 5)
    return rounded(readout.reseeds(fits, members, 0.42, 30))


@query(POP + """, r AS (SELECT side, profit, l_partkey % 12 AS blob, row_number() OVER (PARTITION BY side ORDER BY entry_ts, key) - 1 AS place, count(*) OVER (PARTITION BY side) AS n FROM masked WHERE train),
s AS (SELECT i AS shuffle, CASE i WHEN 0 THEN 0 ELSE ('0x' || substr(md5('11:' || i), 1, 8))::BIGINT END AS h FROM range(0, 21) g(i)),
m AS (SELECT side, shuffle, profit, (place + CASE shuffle WHEN 0 THEN 0 ELSE h % (n - 1) + 1 END) % n AS k FROM r, s WHERE n > 2),
x AS (SELECT side, shuffle, sum(v * v / c) AS x FROM (SELECT m.side, shuffle, blob, sum(m.profit) AS v, count(*) AS c FROM m JOIN r ON r.side = m.side AND r.place = m.k WHERE blob > 0 GROUP BY ALL) GROUP BY ALL),
t AS (SELECT side, avg(x) AS a, greatest(stddev_samp(x), 1e-12) AS d FROM x WHERE shuffle > 0 GROUP BY side)
SELECT x.side, x.shuffle::INTEGER AS shuffle, round((x - a) / d, 6) AS z FROM x JOIN t USING (side)""")
def shift_null(spark: SparkSession, d: str) -> DataFrame:
    """The standardised separation of training rows: as it is (shuffle 0), and of twenty seeded circular shifts."""
    r = _rows(spark, d).where("train")
    v = readout.null_vector(readout.shift_nulls(r, "side", ["entry_ts", "key"], 11, 20), "side")
    whole = v.select("side", F.posexplode(F.concat(F.array("z"), "null_z")).alias("shuffle", "z"))
    return rounded(whole)


_U = "(('0x' || substr(md5('23:{0}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE + i * sqrt({1}::DOUBLE))"
_W = ", ".join(f"0.1::DOUBLE + (2.5::DOUBLE - 0.1::DOUBLE) * ({u} - floor({u})) AS {c}" for c, u in [("wa", _U.format(0, 2)), ("wb", _U.format(1, 3))])


@query(POP + f""", c AS MATERIALIZED (SELECT i::INTEGER AS candidate, 2 + i % 8 AS k, {_W} FROM range(0, 24) g(i)),
r AS MATERIALIZED (SELECT profit, l_quantity / 50.0::DOUBLE AS a, (l_partkey % 1000) / 1000.0::DOUBLE AS b, row_number() OVER (ORDER BY entry_ts, key, profit) - 1 AS place, count(*) OVER () AS n FROM masked WHERE train AND side = 'sell'),
m AS MATERIALIZED (SELECT s AS shuffle, profit, (place + CASE s WHEN 0 THEN 0 ELSE ('0x' || substr(md5('23:' || s), 1, 8))::BIGINT % (n - 1) + 1 END) % n AS place FROM r, range(0, 21) g(s) WHERE n > 2),
d AS MATERIALIZED (SELECT candidate, k, place, 1 + floor(k * (wa * a + wb * b - floor(wa * a + wb * b))) AS blob FROM r, c),
g AS (SELECT candidate, k, shuffle, blob, sum(m.profit) AS v, count(*) AS n FROM d JOIN m USING (place) GROUP BY ALL HAVING n >= 30),
x AS (SELECT candidate, k, shuffle, sum(v * v / n) AS x, count(*) AS n_blobs FROM g GROUP BY ALL HAVING n_blobs > 1),
t AS (SELECT candidate, avg(x) AS m, greatest(stddev_samp(x), 1e-12) AS s FROM x WHERE shuffle > 0 GROUP BY candidate),
z AS (SELECT candidate, k, shuffle, n_blobs, x AS separation, (x - m) / s AS z FROM x JOIN t USING (candidate)),
o AS (SELECT list_sort(list(z)) AS l, count(*) AS n FROM (SELECT shuffle, max(z) AS z FROM z WHERE shuffle > 0 GROUP BY shuffle)),
q AS (SELECT *, n * 0.95::DOUBLE + 0.5 AS p, greatest(1, least(n, floor(n * 0.95::DOUBLE + 0.5)::BIGINT)) AS lo FROM o),
w AS (SELECT l[lo] + (l[least(n, lo + 1)] - l[lo]) * greatest(0, least(1, p - lo)) AS gate FROM q),
b AS (SELECT k, candidate, n_blobs, separation, z FROM z WHERE shuffle = 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY z DESC, candidate) = 1)
SELECT k::INTEGER AS k, candidate, n_blobs, round(separation, 6) AS separation, round(z, 6) AS z, round(gate, 6) AS gate, z > gate AS passes, row_number() OVER (ORDER BY z DESC, candidate) = 1 AS best FROM b, w""")
def search_winners(spark: SparkSession, d: str) -> DataFrame:
    """Sold training rows in k bands of a weighted sum of two features: of 24 candidates the best for each k, against the gate of the whole search."""
    rows = _rows(spark, d).where("train AND side = 'sell'").select("profit", "entry_ts", "key", (F.col("l_quantity") / 50.0).alias("a"), (F.col("l_partkey") % 1000 / 1000.0).alias("b"))

    def band(c):
        at = c["wa"] * F.col("a") + c["wb"] * F.col("b")
        return 1 + F.floor(c["k"] * (at - F.floor(at)))

    candidates = search.design(24, {"wa": (0.1, 2.5), "wb": (0.1, 2.5)}, list(range(2, 10)), 23)
    found = search.search(rows, candidates, band, ["entry_ts", "key", "profit"], 23, 20, 30, Scratch(spark, "search").path)
    return rounded(search.winners(search.scored(found), candidates))
