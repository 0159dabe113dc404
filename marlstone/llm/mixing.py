"""Mixing sources to target weights by hash-threshold histograms, with built-in functions only.

Documents of a source are dealt over the hash range. Tokens are summed by source and hash
bucket; the running sum over a source's buckets (a few thousand rows for a source,
whatever the input) finds the one bucket in which the source's budget ends. Only the documents of that
boundary bucket are dealt again, by the next bits of the hash, until the hash is used up.
The result is one hash threshold for each source, nested in the budget: a larger budget keeps
every document that a smaller one has. The mix is then a filter; nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3  # epochs
BITS = 12  # hash bits of one histogram
LEVELS = 4


def size_of(text: Column) -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """The first 48 bits of the MD5 of the id, as a non-negative long; null ids hash as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``target`` to rows of (source, source_size), one for each source.

    Sources in code point order, null last, weigh ``weights`` repeating and share the sum of all sizes.
    A source gets ``most`` times its size at most; the excess goes to the others by weight. That is the level
    t with sum(min(most * size, t * weight)) = total: sources reach their limit in order of
    limit / weight, and t follows from those before (at their limit) and those after.
    The windows run over the table of sources, a row each.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = (
        rows.withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_t", (F.sum("source_size").over(all_rows) - F.col("_full")) / F.col("_left"))
    )
    # The level is that of the first source, in this order, which stays below its limit.
    level = F.min(F.when(F.col("_cap") >= F.col("_t") * F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), F.col("_t").alias("t")))).over(all_rows)["t"]
    rows = rows.withColumn("target", F.least(F.col("_cap"), F.coalesce(level, F.lit(0.0)) * F.col("_w")))
    return rows.select("source", "source_size", "target")


def thresholds(docs: DataFrame, budgets: DataFrame, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """For each source of ``budgets`` (source, rest) the hash below which documents are within ``rest``.

    ``docs``: source, size, hash. Returns source, limit: documents with hash < limit are taken.
    The document (or documents of one id) on the boundary is taken if that comes nearer to ``rest``.
    """
    bound = budgets.select("source", F.col("rest"), F.lit(0).cast("long").alias("low"))
    for level in range(1, levels + 1):
        width = 1 << (48 - level * bits)  # of a bucket
        inside = docs if level == 1 else docs.join(bound.select(F.col("source").alias("_s"), "low"), F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("hash", 48 - (level - 1) * bits) == F.shiftright("low", 48 - (level - 1) * bits)))
        hist = inside.groupBy("source", F.shiftright("hash", 48 - level * bits).alias("bucket")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("n").over(run))
        if level == levels:
            near = F.when(F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("n")), F.col("bucket") + 1).otherwise(F.col("bucket"))
        step = hist.select(F.col("source").alias("_s"), "bucket", "n", "upto").join(bound, F.col("_s").eqNullSafe(F.col("source"))).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")) & (F.col("n") > 0))
        if level == levels:
            return step.select("source", near.alias("limit"))
        bound = step.select("source", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("rest"), (F.col("bucket") * F.lit(width)).alias("low"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add size, source_size, target and taken to every row of ``docs`` (doc_id, text, source, ...).

    ``taken``: words that the mix takes, repeats counted. Each source gives whole epochs and, from the
    documents below its hash threshold, one more, so a document gives a multiple of its size,
    ``most`` times at most. Rows with one doc_id (or with none) share a hash and are taken together.
    Null texts have size 0; null is a source like others; an empty table gives an empty table; columns of ``docs``
    that clash with the four are replaced.
    """
    spark = docs.sparkSession
    run = Scratch(spark, "mixing")
    small = run.table("sizes", docs.select(F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("hash")))
    goal = targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = run.table("targets", goal.withColumn("epochs", epochs).withColumn("rest", F.when(F.col("target") > 0, F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(0.0)))
    cut = thresholds(small, goal.select("source", "rest"))
    goal = goal.alias("g").join(cut.select(F.col("source").alias("_cs"), "limit"), F.col("source").eqNullSafe(F.col("_cs")), "left").select(F.col("source").alias("_src"), "source_size", "target", "epochs", F.coalesce("limit", F.lit(0)).alias("_limit"))
    goal = run.table("thresholds", goal)
    kept = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    rows = docs.select(*kept, size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("_hash"))
    rows = rows.join(goal, rows["source"].cast("string").eqNullSafe(goal["_src"]), "left")
    taken = F.col("size") * (F.col("epochs") + F.when(F.col("_hash") < F.col("_limit"), 1).otherwise(0))
    return rows.select(*kept, "size", "source_size", "target", taken.cast("long").alias("taken"))


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / w AS r,
        coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
        coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before,
        sum(w) OVER () AS w_all, sum(source_size) OVER () AS total FROM w),
t AS (SELECT *, (total - full_before) / (w_all - w_before) AS t FROM l),
g AS (SELECT source, source_size, least(cap, coalesce((SELECT t FROM t WHERE cap >= t * w ORDER BY r LIMIT 1), 0) * w) AS target FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM g),
b AS (SELECT *, CASE WHEN target > 0 THEN target - epochs * source_size ELSE 0 END AS rest FROM e),
c AS (SELECT d.*, source_size, target, epochs, rest, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
             sum(size) OVER (PARTITION BY d.source, h) AS n
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN upto <= rest OR (upto - n <= rest AND upto - rest <= rest - (upto - n)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
