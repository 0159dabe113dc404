"""Chat formatting: cumulative-snapshot collapse by rolling turn-prefix hashes.

Logs hold a conversation again and again, each time with a few turns more. A turn's hash covers its
rank, role and text; the hash of a prefix is the sum of its turns' hashes, kept as four sums of 32-bit
lanes, which identifies role, text and order. As sums they are computed like any running total: turns are range-sorted over
all conversations, each partition sums its own part, and what the earlier partitions hold of a
conversation is added, so that one conversation may be larger than any task. A conversation is dropped
if its whole hash is that of a proper prefix of another (an anti-join against the distinct
prefix hashes); of equal conversations the one with the least conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.scratch import Scratch

PART_TURNS = 200
LANES = ["l0", "l1", "l2", "l3"]
ROLES = ("system", "user", "assistant", "tool")


def _lanes(rank: Column, role: Column, text: Column) -> list[Column]:
    # A null and an empty string differ; the null flags are part of what is hashed.
    what = [rank, role.isNull(), F.coalesce(role, F.lit("")), text.isNull(), F.coalesce(text, F.lit(""))]
    a, b = F.xxhash64(*what), F.xxhash64(F.lit(20011), *what)
    low = F.lit(0xFFFFFFFF)
    return [x.alias(n) for x, n in zip((a.bitwiseAND(low), F.shiftrightunsigned(a, 32), b.bitwiseAND(low), F.shiftrightunsigned(b, 32)), LANES)]


def prefixes(turns: DataFrame, run: Scratch) -> DataFrame:
    """Each turn with its rank in its conversation and the sums of lanes up to it (n, l0 .. l3).

    Turns are ordered by turn, null first, then role and text; repeated rows are turns of their own.
    """
    order = ["turn", "role", "text"]
    sort = [F.col(c).asc_nulls_first() for c in ["conv_id", *order]]
    dealt = turns.select("conv_id", *order).repartitionByRange(*sort).sortWithinPartitions(*sort)
    # Written, as the partition's number is part of the order and a lost task must find it again.
    dealt = run.table("turns", dealt.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "*"))
    here = Window.partitionBy("conv_id", "part").orderBy("at")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    def shifted(rows: DataFrame, totals: DataFrame, cols: list[str]) -> DataFrame:
        """Add what earlier partitions hold of the conversation; only conversations of several partitions have such rows."""
        before = totals.select("conv_id", "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in cols]).where(" OR ".join(f"_{c} > 0" for c in cols))
        before = before.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), *[f"_{c}" for c in cols])
        rows = rows.join(before, rows["conv_id"].eqNullSafe(before["_conv"]) & (rows["part"] == before["_part"]), "left")
        return rows.withColumns({c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in cols}).drop("_conv", "_part", *[f"_{c}" for c in cols])

    counts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    ranked = shifted(dealt.withColumn("n", F.row_number().over(here).cast("long")), counts, ["n"])
    lanes = ranked.select("*", *_lanes(F.col("n"), F.col("role"), F.col("text")))
    lanes = run.table("lanes", lanes)
    sums = lanes.groupBy("conv_id", "part").agg(*[F.sum(c).alias(c) for c in LANES])
    local = lanes.withColumns({c: F.sum(c).over(here) for c in LANES})
    return run.table("prefixes", shifted(local, sums, LANES))


def maximal(pre: DataFrame) -> DataFrame:
    """conv_id of the conversations that are not a proper prefix of another, one of each set of equal ones."""
    whole = pre.groupBy("conv_id").agg(F.max_by(F.struct("n", *LANES), "n").alias("w")).select("conv_id", "w.*")
    one = whole.groupBy("n", *LANES).agg(F.min("conv_id").alias("conv_id"))
    ends = whole.select("conv_id", F.col("n").alias("_n"))
    proper = pre.join(ends.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).where("n < _n").select("n", *LANES).distinct()
    return one.join(proper, ["n", *LANES], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def collapse(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Render the maximal conversations of ``turns`` (conv_id, turn, role, text).

    Returns conv_id, part, n_turns (of the whole conversation), turns (of this part), rendered. A part holds
    ``part_turns`` turns, so that no row grows with a conversation. A turn is rendered as ``<|role|>``, a line
    break, its text and ``<|end|>``, then a line break; null roles render as ``unknown``, null texts as empty; text that looks like a
    marker gets a space after its first character. Rows of a null conv_id form one conversation. No turns, no rows.
    """
    run = Scratch(turns.sparkSession, "chat")
    pre = prefixes(turns, run)
    keep = maximal(pre).select(F.col("conv_id").alias("_c"), "n_turns")
    rows = pre.select("conv_id", "n", "role", "text").join(keep, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|(?=\w+\|>)", "< |")
    role = F.when(F.lower("role").isin(*ROLES), F.lower("role")).otherwise(F.lit("unknown"))
    line = F.concat(F.lit("<|"), role, F.lit("|>\n"), clean, F.lit("<|end|>\n"))
    rows = rows.select("conv_id", "n_turns", F.floor((F.col("n") - 1) / part_turns).cast("long").alias("part"), F.struct("n", line.alias("line")).alias("t"))
    grouped = rows.groupBy("conv_id", "part", "n_turns").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", "part", "n_turns", F.size("t").cast("long").alias("turns"), F.array_join(F.col("t.line"), "").alias("rendered"))


ORACLE = """
WITH r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM conversations),
p AS (SELECT *, md5(coalesce(role, '?null') || chr(1) || coalesce(text, '?null')) AS h FROM r),
q AS (SELECT conv_id, n, string_agg(h, ',') OVER (PARTITION BY conv_id ORDER BY n) AS chain, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM p),
whole AS (SELECT min(conv_id) AS conv_id, chain, n_turns FROM q WHERE n = n_turns GROUP BY chain, n_turns),
proper AS (SELECT DISTINCT chain FROM q WHERE n < n_turns),
keep AS (SELECT conv_id, n_turns FROM whole WHERE chain NOT IN (SELECT chain FROM proper))
SELECT r.conv_id, ((n - 1) // 200)::BIGINT AS part, n_turns::BIGINT AS n_turns, count(*)::BIGINT AS turns,
  string_agg('<|' || CASE WHEN lower(role) IN ('system', 'user', 'assistant', 'tool') THEN lower(role) ELSE 'unknown' END || '|>' || chr(10)
    || regexp_replace(coalesce(text, ''), '<\\|(\\w+\\|>)', '< |\\1', 'g') || '<|end|>' || chr(10), '' ORDER BY n) AS rendered
FROM r JOIN keep ON r.conv_id IS NOT DISTINCT FROM keep.conv_id GROUP BY ALL
"""
