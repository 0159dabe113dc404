"""Cards: short, reproducible reports on objects of the log. The id of a card is a hash of its payload, so the same content has the same card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators import predicates
from marlstone.operators.payloads import short_sha
from marlstone.operators.projections import State, lineage_of

KEEP = {"ignoreNullFields": "false"}


def card_id(payload: Column) -> Column:
    return short_sha(payload, 12, "card_")


def provisional_flags(constants: DataFrame) -> DataFrame:
    """One row: the series, in order, of documents that hold a known provisional entry. There are as many series as kinds of constants."""
    rows = constants.where(predicates.provisional(F.col("entries"))).select(F.concat(F.lit("provisional:"), "series").alias("_f"))
    return rows.agg(F.sort_array(F.collect_set("_f")).alias("provisional_flags"))


def card(rows: DataFrame, kind: str, payload: Column, source: Column, flags: DataFrame, coarse: bool = False, *more: Column) -> DataFrame:
    """(card_id, card_type, inputs, payload, coarseness_applied, provisional_flags, ..)"""
    doc = F.to_json(payload, KEEP)
    out = rows.select(doc.alias("payload"), F.array(source).alias("inputs"), *more).join(F.broadcast(flags), how="left")  # one row
    return out.select(card_id(F.col("payload")).alias("card_id"), F.lit(kind).alias("card_type"), "inputs", "payload", F.lit(coarse).alias("coarseness_applied"), "provisional_flags", *[c for c in out.columns if c not in ("payload", "inputs", "provisional_flags")])


def budget_state(lineages: DataFrame) -> DataFrame:
    """(lineage, budget_state) as every separation card carries it."""
    return lineages.select("lineage", F.struct("k_cumulative", "remaining", F.col("alarm_at").alias("alarm_remaining"), F.coalesce("diagnostic", F.lit(False)).alias("diagnostic_mode")).alias("budget_state"))


def separation(state: State) -> DataFrame:
    """A card for each recorded readout: which clauses passed, never by how much."""
    kind = lambda v: F.when(v.isin("true", "false"), v.cast("boolean")).otherwise(F.get_json_object(v, "$.pass").try_cast("boolean"))
    clauses = F.transform_values(F.coalesce(F.from_json("five_clause", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: kind(v))
    rows = lineage_of(state.readouts.where("recorded"), state.windowsets)
    at = budget_state(state.lineages).withColumnRenamed("lineage", "_l")
    rows = rows.join(at, F.col("lineage") == F.col("_l"), "left")
    payload = F.struct(F.lit("separation").alias("card_type"), "readout_id", clauses.alias("clause_passfail"), F.coalesce("placebo", F.lit("none")).alias("placebo_classification"), F.col("cert_ineligible"), F.lit(True).alias("coarseness_applied"))
    stamp = F.when(F.col("budget_state").isNotNull(), F.concat(F.lit("look "), F.col("budget_state.k_cumulative").cast("string"), F.lit(" of budget")))
    return card(rows, "separation", payload, F.col("readout_id"), provisional_flags(state.constants), True, F.col("budget_state"), stamp.alias("k_stamp"))


def surface(summaries: DataFrame, flags: DataFrame) -> DataFrame:
    """A card for each block's grid (block_id, grid_digest, plateau_stats)."""
    return card(summaries, "surface", F.struct(F.lit("surface").alias("card_type"), "block_id", "grid_digest", F.col("plateau_stats").alias("plateau_summary")), F.col("block_id"), flags)


def stability(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """A card for each block with whatever else its row holds."""
    return card(rows, "stability", F.struct(F.lit("stability").alias("card_type"), *rows.columns), F.col("block_id"), flags)


def cluster(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """A card for each geometry with its census."""
    return card(rows, "cluster", F.struct(F.lit("cluster").alias("card_type"), *rows.columns), F.col("geometry_ref"), flags)


def novelty(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """A card for each population; the payload's model has no place for a payoff."""
    return card(rows, "novelty", F.struct(*rows.columns), F.col("population_ref"), flags)


def novelty_payload(neighbours: DataFrame, tau: float, edges: list[float]) -> DataFrame:
    """(population_ref, abstain_fraction, affinity_histogram) of rows (population_ref, affinity): the share below ``tau`` and counts between ``edges``."""
    a = F.col("affinity")
    bands = [F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.count_if((a >= lo) & (a < hi)).alias("n")) for lo, hi in zip(edges, edges[1:])]
    return neighbours.groupBy("population_ref").agg(F.avg((a < tau).cast("double")).alias("abstain_fraction"), F.array(*bands).alias("affinity_histogram"))


def energy_distances(points: DataFrame, x: str) -> DataFrame:
    """(a, b, distance): twice the mean distance between two populations less those within, for each pair of populations of one coordinate.

    Sums of |x - y| come from ranks: sorted values are numbered over ranges, and a value counts once for each smaller one and against each larger one.
    """
    from marlstone.operators.placing import placed

    pops = points.select("population_ref").distinct()
    pairs = pops.select(F.col("population_ref").alias("a")).join(pops.select(F.col("population_ref").alias("b")), F.col("a") < F.col("b"))  # populations, not their rows
    v = points.select("population_ref", F.col(x).cast("double").alias("x"))

    def within(rows: DataFrame, by: list[str]) -> DataFrame:
        p = placed(rows, by, ["x"])
        return p.groupBy(*by).agg(F.sum((2 * F.col("place") - F.col("n") + 1) * F.col("x")).alias("s"), F.count(F.lit(1)).alias("n"))

    one = within(v, ["population_ref"])
    both = pairs.join(v, (F.col("population_ref") == F.col("a")) | (F.col("population_ref") == F.col("b"))).select("a", "b", "x")
    two = within(both, ["a", "b"])
    out = two.join(one.select(F.col("population_ref").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na")), "a").join(one.select(F.col("population_ref").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb")), "b")
    across = (F.col("s") - F.col("sa") - F.col("sb")) / (F.col("na") * F.col("nb"))
    return out.select("a", "b", (2 * across - 2 * F.col("sa") / (F.col("na") * F.col("na")) - 2 * F.col("sb") / (F.col("nb") * F.col("nb"))).alias("distance"))


def descriptor(stats: DataFrame, population_ref: str, featureset: str, partition: str) -> DataFrame:
    """(side, payload, card_id) from descriptor statistics (side, component, feature, n, median, iqr, p05, p95, bowley): components in order of their number, and of
    nothing but features. A component and its features are few."""
    r = lambda c: F.round(c, 9)
    feats = F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", F.struct("n", r("median").alias("median"), r("iqr").alias("iqr"), r("p05").alias("p05"), r("p95").alias("p95"), r(F.coalesce("bowley", F.lit(0.0))).alias("bowley_skew"))))))
    comps = stats.groupBy("side", "component").agg(F.max("n").alias("n"), feats.alias("features"))
    sides = comps.groupBy("side").agg(F.sum("n").alias("n_side"), F.sort_array(F.collect_list(F.struct(F.col("component").cast("long").alias("component_id"), "n", F.to_json("features").alias("features")))).alias("_c"))
    text = F.concat_ws(",", F.transform("_c", lambda c: F.concat(F.lit('{"component_id":'), c["component_id"].cast("string"), F.lit(',"features":'), c["features"], F.lit(',"n":'), c["n"].cast("string"), F.lit("}"))))
    payload = F.concat(F.lit('{"components":['), text, F.lit(f'],"featureset":"{featureset}","n_side":'), F.col("n_side").cast("string"), F.lit(f',"partition":"{partition}","population_ref":"{population_ref}","schema":"descriptor_v1","side":"'), "side", F.lit('"}'))
    out = sides.select("side", payload.alias("payload"))
    return out.withColumn("card_id", card_id(F.col("payload")))
