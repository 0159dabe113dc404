"""Connected components by label propagation with pointer jumping; nothing is collected to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.scratch import Scratch


def components(edges: DataFrame, run: Scratch, name: str) -> DataFrame:
    """``edges`` (a, b) to (node, root): the least node of each component. Nodes without an edge are not in the result.

    Each round every node takes the least root among its neighbours' and then that root's own root; rounds go with the
    logarithm of the longest path for most graphs, and end when no root changes. Sums per node are combined
    before the shuffle, so that a node with many edges is no burden to one task. Every round is a written table.
    """
    both = run.table(f"{name}-edges", edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    roots = run.table(f"{name}-0", both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    step = 0
    while True:
        step += 1
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hook = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("to"))
        # The root of a node that moved also moves, so that whole trees join at once.
        moved = hook.where("to < root").groupBy(F.col("root").alias("node")).agg(F.min("to").alias("pull"))
        hook = hook.join(moved, "node", "left").select("node", "root", F.least("to", F.coalesce("pull", "to")).alias("to"))
        jump = hook.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
        new = hook.join(jump, F.col("to") == F.col("_n"), "left").select("node", F.least("to", F.coalesce("_t", "to")).alias("root"), (F.least("to", F.coalesce("_t", "to")) < F.col("root")).alias("changed"))
        new = run.table(f"{name}-{step}", new)
        if new.where("changed").limit(1).count() == 0:
            return new.select("node", "root")
        roots = new.select("node", "root")
