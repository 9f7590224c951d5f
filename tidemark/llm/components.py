"""Connected components of a graph given as edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """For edges (a long, b long), undirected, repeats and loops allowed: one row (node, root) for each node with a
    neighbour; nodes of one component, and no others, share a root.

    Each round joins every node to the least of itself and its neighbours, in an order that a hash shuffles every other
    round: so a constant share of the nodes goes whatever the graph's shape, a long path too, and the leaves of a star
    are joined to its least in the first round of an order and to each other in the second. The edges between what is left go to
    the next round. Minima are made before the shuffle, so a node of many edges
    does not meet in one task. No edges: no rows.
    """
    steps: list[DataFrame] = []
    left = materialise(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not left.isEmpty():
        salt = F.lit(len(steps) // 2)
        rank = lambda c: F.struct(F.xxhash64(F.col(c), salt).alias("h"), F.col(c).alias("n"))
        both = left.select(F.col("a").alias("node"), F.least(rank("a"), rank("b")).alias("m")).unionAll(left.select(F.col("b").alias("node"), F.least(rank("a"), rank("b")).alias("m")))
        step = materialise(both.groupBy("node").agg(F.min("m").alias("m")).select("node", F.col("m.n").alias("root")), "step")
        steps.append(step)
        to = lambda c: step.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        moved = left.join(to("a"), "a").join(to("b"), "b").where("a_root != b_root")
        left = materialise(moved.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0]
    for step in steps[1:]:  # a root of one round may have gone on in the next
        found = found.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return materialise(found, "components") if len(steps) > 1 else found
