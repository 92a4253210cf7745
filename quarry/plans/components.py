"""Connected components of a link table by repeated contraction, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.scratch import Scratch


def contract(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): root is the smallest node reachable over links (a, b); only linked nodes appear.

    Every node points to its smallest neighbour or itself.  Pointers are doubled until all point to the
    ends of their chains (a star needs one look, a chain of n links log n), links are moved to these
    ends, and loops vanish.  Every end that still has links loses at least itself or its neighbour in
    the next round, so ends at least halve.  A hub's neighbours are combined before the shuffle, and
    lookups are plain equi-joins that adaptive execution can split.
    """
    edges, n = scratch.counted(links.select("a", "b").filter("a <> b").distinct(), "edges")
    roots, nodes = None, 0
    while n:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up, ends = scratch.counted(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "up", rows=2 * n)
        nodes = nodes or ends
        jump, moving = up, True
        while moving:
            far = jump.select(F.col("a").alias("_at"), F.col("p").alias("_to"))
            ahead = jump.join(far, F.col("p") == F.col("_at"), "left").select("a", F.coalesce("_to", "p").alias("p"), (F.col("_to") < F.col("p")).alias("moved"))
            ahead, moving = scratch.counted(ahead, "jump", rows=ends, which="moved")
            scratch.drop(jump)
            jump = ahead
        to = jump.select(F.col("a").alias("_at"), F.col("p").alias("_to"))
        moved = jump.select(F.col("a").alias("node"), F.col("p").alias("root"))
        if roots is not None:
            # later rounds' nodes are earlier rounds' roots
            moved = roots.join(to, F.col("root") == F.col("_at"), "left").select("node", F.coalesce("_to", "root").alias("root"))
        before, roots = roots, scratch.table(moved, "roots", rows=nodes)
        rest = edges.join(to, F.col("a") == F.col("_at")).select(F.col("_to").alias("a"), "b")
        rest = rest.join(to, F.col("b") == F.col("_at")).select("a", F.col("_to").alias("b"))
        rest = rest.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        done = edges
        edges, n = scratch.counted(rest, "edges", rows=n)
        scratch.drop(done, jump, *([] if before is None else [before]))
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return roots
