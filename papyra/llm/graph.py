"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half step: every node links its larger (or smaller) neighbours, and itself, to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = both.join(least, "a")
    kept = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return kept.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component, for the nodes of the links (a, b).

    Alternating large and small stars (Kiveris et al., 2014): a number of steps logarithmic in the longest chain, each
    written to the shared folder. Links of a node to itself and repeated links do no harm.
    """
    now = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "links")
    while True:
        after = written(_star(_star(now, True), False), "links")
        if after.count() == now.count() and not after.join(now, ["a", "b"], "left_anti").limit(1).count():
            break
        now = after
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return written(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "components")
