"""Connected components of a distributed edge table, by alternating large and small stars.

Both steps send each node to the least node it knows; the minimum is a partial
aggregate and the edges of a hot node are joined back to it, which adaptive
skew handling can split. Nothing is gathered by key, broadcast or collected;
every round is cut in the shared checkpoint folder. Few edges are kept in few
partitions (``EDGES`` in each), as each of a round's exchanges writes files by
partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.lineage import cut

#: Edges of a partition, where there are few.
EDGES = 50_000


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One step over edges (a, b) with a > b."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        sent = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        sent = both.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return sent.filter("a <> b").coalesce(parts).distinct().coalesce(parts)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node of its component.

    Self-loops and repeated edges don't matter; nulls aren't nodes. No edges give no rows.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # the number of edges never grows
    mark, parts = None, now.count() // EDGES + 1
    now = now.coalesce(parts)
    while True:
        now = cut(_star(_star(now, True, parts), False, parts))
        # the edge set no longer changes once all are stars
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
