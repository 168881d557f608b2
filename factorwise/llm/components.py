"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factorwise.llm.common import cut


def _star(pairs: DataFrame) -> DataFrame:
    """Every edge's ends both linked to the least neighbour of the larger end."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    linked = pairs.join(least, "u")
    both = linked.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return both.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) but the roots; the root is the least node of its component.

    Each round keeps at most as many edges as before and shortens paths at least by half, so rounds grow with the
    logarithm of the longest path. A hub costs rows of a splittable join, never a list. Null ends are dropped.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen = None
    while True:
        e = cut(e)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e = _star(large)
