"""Connected components by alternating star contraction; edges and labels stay distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.session import cut_lineage


def _star(pairs: DataFrame, keep_centre: bool) -> DataFrame:
    """Link each second node of ``pairs`` (a, b) to the smallest node around ``a``.

    Minima and pairs are both stored before they are joined, so the rows of a hub are split by Spark's skew join.
    """
    pairs = cut_lineage(pairs, "star-pairs")
    least = cut_lineage(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "star-least")
    linked = pairs.join(least, "a")
    if keep_centre:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    else:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return cut_lineage(out.where("a != b").distinct(), "star-edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) that is not its component's smallest node."""
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    mark = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(seen) == mark or seen[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)
        edges = _star(edges.union(edges.select("b", "a")), keep_centre=False)
        edges = _star(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), keep_centre=True)
