"""Connected components of links, for tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselens.sources.tables import discard, materialise


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes in ``links`` (a, b) but the roots: the smallest node reachable.

    Each round points every node at the smallest node around it, then at that
    one's own smallest, until nothing moves; paths halve in every round.  Nodes may
    be of any type that sorts.  Links from a node to itself are passed over.
    """
    both = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = materialise(both, "links")
    for _ in range(rounds):
        # Large star: neighbours above a node go to the smallest around it.
        ends = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = ends.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("least"))
        large = ends.filter("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        large = large.distinct()
        # Small star: neighbours below a node, and itself, go to the smallest of them.
        down = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(down, "hi").select(
            F.explode(F.array("hi", "lo")).alias("hi"), F.col("least").alias("lo")).filter("hi <> lo").distinct()
        new = materialise(small, "links")
        same = _total(new) == _total(edges)
        discard(edges)
        edges = new
        if same:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    raise RuntimeError("components did not settle")


def _total(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.hash("hi", "lo"))).first())
