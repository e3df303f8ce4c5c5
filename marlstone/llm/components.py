"""Connected components of an edge table, by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for every node of edges (a, b): root is the same for connected nodes and is one of them.

    Each round points every node at its smallest neighbour (a grouped minimum, so a hot node is pre-aggregated) and
    relabels the edges; rounds fall off as the logarithm of the longest path when node numbers are hashes, and it goes on
    until no edge is left whatever they are. A null in an edge links nothing; edges of a node to itself and repeated ones don't matter; without edges there
    are no rows; other columns of edges are ignored.
    """
    maps, left = [], edges.select("a", "b").where("a <> b").distinct()
    n = edges.count()
    while True:
        both = left.select("a", "b").union(left.select(F.col("b"), F.col("a"))).toDF("node", "near")
        parent = scratch.write(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root")), "parents", 2 * n)
        maps.append(parent)
        pa, pb = parent.toDF("a", "ra"), parent.toDF("b", "rb")
        left = scratch.write(left.join(pa, "a").join(pb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges", n)
        n = left.count()
        if not n:
            break
    out = maps[0]
    for m in maps[1:]:
        step = m.toDF("root", "next")
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
