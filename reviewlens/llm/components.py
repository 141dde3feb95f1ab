"""Connected components of an edge table, by alternating large-star and
small-star steps (MapReduce connectivity; Kiveris et al., 2014).

Every step is a grouped minimum and a join. Nodes with many neighbours go
through ``lookup`` and so are not one task's work. Both tables of a step are
written to the shared folder; the driver only sees two sums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, written


def _star(edges: DataFrame, from_: str, total: int, name: str) -> DataFrame:
    """``edges`` (a, b): joins each row with the smallest b of its a."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), name)
    return lookup(edges, least, "a", "n", total)


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b) bigint pairs. Returns (node, root), root being the
    smallest node of the component, for every node that has an edge. No
    edges: no rows. Loops and repeated edges change nothing."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
                          ).collect()[0]
        if state["n"] == 0 or before == (state["n"], state["s"]):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = (state["n"], state["s"])
        # large star: the larger neighbours of a node move to its smallest neighbour (or itself)
        both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        large = (_star(both, "a", 2 * state["n"], "least").filter(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        large = written(large, "large")
        # small star: the smaller neighbours of a node, and the node, move to the smallest
        small = _star(large, "a", large.count(), "least")
        edges = written(small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
                        .unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
