"""Connected components by alternating star contraction.

Large star: every node hands its larger neighbours on to the smallest node it knows. Small star: every node joins itself and
its smaller neighbours to the smallest of them. Both are a minimum per node, taken with map-side combine, and a join
back; the join on a hub is left to AQE's skew join. Edges shrink to stars in a number of rounds that grows with the logarithm
of a component's size. After each round the edges are written to the checkpoint folder; a count and a checksum come to
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchfloor.llm.common import checkpointed


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge (columns a, b of one orderable type); the component is its smallest
    node. Loops and repeated edges are allowed; null ends are left out. No edges give no rows."""
    edges = edges.select("a", "b").filter("a <> b").distinct()
    state = None
    while True:
        edges = checkpointed(small_star(large_star(edges)))
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
