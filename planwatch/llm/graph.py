"""Connected components of a distributed graph, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwatch.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b: long): root is the smallest node reachable.

    Each round points the larger neighbours of a node to its smallest one (large star), then the smaller ones too
    (small star). The edges shrink to stars around the roots in about log(n) rounds; each round is written to the
    shared folder. No neighbourhood is ever gathered: minima are aggregates and the rest are joins. Edges are dealt by node, once
    for each star: minimum and join read the same shuffle and nothing is broadcast, so a round is three stages, however small the
    edges, and the driver has few tasks to keep account of.
    """
    a, b = F.col("a"), F.col("b")
    edges = written(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u").distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        # Of a node's edges the one to its least neighbour stays and the others move there. An edge may come twice; the next round's distinct() drops it.
        small = large.join(near.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small, "edges")
        # The edge set is stable once every node hangs directly below its root.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
