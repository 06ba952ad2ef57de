"""Connected components by alternating large and small stars, each round a staged table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import spread_join, stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (large) or smaller-or-equal neighbours of every node, and the node itself, on the least of them."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if large else both.where("b < a")
    # the least neighbour is a partial aggregate, so a node with many links sends one row per task
    least = side.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = stage(least, "least")
    joined = spread_join(side, least, "a", "inner")  # the centre of a star has many rows
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()


def connected(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> node, root (the least node of its component), for nodes that have an edge to another.

    Loops and repeated edges don't matter; edges with a null end are left out.
    No edges: no rows. The number of rounds grows with the logarithm of the
    number of nodes; only one checksum row a round comes to the driver.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stage(edges, "links")
    before = _state(edges)
    while before.n:
        # every node hangs on one node that hangs on none: done
        deep = edges.select("b").distinct().join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        many = edges.groupBy("a").count().where("count > 1").limit(1).count()
        if not deep and not many:
            break
        edges = stage(_stars(stage(_stars(edges, True), "stars"), False), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
