"""Connected components of a link table by alternating large-star and small-star contraction.

Every half step is an aggregate and a join on the node, and its result a table
in the shared checkpoint folder, so a hub is pre-aggregated and split like any
other key and nothing passes through the driver but two numbers per step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.session import scratch_path


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b). Large: link every larger neighbour of a node to its least neighbour; small: the others."""
    both = edges.select("a", "b")
    if large:
        both = both.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written, so that the join reads both sides by exchanges of its own and Spark can split a hub's links
    least = _written(both.groupBy("a").agg(F.min("b").alias("m")), "components-least")
    if large:
        # of node a, with least neighbour min(m, a): its neighbours b > a link to that
        joined = both.where("b > a").join(least, "a").select(F.col("b").alias("x"), F.least("m", "a").alias("y"))
    else:
        joined = both.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        joined = joined.union(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return joined.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node in ``links`` (columns a, b of one orderable type); component: its least node.

    Links to null and of a node with itself are ignored; an empty table gives an empty one.
    """
    edges = (links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
             .where("a is not null and b is not null and a != b").distinct())
    edges = _written(edges, name)
    state = None
    while True:
        edges = _written(_star(_written(_star(edges, True), name), False), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == state:
            break
        state = now
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(edges.select("b", "b").distinct()))
