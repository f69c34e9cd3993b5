"""Connected components of an undirected graph given by edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensia.session import discard, materialise

BROADCAST_NODES = 400_000
"""Most nodes whose smallest neighbours (two numbers a node) are broadcast; counted before."""


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node that edges (a, b) reach from each node.

    Alternates two steps until every node has one edge, to a node that has none of its own: every node hands
    its larger neighbours to its smallest neighbour, then hands its smaller ones to it. Each step at most keeps the
    number of edges, nobody's neighbourhood is gathered (a minimum per node is enough), and the rounds grow with the
    logarithm of the longest path. Every round is a written table, so lost executors repeat one round only.
    Self loops and repeated edges are allowed; an edge with a null end is left out.
    """
    current = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        nodes, astray = _unsettled(current)
        if not astray:
            break
        few = F.broadcast if nodes <= BROADCAST_NODES else (lambda lowest: lowest)
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(few(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        # An edge between a node's lowest and another lower neighbour replaces the longer way around.
        small = large.join(few(low2), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = materialise(small.filter("a <> b").distinct(), name)
        discard(current)  # its successor is written
        current = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _unsettled(edges: DataFrame) -> tuple[int, int]:
    """(nodes, nodes that have several edges downwards, or one beside edges upwards): a component of none is a star around its smallest."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    each = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return tuple(each.agg(F.count("*"), F.count_if((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("up") == 1)))).first())
