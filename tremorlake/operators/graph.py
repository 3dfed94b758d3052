"""Connected components of a graph kept as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.session import scratch_root


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is tied to the least of that node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    below = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _roots(edges: DataFrame) -> DataFrame:
    """(node, root) of stars: every node of ``edges`` leads to its centre."""
    tops = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tops)


def _lumped(edges: DataFrame, forked: DataFrame) -> DataFrame:
    """(node, root) where all components that are not single stars yet count as one, named by its least node.

    In such a component each centre has a member with another centre, or is itself a member.
    """
    centres = edges.select(F.col("v").alias("u")).distinct()
    linked = edges.join(forked.select("u").unionByName(centres).distinct(), "u", "left_semi")
    loose = linked.select("v").unionByName(linked.join(centres, "u", "left_semi").select(F.col("u").alias("v"))).distinct().checkpoint()
    found = _roots(edges).join(loose.select(F.col("v").alias("root"), F.lit(True).alias("loose")), "root", "left")
    least = F.broadcast(loose.agg(F.min("v").alias("least")))  # one row
    named = found.crossJoin(least).select("node", F.when(F.col("loose"), F.col("least")).otherwise(F.col("root")).alias("root"))
    own = named.join(loose.select(F.col("v").alias("node")), "node", "left_anti")
    return own.unionByName(loose.crossJoin(least).select(F.col("v").alias("node"), F.col("least").alias("root"))).distinct()


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node it is connected with.

    With ``rounds`` the work stops after so many; components that are not settled by then,
    those with long paths, come out as one with a common root.

    Large and small stars alternate until every edge leads to a root; their number grows
    with the logarithm of the longest path. Nodes may have any orderable type. A node
    with many edges is a join key on one side only, where the other side is unique, so
    adaptive execution can split it.
    """
    scratch_root(edges.sparkSession)
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    done = 0
    while True:
        edges = _small_star(_large_star(edges)).checkpoint()
        forked = edges.groupBy("u").count().where("count > 1")
        if forked.isEmpty() and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return _roots(edges)
        done += 1
        if done == rounds:
            return _lumped(edges, forked)
