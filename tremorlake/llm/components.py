"""Connected components of an edge table, in rounds of two star operations.

Each round hangs the neighbours of a node on the smallest of them (larger neighbours
first, then smaller ones), which keeps components together and shortens paths; the rounds
end when nothing changes. Rounds are written to the shared folder, so that lost executors
cost one round at most. Nothing is gathered: all steps are minima and joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import stored


def _hang(pairs: DataFrame) -> DataFrame:
    """Each pair with ``m``, the least of u and all its partners v."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return pairs.join(least, "u")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = stored(_hang(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "star")
    small = _hang(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    out = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return stored(out.select("e.*").where("u <> v").distinct(), "star")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of its component, for every node that has an edge.

    ``edges`` has columns u and v of one orderable type; loops, repeats and either
    direction are fine. An empty table gives an empty result.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen, now = None, _digest(edges)
    while now[0] and now != seen:
        edges = _round(edges)
        seen, now = now, _digest(edges)
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
