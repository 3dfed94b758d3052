"""Minimum-cost-flow resharding: from old shard sizes to new capacities with the fewest bytes moved.

The flow is solved between shards (a small table), never between documents. Each old shard
is then cut along one order of its documents, largest first, into the byte ranges that the
flow sends to each target, its own target first. Large documents so stay where they are and
the cuts fall between small ones, which keeps the new shards near their capacities.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.llm.common import stored
from tremorlake.operators.scan import running_totals
from tremorlake.session import scratch_path, shuffle_width

OVERHEAD = 16  #: bytes a document takes beside its text
OLD_SHARDS, NEW_SHARDS = 32, 40


def min_cost_flow(supply: list[int], demand: list[int], cost: np.ndarray) -> np.ndarray:
    """Amounts from each supply to each demand at least total cost (equal totals, costs of 0 and more).

    Successive shortest paths over the residual graph; with a table of arcs between shards
    each path is a few vector steps.
    """
    left, need = np.array(supply, np.int64), np.array(demand, np.int64)
    flow = np.zeros((len(left), len(need)), np.int64)
    while left.any():
        far = np.where(left > 0, 0.0, np.inf)
        back, to, through = np.full(len(left), -1), np.full(len(need), np.inf), np.full(len(need), -1)
        while True:
            # Links change on strict gains only, so that they never close a loop among equals.
            reach = far[:, None] + cost
            nearer = reach.min(0) < to - 1e-12
            to, through = np.where(nearer, reach.min(0), to), np.where(nearer, reach.argmin(0), through)
            again = np.where(flow > 0, to[None, :] - cost, np.inf)
            better = again.min(1)
            improved = better < far - 1e-12
            if not improved.any():
                break
            far = np.where(improved, better, far)
            back = np.where(improved, again.argmin(1), back)
        j = int(np.argmin(np.where(need > 0, to, np.inf)))
        path, sink = [], j
        while True:
            i = int(through[sink])
            path.append((i, sink, 1))
            if back[i] < 0:
                break
            sink = int(back[i])
            path.append((i, sink, -1))
        amount = min(int(left[i]), int(need[j]), *[int(flow[a, b]) for a, b, s in path if s < 0])
        for a, b, s in path:
            flow[a, b] += s * amount
        left[i] -= amount
        need[j] -= amount
    return flow


def capacities(total: int, shards: int) -> list[int]:
    """Equal capacities that add up to ``total``."""
    return [total // shards + (1 if j < total % shards else 0) for j in range(shards)]


def size_of(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint")


def text_crc(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def assign(docs: DataFrame, old: Column, old_shards: int, new_shards: int, cost: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """``docs`` with columns old_shard and shard, and the bytes that flow between shards.

    A shard below ``min(old_shards, new_shards)`` keeps its place, so bytes that stay cost
    nothing; ``cost`` may say otherwise. Documents are cut by (size, doc_id, checksum); rows
    equal in all three go to one shard. Null ids come first.
    """
    keyed = docs.withColumns({"old_shard": old.cast("int"), "_k": F.struct((-size_of()).alias("s"), F.col("doc_id").alias("d"), text_crc().alias("c"))})
    sizes = {r[0]: int(r[1]) for r in keyed.groupBy("old_shard").agg(F.sum(-F.col("_k.s"))).collect()}  # a row for each old shard
    supply = [sizes.get(i, 0) for i in range(old_shards)]
    if cost is None:
        cost = 1.0 - np.eye(old_shards, new_shards)
    flow = min_cost_flow(supply, capacities(sum(supply), new_shards), cost)
    cuts = []
    for i in range(old_shards):
        targets = [*([i] if i < new_shards and flow[i, i] else []), *[j for j in range(new_shards) if j != i and flow[i, j]]]
        ends = np.cumsum([int(flow[i, j]) for j in targets]).tolist()
        cuts.append((i, targets or [min(i, new_shards - 1)], ends[:-1]))
    spark = docs.sparkSession
    plan = F.broadcast(spark.createDataFrame(cuts, "old_shard int, targets array<int>, ends array<bigint>"))
    narrow = keyed.select("old_shard", F.col("_k.s").alias("s"), F.col("_k.d").alias("d"), F.col("_k.c").alias("c"), (-F.col("_k.s")).alias("size"))
    placed = running_totals(narrow, ["old_shard"], ["s", "d", "c"], {"before": "size"}).join(plan, "old_shard")
    middle = 2 * F.col("before") + F.col("size")
    piece = F.size(F.filter("ends", lambda e: 2 * e <= middle))
    # The first key of each range: at most a row per arc of the flow.
    firsts = placed.select("old_shard", piece.alias("piece"), F.struct("s", "d", "c").alias("k")).groupBy("old_shard", "piece").agg(F.min("k").alias("k"))
    ranges = stored(firsts.groupBy("old_shard").agg(F.sort_array(F.collect_list(F.struct("k", "piece"))).alias("firsts")), "ranges").join(plan.select("old_shard", "targets"), "old_shard", "right")
    found = F.filter("firsts", lambda f: f["k"] <= F.col("_k"))
    shard = F.col("targets")[F.coalesce(F.element_at(found, -1)["piece"], F.lit(0))]
    return keyed.join(F.broadcast(ranges), "old_shard").withColumn("shard", shard).drop("_k", "firsts", "targets"), flow


def rewrite(assigned: DataFrame, folder: str, shards: int) -> DataFrame:
    """Write documents as one folder per shard and read them back with their place.

    Files are ranges of (shard, hash of the id), so that a shard may span many tasks. A row
    keeps its place within its task; ``slot`` adds the rows of earlier tasks of the shard.
    """
    spark = assigned.sparkSession
    parts = max(shards, shuffle_width(spark))
    dealt = (assigned.withColumn("_salt", F.xxhash64("doc_id", "_crc")).repartitionByRange(parts, "shard", "_salt").sortWithinPartitions("shard", "_salt")
             .withColumn("_at", F.monotonically_increasing_id()).drop("_salt", "_crc"))
    dealt.write.partitionBy("shard").parquet(folder)
    back = spark.read.schema(dealt.schema).parquet(folder).withColumn("_task", F.shiftright("_at", 33))
    tasks = back.groupBy("shard", "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = Window.partitionBy("shard").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    # At most a row for each task and shard; unhinted, the join would shuffle every text once more.
    base = F.broadcast(tasks.select("shard", "_task", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    return back.join(base, ["shard", "_task"]).withColumn("slot", F.col("_at") - F.col("_low") + F.col("_base")).drop("_at", "_task", "_low", "_base")


def reshard(docs: DataFrame, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS, folder: str | None = None) -> DataFrame:
    """Documents read back from ``new_shards`` rewritten shards, with old_shard, shard and slot.

    The old layout places a document by the hash of its text, so equal texts lie together
    and stay together unless their shard overflows. Null and empty texts share a place.
    """
    old = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(old_shards))
    assigned, _ = assign(docs.select("doc_id", "text"), old, old_shards, new_shards)
    return rewrite(assigned.withColumn("_crc", text_crc()), folder or scratch_path(docs.sparkSession, "shards"), new_shards)
