"""Best-fit packing of tokenised documents with a grouping genetic algorithm on islands.

A packing depends on the lengths of pieces only, so it is searched over the histogram of
lengths (at most ``capacity`` rows, whatever the number of documents). A solution is a
list of bin patterns with multiplicities. Crossover injects whole well-filled bins of one
parent into the other, drops the bins whose pieces are then used twice, and best-fits what
lost its place. Islands are groups of a Spark table; their elites migrate between epochs.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.llm.common import map_batches, small_batches, stored, tidy, tokenizer_file
from tremorlake.llm.fast_encode import encoder

CAPACITY, TOKENIZER, END_ID = 2048, "byte_bpe_50k.json", 0
ISLANDS, POPULATION, EPOCHS, GENERATIONS = 4, 4, 3, 3
WELL_FILLED = 0.995  #: share of the capacity from which on a bin may be injected
Solution = list[tuple[tuple[int, ...], int]]  # (lengths of a bin, how many such bins)


def best_fit(items: Counter, bins: Solution, capacity: int) -> Solution:
    """Put items, longest first, into the bins with the least room that holds them; open bins when none does."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for pattern, n in bins:
        if n:
            room.setdefault(capacity - sum(pattern), []).append((pattern, n))
    order = np.zeros(capacity + 2, bool)
    for r in room:
        order[r] = True
    for length in sorted(items, reverse=True):
        left = items[length]
        while left > 0:
            fits = np.flatnonzero(order[length:capacity + 1])
            if len(fits):
                r = int(fits[0]) + length
                pattern, n = room[r].pop()
                if not room[r]:
                    order[r] = False
                each = min(r // length, left)
                used = min(n, left // each)
                if used < n:
                    room.setdefault(r, []).append((pattern, n - used))
                    order[r] = True
            else:
                pattern, r, each = (), capacity, min(capacity // length, left)
                used = left // each
            room.setdefault(r - each * length, []).append((pattern + (length,) * each, used))
            order[r - each * length] = True
            left -= used * each
    merged: Counter = Counter()
    for groups in room.values():
        for pattern, n in groups:
            merged[tuple(sorted(pattern, reverse=True))] += n
    return sorted(merged.items(), key=lambda x: (-sum(x[0]), x[0]))


def n_bins(solution: Solution) -> int:
    return sum(n for _, n in solution)


def fitness(solution: Solution, capacity: int) -> tuple[float, float]:
    """Fewer bins first, then fuller ones (mean of squared fills)."""
    return -n_bins(solution), sum(n * (sum(p) / capacity) ** 2 for p, n in solution)


def crossover(a: Solution, b: Solution, items: Counter, capacity: int, rng: np.random.Generator) -> Solution:
    """A child of ``a`` with whole well-filled bins of ``b``."""
    left, child = Counter(items), []

    def take(pattern: tuple[int, ...], wanted: int) -> None:
        need = Counter(pattern)
        n = min([wanted, *(left[k] // v for k, v in need.items())])
        if n > 0:
            child.append((pattern, n))
            for k, v in need.items():
                left[k] -= n * v

    good = [(p, n) for p, n in b if sum(p) >= WELL_FILLED * capacity]
    share = rng.uniform(0.2, 0.8)
    for pattern, n in good:
        take(pattern, int(rng.binomial(n, share)))
    for pattern, n in a:  # fullest first; bins with pieces that are used already stay out
        if sum(pattern) >= rng.uniform(0.9, 1.0) * capacity:
            take(pattern, n)
    return best_fit(+left, child, capacity)


def mutate(a: Solution, items: Counter, capacity: int, rng: np.random.Generator) -> Solution:
    """Dissolve the emptiest bins and a few others at random, and best-fit their pieces anew."""
    kept, free = [], Counter()
    least = np.quantile([sum(p) for p, _ in a], 0.1) if a else 0
    for pattern, n in a:
        out = n if sum(pattern) <= least and sum(pattern) < capacity else int(rng.binomial(n, 0.05))
        kept.append((pattern, n - out))
        for length in pattern:
            free[length] += out
    return best_fit(+free, kept, capacity)


def start_population(items: Counter, capacity: int, rng: np.random.Generator, size: int) -> list[Solution]:
    """Best-fit decreasing, and variants that seed some bins with random partners first."""
    out = [best_fit(items, [], capacity)]
    for _ in range(size - 1):
        out.append(mutate(out[0], items, capacity, rng))
    return out


def evolve(population: list[Solution], items: Counter, capacity: int, rng: np.random.Generator, size: int, generations: int) -> list[Solution]:
    least = -(-sum(k * v for k, v in items.items()) // capacity)
    population = sorted(population, key=lambda s: fitness(s, capacity), reverse=True)
    for _ in range(generations):
        if not population or n_bins(population[0]) <= least:
            break
        i, j = rng.choice(len(population), 2, replace=len(population) < 2)
        child = crossover(population[i], population[j], items, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, items, capacity, rng)
        population = sorted([*population, child], key=lambda s: fitness(s, capacity), reverse=True)[:size]
    return population[:size]


def search(lengths: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, population: int = POPULATION,
           epochs: int = EPOCHS, generations: int = GENERATIONS) -> Solution:
    """The best packing found for a histogram ``lengths`` (length, n), with lengths from 1 to ``capacity``."""
    spark = lengths.sparkSession
    items = Counter({int(k): int(n) for k, n in lengths.collect()})  # at most ``capacity`` rows
    if not items:
        return []
    least = -(-sum(k * v for k, v in items.items()) // capacity)

    def island(key, rows: pd.DataFrame) -> pd.DataFrame:
        number, epoch = int(key[0]), int(rows["epoch"].max())
        rng = np.random.default_rng([number, epoch])
        if epoch == 0:
            people = start_population(items, capacity, rng, population)
        else:
            people = [[(tuple(p), n) for p, n in json.loads(x)] for x in sorted(rows["solution"])]
        people = evolve(people, items, capacity, rng, population, generations * population)
        return pd.DataFrame({"island": number, "epoch": epoch + 1, "place": range(len(people)), "bins": [n_bins(s) for s in people],
                             "solution": [json.dumps(s) for s in people]})

    schema = "island bigint, epoch bigint, place int, bins bigint, solution string"
    world = spark.range(islands).selectExpr("id as island", "0L as epoch", "0 as place", "0L as bins", "'' as solution")
    for _ in range(epochs):
        world = stored(world.repartition(islands, "island").groupBy("island").applyInPandas(island, schema), "islands")
        if world.agg(F.min("bins")).first()[0] <= least:
            break
        elite = world.where("place = 0").withColumn("island", (F.col("island") + 1) % islands).withColumn("place", F.lit(population))
        world = world.unionByName(elite)
    best = world.orderBy("bins", "island", "place").first()
    return [(tuple(p), n) for p, n in json.loads(best["solution"])]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, keep: str = "doc_id") -> DataFrame:
    """Documents as token pieces: (keep, piece, start, length, ids_crc32, part, nth).

    A document longer than ``capacity`` is cut; its first piece takes the remainder. ``nth``
    counts the pieces of one length inside the partition ``part`` that made them.
    """
    def run(batches):
        codec = encoder(tokenizer_file(tokenizer))
        part, counts = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, size = codec.encode(batch.column("_text").to_pylist())
            flat = np.insert(flat, np.cumsum(size), np.uint32(end_id)).astype("<u4")
            size = size + 1
            n = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), n)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            head = (size - (n - 1) * capacity)[row]
            start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
            length = np.where(piece == 0, head, capacity)
            at = (np.cumsum(size) - size)[row] + start
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(ranked)) - np.searchsorted(ranked, ranked) + counts[ranked]
            counts += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                                              pa.array(crc, pa.int64()), pa.array(np.full(len(row), part)), pa.array(nth)],
                                             names=[keep, "piece", "start", "length", "ids_crc32", "part", "nth"])
            del batch, flat
            tidy()

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[keep]
    return docs.select(F.col(keep).alias("_key"), F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(
        run, f"`{keep}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint")


def placements(solution: Solution) -> dict[str, np.ndarray]:
    """For each (length, run of ranks): pattern's first sequence, pieces of that length in a bin, their first offset."""
    rows, used, sequence = [], Counter(), 0
    for pattern, n in solution:
        offset = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length, used[length], sequence, each, offset))
            used[length] += n * each
            offset += length * each
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) + table[:, 1], "first": table[:, 1], "sequence": table[:, 2], "each": table[:, 3], "offset": table[:, 4]}


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, keep: str = "doc_id") -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; sequences hold ``capacity`` ids at most.

    A null text is an empty document (one end id). Repeated rows are packed as often as they
    occur; an empty table gives an empty result. Other columns of ``docs`` play no part.
    """
    cut = stored(pieces(docs, capacity, tokenizer, end_id, keep), "pieces")
    counts = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    where = placements(search(counts.groupBy("length").agg(F.sum("n").alias("n")), capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = cut.join(carry, ["part", "length"]).select(keep, "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("_before")).alias("_rank"))

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
        at = np.searchsorted(where["key"], (length << 44) + rank, side="right") - 1
        inside = rank - where["first"][at]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(where["sequence"][at] + inside // where["each"][at]),
                                           pa.array(where["offset"][at] + inside % where["each"][at] * length)],
                                          names=[*b.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("_rank").schema) + ", sequence_id bigint, offset bigint"
    return map_batches(ranked, place, schema)
