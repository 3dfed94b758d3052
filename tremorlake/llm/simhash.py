"""SimHash near-duplicates: segment bit counts as a grid, joined within Manhattan distance."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import map_batches, stored
from tremorlake.llm.components import components

BITS, SEGMENTS = 64, 16
WIDTH = BITS // SEGMENTS
#: Fingerprints of one grid key that are compared directly; fuller keys are joined through bit flips.
DIRECT = 48
BLOCK_SHINGLES = 1 << 16


def _fingerprints(words: int):
    """Arrow batch function: fingerprint of each text (column ``text``, A-Z already lower)."""
    from xxhash import xxh64_intdigest

    find = re.compile(rb"[^\x20\x09-\x0D]+").findall

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        votes, held = np.zeros((batch.num_rows, BITS), np.int64), np.zeros(batch.num_rows, np.int64)
        hashes: list[int] = []
        owners: list[tuple[int, int]] = []

        def count() -> None:
            if not hashes:
                return
            rows = np.array([o for o, _ in owners], np.int64)
            sizes = np.array([n for _, n in owners], np.int64)
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            # Rows of one text lie together, so that one running sum serves all texts.
            np.add.at(votes, rows, np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64))
            np.add.at(held, rows, sizes)
            hashes.clear()
            owners.clear()

        for row, text in enumerate(batch.column("text").to_pylist()):
            w = find(text.encode()) if text else []
            if not w:
                continue
            flat = b" ".join(w)
            size = np.fromiter(map(len, w), np.int64, len(w))
            end = np.cumsum(size + 1) - 1
            k = min(words, len(w))
            spans = list(zip((end - size)[: len(w) - k + 1].tolist(), end[k - 1:].tolist()))
            for i in range(0, len(spans), BLOCK_SHINGLES):
                part = spans[i:i + BLOCK_SHINGLES]
                hashes.extend([xxh64_intdigest(flat[a:b], 42) for a, b in part])
                owners.append((row, len(part)))
                if len(hashes) >= BLOCK_SHINGLES:
                    count()
        count()
        set_bits = (2 * votes > held[:, None]).astype(np.uint8)
        fp = np.packbits(set_bits, axis=1, bitorder="little").view("<i8").ravel()
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != "text"], pa.array(fp)],
                                          names=[*[c for c in batch.schema.names if c != "text"], "fp"])

    return of


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp``, the 64-bit SimHash over word shingles of whole texts.

    A-Z count as a-z, words are runs of anything but the six ASCII blanks, repeats count.
    A text of fewer words is one shingle; a null text or one without a word has fingerprint 0.
    """
    kinds = dict(docs.dtypes)
    low = F.translate(F.col(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return map_batches(docs.select(*keep, low.alias("text")), _fingerprints(words), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", fp bigint")


def _grid_keys() -> Column:
    """The grid point of a fingerprint (bit count of each segment) and its neighbours at distance 1.

    Points within Manhattan distance 2 share at least one of these keys: step one unit
    from either side. Counts run from 0 to WIDTH, so base WIDTH + 3 leaves room for a step.
    """
    base = WIDTH + 3
    point = " + ".join(f"(1 + bit_count(shiftrightunsigned(fp, {WIDTH * i}) & {(1 << WIDTH) - 1})) * {base ** i}L" for i in range(SEGMENTS))
    steps = ", ".join(f"{s}{base ** i}L" for i in range(SEGMENTS) for s in ("", "-"))
    return F.expr(f"transform(array(0L, {steps}), x -> x + ({point}))")


def links(points: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints; u and v are linked by the edges if and
    only if a chain of fingerprints with at most 2 differing bits joins them.

    The Manhattan distance of segment bit counts never exceeds the Hamming distance, so
    the grid join misses no link; pairs that meet are checked exactly. A grid key with more
    than DIRECT fingerprints is not paired: its members meet in the values at one bit flip,
    which two fingerprints share exactly if they differ in 2 bits or fewer.
    """
    cells = points.select("fp", F.explode(_grid_keys()).alias("key"))
    filled = stored(cells.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    met = stored(cells.join(filled, "key"), "met")
    few = met.where(F.col("n") <= DIRECT)
    pairs = (few.select("key", F.col("fp").alias("u")).join(few.select("key", F.col("fp").alias("v")), "key")
             .where("u > v and bit_count(u ^ v) <= 2").select("u", "v"))
    flips = ", ".join(["0L", *[f"shiftleft(1L, {i})" for i in range(BITS)]])
    many = stored(met.where(F.col("n") > DIRECT).select("fp").distinct().select("fp", F.explode(F.expr(f"transform(array({flips}), x -> x ^ fp)")).alias("flip")), "flips")
    root = many.groupBy("flip").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    stars = many.join(root, "flip").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars)


def near_groups(docs: DataFrame, words: int = 3, row: str = "doc_id") -> DataFrame:
    """(row, fp, component_id): the least ``row`` reachable over links of at most 2 bits.

    Equal fingerprints are one point, so copies cost nothing beyond their fingerprint. Rows
    with a null id keep their place but never name a component unless nothing else can.
    """
    seen = stored(fingerprints(docs, words, keep=(row,)), "fingerprints")
    points = stored(seen.groupBy("fp").agg(F.min(row).alias("_low")), "points")
    root = components(links(points)).select(F.col("node").alias("fp"), "root")
    placed = stored(points.join(root, "fp", "left").select("fp", "_low", F.coalesce("root", "fp").alias("root")), "placed")
    lowest = placed.groupBy("root").agg(F.min("_low").alias("component_id"))
    return seen.join(placed.join(lowest, "root").select("fp", "component_id"), "fp").select(row, "fp", "component_id")


def one_of_each_group(docs: DataFrame, words: int = 3) -> DataFrame:
    """One document of each group of near copies, with all its columns: the one with the least id.

    Repeated rows of one id count as one document. Documents with a null id cannot be told
    apart and stay.
    """
    named = docs.where("doc_id is not null")
    groups = stored(near_groups(named, words), "groups")
    least = groups.where("doc_id = component_id")
    repeated = least.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    kept = named.join(least.select("doc_id").distinct(), "doc_id", "left_semi")
    return (kept.dropDuplicates(["doc_id"]) if repeated else kept).unionByName(docs.where("doc_id is null"))
