"""Near copies by common five-word shingles: SimHash classes and MinHash bands bring pairs together, the exact Jaccard similarity decides.

Texts whose fingerprints link at 2 differing bits (``simhash.near_groups``) meet first; the
bands bring together similar texts whose fingerprints lie further apart.

A band value that few texts share is compared pair by pair. Where many share one, texts
are first compared with the most central of them, and what is still apart meets by a
lossless prefix filter: with shingles in order of their frequency, rarest first, two texts
of sizes x and y at 0.8 share one of their first x - o + 1 and y - o + 1 shingles, where
o = 4 / 9 (x + y) is what they must have in common. So a common passage, whose shingles are
the frequent ones, does not bring texts together unless it is nearly all of them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.llm import simhash
from tremorlake.llm.common import map_batches, stored
from tremorlake.llm.components import components

WORDS = 5
#: Two texts are near copies if SHARE[1] * common shingles >= SHARE[0] * all shingles of both.
SHARE = (4, 5)
#: At a similarity of 0.8 a pair shares no band with a chance of (1 - 0.8 ** ROWS) ** BANDS = 6e-5, less above.
BANDS, ROWS = 32, 6
#: Bands whose members are first compared with one of them; what that joins is not compared again.
LEADING = 4
#: Texts of one band value that are compared directly; fuller values go to pivots and the prefix filter.
DIRECT = 8
PIVOTS = 2
#: Sizes of texts that meet in the prefix filter are told apart by powers of this.
SIZE_STEP = 1.05
BLOCK_SHINGLES = 1 << 12

_rng = np.random.default_rng(42)
_FACTORS = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
_TERMS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]


def _low(text: str = "text") -> Column:
    return F.translate(F.col(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text (A-Z already lower); a text of fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode()) if text else []
    if not w:
        return np.empty(0, "<u8")
    flat = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    k = min(WORDS, len(w))
    starts, ends = (end - size)[: len(w) - k + 1].tolist(), end[k - 1:].tolist()
    return np.unique(np.fromiter((xxh64_intdigest(flat[a:b], 42) for a, b in zip(starts, ends)), "<u8", len(starts)))


def _bands(held: np.ndarray) -> list[int]:
    """A value for each band: equal if the least shingles under all orders of the band are equal."""
    from xxhash import xxh64_intdigest

    if not len(held):
        return []
    x = (held >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), BLOCK_SHINGLES):
        least = np.minimum(least, (x[None, i:i + BLOCK_SHINGLES] * _FACTORS + _TERMS).min(axis=1))
    flat, step = least.tobytes(), 4 * ROWS
    return [xxh64_intdigest(flat[step * b:step * b + step], b) for b in range(BANDS)]


def _node(held: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(held.tobytes(), 7)


def _signed(values, kind=np.uint64) -> pa.Array:
    return pa.array(np.array(values, kind).view(np.int64))


def _sketches(batch: pa.RecordBatch) -> pa.RecordBatch:
    nodes, bands, ends = [], [], [0]
    for text in batch.column("text").to_pylist():
        held = shingles(text)
        nodes.append(_node(held))
        bands.extend(_bands(held))
        ends.append(len(bands))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(bands))
    rest = [c for c in batch.schema.names if c != "text"]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], _signed(nodes), lists], names=[*rest, "node", "bands"])


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    held = [shingles(t) for t in batch.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays([_signed([_node(h) for h in held]), pa.array([h.tobytes() for h in held], pa.binary())], names=["node", "held"])


def _near(batch: pa.RecordBatch) -> pa.RecordBatch:
    keep = []
    for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
        x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
        both = np.concatenate((x, y))
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        keep.append(SHARE[1] * common >= SHARE[0] * (len(both) - common))
    return batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The pairs (u, v) whose shingles are similar enough."""
    size = lambda c: F.length(c)
    met = (pairs.distinct().join(sets.select(F.col("node").alias("u"), F.col("held").alias("a")), "u")
           .join(sets.select(F.col("node").alias("v"), F.col("held").alias("b")), "v")
           .where(SHARE[1] * F.least(size("a"), size("b")) >= SHARE[0] * F.greatest(size("a"), size("b"))))
    return stored(map_batches(met.select("u", "v", "a", "b"), _near, "u bigint, v bigint"), name)


def _open(cells: DataFrame) -> DataFrame:
    """The cells (key, node, root, ..) that hold more than one component, with the number of their members and the component of most."""
    per_root = cells.groupBy("key", "root").agg(F.count("*").alias("n"))
    open_ = per_root.groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("main")).where("roots > 1")
    return cells.join(open_.select("key", "n", "main"), "key")


def _rooted(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Open cells after the nodes' components are known."""
    root = stored(components(edges), "roots")
    cells = cells.select("key", "node", "weight").join(root, "node", "left").select("key", "node", "weight", F.coalesce("root", "node").alias("root"))
    return stored(_open(stored(cells, "rooted")), "open")


def _stars(cells: DataFrame, centre: Column) -> DataFrame:
    """Every member of a cell with the heaviest member that ``centre`` allows: the one that meets most others over all its cells."""
    pivot = cells.where(centre).groupBy("key").agg(F.max_by(F.struct(F.col("node").alias("v"), F.col("root").alias("rv")), F.struct("weight", "node")).alias("p"))
    return cells.join(pivot, "key").where("root <> p.rv").select(F.greatest("node", "p.v").alias("u"), F.least("node", "p.v").alias("v"))


def _across(cells: DataFrame, more: tuple[str, ...] = (), met: Column | None = None) -> DataFrame:
    """Pairs of members of one cell that lie in different components: each member outside the main one with all others."""
    side = lambda df, c: df.select("key", *[F.col(x).alias(f"{c}_{x}") for x in ("node", "root", *more)])
    pairs = side(cells.where("root <> main"), "x").join(side(cells, "y"), "key").where("x_root <> y_root")
    pairs = pairs if met is None else pairs.where(met)
    return pairs.select(F.greatest("x_node", "y_node").alias("u"), F.least("x_node", "y_node").alias("v"))


def _unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    held = [np.frombuffer(h, "<u8") for h in batch.column("held").to_pylist()]
    ends = np.cumsum([0, *map(len, held)])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(np.concatenate(held)))
    return pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), lists], names=["node", "root", "held"])


def _common(x, y):
    """How many shingles texts of x and y shingles must share, as SQL."""
    return f"((({x}) + ({y})) * {SHARE[0]} + {SHARE[0] + SHARE[1] - 1}) div {SHARE[0] + SHARE[1]}"


def _prefixes(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, node, root, place, size, grade, same) for the first shingles of each node, for each grade of size that a partner may have."""
    words = map_batches(nodes.join(sets, "node"), _unpacked, "node bigint, root bigint, held array<bigint>").select("node", "root", F.explode("held").alias("shingle"))
    words = stored(words, "shingles")
    often = words.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    order = F.struct(F.coalesce("often", F.lit(1)).alias("often"), "shingle")
    held = words.join(often, "shingle", "left").groupBy("node", "root").agg(F.sort_array(F.collect_list(order)).alias("held")).withColumn("size", F.size("held"))
    grade = lambda n: f"int(floor(ln({n}) / ln({SIZE_STEP})))"
    least = f"greatest(int(floor(pow({SIZE_STEP}, other))) - 1, 1)"  # one less than needed: logarithms are rounded
    low, high = f"ceil(size * {SHARE[0]} / {SHARE[1]})", f"floor(size * {SHARE[1]} / {SHARE[0]})"
    held = held.withColumn("grade", F.expr(grade("size"))).withColumn("other", F.expr(f"explode(sequence({grade(low)}, {grade(high)}))"))
    first = held.select("node", "root", "size", "grade", "other", F.posexplode(F.expr(f"slice(held, 1, greatest(size - {_common('size', least)} + 1, 0))")).alias("place", "at"))
    pair = F.least("grade", "other"), F.greatest("grade", "other")
    return first.where("at.often > 1").select(F.xxhash64("at.shingle", *pair).alias("key"), "node", "root", "place", "size", "grade", (F.col("grade") == F.col("other")).alias("same"))


def _sharing(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of nodes (node, root) of different components that the prefix filter leaves; all similar ones are among them."""
    need = _common("x_size", "y_size")
    met = F.expr(f"x_same = (x_grade = y_grade) and least(x_size - x_place, y_size - y_place) >= {need}")
    return _across(stored(_open(stored(_prefixes(nodes, sets), "prefixes")), "shared"), ("place", "size", "grade", "same"), met)


def links(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (u, v) that join the nodes as all similar pairs that share a cell (key, node, leading) do.

    Pairs inside one component change nothing and are left out; no other similar pair that
    shares a cell is. Full cells are first compared with a few pivots, after which a group
    of near copies is mostly one component; what stays apart in them goes through the prefix filter.
    """
    filled = cells.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(cells.join(filled, "key"), "filled")
    weight = met.groupBy("node").agg(F.sum("n").alias("weight"))
    met = stored(met.join(weight, "node").withColumn("root", F.col("node")), "met")
    edges = _links(_stars(met.where("leading"), F.lit(True)), sets, "links")
    now = _rooted(met, edges)
    for _ in range(PIVOTS):
        full = now.where(F.col("n") > DIRECT)
        if not full.take(1):
            break
        edges = edges.unionByName(_links(_stars(full, F.col("root") != F.col("main")), sets, "links"))
        now = _rooted(now, edges)
    pairs, full = _across(now.where(F.col("n") <= DIRECT)), now.where(F.col("n") > DIRECT)
    if full.take(1):
        pairs = pairs.unionByName(_sharing(full.select("node", "root").distinct(), sets))
    return edges.unionByName(_links(pairs, sets, "links"))


def _fingerprint_cells(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """(key, node, leading): the nodes of each class of linked SimHash fingerprints, copies of one text as one."""
    marked = docs.select(F.xxhash64("text").alias("mark"), "text")
    classes = simhash.near_groups(marked, row="mark").select("mark", F.col("component_id").alias("class")).distinct()
    placed = seen.select("mark", "node").distinct().join(classes, "mark")
    return placed.select(F.xxhash64(F.lit("simhash"), "class").alias("key"), "node", F.lit(True).alias("leading")).distinct()


def _band_cells(points: DataFrame) -> DataFrame:
    """(key, node, leading): the nodes of each band value."""
    return points.select("node", F.posexplode("bands").alias("band", "key")).select("key", "node", (F.col("band") < LEADING).alias("leading"))


def near_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, node) of every row and (node, root) of every node that has a near copy.

    ``mark`` is the 64-bit hash of the text, ``node`` that of its set of shingles; equal sets are one node.
    """
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), _low().alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    seen = stored(map_batches(marked, _sketches, f"doc_id {kind}, mark bigint, node bigint, bands array<bigint>"), "sketches")
    points = stored(seen.groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("one"), F.first("bands").alias("bands")), "points")
    cells = _fingerprint_cells(docs, seen).unionByName(_band_cells(points))
    twice = cells.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    cells = stored(cells.join(twice, "key", "left_semi"), "cells")
    need = points.join(cells.select("node").distinct(), "node", "left_semi").select("one.doc_id", "one.mark")
    on = [marked["doc_id"].eqNullSafe(need["doc_id"]), marked["mark"] == need["mark"]]
    sets = stored(map_batches(marked.join(need, on, "left_semi").select("text"), _sets, "node bigint, held binary").dropDuplicates(["node"]), "sets")
    return seen.select("doc_id", "mark", "node"), components(links(cells, sets))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with all its columns: the one with the least id, then the least hash of its text.

    Rows of one id that hold different texts are different documents; rows without an id
    belong to the group of their text and stay only if the group has no row with an id.
    """
    seen, root = near_groups(docs)
    placed = seen.join(root, "node", "left").select("doc_id", "mark", F.coalesce("root", "node").alias("root"))
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("one"))
    keep = stored(first.select(F.col("one.doc_id").alias("_id"), F.col("one.mark").alias("_mark")), "kept")
    held = docs.withColumn("_text_mark", F.xxhash64("text"))
    kept = held.join(keep, held["doc_id"].eqNullSafe(keep["_id"]) & (held["_text_mark"] == keep["_mark"]), "left_semi")
    repeated = seen.join(keep, seen["doc_id"].eqNullSafe(keep["_id"]) & (seen["mark"] == keep["_mark"]), "left_semi").groupBy("doc_id", "mark").count().where("count > 1").limit(1).count() > 0
    return (kept.dropDuplicates(["doc_id", "_text_mark"]) if repeated else kept).drop("_text_mark")
