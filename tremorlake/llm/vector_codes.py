"""Product codes of vectors in exact integer arithmetic.

Components become integers, vectors are cut into parts, and each part is replaced by the
number of the nearest entry of its codebook. Distances come from dot products by float64
BLAS: integers are broken into limbs so small that every product and every sum of them
stays below 2^53, where float64 is exact; the limbs' products are recombined in int64, or
in Python integers where int64 might overflow. So results do not depend on the order of
sums, on partitions or on the machine.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import map_batches, small_batches, stored, tidy

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
LIMB_BITS = 20  #: products of limbs stay below 2^40, so sums of up to 2^12 of them below 2^52
INT64_BITS = 50  #: a part's distance below this many bits is summed in int64, over up to 2^12 parts
HOT_SHARE = 1000  #: a label is hot if it holds at least one row in so many; there are at most so many hot labels
_COUNT = -1  #: position under which the number of parts of an entry is summed


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite float64 values: int64 where all fit well, else Python integers."""
    if not values.size or np.abs(values).max() < 2.0 ** 40:
        return np.floor(values * scale).astype(np.int64)
    return np.array([int(Fraction(x) * scale // 1) for x in values.ravel().tolist()], object).reshape(values.shape)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """float64 arrays d_k with x = sum of d_k * 2^(LIMB_BITS * k); every limb has the sign of its number."""
    sign, rest, out = np.where(x < 0, -1, 1), abs(x), []
    while True:
        out.append((sign * (rest & ((1 << LIMB_BITS) - 1))).astype(np.float64))
        rest = rest >> LIMB_BITS
        if not rest.any():
            return out


def dot_products(x: np.ndarray, y: np.ndarray, wide: bool = False) -> np.ndarray:
    """x @ y.T of integer matrices, exactly. ``wide`` recombines in Python integers."""
    total = np.zeros((len(x), len(y)), object if wide else np.int64)
    a, b = limbs(x), limbs(y)
    step = 1 << (52 - 2 * LIMB_BITS)
    for at in range(0, x.shape[1], step):
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                part = (p[:, at:at + step] @ q[:, at:at + step].T).astype(np.int64)
                total += (part.astype(object) if wide else part) << (LIMB_BITS * (i + j))
    return total


def _largest(x: np.ndarray) -> int:
    return int(abs(x).max()) if x.size else 0


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest entry, squared distance) of each row; the first of equally near entries."""
    wide = x.dtype == object or entries.dtype == object or 4 * max(x.shape[1], 1) * max(_largest(x), _largest(entries)) ** 2 >= 1 << INT64_BITS
    if wide:
        x, entries = x.astype(object), entries.astype(object)
    far = (entries * entries).sum(1)[None, :] - 2 * dot_products(x, entries, wide)
    best = far.argmin(1)
    return best, far[np.arange(len(x)), best] + (x * x).sum(1)


def bounds(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end; the first ones are longer where ``width`` is no multiple."""
    size = [width // parts + (i < width % parts) for i in range(parts)]
    ends = np.cumsum(size).tolist()
    return [(e - s, e) for s, e in zip(size, ends)]


class Codebooks:
    """Entries of every part position, as integer matrices."""

    def __init__(self, vectors: np.ndarray, parts: int = PARTS):
        self.width = vectors.shape[1]
        self.cuts = bounds(self.width, parts)
        self.entries = [vectors[:, a:b] for a, b in self.cuts]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code of each row and part, squared distances summed over parts)."""
        codes, error = np.empty((len(x), len(self.cuts)), np.int64), np.zeros(len(x), np.int64)
        for k, (a, b) in enumerate(self.cuts):
            codes[:, k], far = nearest(x[:, a:b], self.entries[k])
            error = error.astype(far.dtype) + far if far.dtype == object else error + far
        return codes, error

    def moved(self, sums: dict[tuple[int, int, int], int]) -> None:
        """Replace entries by floor(sum / count) of their parts; ``sums`` has (part, entry, position), and the count at _COUNT."""
        for k, entries in enumerate(self.entries):
            new = entries.astype(object)
            for e in range(len(new)):
                n = sums.get((k, e, _COUNT), 0)
                if n:
                    new[e] = [sums.get((k, e, p), 0) // n for p in range(new.shape[1])]
            self.entries[k] = new.astype(np.int64) if _largest(new) < 1 << 62 else new

    def digest(self) -> str:
        """sha256 of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(v)) for e in self.entries for v in e.ravel()).encode()).hexdigest()


def _matrices(batch: pa.RecordBatch, width: int, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer rows) of a batch, rows with small and with very large numbers apart."""
    column = batch.column("_vector")
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
    large = (np.abs(flat) >= 2.0 ** 40).any(1) if width else np.zeros(batch.num_rows, bool)
    rows = [np.flatnonzero(~large), np.flatnonzero(large)]
    return [(r, integers(flat[r], scale)) for r in rows if len(r)]


def _sums(x: np.ndarray, codes: np.ndarray, cuts: list[tuple[int, int]], held: dict) -> None:
    """Add the parts of ``x`` to ``held``: limbs of sums by (part, entry), so that any size adds up exactly."""
    for k, (a, b) in enumerate(cuts):
        order = np.argsort(codes[:, k], kind="stable")
        which, first = np.unique(codes[order, k], return_index=True)
        part = x[order, a:b]
        total = np.add.reduceat(part, first, axis=0) if b > a else np.zeros((len(which), 0), np.int64)
        n = np.diff(np.append(first, len(order)))
        for e, t, c in zip(which.tolist(), total.astype(object), n.tolist()):
            old, m = held.get((k, e), (0, 0))
            held[k, e] = (old + t, m + c)


def _update(rows: DataFrame, books: Codebooks, scale: int) -> dict[tuple[int, int, int], int]:
    """Sums and counts of the parts nearest to each entry. Tasks send one row per entry and
    position whatever the number of vectors; numbers travel in limbs of 30 bits, because they may pass any column's range."""
    def run(batches):
        held: dict = {}
        for batch in batches:
            if batch.num_rows:
                for _, x in _matrices(batch, books.width, scale):
                    _sums(x, books.assign(x)[0], books.cuts, held)
            tidy()
        out = []
        for (k, e), (total, n) in held.items():
            for p, v in [(_COUNT, n), *enumerate(total.tolist())]:
                sign, rest, limb = (-1 if v < 0 else 1), abs(v), 0
                while rest:
                    out.append((k, e, p, limb, sign * (rest & ((1 << 30) - 1))))
                    rest, limb = rest >> 30, limb + 1
        for i in range(0, len(out), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[i:i + (1 << 16)])], names=["k", "e", "p", "limb", "v"])

    sent = rows.select("_vector").mapInArrow(run, "k bigint, e bigint, p bigint, limb bigint, v bigint")
    sums: dict[tuple[int, int, int], int] = {}
    # At most parts x entries x positions x limbs rows, whatever the table.
    for r in sent.groupBy("k", "e", "p", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        sums[r.k, r.e, r.p] = sums.get((r.k, r.e, r.p), 0) + (int(r.v) << (30 * r.limb))
    return sums


def _finite(vector: str) -> Column:
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(vector).isNotNull() & F.forall(F.col(vector), usable)


def _label_sums(coded: DataFrame, label: str) -> DataFrame:
    """``coded`` with label_error. Hot labels, few by their definition, are looked up in a broadcast table; the rest meet their sums by a shuffle."""
    totals = stored(coded.groupBy(label).agg(F.count("*").alias("_n"), F.sum(F.col("_error").cast("decimal(38,0)")).alias("_sum"), F.count("_error").alias("_known"), F.count("code").alias("_coded")), "label-sums")
    totals = totals.select(F.col(label).alias("_label"), "_n", F.expr("if(_coded = 0 or _known < _coded, null, try_cast(_sum as bigint))").alias("label_error"))
    least = totals.agg(F.sum("_n")).first()[0] or 0
    least = max(-(-least // HOT_SHARE), 1)
    hot = totals.where(F.col("_n") >= least).drop("_n").withColumn("_hot", F.lit(True))
    met = coded.join(F.broadcast(hot), coded[label].eqNullSafe(hot["_label"]), "left").drop("_label")
    cold = met.where("_hot is null").drop("label_error", "_hot")
    rare = totals.where(F.col("_n") < least).drop("_n")
    return met.where("_hot").drop("_hot").unionByName(cold.join(rare, cold[label].eqNullSafe(rare["_label"])).drop("_label"))


def code_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every row whose vector has finite components only.

    Rows whose vector is null or holds null or non-finite components go. The width is that
    of the kept row with the least id (nulls last, equal ids by their vectors); rows of
    another width stay with a null code and error and take no other part. Codebooks start
    from the least ``entries`` kept rows, of which there may be fewer; repeated rows count as often as they
    occur. Errors beyond the range of a long are null. Null labels are one label. An empty
    table gives an empty result. Other columns, whatever their names, play no part.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.where(_finite(vector)).select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_vector"), F.col(label).alias("_label_in"))
    first = rows.orderBy(F.col("_key").asc_nulls_last(), "_vector").select("_vector").limit(1).collect()
    width = len(first[0][0]) if first else 0
    fit = rows.where(F.size("_vector") == width)
    start = fit.orderBy(F.col("_key").asc_nulls_last(), "_vector").select("_vector").limit(entries).collect()
    books = Codebooks(integers(np.array([r[0] for r in start], np.float64).reshape(len(start), width), scale), parts)
    if start:
        for _ in range(rounds):
            books.moved(_update(fit, books, scale))

    def code(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, error = np.empty((batch.num_rows, parts), np.int64), [None] * batch.num_rows
        for at, x in _matrices(batch, width, scale):
            codes[at], far = books.assign(x)
            for i, e in zip(at.tolist(), far.tolist()):
                error[i] = e if e < 1 << 63 else None
        text = ["".join("%02x" % c for c in row) for row in codes.tolist()]
        return pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_label_in"), pa.array(text, pa.string()), pa.array(error, pa.int64())],
                                          names=["_key", "_label_in", "code", "_error"])

    types = dict(rows.dtypes)
    coded = map_batches(fit, code, f"_key {types['_key']}, _label_in {types['_label_in']}, code string, _error bigint")
    odd = rows.where(F.size("_vector") != width).select("_key", "_label_in", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("_error"))
    coded = stored(coded.unionByName(odd), "vector-codes")
    return _label_sums(coded, "_label_in").select(F.col("_key").alias(key), "code", F.col("_error").alias("error"), "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
