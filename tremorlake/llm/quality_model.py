"""Quality classifier: random-indexing word vectors, pooled per document, under a small network.

Every word has a fixed sparse index vector; its word vector is the sum of the index vectors
of the words beside it. A document is the mean of its word vectors plus a few shares, and a
two-layer network gives a probability whose temperature is set on rows kept out of training.
Fitting takes at most FIT_ROWS labelled rows; scoring takes every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import map_batches, small_batches, stored
from tremorlake.llm.text_scan import Block, LETTER, OTHER, cut_long, grouped, lower_points, spans_without_space

FIT_ROWS = 20_000  #: labelled rows used to fit, taken in the order of a hash of their id
BUCKETS, DIMS, NONZERO = 1 << 14, 48, 4
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 40, 256, 3e-3, 1e-4, 11
SHARES = 7
SEEN_LEAST = 3  #: occurrences in the fitting rows below which a word keeps its index vector


def index_vectors() -> np.ndarray:
    """The fixed sparse vectors: NONZERO entries of +1 or -1 for every bucket."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    at = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (BUCKETS, NONZERO)), axis=1)
    return out


def _tokens(texts: list[str]):
    """For each block: owners, buckets, whether the word before is the same, and classes."""
    pieces, owners = [], []
    for i, t in enumerate(texts):
        for p in cut_long(t or ""):
            pieces.append(p)
            owners.append(i)
    owner = np.array(owners, np.int64)
    for s in grouped(pieces):
        block = Block(pieces[s])
        starts, ends = spans_without_space(block)
        if not len(starts):
            continue
        small = lower_points()[block.cp]
        h = block.hashes(starts, ends, small)
        piece = block.owner(starts)
        letters = block.cls[starts] == LETTER
        upper = np.concatenate([[0], np.cumsum((small != block.cp) & (block.cls == LETTER))])
        loud = letters & (ends - starts > 1) & (upper[ends] - upper[starts] == ends - starts)
        yield owner[s][piece], (h & np.uint64(BUCKETS - 1)).astype(np.int64), h, letters, loud, block.cls[starts] == OTHER, ends - starts


def context_sums(texts: list[str], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the neighbours' index vectors, occurrences) of every bucket."""
    total, seen = np.zeros((BUCKETS, DIMS)), np.zeros(BUCKETS)
    for own, bucket, *_ in _tokens(texts):
        seen += np.bincount(bucket, minlength=BUCKETS)
        side = np.flatnonzero(own[1:] == own[:-1])
        a, b = bucket[side], bucket[side + 1]
        for d in range(DIMS):
            total[:, d] += np.bincount(a, index[b, d], BUCKETS) + np.bincount(b, index[a, d], BUCKETS)
    return total, seen


def word_vectors(total: np.ndarray, seen: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Unit word vectors without their common part; rare buckets keep their index vector."""
    mean = total.sum(0) / max(seen.sum(), 1)
    own = total - seen[:, None] * mean
    size = np.linalg.norm(own, axis=1, keepdims=True)
    unit = np.divide(own, size, out=np.zeros_like(own), where=size > 1e-9)
    return np.where(seen[:, None] >= SEEN_LEAST, unit, index / np.sqrt(NONZERO)).astype(np.float32)


def features(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """A row per text: mean word vector, its length, and shares of kinds of words. Empty: zeros."""
    n = len(texts)
    pooled, count = np.zeros((n, DIMS), np.float32), np.zeros(n)
    kinds = np.zeros((n, 5))
    for own, bucket, h, letters, loud, other, size in _tokens(texts):
        rows, first = np.unique(own, return_index=True)
        pooled[rows] += np.add.reduceat(vectors[bucket], first, axis=0)
        count += np.bincount(own, minlength=n)
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (own[1:] == own[:-1])])
        beyond = np.concatenate([[False] * min(2, len(h)), (h[2:] == h[:-2]) & (own[2:] == own[:-2])])
        for k, mark in enumerate((letters, loud, other, again | beyond)):
            kinds[:, k] += np.bincount(own, mark, n)
        kinds[:, 4] += np.bincount(own, np.where(other, size, 0), n)
    share = np.maximum(count, 1)[:, None]
    pooled /= share.astype(np.float32)
    return np.hstack([pooled, np.linalg.norm(pooled, axis=1, keepdims=True), np.log1p(count)[:, None], kinds / share]).astype(np.float32)


@dataclass
class Network:
    """Weights of the two layers, scales of the inputs and the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> Network:
    """Fit on the rows that are not ``apart``; those set the temperature. One label only: a constant."""
    rng = np.random.default_rng(SEED)
    d = x.shape[1]
    net = Network(np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    fit = np.flatnonzero(~apart) if (~apart).any() else np.arange(len(y))
    if not len(fit):
        return net
    share = float(np.clip(y[fit].mean(), 1e-3, 1 - 1e-3))
    net.b2 = float(np.log(share / (1 - share)))
    if y[fit].min() == y[fit].max():
        return net
    net.centre, net.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
    w = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.array(net.b2)]
    z = (x[fit] - net.centre) / net.scale
    moment, power, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(fit))
        for at in range(0, len(fit), BATCH):
            rows = order[at:at + BATCH]
            xb, yb = z[rows], y[fit[rows]]
            hidden = np.maximum(xb @ w[0] + w[1], 0)
            gap = (1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -30, 30))) - yb) / len(rows)
            back = np.outer(gap, w[2]) * (hidden > 0)
            grads = [xb.T @ back + DECAY * w[0], back.sum(0), hidden.T @ gap + DECAY * w[2], gap.sum()]
            step += 1
            for k, g in enumerate(grads):
                moment[k] = 0.9 * moment[k] + 0.1 * g
                power[k] = 0.999 * power[k] + 0.001 * g * g
                w[k] = w[k] - RATE * (moment[k] / (1 - 0.9 ** step)) / (np.sqrt(power[k] / (1 - 0.999 ** step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = w[0], w[1], w[2], float(w[3])
    rest = np.flatnonzero(apart)
    if len(rest):
        logit = net.logits(x[rest])
        grid = np.geomspace(0.25, 8, 141)
        loss = [np.logaddexp(0, np.where(y[rest] > 0, -logit, logit) / t).mean() for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network

    def score(self, texts: list[str]) -> np.ndarray:
        return self.network.probability(features(texts, self.vectors)).astype(float)


def fit(docs: DataFrame, labels: DataFrame, eligible: Column | None = None, rows: int = FIT_ROWS) -> Model:
    """Learn from labelled documents whose id is ``eligible``.

    Rows with a null id or label are left out; a document with several labels takes their
    mean, at least a half counting as 1. ``rows`` bounds the sample (order of xxhash64 of the id).
    """
    known = labels.select("doc_id", F.col("quality").cast("double").alias("_y")).where("doc_id is not null and _y is not null")
    if eligible is not None:
        known = known.where(eligible)
    known = known.groupBy("doc_id").agg((F.avg("_y") >= 0.5).cast("int").alias("_y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = stored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").repartition(8, "doc_id"), "sample")
    small_batches(docs.sparkSession)
    index = index_vectors()

    def contexts(batches):
        total, seen = np.zeros((BUCKETS, DIMS)), np.zeros(BUCKETS)
        for b in batches:
            t, s = context_sums(b.column("text").to_pylist(), index)
            total, seen = total + t, seen + s
        at = np.flatnonzero(seen)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at]), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["bucket", "seen", "total"])

    parts = sample.mapInArrow(contexts, "bucket bigint, seen double, total array<double>")
    sums = parts.groupBy("bucket").agg(F.sum("seen").alias("seen"), *[F.sum(F.col("total")[d]).alias(f"t{d}") for d in range(DIMS)]).toArrow()
    total, seen = np.zeros((BUCKETS, DIMS)), np.zeros(BUCKETS)
    at = sums.column("bucket").to_numpy()
    seen[at] = sums.column("seen").to_numpy()
    for d in range(DIMS):
        total[at, d] = sums.column(f"t{d}").to_numpy()
    vectors = word_vectors(total, seen, index)

    def rows_of(b: pa.RecordBatch) -> pa.RecordBatch:
        x = features(b.column("text").to_pylist(), vectors)
        return pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("_y"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "_y", "x"])

    got = map_batches(sample, rows_of, "doc_id bigint, _y int, x array<float>").toArrow()
    ids = got.column("doc_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, DIMS + SHARES)[order]
    y = got.column("_y").to_numpy()[order].astype(float)
    return Model(vectors, train(x, y, np.arange(len(y)) % 5 == 4))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` (all by default) and ``name``, the probability of label 1.

    Null and empty texts get the score of a document without words.
    """
    columns = docs.columns if keep is None else keep
    held = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], *[] if "text" in columns else [F.col("text").alias("_text")])
    kinds = held.drop("_text").schema
    at = columns.index("text") if "text" in columns else len(columns)

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        names = b.schema.names[:len(columns)]
        return pa.RecordBatch.from_arrays([*b.columns[:len(columns)], pa.array(model.score(b.column(at).to_pylist()))], names=[*names, "_score"])

    out = map_batches(held, of, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kinds), "_score double"]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("_score").alias(name))
