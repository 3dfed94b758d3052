"""Boosted trees of many heads at once, from one table of binned features.

Feature values become bin numbers once, by quantiles of all training rows. Rows with equal
bins and fold are one row with counts: rows in all, and positives of each head. This loses
nothing, and no row is left out. The condensed table goes to the tasks in blocks, by a
shuffle; the driver never holds it. Each task grows the trees of one model (head, learner,
fold) from histograms over bins, so that all heads, both learners and all folds are fitted
in one job; it holds about 150 bytes a condensed row. There are at most as many of these as
cells times training snapshots, however many events there are. Scoring takes all models
over the rows in one pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.session import scratch_path, struct_array

BLOCK_ROWS = 32_768  #: condensed rows that travel to a model's task as one row
JOINT = 4096  #: kinds of values of features whose histograms are counted in one pass
BINS, DEPTH, STEP = 32, 4, 0.08
SMOOTH, LEAST_WEIGHT = 1.0, 1.0  #: added to a node's weight; a child weighs at least so much
#: Learners: share of the features and of the rows that a tree sees.
LEARNERS = ((1.0, 1.0), (0.6, 0.8))
FULL = -1  #: fold of a model fitted on all rows


@dataclass
class Forest:
    """Trees of full depth: feature and greatest left bin of every inner node, value of every leaf."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(bins)), np.arange(len(bins))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(bins), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            out += leaf[node - (1 << DEPTH) + 1]
        return out

    def probability(self, bins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margins(bins)))


def _joint(columns: list[np.ndarray]) -> list[tuple[list[int], tuple[int, ...], np.ndarray]]:
    """(features, kinds of each, joint number of each row): features are put together as long as their kinds
    multiply to ``JOINT`` at most, so that one count over joint numbers holds the histograms of all of them."""
    out = []
    for j, c in enumerate(columns):
        kinds = int(c.max(initial=0)) + 1
        if out and math.prod(out[-1][1]) * kinds <= JOINT:
            members, sizes, code = out[-1]
            out[-1] = ([*members, j], (*sizes, kinds), code * np.uint16(kinds) + c.astype(np.uint16))
        else:
            out.append(([j], (kinds,), c.astype(np.uint16)))
    return out


def _histograms(joint: list, node: np.ndarray, n: int, g: np.ndarray, h: np.ndarray, allowed: set[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums of g and h by node and value of every allowed feature."""
    out = {}
    for members, sizes, code in joint:
        if allowed.isdisjoint(members):
            continue
        width = math.prod(sizes)
        key = node * width + code
        sums = [np.bincount(key, v, n * width).reshape(n, *sizes) for v in (g, h)]
        for i, j in enumerate(members):
            if j in allowed:
                others = tuple(k + 1 for k in range(len(sizes)) if k != i)
                out[j] = tuple(v.sum(others) for v in sums)
    return out


def _tree(columns: list[np.ndarray], g: np.ndarray, h: np.ndarray, allowed: np.ndarray, joint: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, cuts, leaf values, leaf of each row) of the tree that lowers the loss most, level by level."""
    features, cuts, node = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, 255, np.int64), np.zeros(len(g), np.int64)
    joint = _joint(columns) if joint is None else joint
    for level in range(DEPTH):
        n, first = 1 << level, (1 << level) - 1
        best = np.full(n, 1e-9)
        held = _histograms(joint, node, n, g, h, set(allowed.tolist()))
        for j in allowed:
            left_g, left_h = (np.cumsum(v, 1) for v in held[int(j)])
            all_g, all_h = left_g[:, -1:], left_h[:, -1:]
            right_h = all_h - left_h
            gain = left_g ** 2 / (left_h + SMOOTH) + (all_g - left_g) ** 2 / (right_h + SMOOTH) - all_g ** 2 / (all_h + SMOOTH)
            gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = 0.0
            at = gain.argmax(1)
            value = gain[np.arange(n), at]
            better = np.flatnonzero(value > best * (1 + 1e-9))  # equal but for the order of sums: the first feature
            best[better], features[first + better], cuts[first + better] = value[better], j, at[better]
        right = np.zeros(len(g), bool)
        for k in range(n):  # at most 2 ^ (DEPTH - 1) nodes
            own = node == k
            right[own] = columns[features[first + k]][own] > cuts[first + k]
        node = 2 * node + right
    sums = np.bincount(node, g, 1 << DEPTH), np.bincount(node, h, 1 << DEPTH)
    return features, cuts, -STEP * sums[0] / (sums[1] + SMOOTH), node


def fit_forest(bins: np.ndarray, rows: np.ndarray, positives: np.ndarray, rounds: int, shares: tuple[float, float], seed: int) -> Forest | None:
    """Logistic boosting on weighted rows, positives weighing negatives / positives; None for a single class."""
    pos, total = float(positives.sum()), float(rows.sum())
    if pos <= 0 or pos >= total:
        return None
    rng, columns = np.random.default_rng(seed), [np.ascontiguousarray(c) for c in bins.T]
    joint = _joint(columns)
    up, down = positives * ((total - pos) / pos), rows - positives
    margin, trees = np.zeros(len(rows)), []
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = down * p - up * (1 - p), (up + down) * p * (1 - p)
        allowed = np.sort(rng.choice(len(columns), max(1, round(shares[0] * len(columns))), replace=False))
        seen = rng.random(len(rows)) < shares[1] if shares[1] < 1 else None
        feature, cut, leaf, node = _tree(columns, g if seen is None else g * seen, h if seen is None else h * seen, allowed, joint)
        margin += leaf[node]
        trees.append((feature, cut, leaf))
    return Forest(*map(np.array, zip(*trees)))


def bin_edges(rows: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Quantiles of every feature over all rows: one pass, a few numbers per feature."""
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(F.col(c), shares, 2000).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(q or [], np.float64)) for q in found]


def _bins(values: pa.Array, edges: list[np.ndarray]) -> np.ndarray:
    x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), len(edges))
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1).astype(np.uint8)


def _given(df: DataFrame, features: list[str], labels: list[str], keep: list[str], fold: Column) -> DataFrame:
    return df.select(*keep, fold.cast("int").alias("fold"), F.array(*[F.col(c).cast("bigint") for c in labels]).alias("ys"), F.array(*features).alias("xs"))


def condensed(train: DataFrame, features: list[str], labels: list[str], edges: list[np.ndarray], fold: Column) -> DataFrame:
    """Rows (bins, fold, n, y0, y1, ..) in order of bins and fold: all training rows, equal ones as one."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in _bins(b.column("xs"), edges)], pa.binary()), b.column("fold"), b.column("ys")], names=["bins", "fold", "ys"])

    rows = _given(train, features, labels, [], fold).mapInArrow(run, "bins binary, fold int, ys array<bigint>")
    path = scratch_path(train.sparkSession, "condensed")
    rows.groupBy("bins", "fold").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(F.col("ys")[i], F.lit(0))).alias(f"y{i}") for i in range(len(labels))]).write.parquet(path)
    return train.sparkSession.read.parquet(path).orderBy("bins", "fold")


def _blocks(rows: DataFrame, heads: int) -> DataFrame:
    """Rows (first, bins, fold, n, ys) of packed condensed rows; ``first`` is the place of the block in their order."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                t = b.slice(at, BLOCK_ROWS)
                of = lambda c, kind: t.column(c).to_numpy(zero_copy_only=False).astype(kind).tobytes()
                bins, folds = t.column("bins").to_pylist(), of("fold", "<i4")
                yield pa.RecordBatch.from_arrays([
                    pa.array([bins[0] + (t.column("fold")[0].as_py() + 128).to_bytes(1)], pa.binary()), pa.array([b"".join(bins)], pa.binary()), pa.array([folds], pa.binary()),
                    pa.array([of("n", "<i8")], pa.binary()), pa.array([[of(f"y{i}", "<i8") for i in range(heads)]], pa.list_(pa.binary()))], names=["first", "bins", "fold", "n", "ys"])

    return rows.mapInArrow(run, "first binary, bins binary, fold binary, n binary, ys array<binary>")


def fit_models(train: DataFrame, features: list[str], labels: list[str], edges: list[np.ndarray], wanted: list[tuple[int, int, int]], fold: Column,
               rounds: int = 200) -> dict[tuple[int, int, int], Forest]:
    """The models (head, learner, fold) of ``wanted``, each fitted on all training rows in a task of its own. A model of
    a fold does not see that fold's rows. Models of a single class are left out."""
    if not wanted:
        return {}
    spark, width = train.sparkSession, len(edges)
    models = struct_array([(i, head) for i, (head, _, _) in enumerate(wanted)], ["id", "head"])
    blocks = _blocks(condensed(train, features, labels, edges, fold), len(labels)).select("first", "bins", "fold", "n", "ys", F.inline(models))
    given = blocks.select("id", "first", "bins", "fold", "n", F.get("ys", F.col("head")).alias("y")).repartition(4 * len(wanted), "id")  # few models share a task
    schema = pa.schema([("id", pa.int64()), ("feature", pa.list_(pa.int32())), ("cut", pa.list_(pa.int32())), ("leaf", pa.list_(pa.float64()))])

    def run(key, table):
        i = key[0].as_py()
        head, learner, out = wanted[i]
        table = table.sort_by("first")
        whole = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        own = whole("fold", "<i4") != out
        got = fit_forest(whole("bins", np.uint8).reshape(-1, width)[own], whole("n", "<i8")[own].astype(float), whole("y", "<i8")[own].astype(float), rounds, LEARNERS[learner], 42 + i)
        rows = [] if got is None else [{"id": i, "feature": got.feature.ravel().tolist(), "cut": got.cut.ravel().tolist(), "leaf": got.leaf.ravel().tolist()}]
        return pa.Table.from_pylist(rows, schema)

    path = scratch_path(spark, "forests")
    given.groupBy("id").applyInArrow(run, "id bigint, feature array<int>, cut array<int>, leaf array<double>").write.parquet(path)
    inner = (1 << DEPTH) - 1
    # One row per model, of a size set by the rounds.
    return {wanted[r.id]: Forest(np.array(r.feature, np.int64).reshape(-1, inner), np.array(r.cut, np.int64).reshape(-1, inner), np.array(r.leaf).reshape(-1, inner + 1))
            for r in spark.read.parquet(path).collect()}


def score_rows(df: DataFrame, features: list[str], labels: list[str], edges: list[np.ndarray], models: dict[tuple[int, int, int], Forest], fold: Column, keep: list[str],
               heads: list[int]) -> DataFrame:
    """(keep, head, y, p1, p2) of every row and head: probabilities of both learners, by the models of the row's fold. Without a model it is zero."""
    sent = df.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        held = sent.value
        for b in batches:
            bins, folds = _bins(b.column("xs"), edges), b.column("fold").to_numpy()
            p = np.zeros((len(LEARNERS), len(bins), len(heads)))
            for f in np.unique(folds):
                own = folds == f
                for k, head in enumerate(heads):
                    for learner in range(len(LEARNERS)):
                        model = held.get((head, learner, int(f)))
                        if model is not None:
                            p[learner, own, k] = model.probability(bins[own])
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1) * len(heads), pa.int32()), pa.array(x.ravel())) for x in p]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], b.column("ys"), *lists], names=[*keep, "ys", "p1", "p2"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "ys array<bigint>", "p1 array<double>", "p2 array<double>"])
    out = _given(df, features, labels, keep, fold).mapInArrow(run, schema)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("head"), F.col("ys")[h].cast("int").alias("y"), F.col("p1")[k].alias("p1"), F.col("p2")[k].alias("p2")) for k, h in enumerate(heads)]))
    return out.select(*keep, each.alias("_e")).select(*keep, "_e.*")
