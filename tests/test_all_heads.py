"""Boosting of all heads at once: trees against plain sums, learners that learn, and the whole query."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.operators import boosting, learning
from tremorlake.plans import q_models


def plain_gain(x, g, h, cut):
    left = x <= cut
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + boosting.SMOOTH)
    return part(left) + part(~left) - part(np.ones(len(x), bool))


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, boosting.BINS, (400, 5)).astype(np.uint8)
    g, h = rng.normal(size=400) + (bins[:, 3] > 11), np.full(400, 0.25)
    feature, cut, leaf, node = boosting._tree([c.astype(np.int64) for c in bins.T], g, h, np.arange(5))
    best = max(((plain_gain(bins[:, j], g, h, c), j, c) for j in range(5) for c in range(boosting.BINS - 1)), key=lambda x: x[0])
    assert (feature[0], cut[0]) == best[1:]
    for n in np.unique(node):
        assert leaf[n] == pytest.approx(-boosting.STEP * g[node == n].sum() / (h[node == n].sum() + boosting.SMOOTH))
    forest = boosting.Forest(feature[None], cut[None], leaf[None])
    assert forest.margins(bins).tolist() == leaf[node].tolist()


@pytest.mark.parametrize("shares", boosting.LEARNERS)
def test_boosting_learns_and_equal_rows_may_be_condensed(shares):
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 6, (3000, 4)).astype(np.uint8)
    y = ((bins[:, 0] > 2) ^ (bins[:, 1] > 3)).astype(float)
    forest = boosting.fit_forest(bins, np.ones(3000), y, 40 if shares[0] == 1 else 300, shares, 3)  # a tree of the second sees both features one time in six
    assert ((forest.probability(bins) > 0.5) == y).mean() > 0.9
    if shares[1] == 1:
        kinds, code = np.unique(bins, axis=0, return_inverse=True)
        again = boosting.fit_forest(kinds, np.bincount(code).astype(float), np.bincount(code, y), 40, shares, 3)
        assert np.allclose(again.probability(bins), forest.probability(bins))
    assert boosting.fit_forest(bins, np.ones(3000), np.zeros(3000), 5, shares, 3) is None


def test_models_of_folds_do_not_see_their_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, float(rng.normal()), None if i % 50 == 0 else float(rng.normal()), int(rng.random() < 0.3), 0) for i in range(900)]
    rows = [(i, f, a + y, b, y, z) for i, f, a, b, y, z in rows]
    df = learning.prepared(spark.createDataFrame(rows, "i int, fold int, a double, b double, y int, z int"), ["a", "b"])
    edges = boosting.bin_edges(df, ["a", "b"])
    wanted = [(h, n, f) for h in (0, 1) for n in (0, 1) for f in (-1, 0, 1, 2)]
    models = boosting.fit_models(df, ["a", "b"], ["y", "z"], edges, wanted, F.col("fold"), 10)
    assert set(models) == {w for w in wanted if w[0] == 0}
    out = boosting.score_rows(df, ["a", "b"], ["y", "z"], edges, models, F.col("fold"), ["i"], [0, 1]).toPandas()
    assert len(out) == 1800 and out.p1.between(0, 1).all() and (out[out["head"] == 1].p1 == 0).all()
    changed = df.withColumn("y", F.when(F.col("fold") == 1, 1 - F.col("y")).otherwise(F.col("y")))
    again = boosting.fit_models(changed, ["a", "b"], ["y", "z"], edges, wanted, F.col("fold"), 10)
    assert np.array_equal(again[0, 0, 1].leaf, models[0, 0, 1].leaf) and not np.array_equal(again[0, 0, 0].leaf, models[0, 0, 0].leaf)


def test_models_are_fitted_on_all_rows(spark):
    """More kinds of rows than the 40,000 that fitting was once bounded by: the trees are those of all rows."""
    names = ["a", "b", "c"]
    x = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 20)).cast("double").alias(c) for i, c in enumerate(names)]
    df = spark.range(60_000).select(*x, F.pmod(F.col("id"), F.lit(3)).cast("int").alias("fold"), F.pmod(F.xxhash64("id"), F.lit(5)).cast("int").alias("r")).withColumn(
        "y", ((F.col("a") > 600_000) | (F.col("r") == 0)).cast("int"))
    edges = boosting.bin_edges(df, names)
    held = df.toPandas()
    bins = np.stack([np.searchsorted(e, held[c].to_numpy(), side="left") for c, e in zip(names, edges)], 1).astype(np.uint8)
    assert len({*map(tuple, np.column_stack([bins, held["fold"]]).tolist())}) > 40_000
    wanted = [(0, 0, boosting.FULL), (0, 0, 1)]
    models = boosting.fit_models(df, names, ["y"], edges, wanted, F.col("fold"), 3)
    for i, w in enumerate(wanted):
        own = held["fold"].to_numpy() != w[2]
        plain = boosting.fit_forest(bins[own], np.ones(own.sum()), held["y"].to_numpy(float)[own], 3, boosting.LEARNERS[0], 42 + i)
        assert np.array_equal(models[w].feature, plain.feature) and np.array_equal(models[w].cut, plain.cut) and np.allclose(models[w].leaf, plain.leaf, rtol=1e-9, atol=0)


def test_learner_query_trains_and_scores_all_heads(spark):
    """The query itself, with all rounds."""
    got = q_models.m12_m15_learn(spark, "/root/testdata/sf0.001").groupBy("horizon_days", "mag_threshold").agg(
        F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.countDistinct("p1").alias("kinds"), F.max("y").alias("any")).collect()
    assert {(r.horizon_days, r.mag_threshold) for r in got} == {(h, t) for h in K.HORIZONS for t in K.THRESHOLDS}
    assert len({r.n for r in got}) == 1 and all(0 <= r.lo <= r.hi <= 1 for r in got) and any(r.kinds > 20 for r in got)
    facts = q_models.m12_m15_facts(spark, "/root/testdata/sf0.001")
    assert facts.where("not scores_are_probabilities or not calibration_helps").count() == 0
