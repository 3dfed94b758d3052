import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import EPOCH, frame
from tremorlake import constants as K
from tremorlake.operators import ensemble, etas, evaluation, learning, priors, serving
from tremorlake.operators import features as X
from tremorlake.operators import labels as L
from tremorlake.operators.grid import with_cell_no


@pytest.mark.parametrize("c,p", [(0.01, 1.1), (1e-4, 0.5), (10.0, 2.5), (0.5, 1.0)])
def test_exponential_sum_is_the_power_law(c, p):
    s, w = etas.exponentials(c, p, 2000.0)
    x = c + np.concatenate([[0.0], np.geomspace(1e-4, 2000.0, 200)])
    got = (w * np.exp(-np.outer(x, s))).sum(axis=1)
    assert np.max(np.abs(got / x ** -p - 1)) < 1e-9


@pytest.mark.parametrize("chunk", [60, 50_000])
def test_likelihood_equals_pair_sum(spark, chunk):
    rng = np.random.default_rng(1)
    t, m = np.sort(rng.uniform(0, 300, 400)), 4.5 + rng.exponential(0.4, 400)
    t[10] = t[11]  # a tie
    df = spark.createDataFrame([(f"{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(zip(t, m))], "event_id string, t double, m double")
    cands = [dict(K.ETAS_START), {"mu": 0.5, "k": 0.1, "c": 0.1, "p": 1.0, "alpha": 1.0}]
    got = {r.candidate: r.loglik for r in etas.log_likelihoods(df, 300.0, cands, chunk_rows=chunk).collect()}
    for i, q in enumerate(cands):
        g = np.exp(q["alpha"] * (m - 4.5))
        lam = [q["mu"] + q["k"] * np.sum(g[:j] * (t[j] - t[:j] + q["c"]) ** -q["p"]) for j in range(len(t))]
        left = 300.0 - t + q["c"]
        mass = np.log(left / q["c"]) if q["p"] == 1.0 else (left ** (1 - q["p"]) - q["c"] ** (1 - q["p"])) / (1 - q["p"])
        assert got[i] == pytest.approx(np.sum(np.log(lam)) - q["mu"] * 300 - q["k"] * np.sum(g * mass), rel=1e-8)


def test_fit_improves_and_stays_in_bounds(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(f"{i:04d}", float(a), float(4.5 + b)) for i, (a, b) in enumerate(
        zip(np.sort(rng.uniform(0, 500, 300)), rng.exponential(0.4, 300)))], "event_id string, t double, m double")
    start = etas.log_likelihoods(df, 500.0, [dict(K.ETAS_START)]).first().loglik
    best, ll = etas.fit(df, 500.0)
    assert ll > start and all(low <= best[n] <= high for n, low, high in K.ETAS_BOUNDS)
    assert etas.fit(df.limit(0), 500.0)[0] == dict(K.ETAS_EMPTY)


def _scored(spark, n=600, seed=5):
    rng = np.random.default_rng(seed)
    p = np.round(rng.beta(1, 6, n), 2)
    y = (rng.uniform(size=n) < p).astype(int)
    return spark.createDataFrame([(30, 5.0, int(a), float(b)) for a, b in zip(y, p)], "horizon_days int, mag_threshold double, y int, p double"), y, p


def test_auc_equals_pair_counting(spark):
    df, y, p = _scored(spark)
    pos, neg = p[y == 1], p[y == 0]
    expect = np.mean([(a > neg).mean() + 0.5 * (a == neg).mean() for a in pos])
    assert evaluation.roc_auc(df).first().roc_auc == pytest.approx(expect)


def test_simulated_tests_accept_a_calibrated_forecast(spark):
    df, _, _ = _scored(spark, 4000, 8)
    rows = {r.test: r for r in evaluation.consistency_tests(df, 300).collect()}
    assert rows["n_test"].status == rows["l_test"].status == rows["s_test"].status == "pass"
    again = {r.test: r for r in evaluation.consistency_tests(df.repartition(3), 300).collect()}
    assert again["l_test"].quantile == rows["l_test"].quantile
    low = df.withColumn("p", F.col("p") / 20)
    assert {r.status for r in evaluation.n_test(low).collect()} == {"fail"}


def test_poisson_cdf_branches(spark):
    df = spark.createDataFrame([(3.0, 2), (5000.0, 5010), (0.5, 0)], "lam double, n int").withColumn("c", evaluation._poisson_cdf(F.col("n"), F.col("lam")))
    for r in df.collect():
        exact = sum(math.exp(k * math.log(r.lam) - r.lam - math.lgamma(k + 1)) for k in range(r.n + 1))
        assert r.c == pytest.approx(exact, rel=1e-8)


def test_monotone_wide_and_long_agree(spark):
    rng = np.random.default_rng(0)
    rows = [(c, h, t, float(rng.uniform())) for c in range(20) for h in K.HORIZONS for t in K.THRESHOLDS]
    df = spark.createDataFrame(rows, "cell_no int, horizon_days int, mag_threshold double, p double")
    from tremorlake.functions.heads import to_long, to_wide
    a = priors.monotone(df, ["p"], ["cell_no"]).toPandas().set_index(["cell_no", "horizon_days", "mag_threshold"]).p
    b = to_long(priors.monotone_wide(to_wide(df, ["cell_no"], "p")), ["cell_no"], "p").toPandas().set_index(["cell_no", "horizon_days", "mag_threshold"]).p
    assert np.allclose(a.sort_index(), b.sort_index())
    wide = a.unstack("mag_threshold")
    assert (wide.diff(axis=1).iloc[:, 1:] <= 1e-12).all().all()


def test_compression_keeps_rank_and_meets_rate(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, 30, 5.0, float(v)) for i, v in enumerate(rng.uniform(0.2, 0.9, 301))], "cell_no int, horizon_days int, mag_threshold double, p double")
    rates = spark.createDataFrame([(30, 5.0, 0.01)], "horizon_days int, mag_threshold double, base_rate double")
    out = ensemble.compress(df, rates, ensemble.HEAD).toPandas().sort_values("cell_no")
    raw = df.toPandas().sort_values("cell_no")
    assert (out.p.rank() == raw.p.rank()).all() and out.p.median() == pytest.approx(0.01)


def test_calibrators_improve_brier(spark):
    rng = np.random.default_rng(6)
    p = rng.uniform(0.01, 0.99, 3000)
    y = (rng.uniform(size=3000) < p ** 3).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    best, metrics = learning.fit_calibrators(df, "y")
    assert best["kind"] != "identity" and metrics[best["kind"]] < metrics["identity"]
    one, only = learning.fit_calibrators(df.withColumn("y", F.lit(0)), "y")
    assert one["kind"] == "identity" and set(only) == {"identity"}


def test_window_edges(spark):
    """Feature windows are closed on both ends, label windows open at the snapshot."""
    snaps = X.Snapshots("2000-06-01", 1, 7)
    at = pd.Timestamp("2000-06-01")
    times = {"on": at, "edge30": at - pd.Timedelta(days=30), "old": at - pd.Timedelta(days=30, seconds=1), "next": at + pd.Timedelta(seconds=1),
             "edge7": at + pd.Timedelta(days=7), "late": at + pd.Timedelta(days=60, seconds=1)}
    df = pd.DataFrame([{"event_id": k, "time": v, "lat": 0.1, "lon": 120.1, "depth": 10.0, "magnitude": {"edge7": 5.6, "late": 6.5}.get(k, 4.6), "mag_type": "mb",
                        "source": "usgs", "place": "x"} for k, v in times.items()])
    ev = with_cell_no(frame(spark, df))
    cell = ev.first().cell_no
    row = X.build_features(ev, snaps).where(F.col("cell_no") == cell).first()
    assert (row.event_count_30d, row.event_count_90d) == (2.0, 3.0) and row.time_since_last_M4_days == 0.0
    assert len(X.feature_columns()) == 48
    lab = L.build_labels(ev, snaps).where(F.col("cell_no") == cell).first()
    assert (lab.label_h7_m45, lab.label_h7_m55, lab.label_h60_m60) == (1, 1, 0)
    assert L.build_labels(ev.limit(0), snaps).agg(F.sum("label_h60_m45")).first()[0] == 0


def test_time_split_by_year_and_by_share(spark):
    def split(days):
        df = spark.createDataFrame([(i, pd.Timestamp(d, tz="UTC").to_pydatetime()) for i, d in enumerate(days)], "cell_no int, snapshot timestamp")
        return {r.cell_no: r.split for r in L.time_split(df).collect()}
    got = split(["2019-06-01", "2020-06-01", "2021-06-01", "2022-06-01", "2024-06-01"])
    assert list(got.values()) == ["train", "train", "val", "test", "test"]
    near = split([f"2005-01-{d:02d}" for d in range(1, 11)])
    assert near[0] == "train" and near[9] is None


def test_risk_bands_and_slug(spark):
    df = spark.createDataFrame([(None,), (5e-7,), (0.0049,), (0.03,)], "p double").withColumns(serving.risk_columns(F.col("p")))
    rows = df.collect()
    assert [r.risk_level for r in rows] == ["belum ada data", "rendah", "rendah-sedang", "tinggi relatif"] and rows[1].pct_shown == "data minim"
    assert spark.range(1).select(serving.slug(F.lit("Lepas Pantai Acéh - dekat Meulaboh"))).first()[0] == "lepas-pantai-aceh-dekat-meulaboh"


def test_demo_tier_for_an_empty_catalog(spark):
    from tremorlake.operators.geology import area_labels
    none = spark.createDataFrame([], "cell_no int, time timestamp, magnitude double, lat double, lon double")
    out, mode, tag = serving.run_forecast(none, area_labels(spark), "2001-01-01")
    assert mode == tag == "demo_seed" and out.count() == 3128 * 16
    assert EPOCH.year == 2000
