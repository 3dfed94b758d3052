"""Weekly window sums against plain pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import frame
from tremorlake import constants as K
from tremorlake.operators import features as X
from tremorlake.operators import labels as L
from tremorlake.operators.catalog_stats import mc_lookup, with_mc
from tremorlake.operators.grid import with_cell_no

DAY = pd.Timedelta(days=1)


def catalog():
    """Four years over a change of epoch: one hot cell, midnights, repeated rows, missing and NaN depths, one giant."""
    rng = np.random.default_rng(5)
    n = 900
    day = rng.integers(0, 1400, n)
    sec = np.where(rng.random(n) < 0.2, 0, rng.integers(0, 86400, n))
    df = pd.DataFrame({
        "event_id": [f"e{i}" for i in range(n)], "time": [pd.Timestamp("1998-03-05") + int(d) * DAY + pd.Timedelta(seconds=int(s)) for d, s in zip(day, sec)],
        "lat": 0.1 + 0.5 * rng.choice([0, 0, 0, 1, 2], n), "lon": 120.1, "depth": np.round(rng.uniform(1, 90, n), 3),
        "magnitude": np.round(3.5 + rng.exponential(0.5, n) + np.where(day > 700, 0.6, 0), 1), "mag_type": "mb", "source": "usgs", "place": "x"})
    df.loc[3, "time"] = pd.Timestamp("1998-03-05 06:00:00")
    df.loc[7, "magnitude"] = 9.1
    df = pd.concat([df, df.iloc[:30].assign(event_id=[f"c{i}" for i in range(30)])], ignore_index=True)
    df["missing"] = np.where(rng.random(len(df)) < 0.02, np.where(rng.random(len(df)) < 0.5, 1, 2), 0)
    return df


@pytest.fixture(scope="module")
def data(spark):
    df = catalog()
    depth = F.when(F.col("missing") == 1, F.lit(None)).when(F.col("missing") == 2, F.lit(float("nan"))).otherwise(F.col("depth"))
    ev = with_cell_no(frame(spark, df)).withColumn("depth", depth).checkpoint()
    return df, ev, X.Snapshots.over(ev)


def test_series_covers_the_catalog(spark, data):
    df, ev, snaps = data
    last = df["time"].max()
    assert (snaps.start, snaps.every) == ("1998-03-05", 7)
    end = pd.Timestamp(snaps.start) + (snaps.count - 1) * 7 * DAY
    assert end <= last < end + 7 * DAY
    assert sum(b - a for _, a, b in snaps.epochs()) == snaps.count and [e for e, _, _ in snaps.epochs()] == [1995, 2000]
    none = X.Snapshots.over(ev.limit(0))
    assert none.count == 0 and X.build_features(ev.limit(0), none).count() == 0 and L.build_labels(ev.limit(0), none).count() == 0


@pytest.mark.parametrize("every", [7, 91, 10])
def test_windows_match_plain_sums(spark, data, every):
    df, ev, weekly = data
    snaps = X.Snapshots.over(ev, every)
    table = mc_lookup(ev)
    got = X.window_stats(X.daily(ev, snaps), table, snaps).toPandas().set_index(["cell_no", "k"]).sort_index()
    mc = with_mc(X.snapshot_times(spark, snaps).withColumns({"lat": F.lit(0.25), "lon": F.lit(120.25)}), table, F.col("snapshot")).toPandas().set_index("k")["mc"]
    assert every != 7 or mc.nunique() > 1
    cells = {r.event_id: r.cell_no for r in ev.select("event_id", "cell_no").collect()}
    df = df.assign(cell_no=df["event_id"].map(cells))
    seen = 0
    for cell, part in df.groupby("cell_no"):
        for k in range(snaps.count):
            at = pd.Timestamp(snaps.start) + k * every * DAY
            w = {d: part[(part["time"] <= at) & (part["time"] >= at - d * DAY)] for d in (30, 84, 90, 365, 1095)}
            if not len(w[1095]):
                assert (cell, k) not in got.index
                continue
            seen += 1
            row = got.loc[(cell, k)]
            assert [row[f"event_count_{d}d"] for d in (30, 90, 365)] == [len(w[d]) for d in (30, 90, 365)]
            assert [row[f"max_mag_{d}d"] for d in (30, 90)] == [w[d]["magnitude"].max() if len(w[d]) else 0 for d in (30, 90)]
            energy = {d: (10 ** (K.ENERGY_SLOPE * w[d]["magnitude"] + K.ENERGY_SHIFT)).sum() for d in (30, 365)}
            assert row["log_energy_30d"] == pytest.approx(np.log10(energy[30]) if len(w[30]) else 0, abs=1e-8)
            assert row["moment_release_ratio_30d_vs_365d"] == pytest.approx(energy[30] / energy[365] if len(w[30]) else 0, rel=1e-7)
            known = w[30]["depth"].where(w[30]["missing"] == 0)
            if len(w[30]) and known.isna().any():
                assert np.isnan(row["mean_depth_30d"])
            elif len(w[30]):
                assert row["mean_depth_30d"] == pytest.approx(known.mean()) and row["std_depth_30d"] == pytest.approx(known.std(ddof=0), abs=1e-5)
            for d in (90, 365, 1095):
                m = w[d]["magnitude"][w[d]["magnitude"] >= mc[k]]
                assert row[f"b_value_{d}d"] == pytest.approx(np.log10(np.e) / (m.mean() - (mc[k] - 0.05)) if len(m) >= 5 else 1.0)
            if len(w[365]):
                assert [row["t0"], row["t1"]] == [w[365]["time"].min().timestamp(), w[365]["time"].max().timestamp()]
            else:
                assert np.isnan(row["t0"]) and np.isnan(row["t1"])
            week = np.minimum(11, (w[84]["time"] - (at - 84 * DAY)) // (7 * DAY))
            assert row["activity_trend_90d"] == pytest.approx((week - 5.5).sum() / 143 if len(w[90]) >= 5 and len(w[84]) else 0)
    assert seen == len(got) > 40


def test_slopes_are_plain_and_copy_no_event_to_its_snapshots(spark, data, monkeypatch):
    df, ev, snaps = data
    real, reached = X.Snapshots.covering, []
    monkeypatch.setattr(X.Snapshots, "covering", lambda self, slot, back: reached.append(back) or real(self, slot, back))
    stats = X.window_stats(X.daily(ev, snaps), mc_lookup(ev), snaps).checkpoint()
    reached.clear()
    got = {(r.cell_no, r.k): r.b_value_slope_1y for r in X.b_slopes(ev, stats, snaps).collect()}
    assert not reached
    cells = ev.select("event_id", "cell_no").toPandas().set_index("event_id").cell_no
    rows = df.assign(cell_no=df["event_id"].map(cells), s=df["time"].map(lambda t: int(t.timestamp())))
    mcs, want = {(r.cell_no, r.k): r.mc for r in stats.collect()}, {}
    for k in range(snaps.count):
        at = pd.Timestamp(snaps.start) + 7 * k * DAY
        for cell, g in rows[(rows.time <= at) & (rows.time >= at - 365 * DAY)].groupby("cell_no"):
            t0, t1, found = g.s.min(), g.s.max(), []
            for w in range(4) if len(g) > 50 and t1 - t0 >= 180 * 86400 else ():
                a, b = t0 + w * 7_776_000, t0 + (w + 1) * 7_776_000
                sub = g[(g.s >= a) & (g.s <= b)]
                up = sub[sub.magnitude >= mcs[cell, k]].magnitude
                if b <= t1 and len(sub) >= 10 and len(up) >= 5:
                    found.append((w * 90.0, np.log10(np.e) / (up.mean() - (mcs[cell, k] - 0.05))))
            if len(found) >= 3:
                want[cell, k] = np.polyfit(*zip(*found), 1)[0]
    assert len(want) > 100 and set(got) == set(want)
    assert all(got[x] == pytest.approx(v, abs=1e-9) for x, v in want.items())


def test_copies_to_cells_around_are_summed_where_they_are_made(spark, data):
    """No shuffle between the copying of a cell's week to the cells around it and the sums of these."""
    _, ev, snaps = data
    lines = X.short_term(ev, snaps)._jdf.queryExecution().executedPlan().toString().splitlines()
    copies = [i for i, line in enumerate(lines) if "BroadcastHashJoin" in line and "cell_no" in line]
    assert copies
    for i in copies:
        above = lines[:i][::-1]
        sums = [n for n, line in enumerate(above) if "HashAggregate" in line or "SortAggregate" in line]
        assert not [line for line in above[:sums[1]] if "Exchange" in line]
