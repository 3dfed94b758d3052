import math

import numpy as np
import pandas as pd
import pytest

from tests.helpers import EPOCH, frame, km, swarm
from tremorlake.operators import decluster, dedup, graph

ORDER = {"usgs": 0, "emsc": 1, "bmkg": 2}
SCORE = {"bmkg": 3, "usgs": 2, "emsc": 1}


def greedy_filter(df):
    kept = []
    rows = sorted(df.itertuples(), key=lambda r: (ORDER.get(r.source, 9), r.time, r.event_id))
    for r in rows:
        if not any(abs((r.time - k.time).total_seconds()) <= 60 and abs(r.lat - k.lat) <= 0.5 and abs(r.lon - k.lon) <= 0.5
                   and abs(r.magnitude - k.magnitude) <= 0.5 for k in kept):
            kept.append(r)
    return {k.event_id for k in kept}


def greedy_clusters(df, seconds, radius, mag, by_score):
    groups, member = [], {}
    for r in sorted(df.itertuples(), key=lambda r: (r.time, -r.magnitude, r.event_id)):
        hit = next((g for g in groups if abs((r.time - g["rep"].time).total_seconds()) <= seconds
                    and km(r.lat, r.lon, g["rep"].lat, g["rep"].lon) <= radius
                    and (mag is None or abs(r.magnitude - g["rep"].magnitude) <= mag)), None)
        if hit is None:
            groups.append({"rep": r, "seed": r.event_id})
            member[r.event_id] = r.event_id
            continue
        member[r.event_id] = hit["seed"]
        better = by_score and r.magnitude == hit["rep"].magnitude and SCORE[r.source] > SCORE[hit["rep"].source]
        if r.magnitude > hit["rep"].magnitude or better:
            hit["rep"] = r
    return member, {g["seed"]: g["rep"].event_id for g in groups}


@pytest.mark.parametrize("minutes,spread", [(600, 0.6), (20, 0.3), (5, 0.9)])
def test_filter_equals_sequential_rule(spark, minutes, spread):
    df = swarm(400, seed=minutes, minutes=minutes, spread=spread)
    got = {r.event_id for r in dedup.kept_events(frame(spark, df)).collect()}
    assert got == greedy_filter(df)


@pytest.mark.parametrize("limits", [(600, 100.0, 0.5, True), (900, 120.0, None, False)])
@pytest.mark.parametrize("chunk", [40, 50_000])
def test_clusters_equal_sequential_rule(spark, limits, chunk):
    """Small chunks force several hand-overs through one long chain of reports."""
    df = swarm(250, seed=3, minutes=240, spread=1.5)
    expect, reps = greedy_clusters(df, *limits)
    members = dedup.leader_clusters(frame(spark, df), *limits[:3], by_score=limits[3], chunk_rows=chunk)
    assert {r.event_id: r.seed for r in members.collect()} == expect
    canon = {r.seed: r.magnitude for r in dedup.canonical_events(frame(spark, df), members, limits[3]).collect()}
    size = df.set_index("event_id").magnitude
    assert canon == {s: size[e] for s, e in reps.items()}


def sequential_decluster(df):
    rows = sorted(df.itertuples(), key=lambda r: (r.time, r.event_id))
    cluster, main, nxt = {r.event_id: -1 for r in rows}, {r.event_id: True for r in rows}, 0
    for i, r in enumerate(rows):
        for p in reversed(rows[:i]):
            days = (int(r.time.timestamp()) - int(p.time.timestamp())) / 86400
            tau = max(1.0, min(10 ** (0.43 * p.magnitude - 0.06), 1825.0))
            if days > tau or p.magnitude <= r.magnitude:
                continue
            if km(r.lat, r.lon, p.lat, p.lon) <= 10 * 10 ** (-2.44 + 0.59 * p.magnitude) / 2:
                main[r.event_id] = False
                if cluster[p.event_id] == -1:
                    cluster[p.event_id], nxt = nxt, nxt + 1
                cluster[r.event_id] = cluster[p.event_id]
                break
    return main, cluster


def test_decluster_equals_sequential_rule(spark):
    df = swarm(300, seed=9, minutes=400_000, spread=0.8)
    main, cluster = sequential_decluster(df)
    got = decluster.decluster(frame(spark, df)).collect()
    assert {r.event_id: r.is_mainshock for r in got} == main
    assert {r.event_id: r.cluster_id for r in got} == cluster
    assert max(cluster.values()) > 3


def test_aftershock_sequence(spark):
    rows = [("m", 0, 0.0, 6.5), ("a", 1, 0.05, 5.0), ("b", 2, 0.02, 4.5), ("c", 4, 0.01, 4.2), ("far", 3, 5.0, 6.0)]
    df = pd.DataFrame([{"event_id": i, "time": EPOCH + pd.Timedelta(days=d), "lat": lat, "lon": 120.0, "depth": 1.0, "magnitude": m,
                        "mag_type": "mb", "source": "usgs", "place": "x"} for i, d, lat, m in rows])
    got = {r.event_id: (r.is_mainshock, r.cluster_id) for r in decluster.decluster(frame(spark, df)).collect()}
    assert got == {"m": (True, 0), "a": (False, 0), "b": (False, 0), "c": (False, 0), "far": (True, -1)}


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(2000, 2001), (2001, 2002), (2002, 2000), (5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1300), 1000), **dict.fromkeys(range(2000, 2003), 2000)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_bounded_components_lump_long_paths_only(spark):
    paths = [(i, i + 1) for i in range(10, 400)] + [(i, i + 1) for i in range(500, 900)]
    edges = paths + [(1000, i) for i in range(1001, 1300)] + [(2000, 2001), (2001, 2002)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long"), 2).collect()}
    long = dict.fromkeys([*range(10, 401), *range(500, 901)], 10)
    assert got == {**long, **dict.fromkeys(range(1000, 1300), 1000), **dict.fromkeys(range(2000, 2003), 2000)}


def test_clusters_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    """Reports that follow each other for days are one chain of buckets; it runs in stretches of time."""
    calls = []
    real = graph._small_star
    monkeypatch.setattr(graph, "_small_star", lambda e: calls.append(1) or real(e))
    df = swarm(400, seed=11, minutes=12_000, spread=1.5)
    expect, _ = greedy_clusters(df, 600, 100.0, 0.5, True)
    assert {r.event_id: r.seed for r in dedup.leader_clusters(frame(spark, df), chunk_rows=60).collect()} == expect
    before = len(calls)
    chain = [(i, i + 1) for i in range(3000)]
    graph.components(spark.createDataFrame(chain, "u long, v long"), dedup._STAR_ROUNDS)
    assert before <= dedup._STAR_ROUNDS and len(calls) - before == dedup._STAR_ROUNDS


def test_dense_swarm_settles_in_few_rounds(spark):
    """One component cut in many stretches: the number of rounds does not follow the number of stretches."""
    fold = dedup._fold(600, 100.0, 0.5, True)
    rounds = []
    for n in (300, 1200):
        df = swarm(n, seed=n, minutes=n, spread=1.0)
        base = frame(spark, df).selectExpr("event_id", "unix_micros(time) as t", "lat", "lon", "magnitude as mag",
                                           "map('bmkg', 3, 'usgs', 2, 'emsc', 1)[source] as score", "-magnitude as nm")
        units = dedup._units(base, 600, 100.0, 60).checkpoint()
        found, counts = dedup._settle(units, fold)
        expect, _ = greedy_clusters(df, 600, 100.0, 0.5, True)
        got = {r.event_id: r.seed for r in found.collect()}
        assert got == {e: expect[e] for e in got} and len(got) > 0.9 * n
        assert counts[0] >= n // 60 and sum(counts) <= 4 * counts[0]
        rounds.append(len(counts))
    assert max(rounds) <= 6


def test_decluster_of_one_crowded_bucket(spark, monkeypatch):
    """All events within reach of each other: short shells go first, the parents are the same."""
    df = swarm(1500, seed=4, minutes=300, spread=0.012)
    shells = []
    real = decluster._candidates
    monkeypatch.setattr(decluster, "_candidates", lambda *a: shells.append(a[3:]) or real(*a))
    got = {r.event_id: (r.is_mainshock, r.cluster_id) for r in decluster.decluster(frame(spark, df)).collect()}
    main, cluster = sequential_decluster(df)
    assert got == {e: (main[e], cluster[e]) for e in main}
    assert shells[0][1] < 43_200


def test_a_dense_catalog_spends_no_star_rounds(spark, monkeypatch):
    """More links than buckets: one chain from the start, cut in time; the clusters are those of the sequential rule."""
    calls = []
    real = graph._small_star
    monkeypatch.setattr(graph, "_small_star", lambda e: calls.append(1) or real(e))
    df = swarm(500, seed=12, minutes=3_000, spread=6.0)
    expect, _ = greedy_clusters(df, 600, 100.0, 0.5, True)
    assert {r.event_id: r.seed for r in dedup.leader_clusters(frame(spark, df), chunk_rows=70).collect()} == expect
    dense = swarm(500, seed=13, minutes=200, spread=3.0)
    expect, _ = greedy_clusters(dense, 600, 100.0, 0.5, True)
    calls.clear()
    assert {r.event_id: r.seed for r in dedup.leader_clusters(frame(spark, dense), chunk_rows=70).collect()} == expect
    assert not calls


@pytest.mark.parametrize("lat,lon", [(0.0, 120.0), (70.0, 120.0), (-40.0, 180.0), (89.5, 0.0)])
def test_a_row_meets_near_clusters_only(monkeypatch, lat, lon):
    """Reports of one hour over a wide region: few distances a row, and the clusters of the sequential rule at any place."""
    rng, n = np.random.default_rng(6), 1500
    df = pd.DataFrame({"event_id": [f"e{i:04d}" for i in range(n)], "t": np.sort(rng.integers(0, 3600, n)) * 1_000_000, "lat": np.clip(lat + rng.uniform(-15, 15, n), -90, 90),
                       "lon": (lon + rng.uniform(-20, 20, n) + 180) % 360 - 180, "mag": np.round(4 + rng.exponential(0.4, n), 1)})
    plain = df.assign(time=pd.Timestamp("2000-01-01") + pd.to_timedelta(df.t, unit="us"), magnitude=df.mag, source="usgs")
    expect, _ = greedy_clusters(plain, 600, 100.0, 0.5, True)
    calls, real = [], math.atan2
    monkeypatch.setattr(math, "atan2", lambda a, b: calls.append(1) or real(a, b))
    out = dedup._fold(600, 100.0, 0.5, True)(df.assign(nm=-df.mag, score=2, unit="0", part=0), pd.DataFrame(columns=dedup._STATE_NAMES))
    assert dict(out[out.kind == "m"][["event_id", "seed"]].to_numpy().tolist()) == expect
    assert 0 < len(calls) < (10 if (lat, lon) == (0.0, 120.0) else 60) * n
