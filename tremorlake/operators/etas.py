"""Aftershock point process: likelihood, bounded fit, rate field and forecasts.

The likelihood needs, at every event, the decayed sum over all earlier events. The
power law (t + c)^-p is written as a sum of about a hundred exponentials (trapezoid rule
on its Laplace form, relative error under 1e-10), and exponential sums carry forward in
one number each. So the O(N^2) pair sum becomes one ordered scan: each range partition
sums its own events, a small table carries the sums on, and no pairs are built.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions.geo import haversine_km
from tremorlake.functions.heads import with_heads
from tremorlake.operators.scan import ranged
from tremorlake.session import inline

PARAMS = ("mu", "k", "c", "p", "alpha")
_BLOCK = 256
_NEAR = 64  #: events that meet pair by pair before the exponentials take over


def exponentials(c: float, p: float, span: float, step: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Decay rates and weights with sum(w * exp(-s * x)) = x^-p for x in [c, c + span]."""
    low = -math.log(span + c) - 28.0 / p
    high = math.log(36.0 / c)
    u = np.arange(low, high + step, step)
    return np.exp(u), step * np.exp(p * u) / math.gamma(p)


def history(events: DataFrame, start: str, end: str, mc: float = K.ETAS_MC) -> DataFrame:
    """Events of the window with time in days since its start."""
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return events.where(F.col("time").between(a, b) & (F.col("magnitude") >= mc)).select(
        "event_id", ((F.unix_micros("time") - F.unix_micros(a)) / 86400e6).alias("t"), F.col("magnitude").alias("m"), "lat", "lon")


def window_length(spark, start: str, end: str) -> float:
    return spark.sql(f"select (unix_micros(timestamp'{end}') - unix_micros(timestamp'{start}')) / 86400e6 as d").first()["d"]


def log_likelihoods(past: DataFrame, t_end: float, candidates: list[dict], mc: float = K.ETAS_MC, chunk_rows: int = 50_000) -> DataFrame:
    """Log-likelihood of every candidate, all in the same two passes over the catalog.

    Powers and exponentials depend on c and p alone; candidates that differ in alpha share them.
    """
    spark = past.sparkSession
    shapes = sorted({(q["c"], q["p"], q["alpha"]) for q in candidates})
    nodes = [exponentials(c, p, t_end) for c, p, _ in shapes]
    decays = [[j for j, x in enumerate(shapes) if x[:2] == d] for d in sorted({x[:2] for x in shapes})]
    members = [[(i, q["mu"], q["k"]) for i, q in enumerate(candidates) if (q["c"], q["p"], q["alpha"]) == s] for s in shapes]
    n = past.count()
    if n == 0:
        return inline(spark, [(i, float(-q["mu"] * t_end)) for i, q in enumerate(candidates)], "candidate, loglik")
    rows = ranged(past.select("event_id", "t", "m"), ["t", "event_id"], max(1, -(-n // chunk_rows)))

    def summarise(key, g: pd.DataFrame) -> pd.DataFrame:
        t, m = g["t"].to_numpy(), g["m"].to_numpy()
        out = []
        for js in decays:
            s = nodes[js[0]][0]
            weight, total = np.exp(np.outer([shapes[j][2] for j in js], m - mc)), np.zeros((len(js), len(s)))
            for a in range(0, len(t), _BLOCK):
                total += weight[:, a:a + _BLOCK] @ np.exp(-np.outer(t.max() - t[a:a + _BLOCK], s))
            out += [(int(key[0]), j, float(t.max()), x.tolist()) for j, x in zip(js, total)]
        return pd.DataFrame(out, columns=["part", "shape", "t_last", "total"])

    sums = rows.groupBy("part").applyInPandas(summarise, "part int, shape int, t_last double, total array<double>")

    def carry(key, g: pd.DataFrame) -> pd.DataFrame:
        """State handed to each partition, one row per partition of the catalog."""
        s = nodes[int(key[0])][0]
        g = g.sort_values("part")
        state, at, out = np.zeros(len(s)), float(g["t_last"].iloc[0]), []
        for part, t_last, total in zip(g["part"], g["t_last"], g["total"]):
            out.append((int(part), int(key[0]), at, state.tolist()))
            state, at = state * np.exp(-s * (t_last - at)) + np.asarray(total), float(t_last)
        return pd.DataFrame(out, columns=["part", "shape", "at", "state"])

    carried = sums.groupBy("shape").applyInPandas(carry, "part int, shape int, at double, state array<double>")

    def score(key, g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["t", "event_id"])
        t, m = g["t"].to_numpy(), g["m"].to_numpy()
        out = []
        first = dict(zip(c["shape"], c["state"]))
        for js in decays:
            cc, p, _ = shapes[js[0]]
            s, w = nodes[js[0]]
            weight, at = np.exp(np.outer([shapes[j][2] for j in js], m - mc)), float(min(c["at"].iloc[0], t[0]))
            state, before = np.array([first[j] for j in js]), np.empty((len(js), len(t)))
            for a in range(0, len(t), _NEAR):
                tb, gb = t[a:a + _NEAR], weight[:, a:a + _NEAR]
                own = gb @ np.tril((np.abs(tb[:, None] - tb[None, :]) + cc) ** -p, -1).T
                older = (w * state) @ np.exp(-np.outer(tb - at + cc, s)).T
                before[:, a:a + _NEAR] = own + older
                state = state * np.exp(-s * (tb[-1] - at)) + gb @ np.exp(-np.outer(tb[-1] - tb, s))
                at = float(tb[-1])
            left = t_end - t
            if abs(p - 1.0) < 1e-9:
                mass = np.log((left + cc) / max(cc, K.ETAS_EPS))
            else:
                mass = ((left + cc) ** (1 - p) - cc ** (1 - p)) / (1 - p)
            mass = (weight * mass)[:, t < t_end].sum(axis=1)
            for n, j in enumerate(js):
                for i, mu, k in members[j]:
                    logs = float(np.sum(np.log(np.maximum(mu + k * before[n], K.ETAS_EPS))))
                    out.append((i, logs - k * float(mass[n])))
        return pd.DataFrame(out, columns=["candidate", "ll"])

    parts = rows.groupBy("part").cogroup(carried.groupBy("part")).applyInPandas(score, "candidate int, ll double")
    mus = inline(spark, [(i, q["mu"] * t_end) for i, q in enumerate(candidates)], "candidate, background")
    return parts.groupBy("candidate").agg(F.sum("ll").alias("ll")).join(F.broadcast(mus), "candidate").select(
        "candidate", (F.col("ll") - F.col("background")).alias("loglik"))


def around(best: dict, factor: float) -> list[dict]:
    """Candidates below, at and above each parameter, held inside the bounds."""
    axes = []
    for name, low, high in K.ETAS_BOUNDS:
        step = factor if name in ("mu", "k", "c") else 1 + (factor - 1) / 10
        axes.append(sorted({min(max(best[name] * f, low), high) for f in (1 / step, 1.0, step)}))
    return [dict(zip(PARAMS, v)) for v in product(*axes)]


def fit(past: DataFrame, t_end: float, mc: float = K.ETAS_MC, factors=(4.0, 2.0, 1.4)) -> tuple[dict, float]:
    """Best candidate of a bounded grid that is refined around its own maximum."""
    if past.isEmpty():
        return dict(K.ETAS_EMPTY), -dict(K.ETAS_EMPTY)["mu"] * t_end
    best, loglik = dict(K.ETAS_START), -math.inf
    for factor in factors:
        grid = around(best, factor)
        top = log_likelihoods(past, t_end, grid, mc).agg(F.max(F.struct("loglik", (-F.col("candidate")).alias("i"))).alias("b")).select("b.*").first()
        best, loglik = grid[-top["i"]], top["loglik"]
    return best, loglik


def _strength(age: Column, params: dict, mc: float) -> Column:
    """K * productivity * decay of one past event at the given age in days."""
    return params["k"] * F.exp(params["alpha"] * (F.col("m") - mc)) * F.pow(age + params["c"], F.lit(-params["p"]))


def _kernel(dist: Column, mc: float) -> Column:
    d = K.ETAS_D0 * F.exp(K.ETAS_GAMMA * (F.col("m") - mc))
    return (K.ETAS_Q - 1) / (math.pi * d * d) * F.pow(1 + F.pow(dist / d, 2), F.lit(-K.ETAS_Q))


def rate_field(past: DataFrame, t_query: float, params: dict, mc: float = K.ETAS_MC) -> DataFrame:
    """Events per km^2 and day in every cell at the query time.

    Each event adds to all 3,128 cells (the kernel has no edge). A task keeps one sum per
    cell and adds its events block by block, so no pairs leave it and the shuffle carries
    3,128 rows per task; cost is linear in events. The cell centre is the one written in
    its id, at tenths of a degree.
    """
    names = ["t", "m", "lat", "lon"]

    def unit(lat, lon):
        a, b = np.radians(lat), np.radians(lon)
        return np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, col = np.divmod(np.arange(K.N_CELLS), K.N_LON)
        centre = unit(np.round((K.LAT_MIN + K.STEP / 2 + row * K.STEP) * 10) / 10, np.round((K.LON_MIN + K.STEP / 2 + col * K.STEP) * 10) / 10)
        total = np.zeros(K.N_CELLS)
        for batch in batches:
            for a in range(0, len(batch), _BLOCK):
                g = batch.iloc[a:a + _BLOCK]
                over = g["m"].to_numpy() - mc
                strength = params["k"] * np.exp(params["alpha"] * over) * (t_query - g["t"].to_numpy() + params["c"]) ** -params["p"]
                d = K.ETAS_D0 * np.exp(K.ETAS_GAMMA * over)
                chord2 = sum((e[:, None] - c[None, :]) ** 2 for e, c in zip(unit(g["lat"].to_numpy(), g["lon"].to_numpy()), centre))
                dist = 2 * K.EARTH_RADIUS_KM * np.arcsin(np.minimum(np.sqrt(chord2) / 2, 1.0))
                kernel = ((K.ETAS_Q - 1) / (math.pi * d * d))[:, None] * (1 + (dist / d[:, None]) ** 2) ** -K.ETAS_Q
                total += np.minimum(strength[:, None] * kernel, K.EVENT_RATE_CAP).sum(axis=0)
        yield pd.DataFrame({"cell_no": np.arange(K.N_CELLS, dtype="int32"), "triggered": total})

    sums = past.where(F.col("t") < t_query).select(*names).mapInPandas(add, "cell_no int, triggered double").groupBy("cell_no").agg(
        F.sum("triggered").alias("triggered"))
    base = past.sparkSession.range(K.N_CELLS).select(F.col("id").cast("int").alias("cell_no"))
    return base.join(sums, "cell_no", "left").select(
        "cell_no", (F.coalesce("triggered", F.lit(0.0)) + params["mu"] / K.STUDY_AREA_KM2).alias("rate"))


def forecast(field: DataFrame, mc: float = K.ETAS_MC, b_value: DataFrame | float = 1.0, area: float = K.CELL_AREA_KM2) -> DataFrame:
    """P(at least one event) per head; b may differ by cell (missing cells take 1)."""
    if isinstance(b_value, DataFrame):
        field = field.join(b_value.select("cell_no", F.col("b_value").alias("b")), "cell_no", "left").withColumn("b", F.coalesce("b", F.lit(1.0)))
    else:
        field = field.withColumn("b", F.lit(float(b_value)))
    scale = F.pow(F.lit(10.0), -F.col("b") * (F.col("mag_threshold") - mc))
    p = 1 - F.exp(-F.col("rate") * area * scale * F.col("horizon_days"))
    return with_heads(field).select("cell_no", "horizon_days", "mag_threshold", F.greatest(F.lit(0.0), F.least(p, F.lit(1.0))).alias("p"))


def decay_check(events: DataFrame, references: DataFrame, params: dict, mc: float = K.ETAS_MC, years: int = 5, days: int = 60) -> DataFrame:
    """Decay exponent of the modelled daily rate after each reference event.

    ``references(name, time, lat, lon)`` is a short list; each takes the five years up
    to and including its own time.
    """
    ref = F.broadcast(references.select("name", F.col("time").alias("r_time"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")))
    since = F.col("r_time") - F.make_interval(days=F.lit(365 * years))
    past = events.join(ref, F.col("time").between(since, F.col("r_time"))).withColumns({
        "m": F.col("magnitude"), "age0": (F.unix_micros("r_time") - F.unix_micros("time")) / 86400e6,
        "dist": haversine_km(F.col("r_lat"), F.col("r_lon"), F.col("lat"), F.col("lon"))})
    daily = past.withColumn("w", _kernel(F.col("dist"), mc)).withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days)))).groupBy("name", "day").agg(
        F.sum(F.least(_strength(F.col("age0") + F.col("day"), params, mc) * F.col("w"), F.lit(K.EVENT_RATE_CAP))).alias("s"))
    rates = daily.select("name", "day", ((F.col("s") + params["mu"] / K.STUDY_AREA_KM2) * K.CELL_AREA_KM2).alias("rate"))
    fit_ = rates.where("rate > 0").groupBy("name").agg(F.count("*").alias("n"), F.regr_slope(F.log10("rate"), F.log10("day")).alias("slope"))
    return fit_.where("n >= 5").select("name", (-F.col("slope")).alias("p_estimate"), F.col("slope").between(-1.5, -0.8).alias("in_range"))


__all__ = ["decay_check", "fit", "forecast", "history", "log_likelihoods", "rate_field"]
