"""Forecast scores and consistency tests, all heads at once.

Input is a long frame: head columns, ``y`` (0/1) and ``p`` (and baselines). Rows are
condensed to distinct scores per head first; every ordered metric works on that table
through range partitions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.operators.priors import clip
from tremorlake.operators.scan import ranged, running_totals

HEAD = ["horizon_days", "mag_threshold"]


PART_SCORES = 4000  #: distinct scores drawn in one task (times the simulations: its matrix)


def align(labels: DataFrame, predictions: DataFrame, keys: list[str], baselines: dict[str, DataFrame]) -> DataFrame:
    """Labels with prediction (0.5 if absent) and baselines per cell or per head (0.05 if absent).

    Both keys, cell and snapshot, are used when the predictions carry them; one key
    alone would multiply rows.
    """
    out = labels.join(predictions, [*keys, *HEAD], "left").withColumn("p", F.coalesce("p", F.lit(K.PRED_FILL)))
    for name, base in baselines.items():
        on = [c for c in ("cell_no", *HEAD) if c in base.columns]
        out = out.join(base.withColumnRenamed("p", name), on, "left").withColumn(name, F.coalesce(name, F.lit(K.BASELINE_FILL)))
    return out


def by_score(df: DataFrame) -> DataFrame:
    """Rows and positives per distinct score."""
    return df.groupBy(*HEAD, "p").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))


def _gain(y: Column, p: Column, b: Column, eps: float = 1e-9) -> Column:
    pm, pb = clip(p, eps, 1 - eps), clip(b, eps, 1 - eps)
    return (F.when(y == 1, F.ln(pm) - F.ln(pb)).otherwise(F.ln(1 - pm) - F.ln(1 - pb))) / math.log(2.0)


def scores(df: DataFrame, baselines: list[str]) -> DataFrame:
    """Brier, skill and information gain (bits per row) per head, in one pass."""
    aggs = [F.count("*").alias("n"), F.sum("y").cast("bigint").alias("positives"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier")]
    for b in baselines:
        aggs += [F.avg(F.pow(F.col(b) - F.col("y"), 2)).alias(f"_{b}"), F.avg(_gain(F.col("y"), F.col("p"), F.col(b))).alias(f"info_gain_vs_{b}")]
    out = df.groupBy(*HEAD).agg(*aggs)
    for b in baselines:
        out = out.withColumn(f"bss_vs_{b}", 1 - F.col("brier") / F.greatest(F.col(f"_{b}"), F.lit(1e-9))).drop(f"_{b}")
    return out


def roc_auc(df: DataFrame) -> DataFrame:
    """Exact area under the ROC curve with ties averaged; NULL for a single class."""
    g = by_score(df).withColumn("neg", F.col("n") - F.col("pos"))
    ranked = running_totals(g, HEAD, ["p"], {"neg_below": "neg"})
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    return ranked.groupBy(*HEAD).agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    number = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*HEAD, number.alias("bin")).agg(
        F.avg("p").alias("predicted_mean"), F.avg("y").alias("observed_freq"), F.count("*").alias("n")
    ).withColumn("bin_center", (F.col("bin") + 0.5) / bins)


def roc_curve(df: DataFrame, points: int = 50) -> DataFrame:
    """ROC points from high to low score, straight stretches removed, thinned by index."""
    g = by_score(df).withColumns({"neg": F.col("n") - F.col("pos"), "np": -F.col("p"), "one": F.lit(1).cast("bigint")})
    cum = running_totals(g, HEAD, ["np"], {"i": "one", "tp0": "pos", "fp0": "neg"}).checkpoint()
    after = cum.select(*HEAD, (F.col("i") - 1).alias("i"), F.col("pos").alias("pos2"), F.col("neg").alias("neg2"))
    totals = cum.groupBy(*HEAD).agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    corner = cum.join(after, [*HEAD, "i"], "left").where(
        F.col("pos2").isNull() | (F.col("pos2") != F.col("pos")) | (F.col("neg2") != F.col("neg")) | (F.col("i") == 0))
    kept = running_totals(corner.select(*HEAD, "np", "one", (F.col("tp0") + F.col("pos")).alias("tps"), (F.col("fp0") + F.col("neg")).alias("fps")),
                          HEAD, ["np"], {"j": "one"})
    kept = kept.withColumn("j", F.col("j") + 1)  # point 0 is the origin
    size = kept.groupBy(*HEAD).agg((F.max("j") + 1).alias("m"))
    last = F.col("m") - 1
    wanted = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda s: F.floor(s * (last / float(points - 1))))
    listed = F.when(F.col("m") > points, F.array_distinct(wanted)).otherwise(F.sequence(F.lit(0).cast("bigint"), last))
    spine = size.withColumn("j", F.explode(listed)).join(totals, HEAD).where("tp > 0 and fp > 0")
    return spine.join(kept, [*HEAD, "j"], "left").select(
        *HEAD, "j", F.coalesce(F.col("fps") / F.col("fp"), F.lit(0.0)).alias("fpr"), F.coalesce(F.col("tps") / F.col("tp"), F.lit(0.0)).alias("tpr"))


def molchan(df: DataFrame, points: int = 50) -> DataFrame:
    """Alarm fraction and miss rate over score thresholds (or 50 percentiles), plus one above all."""
    g = running_totals(by_score(df), HEAD, ["p"], {"before": "n"}).checkpoint()
    t = g.groupBy(*HEAD).agg(F.sum("n").alias("total"), F.sum("pos").alias("events"), F.count("*").alias("distinct"))
    at = g.join(F.broadcast(t.where(F.col("distinct") > points)), HEAD)
    place = lambda j: (F.col("total") - 1) * (j / float(points - 1))
    seq = F.sequence(F.lit(0), F.lit(points - 1))

    def holding(index):
        """Percentile numbers whose order statistic lies inside this score."""
        hit = F.filter(seq, lambda j: (index(j) >= F.col("before")) & (index(j) < F.col("before") + F.col("n")))
        return at.select(*HEAD, "total", "p", F.explode(hit).alias("j"))

    low = holding(lambda j: F.floor(place(j)))
    high = holding(lambda j: F.least(F.ceil(place(j)), F.col("total") - 1)).select(*HEAD, "j", F.col("p").alias("p_hi"))
    part = place(F.col("j")) - F.floor(place(F.col("j")))
    perc = low.join(high, [*HEAD, "j"]).select(*HEAD, (F.col("p") + (F.col("p_hi") - F.col("p")) * part).alias("th"))
    few = g.join(F.broadcast(t.where(F.col("distinct") <= points)), HEAD).select(*HEAD, F.col("p").alias("th"))
    ths = perc.unionByName(few).distinct().unionByName(t.select(*HEAD, F.lit(1.01).alias("th")))
    lists = ths.groupBy(*HEAD).agg(F.collect_list("th").alias("ths"))  # at most points + 1 per head
    hits = g.join(F.broadcast(lists), HEAD).withColumn("th", F.explode("ths")).groupBy(*HEAD, "th").agg(
        F.sum(F.when(F.col("p") >= F.col("th"), F.col("n"))).alias("alarms"), F.sum(F.when(F.col("p") >= F.col("th"), F.col("pos"))).alias("hits"))
    return hits.join(F.broadcast(t), HEAD).where("events > 0").select(
        *HEAD, F.col("th").alias("threshold"), (F.coalesce("alarms", F.lit(0)) / F.col("total")).alias("tau"),
        (1 - F.coalesce("hits", F.lit(0)) / F.col("events")).alias("nu"))


def _poisson_cdf(n: Column, lam: Column) -> Column:
    """P(X <= n), summed in log space over the terms that are not negligible."""
    start = F.greatest(F.lit(0.0), F.floor(lam - 40 * F.sqrt(lam) - 50))
    x = start + 1
    stirling = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    first = F.when(start == 0, -lam).otherwise(start * F.ln(lam) - lam - stirling)
    last = F.least(n, F.ceil(lam + 40 * F.sqrt(lam) + 50))  # beyond, nothing is left to add
    steps = F.when(last >= start + 1, F.sequence((start + 1).cast("bigint"), last.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, F.struct(first.alias("t"), F.exp(first).alias("s")),
                        lambda a, k: F.struct((a["t"] + F.ln(lam) - F.ln(k.cast("double"))).alias("t"),
                                              (a["s"] + F.exp(a["t"] + F.ln(lam) - F.ln(k.cast("double")))).alias("s")))["s"]
    return F.when(n < start, 0.0).otherwise(F.least(total, F.lit(1.0)))


def n_test(df: DataFrame) -> DataFrame:
    g = df.groupBy(*HEAD).agg(F.sum("y").cast("bigint").alias("observed"), F.sum("p").alias("predicted"))
    some = F.col("predicted") > 0
    low = F.when(some, _poisson_cdf(F.col("observed"), F.col("predicted"))).otherwise(0.0)
    high = F.when(~some, 0.0).when(F.col("observed") > 0, 1 - _poisson_cdf(F.col("observed") - 1, F.col("predicted"))).otherwise(1.0)
    return g.withColumns({"p_value_low": low, "p_value_high": high}).withColumn(
        "status", F.when((F.col("p_value_low") >= K.TEST_LOW) & (F.col("p_value_high") >= K.TEST_LOW), "pass").otherwise("fail"))


def observed_likelihoods(df: DataFrame) -> DataFrame:
    """Observed joint and spatial log-likelihood per head."""
    p = clip(F.col("p"), 1e-7, 1 - 1e-7)
    total = df.groupBy(*HEAD).agg(F.sum("p").alias("sum_p"), F.sum("y").alias("events"))
    w = clip(F.col("p") / F.col("sum_p"), 1e-9, 1.0)
    return df.join(F.broadcast(total), HEAD).groupBy(*HEAD).agg(
        F.sum(F.when(F.col("y") == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("joint_ll"),
        F.sum(F.when(F.col("y") == 1, F.ln(w)).otherwise(0.0)).alias("spatial_ll"))


def _verdict(sims: DataFrame, observed: DataFrame, name: str) -> DataFrame:
    g = sims.join(F.broadcast(observed), HEAD).groupBy(*HEAD).agg(
        F.first("observed_ll").alias("observed_ll"), F.avg("ll").alias("mean_sim_ll"),
        F.avg((F.col("ll") <= F.col("observed_ll")).cast("double")).alias("quantile"))
    return g.withColumns({"test": F.lit(name), "status": F.when(F.col("quantile").between(K.TEST_LOW, K.TEST_HIGH), "pass").otherwise("fail")})


def l_test(df: DataFrame, n_sim: int = K.N_SIMULATIONS) -> DataFrame:
    """Joint likelihood against resampled catalogs.

    Rows with the same score are exchangeable, so a catalog draws one binomial count
    per distinct score; seeds come from the score, so results do not depend on
    partitioning.
    """
    groups = by_score(df).select(*HEAD, "p", "n")

    def draw(batches):
        for batch in batches:
            for (h, t), g in batch.groupby(HEAD):
                total = np.zeros(n_sim)
                for p, n in zip(g["p"], g["n"]):
                    q = min(max(p, 1e-7), 1 - 1e-7)
                    rng = np.random.default_rng([42, int(h), int(t * 100), np.float64(p).view(np.uint64) & 0x7FFFFFFF])
                    hits = rng.binomial(n, min(max(p, 0.0), 1.0), n_sim)
                    total += hits * math.log(q) + (n - hits) * math.log(1 - q)
                yield pd.DataFrame({"horizon_days": int(h), "mag_threshold": float(t), "sim": np.arange(n_sim), "ll": total})

    sims = groups.mapInPandas(draw, "horizon_days int, mag_threshold double, sim int, ll double").groupBy(*HEAD, "sim").agg(F.sum("ll").alias("ll"))
    obs = observed_likelihoods(df).select(*HEAD, F.col("joint_ll").alias("observed_ll"))
    return _verdict(sims, obs, "l_test")


def s_test(df: DataFrame, n_sim: int = K.N_SIMULATIONS) -> DataFrame:
    """Spatial likelihood against draws of the observed number of events.

    The multinomial draw is split in two exact steps: counts per range partition, then
    counts per score inside each partition, of about PART_SCORES scores.
    """
    scores = by_score(df).select(*HEAD, "p", "n").where("p > 0").checkpoint()
    groups = ranged(scores, [*HEAD, "p"], max(1, -(-scores.count() // PART_SCORES)))
    total = df.groupBy(*HEAD).agg(F.sum("p").alias("sum_p"), F.sum("y").cast("bigint").alias("events")).where("events > 0 and sum_p > 0")
    shares = groups.groupBy(*HEAD, "part").agg(F.sum(F.col("p") * F.col("n")).alias("w")).join(F.broadcast(total), HEAD)

    def over_parts(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("part")
        rng = np.random.default_rng([43, int(g["horizon_days"].iloc[0]), int(g["mag_threshold"].iloc[0] * 100)])
        drawn = rng.multinomial(int(g["events"].iloc[0]), (g["w"] / g["w"].sum()).to_numpy(), n_sim)
        return pd.DataFrame([(int(h), float(t), int(part), float(s), drawn[:, i].tolist()) for i, (h, t, part, s) in enumerate(
            zip(g["horizon_days"], g["mag_threshold"], g["part"], g["sum_p"]))], columns=[*HEAD, "part", "sum_p", "counts"])

    counts = shares.groupBy(*HEAD).applyInPandas(over_parts, "horizon_days int, mag_threshold double, part int, sum_p double, counts array<bigint>")

    def inside(key, g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(c):
            return pd.DataFrame(columns=[*HEAD, "sim", "ll"])
        g = g.sort_values("p")
        w = (g["p"] * g["n"]).to_numpy()
        log_w = np.log(np.clip(g["p"].to_numpy() / c["sum_p"].iloc[0], 1e-9, 1.0))
        rng = np.random.default_rng([44, int(key[0]), int(key[1] * 100), int(key[2])])
        drawn = rng.multinomial(np.asarray(c["counts"].iloc[0]), w / w.sum())
        return pd.DataFrame({"horizon_days": int(key[0]), "mag_threshold": float(key[1]), "sim": np.arange(n_sim), "ll": drawn @ log_w})

    keys = [*HEAD, "part"]
    sims = groups.groupBy(*keys).cogroup(counts.groupBy(*keys)).applyInPandas(
        inside, "horizon_days int, mag_threshold double, sim int, ll double").groupBy(*HEAD, "sim").agg(F.sum("ll").alias("ll"))
    obs = observed_likelihoods(df).select(*HEAD, F.col("spatial_ll").alias("observed_ll"))
    return _verdict(sims, obs, "s_test")


def consistency_tests(df: DataFrame, n_sim: int = K.N_SIMULATIONS) -> DataFrame:
    n = n_test(df).select(*HEAD, F.lit("n_test").alias("test"), "status", F.col("observed").cast("double").alias("observed_ll"),
                          F.col("predicted").alias("mean_sim_ll"), F.col("p_value_low").alias("quantile"))
    return n.unionByName(l_test(df, n_sim)).unionByName(s_test(df, n_sim))


def evaluate(df: DataFrame, baselines: list[str]) -> DataFrame:
    """One row of metrics per head."""
    return scores(df, baselines).join(roc_auc(df), HEAD).join(n_test(df).select(*HEAD, "predicted", "p_value_low", "p_value_high", "status"), HEAD)


__all__ = ["align", "consistency_tests", "evaluate"]
