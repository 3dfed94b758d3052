"""Blend of two learners with the Poisson baseline, calibration and compression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.operators.priors import clip

HEAD = ["horizon_days", "mag_threshold"]


def logit(p: Column, eps: float) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def compress(df: DataFrame, rates: DataFrame, groups: list[str]) -> DataFrame:
    """Rank-preserving logit compression of ``p`` so that its median meets the base rate.

    ``groups`` are the head columns (and the run, if several); a group is one map of the
    grid, so its exact median is over at most 3,128 scores.
    """
    e = K.COMPRESS_EPS
    raw = clip(F.col("p"), e, 1 - e)
    shape = df.groupBy(*groups).agg(F.percentile(raw, F.lit(0.5)).alias("med"), F.min(logit(F.col("p"), e)).alias("lo"), F.max(logit(F.col("p"), e)).alias("hi"))
    joined = df.join(F.broadcast(shape), groups).join(F.broadcast(rates), HEAD, "left")
    base = F.coalesce("base_rate", F.lit(K.COMPRESS_DEFAULT_RATE))
    target = logit(F.greatest(base, F.lit(e)), e)
    top = logit(F.least(base * K.COMPRESS_RATIO, F.lit(K.COMPRESS_MAX)), e)
    span = F.col("hi") - F.col("lo")
    slope = F.greatest(F.least(F.try_divide((top - target) * 2, span), F.lit(1.0)), F.lit(K.COMPRESS_MIN_SLOPE))
    moved = clip(sigmoid(slope * logit(F.col("p"), e) + target - slope * logit(F.col("med"), e)), e, 1 - e)
    return joined.withColumn("p", F.when(span < e, base).otherwise(moved)).drop("med", "lo", "hi", "base_rate")


def calibrated(p: Column) -> Column:
    """Apply the head's stored calibrator: columns kind, a, b, c and, for isotonic, xs/ys."""
    eps = K.PROB_FLOOR
    q = clip(p, eps, 1 - eps)
    platt = sigmoid(F.col("a") * logit(p, eps) + F.col("c"))
    beta = sigmoid(F.col("a") * F.ln(q) + F.col("b") * F.ln(1 - q) + F.col("c"))
    # piecewise-linear between the stored knots, flat outside them
    below = F.size(F.filter("xs", lambda x: x <= p))
    i = F.greatest(F.lit(1), F.least(below, F.size("xs") - 1))
    x0, x1, y0, y1 = (F.element_at("xs", i), F.element_at("xs", i + 1), F.element_at("ys", i), F.element_at("ys", i + 1))
    line = y0 + (y1 - y0) * clip(F.coalesce(F.try_divide(p - x0, x1 - x0), F.lit(0.0)), 0.0, 1.0)
    iso = F.when(F.size("xs") == 1, F.element_at("ys", 1)).otherwise(line)
    return (F.when(F.col("kind") == "platt", platt).when(F.col("kind") == "beta", beta)
            .when(F.col("kind") == "isotonic", clip(iso, eps, 1 - eps)).otherwise(q))


def blend(scores: DataFrame, poisson: DataFrame, calibrators: DataFrame, rates: DataFrame, evidence: DataFrame | None,
          keys: list[str], weights=K.BLEND_WEIGHTS, alpha: float = K.BLEND_ALPHA) -> DataFrame:
    """Weighted blend, per-head calibration, compression of uncalibrated heads, and a
    Bayesian pull to the Poisson prior weighed by the cell's event count.

    ``scores(keys, cell_no, head, p1, p2)``; ``poisson(cell_no, head, prior)``.
    """
    w1, w2, w3 = weights
    df = scores.join(poisson, ["cell_no", *HEAD], "left").withColumn("prior", F.nanvl(F.coalesce("prior", F.lit(0.0)), F.lit(0.0)))
    df = df.withColumn("p", (w1 * F.coalesce("p1", F.lit(0.0)) + w2 * F.coalesce("p2", F.lit(0.0)) + w3 * F.col("prior")) / (w1 + w2 + w3))
    df = df.join(F.broadcast(calibrators), HEAD).withColumn("p", calibrated(F.col("p"))).select(
        *keys, "cell_no", *HEAD, "prior", "p", "kind").dropDuplicates([*keys, "cell_no", *HEAD])
    plain = compress(df.where("kind = 'identity'"), rates, [*keys, *HEAD])
    df = df.where("kind <> 'identity'").unionByName(plain)
    if evidence is None:
        n = F.lit(K.BLEND_DEFAULT_EVIDENCE)
    else:
        df = df.join(F.broadcast(evidence), "cell_no", "left")
        n = F.greatest(F.coalesce("n_evidence", F.lit(0)).cast("double"), F.lit(1.0))
    pulled = F.when(F.col("prior") > 0, (n * F.col("p") + alpha * F.col("prior")) / (n + alpha)).otherwise(F.col("p"))
    return df.select(*keys, "cell_no", *HEAD, clip(pulled, K.PROB_FLOOR, 1 - K.PROB_FLOOR).alias("p"))
