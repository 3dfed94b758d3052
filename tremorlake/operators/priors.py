"""Poisson baseline, priors, caps, shrinkage and monotone probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions.heads import HEADS, by_threshold, head_name, with_heads
from tremorlake.session import inline

_KEYS = ["run", "cell_no", "horizon_days", "mag_threshold"]


def run_windows(spark: SparkSession, windows: list[tuple[str, str, str]]) -> DataFrame:
    """Observation windows, one per run: (run, start, end) as text."""
    rows = [(i, *w) for i, w in enumerate(windows)]
    df = inline(spark, rows, "pos, run, win_start, win_end")
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("win_start", "win_end")}).withColumn(
        "days", F.greatest(F.lit(1.0), (F.unix_micros("win_end") - F.unix_micros("win_start")) / 86400e6))


def poisson_counts(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events per run, cell and threshold, in one pass over the catalog.

    ``events`` needs cell_no, time and magnitude. Every event meets the few windows
    that cover it; counts combine before the shuffle, so a hot cell costs one row per
    task.
    """
    spans = windows.select("run", "win_start", "win_end")
    hit = events.select("cell_no", "time", "magnitude").where("cell_no is not null").join(
        F.broadcast(spans), F.col("time").between(F.col("win_start"), F.col("win_end")))
    return hit.groupBy("run", "cell_no").agg(*[
        F.count_if(F.col("magnitude") >= t).alias(f"n_{i}") for i, t in enumerate(K.THRESHOLDS)])


def poisson_forecast(events: DataFrame, windows: DataFrame, n_windows: int = 1) -> DataFrame:
    """P(at least one event) for every run, cell and head: 1 - exp(-rate * horizon).

    Cells without history take a weak share of the catalog-wide rate.
    """
    spark = events.sparkSession
    counts = poisson_counts(events, windows)
    totals = counts.groupBy("run").agg(*[F.sum(f"n_{i}").alias(f"g_{i}") for i in range(len(K.THRESHOLDS))])
    base = spark.range(K.N_CELLS * n_windows).select(
        (F.col("id") % K.N_CELLS).cast("int").alias("cell_no"), F.floor(F.col("id") / K.N_CELLS).cast("int").alias("pos"))
    joined = (base.join(F.broadcast(windows), "pos").join(counts, ["run", "cell_no"], "left")
              .join(F.broadcast(totals), "run", "left"))
    rate = lambda i: F.coalesce(
        F.nullif(F.col(f"n_{i}"), F.lit(0)) / F.col("days"),
        (F.coalesce(F.col(f"g_{i}"), F.lit(0)) + 1) / (K.N_CELLS * F.col("days")) * K.EMPTY_CELL_BACKOFF)
    heads = F.array(*[
        F.struct(F.lit(h).alias("horizon_days"), F.lit(t).alias("mag_threshold"),
                 (1 - F.exp(-rate(K.THRESHOLDS.index(t)) * h)).alias("p"))
        for h, t in HEADS])
    return joined.select("run", "cell_no", F.inline(heads))


def base_rates(events: DataFrame, n_cells: int = K.N_CELLS) -> DataFrame:
    """Catalog-wide P per head; published fallback rates where the catalog is empty."""
    span = (F.unix_micros(F.max("time")) - F.unix_micros(F.min("time"))) / 86400e6
    stats = events.agg(
        F.greatest(F.lit(1.0), span).alias("days"), F.count("*").alias("n"),
        *[F.count_if(F.col("magnitude") >= t).alias(f"n_{i}") for i, t in enumerate(K.THRESHOLDS)])
    lam = by_index("n_") / (n_cells * F.col("days"))
    fallback = K.FALLBACK_ANNUAL * F.exp(-(F.col("mag_threshold") - 4.5) / K.FALLBACK_DECAY) / 365.0
    rate = F.when(F.col("n") == 0, fallback).otherwise(lam)
    return with_heads(stats).select(
        "horizon_days", "mag_threshold",
        F.greatest(1 - F.exp(-rate * F.col("horizon_days")), F.lit(K.RATE_FLOOR)).alias("base_rate"))


def by_index(prefix: str) -> Column:
    chain = F
    for i, t in enumerate(K.THRESHOLDS):
        chain = chain.when(F.col("mag_threshold") == t, F.col(f"{prefix}{i}"))
    return chain


def fallback_rates(df: DataFrame) -> DataFrame:
    """Published fallback P per head beside each row."""
    rate = K.FALLBACK_ANNUAL * F.exp(-(F.col("mag_threshold") - 4.5) / K.FALLBACK_DECAY) / 365.0
    return with_heads(df).withColumn("fallback_rate", F.greatest(
        1 - F.exp(-rate * F.col("horizon_days")), F.lit(K.RATE_FLOOR)))


def _kind_factor(factors) -> Column:
    kind = F.lower("fault_type")
    return F.when(kind == "subduction", factors[0]).when(kind == "transform", factors[1]).otherwise(factors[2])


def demo_prior(areas: DataFrame) -> DataFrame:
    """Fault-distance prior used when there is no catalog."""
    near = F.coalesce(F.nullif("nearest_fault_km", F.lit(0.0)), F.lit(K.DEMO_MISSING_KM))
    annual = K.DEMO_ANNUAL * F.pow(F.lit(10.0), -(F.col("mag_threshold") - 4.5))
    rate = annual * (F.col("horizon_days") / 365.0) * F.exp(-near / K.DEMO_EFOLD_KM) * _kind_factor(K.DEMO_FACTORS)
    return with_heads(areas).select("cell_no", "horizon_days", "mag_threshold",
                                    F.least(1 - F.exp(-rate), F.lit(K.DEMO_CAP)).alias("p"))


def tectonic_prior(areas: DataFrame) -> DataFrame:
    """Conservative prior from fault distance and type, slab depth and position."""
    near = F.coalesce(F.nullif("nearest_fault_km", F.lit(0.0)), F.lit(K.TECTONIC_MISSING_KM))
    hazard = ((0.25 + 0.75 * F.exp(-near / K.TECTONIC_EFOLD_KM)) * _kind_factor(K.TECTONIC_FACTORS)
              * F.when(F.col("slab_depth_km") <= 80.0, 1.10).otherwise(1.0)
              * F.when(F.col("is_offshore"), 0.95).otherwise(1.0))
    rate = by_threshold(F.col("mag_threshold"), K.TECTONIC_ANNUAL, 0.01) * hazard
    p = 1 - F.exp(-rate * (F.col("horizon_days") / 365.0))
    return with_heads(areas).select("cell_no", "horizon_days", "mag_threshold",
                                    F.greatest(F.lit(K.PROB_FLOOR), F.least(p, F.lit(K.TECTONIC_CAP))).alias("p"))


def clip(value: Column, low: float, high) -> Column:
    return F.greatest(F.lit(low), F.least(value, high if isinstance(high, Column) else F.lit(high)))


def smoothed(recent: Column, long_term: Column, horizon: Column, weight: float = K.SMOOTH_LONG_WEIGHT) -> Column:
    """Mix recent and long-term probabilities in rate space."""
    rate = lambda p: -F.log1p(-clip(p, 1e-9, 1 - 1e-9)) / horizon
    return 1 - F.exp(-((1 - weight) * rate(recent) + weight * rate(long_term)) * horizon)


def display_cap(horizon: Column, threshold: Column) -> Column:
    base = by_threshold(threshold, K.CAP_30D, 0.20)
    return F.least(1 - F.exp(F.log1p(-base) * (horizon / 30.0)), F.lit(K.CAP_OVERALL))


def shrink(predictions: DataFrame, recent: DataFrame, long_term: DataFrame, areas: DataFrame) -> DataFrame:
    """Blend model probabilities with the three priors and cap the result.

    All inputs are long frames keyed by run, cell and head; ``tectonic`` has no run.
    """
    tectonic = tectonic_prior(areas).withColumnRenamed("p", "p_tect")
    df = (predictions.withColumnRenamed("p", "p_model")
          .join(recent.withColumnRenamed("p", "p_recent"), _KEYS)
          .join(long_term.withColumnRenamed("p", "p_long"), _KEYS)
          .join(F.broadcast(tectonic), _KEYS[1:], "left"))
    h, t = F.col("horizon_days"), F.col("mag_threshold")
    w = [by_threshold(t, [(row[0], row[i]) for row in K.SHRINK_WEIGHTS], K.SHRINK_WEIGHTS[-1][i]) for i in range(1, 5)]
    mixed = (w[0] * clip(F.col("p_model"), K.PROB_FLOOR, 1 - K.PROB_FLOOR) + w[1] * F.col("p_recent")
             + w[2] * smoothed(F.col("p_recent"), F.col("p_long"), h)
             + w[3] * F.coalesce("p_tect", "p_long"))
    return df.select(*_KEYS, clip(mixed, K.PROB_FLOOR, display_cap(h, t)).alias("p"), F.col("p_model").alias("raw"))


def monotone(df: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """Running maxima: up with the horizon, then up as the threshold falls (long shape)."""
    across_h = Window.partitionBy(*keys, "mag_threshold").orderBy("horizon_days").rowsBetween(Window.unboundedPreceding, 0)
    across_t = Window.partitionBy(*keys, "horizon_days").orderBy(F.desc("mag_threshold")).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({v: F.max(v).over(across_h) for v in values})
    return df.withColumns({v: F.max(v).over(across_t) for v in values})


def monotone_wide(df: DataFrame) -> DataFrame:
    """The same rule on wide head columns, as plain maxima without a shuffle."""
    def dominated(h, t):
        return [F.col(head_name(a, b)) for a in K.HORIZONS if a <= h for b in K.THRESHOLDS if b >= t]

    return df.withColumns({
        head_name(h, t): F.greatest(*d) if len(d := dominated(h, t)) > 1 else d[0] for h, t in HEADS})


def evidence(events: DataFrame) -> DataFrame:
    """Events of M 4.5 and more per cell."""
    return events.where((F.col("magnitude") >= 4.5) & F.col("cell_no").isNotNull()).groupBy("cell_no").agg(
        F.count("*").alias("n_evidence"))
