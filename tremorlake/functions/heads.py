"""The 16 (horizon, threshold) forecast heads: names, wide and long shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake import constants as K

HEADS = tuple((h, t) for h in K.HORIZONS for t in K.THRESHOLDS)


def check_head(horizon: int, threshold: float) -> None:
    if horizon not in K.HORIZONS:
        raise ValueError(f"horizon must be one of {K.HORIZONS}")
    if threshold not in K.THRESHOLDS:
        raise ValueError(f"threshold must be one of {K.THRESHOLDS}")


def head_name(horizon: int, threshold: float) -> str:
    """``label_h{H}_m{M*10}``; hundredths where the threshold is no tenth."""
    tenths = round(threshold * 10)
    if abs(threshold - tenths / 10) < 1e-6:
        return f"label_h{int(horizon)}_m{tenths:02d}"
    return f"label_h{int(horizon)}_m{round(threshold * 100):03d}"


def head_columns() -> list[str]:
    return [head_name(h, t) for h, t in HEADS]


def each_head() -> Column:
    """Generator: one row per head, as struct(horizon_days, mag_threshold)."""
    return F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon_days"), F.lit(t).alias("mag_threshold")) for h, t in HEADS
    ]))


def with_heads(df: DataFrame) -> DataFrame:
    return df.withColumn("_head", each_head()).select("*", "_head.*").drop("_head")


def by_threshold(threshold: Column, pairs, default=None) -> Column:
    """Look a constant up by threshold."""
    chain = None
    for key, value in pairs:
        test = threshold == F.lit(float(key))
        chain = F.when(test, F.lit(value)) if chain is None else chain.when(test, F.lit(value))
    return chain if default is None else chain.otherwise(F.lit(default))


def to_long(df: DataFrame, keys: list[str], value: str = "probability", prefix: str = "") -> DataFrame:
    """Wide head columns to one row per head."""
    entries = F.array(*[
        F.struct(F.lit(h).alias("horizon_days"), F.lit(t).alias("mag_threshold"),
                 F.col(prefix + head_name(h, t)).cast("double").alias(value))
        for h, t in HEADS
    ])
    return df.select(*keys, F.inline(entries))


def to_wide(df: DataFrame, keys: list[str], value: str = "probability") -> DataFrame:
    """One row per head to wide head columns; one grouped pass, no pivot lookup job."""
    return df.groupBy(*keys).agg(*[
        F.max(F.when((F.col("horizon_days") == h) & (F.col("mag_threshold") == t), F.col(value)))
        .alias(head_name(h, t)) for h, t in HEADS
    ])
