"""Completeness magnitude, b-value and quiescence per group.

Magnitudes are binned in integer tenths, so bin edges carry no float error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions.geo import macro_region

LOG10_E = math.log10(math.e)


def _tenths(mag: Column) -> Column:
    return F.bround(mag * 10, 0).cast("int")


def _fullest(b: str = "b", n: str = "n") -> Column:
    """Most populated bin; the lowest bin wins ties."""
    return F.max(F.struct(F.col(n).alias("n"), (-F.col(b)).alias("nb")))


def mc_lookup(events: DataFrame) -> DataFrame:
    """Mc per macro region and five-year epoch: centre of the fullest tenth plus 0.2 (30+ events)."""
    year = F.year("time")
    start = (F.floor((year - K.EPOCH_START) / K.EPOCH_YEARS) * K.EPOCH_YEARS + K.EPOCH_START).cast("int")
    hist = events.where((year >= K.EPOCH_START) & (year < K.EPOCH_END)).select(
        macro_region(F.col("lat"), F.col("lon")).alias("region"), start.alias("epoch_start"), _tenths(F.col("magnitude")).alias("b")
    ).where("region is not null").groupBy("region", "epoch_start", "b").agg(F.count("*").alias("n"))
    return hist.groupBy("region", "epoch_start").agg(F.sum("n").alias("total"), _fullest().alias("m")).where("total >= 30").select(
        "region", "epoch_start", (F.col("epoch_start") + K.EPOCH_YEARS).alias("epoch_end"),
        ((-F.col("m.nb") * 2 + 1) / 20.0 + 0.2).alias("mc"))


def with_mc(points: DataFrame, table: DataFrame, when: Column, default: float = K.DEFAULT_MC) -> DataFrame:
    """Mc of each row's region and epoch (the table has at most 36 rows)."""
    region = macro_region(F.col("lat"), F.col("lon"))
    start = (F.floor((F.year(when) - K.EPOCH_START) / K.EPOCH_YEARS) * K.EPOCH_YEARS + K.EPOCH_START).cast("int")
    keyed = points.withColumns({"_region": region, "_epoch": start})
    small = F.broadcast(table.select(F.col("region").alias("_region"), F.col("epoch_start").alias("_epoch"), F.col("mc")))
    return keyed.join(small, ["_region", "_epoch"], "left").withColumn("mc", F.coalesce("mc", F.lit(default))).drop("_region", "_epoch")


def mc_left_edge(events: DataFrame, keys: list[str], min_events: int = 50) -> DataFrame:
    """Left edge of the fullest tenth per group; NULL under 50 events.

    The last bin is closed on both sides, so the largest tenth counts into the bin below.
    """
    hist = events.where(F.col("magnitude").isNotNull() & ~F.isnan("magnitude")).groupBy(
        *keys, _tenths(F.col("magnitude")).alias("b")).agg(F.count("*").alias("n"))
    ends = hist.groupBy(*keys).agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.sum("n").alias("total"))
    folded = hist.join(ends, keys).withColumn("b", F.when((F.col("b") == F.col("hi")) & (F.col("hi") > F.col("lo")), F.col("b") - 1).otherwise(F.col("b")))
    return folded.groupBy(*keys, "b", "lo", "hi", "total").agg(F.sum("n").alias("n")).groupBy(*keys, "lo", "hi", "total").agg(
        _fullest().alias("m")).select(*keys, F.when((F.col("total") >= min_events) & (F.col("hi") > F.col("lo")), -F.col("m.nb") / 10.0).alias("mc"))


def b_values(events: DataFrame, keys: list[str], mc: float, default: float = 1.0, min_events: int = 50) -> DataFrame:
    """Maximum-likelihood b per group, without bin correction."""
    above = F.when(F.col("magnitude") >= mc, F.col("magnitude"))
    return events.groupBy(*keys).agg(F.count(above).alias("n"), F.avg(above).alias("m")).select(
        *keys, F.when((F.col("n") >= min_events) & (F.col("m") > mc), F.try_divide(F.lit(LOG10_E), F.col("m") - mc)).otherwise(default).alias("b_value"))


def quiescence(events: DataFrame, keys: list[str], snapshot: str, test_days: int = 365, reference_days: int = 1825,
               min_events: int = 30) -> DataFrame:
    """Z of the reference rate against the test rate, from 30-day bin counts.

    Bin means and variances come from sums of counts and squared counts, so empty bins
    need no spine; only whole bins count, the last one closed on the right.
    """
    day = 86400
    snap = F.unix_seconds(F.lit(snapshot).cast("timestamp"))
    age = F.unix_seconds("time") - snap
    n_ref, n_test = (reference_days - test_days) // 30, test_days // 30
    is_test = age >= -test_days * day
    since = F.when(is_test, age + test_days * day).otherwise(age + reference_days * day)
    total = F.when(is_test, F.lit(n_test)).otherwise(F.lit(n_ref))
    bin_no = F.floor(since / (30 * day))
    bin_no = F.when((bin_no == total) & (since == total * 30 * day), total - 1).otherwise(bin_no)
    per_bin = events.where((age >= -reference_days * day) & (age <= 0)).groupBy(
        *keys, is_test.alias("is_test"), bin_no.alias("bin"), (bin_no < total).alias("whole")).agg(F.count("*").alias("n"))
    ref, test = ~F.col("is_test"), F.col("is_test")
    s = per_bin.groupBy(*keys).agg(
        F.sum(F.when(ref, F.col("n"))).alias("ref_all"),
        *[F.coalesce(F.sum(F.when(c & F.col("whole"), F.col("n") * (F.col("n") if sq else F.lit(1)))), F.lit(0)).alias(name)
          for c, sq, name in ((ref, False, "r1"), (ref, True, "r2"), (test, False, "t1"), (test, True, "t2"))])
    var = lambda s1, s2, n: (F.col(s2) - F.col(s1) * F.col(s1) / n) / (n - 1)
    denom = F.sqrt(var("r1", "r2", n_ref) / n_ref + var("t1", "t2", n_test) / n_test)
    z = F.try_divide(F.col("r1") / n_ref - F.col("t1") / n_test, denom)
    return s.select(*keys, F.when(F.coalesce("ref_all", F.lit(0)) < min_events, 0.0).otherwise(F.coalesce(z, F.lit(0.0))).alias("z_value"))
