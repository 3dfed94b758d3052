"""Projections of the given tables to the engine's input shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.session import prepare

SNAP_DAYS = 7  # weekly, over the catalog's whole span
ISSUES = ("1998-01-01", 14, 91)  # start, number and distance in days of the dates that evaluation scores forecasts at
AS_OF = "2001-07-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event catalog projected from ``orders`` by integer arithmetic."""
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 97
    base = table(spark, sf_dir, "orders").select(
        k.alias("k"),
        F.expr("timestampadd(SECOND, cast((o_orderkey*7919) % 86400 as int), cast(o_orderdate as timestamp))").alias("time"),
        ((F.lit(-11000) + c * 7001 % 15500 + (k * 7919) % 1501) / 1e3).alias("lat"),
        ((F.lit(95000) + c * 10007 % 44500 + (k * 104729) % 1501) / 1e3).alias("lon"),
        ((k * 31) % 700).cast("double").alias("depth"),
        (40 + F.floor(F.lit(-1e1) * F.log10(((k * 37) % 9973 + F.lit(0.5)) / F.lit(9973.0))).cast("int")).alias("m10"),
    )
    agency = lambda n: F.element_at(
        F.array(F.lit("usgs"), F.lit("emsc"), F.lit("bmkg")), (n % 3).cast("int") + 1)
    first = F.struct((F.col("k") * 2).alias("event_key"), F.col("time"), F.col("lat"),
                     F.col("m10").alias("m"), agency(F.col("k")).alias("source"))
    again = F.struct((F.col("k") * 2 + 1).alias("event_key"),
                     F.expr("timestampadd(SECOND, cast(20 + k % 60 as int), time)").alias("time"),
                     (F.col("lat") + F.lit(0.05)).alias("lat"),
                     (F.col("m10") - F.col("k") % 2).cast("int").alias("m"),
                     agency(F.col("k") + 1).alias("source"))
    reports = F.when(F.col("k") % 5 == 0, F.array(first, again)).otherwise(F.array(first))
    return base.withColumn("e", F.explode(reports)).select(
        F.col("e.event_key").alias("event_key"),
        F.concat_ws("_", "e.source", F.col("e.event_key").cast("string")).alias("event_id"),
        F.col("e.time").alias("time"), F.col("e.lat").alias("lat"), "lon", "depth",
        (F.col("e.m") / 1e1).alias("magnitude"),
        F.lit(None).cast("string").alias("mag_type"),
        F.col("e.source").alias("source"), F.lit(None).cast("string").alias("place"),
    )


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table with a real timestamp."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
