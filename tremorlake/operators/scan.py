"""Ordered work over whole tables without a single-task window.

Rows are sorted into range partitions on a unique order and written to the checkpoint
folder, so that the partition number of a row is fixed even if executors are lost.
Each partition is then handled on its own, with a small table of carries between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.session import scratch_root, shuffle_width


def ranged(df: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """Sorted range partitions with their number in column ``part``."""
    scratch_root(df.sparkSession)
    width = parts or shuffle_width(df.sparkSession)
    return df.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).checkpoint()


def running_totals(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Add, per key, the sum over all strictly earlier rows (``order`` unique inside a key).

    ``values`` maps a new column to the column that is summed.
    """
    r = ranged(df, [*keys, *order])
    totals = r.groupBy("part", *keys).agg(*[F.sum(v).alias(f"_t_{k}") for k, v in values.items()])
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("part", *keys, *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_c_{k}") for k in values])
    inside = Window.partitionBy("part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return r.join(carry, ["part", *keys]).withColumns({
        k: F.col(f"_c_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in values.items()
    }).drop("part", *[f"_c_{k}" for k in values])


def global_position(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Zero-based position of each row in a total order."""
    return running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), [], order, {name: "_one"}).drop("_one")
