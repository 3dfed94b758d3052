"""Labels, dataset join, positive rates and time splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions.heads import HEADS, head_columns, head_name
from tremorlake.operators.features import KEY, Snapshots
from tremorlake.operators.grid import cells, neighbors
from tremorlake.operators.scan import global_position


def build_labels(events: DataFrame, snaps: Snapshots) -> DataFrame:
    """16 labels per cell and snapshot: an event of M >= t in the cell or one of its
    eight nearest cells within (snapshot, snapshot + h].

    Only the largest magnitude per (cell, slot) matters, then per (cell, snapshot,
    horizon); the copy to neighbouring cells comes last.
    """
    spark = events.sparkSession
    peak = events.where("cell_no is not null").groupBy("cell_no", snaps.slot(F.col("time")).alias("slot")).agg(F.max("magnitude").alias("m"))
    step = 2 * snaps.every
    first = F.greatest(F.lit(0), F.ceil((F.col("slot") - 2 * max(K.HORIZONS)) / step).cast("int"))
    last = F.least(F.lit(snaps.count - 1), F.floor((F.col("slot") - 1) / step).cast("int"))
    ahead = F.col("slot") - F.col("k") * step
    per_cell = peak.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)))).groupBy(*KEY).agg(*[
        F.max(F.when(ahead <= 2 * h, F.col("m"))).alias(f"m{h}") for h in K.HORIZONS])
    near = neighbors(spark).select("cell_no", "other_no").unionByName(
        cells(spark).select("cell_no", F.col("cell_no").alias("other_no"))).toDF("target", "cell_no")
    spread = per_cell.join(F.broadcast(near), "cell_no").groupBy(F.col("target").alias("cell_no"), "k").agg(*[
        F.max(f"m{h}").alias(f"m{h}") for h in K.HORIZONS])
    return snaps.frame(spark).join(spread, KEY, "left").select(*KEY, snaps.at(F.col("k")).alias("snapshot"), *[
        F.coalesce((F.col(f"m{h}") >= t).cast("int"), F.lit(0)).alias(head_name(h, t)) for h, t in HEADS])


def join_dataset(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join on both keys, cell and snapshot."""
    return features.join(labels.drop("snapshot"), KEY)


def positive_rates(dataset: DataFrame) -> DataFrame:
    return dataset.agg(*[F.avg(c).alias(c) for c in head_columns() if c in dataset.columns])


def _year_end(year: int) -> Column:
    return F.lit(f"{year}-12-31 23:59:00").cast("timestamp")


def _split(train_end: Column, val_end: Column, purge_days: int) -> Column:
    gap = F.make_interval(days=F.lit(purge_days))
    s = F.col("snapshot")
    return (F.when(s <= train_end, "train").when((s > train_end + gap) & (s <= val_end), "val")
            .when(s > val_end + gap, "test"))


def time_split(dataset: DataFrame, train_end_year: int = 2020, val_end_year: int = 2021, purge_days: int = max(K.HORIZONS),
               order: list[str] | None = None) -> DataFrame:
    """Add ``split``; rows inside a purge gap get NULL.

    Year limits first; if train or validation would be empty, the years before the
    last; if still empty, the 60 and 80 percent order statistics of time (by position
    where even these do not separate).
    """
    by_year = dataset.withColumn("split", _split(_year_end(train_end_year), _year_end(val_end_year), purge_days))
    filled = lambda df: df.agg(F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") == "val").alias("b"),
                               F.min(F.year("snapshot")).alias("lo"), F.max(F.year("snapshot")).alias("hi"), F.count("*").alias("n")).first()
    seen = filled(by_year)
    if seen["n"] == 0 or (seen["a"] and seen["b"]):
        return by_year
    if seen["hi"] - seen["lo"] >= 2:
        by_year = dataset.withColumn("split", _split(_year_end(seen["hi"] - 2), _year_end(seen["hi"] - 1), purge_days))
        again = filled(by_year)
        if again["a"] and again["b"]:
            return by_year
    n, i1, i2 = seen["n"], int(seen["n"] * 0.6), int(seen["n"] * 0.8)
    per_time = dataset.groupBy("snapshot").agg(F.count("*").alias("c"))
    if i1 > 0 and i1 < i2 < n:
        from tremorlake.operators.scan import running_totals
        upto = running_totals(per_time, [], ["snapshot"], {"before": "c"})
        t1, t2 = upto.agg(F.max(F.when(F.col("before") <= i1, F.col("snapshot"))).cast("string").alias("t1"),
                          F.max(F.when(F.col("before") <= i2, F.col("snapshot"))).cast("string").alias("t2")).first()
        return dataset.withColumn("split", _split(F.lit(t1).cast("timestamp"), F.lit(t2).cast("timestamp"), purge_days))
    placed = global_position(dataset, order or ["snapshot", "cell_no"])
    return placed.withColumn("split", F.when(F.col("pos") < i1, "train").when(F.col("pos") < i2, "val").otherwise("test")).drop("pos")


def folds(dataset: DataFrame, keys: list[str], n: int = 3, seed: int = 42) -> DataFrame:
    """Reproducible fold per key, independent of partitioning: the first eight digits of a sha1."""
    digest = F.sha1(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return dataset.withColumn("fold", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n).cast("int"))
