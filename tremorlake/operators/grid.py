"""Grid cells and cell-to-cell relations, all from index arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions.geo import cell_id, cell_no, center_lat, center_lon, haversine_km
from tremorlake.session import dimension


def grid_cells(spark: SparkSession) -> DataFrame:
    """All forecast cells, from one range: number = row * columns + column."""
    number = F.col("id").cast("int")
    lat, lon = center_lat(number), center_lon(number)
    half = K.STEP / 2
    return spark.range(K.N_CELLS).select(
        number.alias("cell_no"), cell_id(lat, lon).alias("cell_id"),
        lat.alias("lat"), lon.alias("lon"),
        (lat - half).alias("lat_min"), (lat + half).alias("lat_max"),
        (lon - half).alias("lon_min"), (lon + half).alias("lon_max"),
    )


def cells(spark: SparkSession) -> DataFrame:
    """Checkpointed cell dimension (3,128 rows: safe to broadcast)."""
    return dimension(spark, "cells", grid_cells)


def with_cell_no(events: DataFrame) -> DataFrame:
    return events.withColumn("cell_no", cell_no(F.col("lat"), F.col("lon")))


def with_cell_id(df: DataFrame, how: str = "left") -> DataFrame:
    """Attach the text id to rows that carry a cell number."""
    names = F.broadcast(cells(df.sparkSession).select("cell_no", "cell_id"))
    return df.join(names, "cell_no", how)


def assign_cells(events: DataFrame) -> DataFrame:
    """Events with the id of the half-open cell holding them; NULL off the grid."""
    return with_cell_id(with_cell_no(events)).drop("cell_no")


def _offsets(base: DataFrame, reach: int) -> DataFrame:
    """Every in-grid cell at most ``reach`` steps away, the cell itself included."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    i, j = F.floor(F.col("cell_no") / K.N_LON), F.col("cell_no") % K.N_LON
    return (
        base.select("cell_no")
        .withColumn("di", F.explode(steps)).withColumn("dj", F.explode(steps))
        .where((i + F.col("di")).between(0, K.N_LAT - 1) & (j + F.col("dj")).between(0, K.N_LON - 1))
        .withColumn("other_no", (F.col("cell_no") + F.col("di") * K.N_LON + F.col("dj")).cast("int"))
        .withColumn("dist_km", haversine_km(center_lat(F.col("cell_no")), center_lon(F.col("cell_no")),
                                            center_lat(F.col("other_no")), center_lon(F.col("other_no"))))
    )


def nearest_neighbors(spark: SparkSession, k: int = 8) -> DataFrame:
    """The k <= 8 nearest centres of each cell; ties by distance at 6 decimals, then order.

    Three steps each way are enough: a corner cell has its eighth neighbour within
    2.9 steps, and anything outside the box is further.
    """
    if k > 8:
        raise ValueError("k must be at most 8")
    rank = Window.partitionBy("cell_no").orderBy(F.round("dist_km", 6), "other_no")
    return (
        _offsets(spark.range(K.N_CELLS).select(F.col("id").cast("int").alias("cell_no")), 3)
        .where("cell_no <> other_no")
        .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
        .select("cell_no", "other_no", "rank", "dist_km")
    )


def neighbors(spark: SparkSession) -> DataFrame:
    """Checkpointed 8-neighbour table (25,024 rows)."""
    return dimension(spark, "neighbors", nearest_neighbors)


def radius_pairs(spark: SparkSession, radius_km: float) -> DataFrame:
    """Cells within a radius of each cell, itself included."""
    reach = int(radius_km / (111.0 * 0.98 * K.STEP)) + 1
    return _offsets(
        spark.range(K.N_CELLS).select(F.col("id").cast("int").alias("cell_no")), reach
    ).where(F.col("dist_km") <= radius_km).select("cell_no", "other_no", "dist_km")


def radius_neighbors(spark: SparkSession, radius_km: float) -> DataFrame:
    """Checkpointed radius table; about 300,000 rows for the largest radius used."""
    return dimension(spark, f"radius-{radius_km:g}", lambda s: radius_pairs(s, radius_km))


def ring_neighbors(spark: SparkSession, rings: int) -> DataFrame:
    """Cells at most ``rings`` index steps away in either direction, itself included."""
    return _offsets(
        spark.range(K.N_CELLS).select(F.col("id").cast("int").alias("cell_no")), rings
    ).select("cell_no", "other_no",
             F.greatest(F.abs("di"), F.abs("dj")).alias("ring"))


def nearest_cell(points: DataFrame, key: list[str]) -> DataFrame:
    """Closest centre by squared degrees, first cell on ties.

    Rows and columns separate in squared degrees, so the answer is the clamped cell
    itself; on a cell border the smaller index wins. No comparison of all cells.
    """
    def clamp(value, origin, count):
        raw = F.ceil((value - origin) / K.STEP).cast("int") - 1
        return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(count - 1), raw)))

    row = clamp(F.col("lat"), K.LAT_MIN, K.N_LAT)
    col = clamp(F.col("lon"), K.LON_MIN, K.N_LON)
    return with_cell_id(points.withColumn("cell_no", row * K.N_LON + col)).select(*key, "lat", "lon", "cell_no", "cell_id")
