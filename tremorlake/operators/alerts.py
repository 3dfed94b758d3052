"""Snapshot-to-snapshot alert decisions and the daily report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.operators.geology import area_labels
from tremorlake.functions.geo import haversine_km_atan2
from tremorlake.session import inline


def top_snapshots(maps: DataFrame) -> DataFrame:
    """Ranked top cells per run and alert threshold (at most 50 rows each).

    ``maps(seq, cell_id, mag_threshold, p)`` holds the 30-day maps in issue order.
    """
    prof = inline(maps.sparkSession, K.ALERT_PROFILES, "mag_threshold, n, min_prob, abs_delta, rel_delta")
    w = Window.partitionBy("seq", "mag_threshold").orderBy(F.desc("p"), "cell_id")  # one map of the grid
    return maps.join(F.broadcast(prof), "mag_threshold").withColumn("rank", F.row_number().over(w)).where("rank <= n")


def alert_decisions(maps: DataFrame) -> DataFrame:
    """First matching reason per run and threshold, against the run before."""
    tops = top_snapshots(maps)
    prev = tops.select((F.col("seq") + 1).alias("seq"), "mag_threshold", "cell_id", F.col("rank").alias("p_rank"), F.col("p").alias("p_p"))
    both = tops.join(prev, ["seq", "mag_threshold", "cell_id"], "full_outer")
    last = maps.agg(F.max("seq").alias("last"))
    first = lambda c, r: F.max(F.when(F.col(r) == 1, F.col(c)))
    entered = (F.col("rank") <= 5) & (F.coalesce("p_rank", F.lit(999)) > 5)
    jumped = (F.col("rank") <= 10) & (F.coalesce(F.col("p_rank"), F.col("rank")) - F.col("rank") >= 10)
    g = both.groupBy("seq", "mag_threshold").agg(
        first("p", "rank").alias("cur_p"), first("cell_id", "rank").alias("cur_cell"), first("p_p", "p_rank").alias("prev_p"),
        first("cell_id", "p_rank").alias("prev_cell"), F.max("min_prob").alias("min_prob"), F.max("abs_delta").alias("abs_delta"),
        F.max("rel_delta").alias("rel_delta"), F.coalesce(F.bool_or(entered), F.lit(False)).alias("entered"),
        F.coalesce(F.bool_or(jumped), F.lit(False)).alias("jumped"))
    delta = F.abs(F.col("cur_p") - F.col("prev_p"))
    large = F.col("mag_threshold") >= 6.0
    reason = (F.when(F.col("cur_p").isNull(), "empty_current").when(F.col("cur_p") < F.col("min_prob"), "below_threshold")
              .when(F.col("prev_p").isNull(), "baseline_snapshot_created").when(F.col("cur_cell") != F.col("prev_cell"), "top_cell_changed")
              .when(F.col("prev_p") < F.col("min_prob"), "crossed_threshold").when(delta >= F.col("abs_delta"), "absolute_delta")
              .when(delta / F.greatest(F.col("prev_p"), F.lit(1e-9)) >= F.col("rel_delta"), "relative_delta")
              .when(large & F.col("entered"), "entered_top5").when(large & F.col("jumped"), "rank_jump").otherwise("no_significant_change"))
    quiet = ("empty_current", "below_threshold", "baseline_snapshot_created", "no_significant_change")
    return g.withColumn("k", F.lit(1)).join(F.broadcast(last.withColumn("k", F.lit(1))), "k").where("seq <= last").select(
        "seq", "mag_threshold", reason.alias("reason")).withColumn("alert", ~F.col("reason").isin(*quiet))


def combined_alerts(decisions: DataFrame, issued: DataFrame) -> DataFrame:
    """One row per run in which any threshold asks for an alert: when, and all reasons.

    ``issued(seq, issued_at)`` has a row per run. Feed the result to the cool-down.
    """
    asked = decisions.where("alert").groupBy("seq").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat_ws(":", F.format_string("%.1f", "mag_threshold"), "reason"))), ",").alias("reasons"))  # three thresholds
    return asked.join(issued, "seq").select(F.lit("all").alias("key"), F.col("issued_at").alias("time"), "reasons")


def top_cell_event(events: DataFrame, top: DataFrame, now: str, radius_km: float = 300.0, days: int = 7) -> DataFrame:
    """Closest M 4.5+ event of the last days within the radius of the top cell; of equals the latest."""
    until = F.lit(now).cast("timestamp")
    last = events.where((F.col("magnitude") >= 4.5) & (F.col("time") <= until) & (F.col("time") >= until - F.make_interval(days=F.lit(days))))
    cell = top.select("cell_id").join(F.broadcast(area_labels(events.sparkSession)), "cell_id").select("cell_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    dist = haversine_km_atan2(F.col("c_lat"), F.col("c_lon"), F.col("lat"), F.col("lon"))
    near = last.withColumn("k", F.lit(1)).join(F.broadcast(cell.withColumn("k", F.lit(1))), "k").withColumn("dist_km", dist).where(F.col("dist_km") <= radius_km)
    return near.groupBy("cell_id").agg(F.min(F.struct("dist_km", (-F.unix_micros("time")).alias("_late"), "event_id", "magnitude")).alias("b")).select("cell_id", "b.*").drop("_late")


def daily_report(users: DataFrame, opted_out: DataFrame, forecasts: DataFrame, day: str, sent: DataFrame | None = None) -> DataFrame:
    """Own-cell M 5.0 probabilities of every active user, once per user and day."""
    active = users.join(opted_out.select("chat_id"), "chat_id", "left_anti")
    if sent is not None:
        active = active.join(sent.where(F.col("day") == day).select("chat_id"), "chat_id", "left_anti")
    own = forecasts.where("mag_threshold = 5.0").groupBy("cell_id").agg(*[
        F.max(F.when(F.col("horizon_days") == h, F.col("probability"))).alias(f"p{h}") for h in K.HORIZONS])
    return active.join(F.broadcast(own), "cell_id", "left").withColumn("day", F.lit(day))
