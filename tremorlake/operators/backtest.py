"""Map-against-events reports and the pre-event rank back-test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions.heads import head_name
from tremorlake.operators.grid import radius_neighbors, ring_neighbors
from tremorlake.session import struct_array


def rate(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a, b), 4)


def mark_hits(events: DataFrame, high: DataFrame) -> DataFrame:
    """Events with the high-risk cell that holds them, if any."""
    return events.join(F.broadcast(high.select("cell_no", "cell_id", "full_label", "probability")), "cell_no", "left").withColumn(
        "hit", F.col("cell_id").isNotNull())


def performance(marked: DataFrame, high: DataFrame, now: str) -> DataFrame:
    """Hit rates over 30 and 365 days, false alarms and precision of the current map.

    One aggregate per cell first, so that hit cells and events are counted in one pass.
    """
    at = F.lit(now).cast("timestamp")
    year = marked.where((F.col("time") >= at - F.make_interval(days=F.lit(365))) & (F.col("time") <= at))
    month = F.col("time") >= at - F.make_interval(days=F.lit(30))
    per_cell = year.groupBy("cell_no", "hit").agg(F.count("*").alias("n"), F.count_if(month).alias("n30"))
    cards = per_cell.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events_365d"), F.coalesce(F.sum("n30"), F.lit(0)).alias("events_30d"),
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("h365"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n30"))), F.lit(0)).alias("h30"),
        F.count_if("hit").alias("cells_hit"))
    size = high.agg(F.count("*").alias("high_risk_cells"))
    one = cards.withColumn("k", F.lit(1)).join(size.withColumn("k", F.lit(1)), "k")
    return one.select(
        "high_risk_cells", "events_30d", "events_365d", F.col("cells_hit").alias("high_risk_cells_with_event"),
        rate(F.col("h30"), F.col("events_30d")).alias("hit_rate_30d"), rate(F.col("h365"), F.col("events_365d")).alias("hit_rate_365d"),
        rate(F.greatest(F.col("high_risk_cells") - F.col("cells_hit"), F.lit(0)), F.col("high_risk_cells")).alias("false_alarm_rate"),
        rate(F.col("cells_hit"), F.col("high_risk_cells")).alias("precision"))


def monthly(marked: DataFrame, last: int | None = None) -> DataFrame:
    g = marked.groupBy(F.date_format("time", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("events"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")).withColumn(
        "hit_rate", rate(F.col("hits"), F.col("events")))
    return g if last is None else g.orderBy(F.desc("month")).limit(last)


def period_summary(marked: DataFrame, high: DataFrame) -> DataFrame:
    g = marked.groupBy("cell_no", "hit").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("hits"),
        F.count_if("hit").alias("high_risk_cells_hit"))
    one = g.withColumn("k", F.lit(1)).join(high.agg(F.count("*").alias("n_high")).withColumn("k", F.lit(1)), "k")
    missed = F.greatest(F.col("n_high") - F.col("high_risk_cells_hit"), F.lit(0))
    return one.select("events", "hits", (F.col("events") - F.col("hits")).alias("misses"), rate(F.col("hits"), F.col("events")).alias("hit_rate"),
                      "high_risk_cells_hit", missed.alias("false_alarm_cells"), rate(missed, F.col("n_high")).alias("false_alarm_rate"))


# --- pre-event ranks ---------------------------------------------------------------------

def run_before(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest run issued at least each lead before each event (as-of join).

    Runs become validity intervals; an interval is listed under every day it touches,
    so an event and lead meet one day's runs only. ``runs(run, issued_at)`` has one row
    per archived run.
    """
    leads = F.inline(struct_array([(n, s) for n, s in K.BACKTEST_LEADS], ("lead", "lead_seconds")))
    order = Window.orderBy("issued_at", "run")  # the archive listing, one row per run
    spans = runs.select("run", "issued_at", F.lead("issued_at").over(order).alias("until")).where(
        F.col("until").isNull() | (F.col("until") > F.col("issued_at")))
    asked = events.select("*", leads).withColumn("cutoff", F.timestamp_micros(F.unix_micros("time") - F.col("lead_seconds").cast("bigint") * 1_000_000))
    end = asked.agg(F.max("cutoff").alias("m"))
    bounded = spans.withColumn("k", F.lit(1)).join(F.broadcast(end.withColumn("k", F.lit(1))), "k").drop("k").where("issued_at <= m")
    listed = bounded.withColumn("day", F.explode(F.sequence(F.to_date("issued_at"), F.to_date(F.coalesce("until", "m")))))
    c = F.col("cutoff")
    return asked.withColumn("day", F.to_date("cutoff")).join(listed.drop("m"), "day", "inner").where(
        (F.col("issued_at") <= c) & (F.col("until").isNull() | (F.col("until") > c))).drop("day", "until", "lead_seconds", "cutoff")


def ranked_runs(archive: DataFrame, threshold: float) -> DataFrame:
    """Competition rank and percentile of every cell per run and horizon (3,128 rows each)."""
    heads = F.inline(F.array(*[F.struct(F.lit(h).alias("horizon_days"), F.col(head_name(h, threshold)).alias("p")) for h in K.HORIZONS]))
    w = Window.partitionBy("run", "horizon_days")
    return archive.select("run", "cell_no", "cell_id", heads).withColumns({
        "rank": F.rank().over(w.orderBy(F.desc("p"))), "percentile": F.round(F.cume_dist().over(w.orderBy("p")) * 100, 2)})


def pre_event_ranks(events: DataFrame, runs: DataFrame, archive: DataFrame, threshold: float = 6.0, radius_km: float = 300.0) -> DataFrame:
    """Rank of each event's cell in the map issued before it, per lead and horizon, with
    the best-ranked cell of the first two rings, of 100 km and of the radius.

    ``events(event_id, time, cell_no)``; ``archive(run, cell_no, cell_id, heads)``.
    """
    spark = events.sparkSession
    chosen = run_before(events.where("cell_no is not null"), runs)
    maps = ranked_runs(archive.join(chosen.select("run").distinct(), "run", "left_semi"), threshold)
    exact = chosen.join(maps.drop("cell_id"), ["run", "cell_no"])
    out = exact.select("event_id", "lead", "horizon_days", "run", "cell_no", F.col("p").alias("probability"), "rank", "percentile",
                       F.round(1.0 / F.col("rank"), 6).alias("reciprocal_rank"),
                       F.round(F.when(F.col("rank") <= 10, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0), 6).alias("ndcg10"),
                       *[(F.col("rank") <= k).alias(f"top{k}") for k in (10, 25, 50, 100)])
    rings = ring_neighbors(spark, 2)
    near = radius_neighbors(spark, radius_km)
    pairs = rings.select("cell_no", "other_no", "ring").join(near, ["cell_no", "other_no"], "full_outer")
    best = lambda test: F.min(F.when(test, F.struct("rank", "cell_id")))
    around = (chosen.select("run", "cell_no").distinct().join(F.broadcast(pairs), "cell_no")
              .join(maps.withColumnRenamed("cell_no", "other_no"), ["run", "other_no"]).groupBy("run", "cell_no", "horizon_days").agg(
        best(F.col("ring") <= 1).alias("b1"), best(F.col("ring") <= 2).alias("b2"), best(F.col("dist_km") <= 100.0).alias("b3"),
        best(F.col("dist_km") <= radius_km).alias("b4")))
    out = out.join(around, ["run", "cell_no", "horizon_days"])
    for name, col in (("ring1", "b1"), ("ring2", "b2"), ("cluster100", "b3"), ("cluster", "b4")):
        out = out.withColumns({f"{name}_best_rank": F.col(col)["rank"], f"{name}_best_cell_id": F.col(col)["cell_id"],
                               f"{name}_top10": F.coalesce(F.col(col)["rank"] <= 10, F.lit(False))})
    return out.drop("b1", "b2", "b3", "b4")


def rank_summary(ranks: DataFrame) -> DataFrame:
    """Hit rates, mean reciprocal rank, NDCG and upper-median rank per lead and horizon."""
    keys = ["lead", "horizon_days"]
    flags = ["top10", "top25", "top50", "top100", "ring1_top10", "ring2_top10", "cluster100_top10", "cluster_top10"]
    base = ranks.groupBy(*keys).agg(
        F.count("*").alias("events"), *[F.round(F.avg(F.col(f).cast("double")), 4).alias(f"{f}_hit_rate") for f in flags],
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("ndcg10"), 6).alias("ndcg10"))
    per_rank = ranks.groupBy(*keys, "rank").agg(F.count("*").alias("c"))  # at most 3,128 ranks per group
    upto = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    mid = per_rank.withColumn("cum", F.sum("c").over(upto)).join(base.select(*keys, "events"), keys).where(
        F.col("cum") > F.floor(F.col("events") / 2)).groupBy(*keys).agg(F.min("rank").alias("median_rank"))
    return base.join(mid, keys)
