"""The forecast run and the queries that serve it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions.heads import check_head, to_wide
from tremorlake.operators import priors
from tremorlake.operators.grid import radius_neighbors

FORECAST_KEYS = ["cell_no", "horizon_days", "mag_threshold"]


# --- the run ----------------------------------------------------------------------

def run_forecast(events: DataFrame, areas: DataFrame, issued_at: str, model: DataFrame | None = None,
                 etas: DataFrame | None = None, force_demo: bool = False) -> tuple[DataFrame, str, str]:
    """Forecast of the best tier at hand: model, aftershock process, Poisson, fault prior.

    ``model`` and ``etas`` are long frames (cell_no, head, p). Returns the long
    forecast with displayed and raw probability, the mode text and the baseline tag.
    """
    spark = events.sparkSession
    if force_demo or events.isEmpty():
        p = priors.demo_prior(areas).withColumns({"run": F.lit("now"), "raw": F.col("p")})
        return _finish(p), "demo_seed", "demo_seed"
    before = events.where(F.col("time") <= F.lit(issued_at).cast("timestamp"))
    first = before.agg(F.min("time").cast("string").alias("t")).first()["t"]
    recent_win = priors.run_windows(spark, [("now", _shift(spark, issued_at, -365 * 5), issued_at)])
    recent = priors.poisson_forecast(before, recent_win)
    if model is None and etas is not None:
        p = etas.withColumns({"run": F.lit("now"), "raw": F.col("p")})
        return _finish(p), "etas_ogata", "etas"
    tier = "ml_ensemble" if model is not None else "poisson_baseline"
    chosen = recent if model is None else model.withColumn("run", F.lit("now"))
    long_term = priors.poisson_forecast(before, priors.run_windows(spark, [("now", first, issued_at)]))
    out = priors.shrink(chosen, recent, long_term, areas)
    return _finish(out), f"{tier}_public_calibrated", "ml" if model is not None else "poisson"


def _shift(spark, when: str, days: int) -> str:
    return spark.sql(f"select cast(timestampadd(DAY, {days}, timestamp'{when}') as string) as t").first()["t"]


def _finish(p: DataFrame) -> DataFrame:
    return priors.monotone(p, ["p", "raw"], ["cell_no"]).select(
        *FORECAST_KEYS, F.col("p").alias("probability"), F.col("raw").alias("raw_probability"))


def persist_forecast(current: DataFrame, update: DataFrame) -> DataFrame:
    """Replace stored heads by the new run's (newest computed_at per key wins)."""
    from tremorlake.operators.users import upsert_latest
    return upsert_latest(current, update, FORECAST_KEYS, "computed_at")


def wide_run(forecast: DataFrame, value: str = "probability") -> DataFrame:
    return to_wide(forecast, ["cell_id"], value)


# --- reads ------------------------------------------------------------------------

def one_head(forecasts: DataFrame, horizon: int, threshold: float) -> DataFrame:
    check_head(horizon, threshold)
    return forecasts.where((F.col("horizon_days") == horizon) & (F.col("mag_threshold") == threshold))


def latest_forecasts(areas: DataFrame, forecasts: DataFrame, horizon: int, threshold: float,
                     min_probability: float | None = None) -> DataFrame:
    """Every area with its forecast of one head; areas without one are kept."""
    head = one_head(forecasts, horizon, threshold).drop("cell_id", "horizon_days", "mag_threshold")
    out = areas.join(F.broadcast(head), "cell_no", "left")
    return out if min_probability is None else out.where(F.col("probability") >= min_probability)


def by_probability() -> list[Column]:
    return [F.desc_nulls_last("probability"), F.asc("cell_id")]


def neighborhood_best(rows: DataFrame) -> DataFrame:
    """Dense rank and the best cell within 100 and 300 km (own cell on ties).

    Rows are one head of the grid: at most 3,128.
    """
    spark = rows.sparkSession
    scored = rows.where("probability is not null")
    ranked = scored.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("probability"))))
    others = ranked.select(F.col("cell_no").alias("other_no"), F.col("probability").alias("op"),
                           F.col("rank").alias("orank"), F.col("cell_id").alias("oid"))
    pairs = radius_neighbors(spark, 300.0).join(F.broadcast(others), "other_no")
    order = F.struct((-F.col("op")).alias("a"), (F.col("cell_no") != F.col("other_no")).alias("b"), F.col("oid").alias("c"))
    pick = lambda test: F.min_by(F.struct("op", "orank", "oid"), F.when(test, order))
    best = pairs.groupBy("cell_no").agg(
        pick(F.col("dist_km") <= 100.0).alias("b1"), pick(F.lit(True)).alias("b3"))
    out = ranked.join(F.broadcast(best), "cell_no")
    for name, col in (("cluster100", "b1"), ("cluster300", "b3")):
        out = out.withColumns({f"{name}_probability": F.col(col)["op"], f"{name}_rank": F.col(col)["orank"],
                               f"{name}_cell_id": F.col(col)["oid"]})
    return out.drop("b1", "b3")


def sentence(label: Column, p: Column, threshold: Column, horizon: Column) -> Column:
    return F.format_string("%s, %.1f%% probabilitas M≥%.1f dalam %d hari", label, p * 100, threshold, horizon)


def top_forecasts(areas: DataFrame, forecasts: DataFrame, horizon: int = K.DEFAULT_HORIZON,
                  threshold: float = K.DEFAULT_THRESHOLD, n: int = 10) -> DataFrame:
    rows = latest_forecasts(areas, forecasts, horizon, threshold).where("probability is not null")
    return rows.orderBy(*by_probability()).limit(n).withColumn("sentence", sentence(
        F.col("full_label"), F.col("probability"), F.lit(threshold), F.lit(horizon)))


def high_risk(areas: DataFrame, forecasts: DataFrame, horizon: int, threshold: float, top_pct: float = 0.10) -> DataFrame:
    """The max(1, int(n * pct)) likeliest cells of one head; pct is held in [0.01, 0.5]."""
    pct = max(0.01, min(float(top_pct), 0.50))
    rows = latest_forecasts(areas, forecasts, horizon, threshold).where("probability is not null")
    order = Window.orderBy(*by_probability())  # one head of the grid: at most 3,128 rows
    ranked = rows.withColumns({"pos": F.row_number().over(order), "total_cells": F.count("*").over(Window.partitionBy())})
    return ranked.where(F.col("pos") <= F.greatest(F.lit(1), F.floor(F.col("total_cells") * pct)))


# --- clusters ----------------------------------------------------------------------

CLUSTER_SORTS = {"top3_mean": "prob_top3_mean", "max": "prob_max", "any_cell": "prob_any_cell", "mean": "prob_mean"}
# fixed values: accented Latin letters and their plain forms
ACCENTS = ("ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ",
           "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy")


def slug(label: Column) -> Column:
    """Address form of a label; a long one keeps its start and gets a digest, so that two labels never share it."""
    plain = F.lower(F.translate(F.coalesce(label, F.lit("")), *ACCENTS))
    ascii_only = F.regexp_replace(plain, r"[^\x00-\x7f]", "")
    dashed = F.regexp_replace(F.regexp_replace(ascii_only, "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(dashed == "", "unknown").when(F.length(dashed) <= 80, dashed).otherwise(
        F.concat(F.substring(dashed, 1, 80), F.lit("-"), F.sha1(label)))


def clusters(rows: DataFrame) -> DataFrame:
    """Cells grouped by label; a cluster holds at most the grid's cells.

    ``rows`` is a latest-forecast frame with non-null probabilities.
    """
    p = F.col("probability")
    member = F.struct((-p).alias("np"), "cell_id", "full_label", "lat", "lon", p.alias("probability"),
                      "province", "subregion", "region_macro")
    g = rows.withColumn("full_label", F.coalesce("full_label", F.lit("(tanpa label)"))).groupBy("full_label").agg(
        F.array_sort(F.collect_list(member)).alias("m"), F.count("*").alias("n_cells"),
        F.count_if("is_offshore").alias("n_offshore_cells"), F.max(p).alias("prob_max"), F.avg(p).alias("prob_mean"),
        (1 - F.exp(F.sum(F.log1p(-priors.clip(p, 0.0, 1 - 1e-9))))).alias("prob_any_cell"),
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("lat_min").alias("lat_min"),
        F.max("lat_max").alias("lat_max"), F.min("lon_min").alias("lon_min"), F.max("lon_max").alias("lon_max"))
    top = F.slice("m", 1, 3)
    return g.select(
        slug(F.col("full_label")).alias("cluster_id"), F.col("full_label").alias("cluster_label"),
        F.col("m")[0]["province"].alias("province"), F.col("m")[0]["subregion"].alias("subregion"),
        F.col("m")[0]["region_macro"].alias("region_macro"),
        (F.col("n_offshore_cells") > F.col("n_cells") / 2).alias("is_offshore"), "n_cells", "n_offshore_cells",
        "prob_max", (F.aggregate(top, F.lit(0.0), lambda a, x: a + x["probability"]) / F.size(top)).alias("prob_top3_mean"),
        "prob_any_cell", "prob_mean", "lat", "lon", "lat_min", "lat_max", "lon_min", "lon_max",
        F.transform(top, lambda x: F.struct(x["cell_id"].alias("cell_id"), x["full_label"].alias("full_label"),
                                            x["lat"].alias("lat"), x["lon"].alias("lon"),
                                            x["probability"].alias("probability"))).alias("top_cells"),
        F.transform("m", lambda x: x["cell_id"]).alias("cell_ids"))


def cluster_forecasts(areas: DataFrame, forecasts: DataFrame, horizon: int, threshold: float, sort_by: str = "top3_mean",
                      region_macro: str | None = None, province: str | None = None,
                      min_probability: float | None = None, min_cells: int = 1) -> DataFrame:
    """Clusters filtered by place before, by size and metric after aggregation."""
    if sort_by not in CLUSTER_SORTS:
        raise ValueError(f"sort_by must be one of {tuple(CLUSTER_SORTS)}")
    rows = latest_forecasts(areas, forecasts, horizon, threshold).where("probability is not null")
    if region_macro:
        rows = rows.where(F.col("region_macro") == region_macro)
    if province:
        rows = rows.where(F.col("province") == province)
    out = clusters(rows).where(F.col("n_cells") >= min_cells)
    metric = CLUSTER_SORTS[sort_by]
    if min_probability is not None:
        out = out.where(F.col(metric) >= min_probability)
    return out.orderBy(F.desc(F.round(metric, 9)), "cluster_label")


def top_clusters(areas: DataFrame, forecasts: DataFrame, horizon: int, threshold: float, n: int = 10,
                 sort_by: str = "top3_mean") -> DataFrame:
    words = dict(K.SORT_WORDS)[sort_by]
    text = F.format_string(f"%s (%d cell), %.1f%% {words}, M≥{threshold} dalam {horizon} hari",
                           F.col("cluster_label"), F.col("n_cells"), F.col(CLUSTER_SORTS[sort_by]) * 100)
    return cluster_forecasts(areas, forecasts, horizon, threshold, sort_by).limit(max(0, n)).withColumn("sentence", text)


# --- search, sort, text --------------------------------------------------------------

def search_cells(rows: DataFrame, text: str, region: str | None = None) -> DataFrame:
    has = lambda c, t: F.coalesce(F.contains(F.lower(c), F.lit(t.lower())), F.lit(False))
    out = rows.where(has("full_label", text) | has("province", text) | has("cell_id", text))
    if region:
        out = out.where(has("region_macro", region) | has("subregion", region) | has("province", region))
    return out


def search_clusters(rows: DataFrame, text: str, region: str | None = None) -> DataFrame:
    has = lambda c, t: F.coalesce(F.contains(F.lower(c), F.lit(t.lower())), F.lit(False))
    out = rows.where(has("cluster_label", text) | has("province", text) | has("subregion", text))
    if region:
        out = out.where(has("region_macro", region) | has("province", region))
    return out


def sort_cells(rows: DataFrame, by: str) -> DataFrame:
    orders = {"prob-desc": [F.desc(F.coalesce("probability", F.lit(0.0)))],
              "prob-asc": [F.asc(F.coalesce("probability", F.lit(0.0)))],
              "fault-asc": [F.asc(F.coalesce("nearest_fault_km", F.lit(K.MISSING_FAR)))],
              "name-asc": [F.asc(F.coalesce("full_label", F.lit("")))]}
    return rows.orderBy(*orders[by], "cell_id")


def risk_columns(p: Column) -> dict[str, Column]:
    """Risk word, map colour, floor and very-low flags, percentage texts."""
    level, color = F.when(p.isNull(), K.RISK_NONE), F.when(p.isNull(), K.COLOR_NONE)
    for limit, word in K.RISK_BANDS:
        level = level.when(p < limit, word)
    for limit, word in K.COLOR_BANDS:
        color = color.when(p < limit, word)
    floor = p <= K.PROB_FLOOR * 1.01
    shown = (F.when(p.isNull(), "—").when(floor, "data minim").when(p * 100 < 0.01, "< 0.01%")
             .when(p * 100 < 1, F.format_string("%.2f%%", p * 100)).otherwise(F.format_string("%.1f%%", p * 100)))
    return {"risk_level": level.otherwise(K.RISK_TOP), "color": color.otherwise(K.COLOR_TOP),
            "at_floor": F.coalesce(floor, F.lit(False)), "very_low": F.coalesce(p <= K.PROB_VERY_LOW, F.lit(False)),
            "pct_text": F.when(p.isNull(), "—").otherwise(F.format_string("%.2f%%", p * 100)), "pct_shown": shown}
