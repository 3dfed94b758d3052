"""Poisson, priors, forecast run and serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions.heads import head_columns, head_name, to_long, to_wide, with_heads
from tremorlake.operators import geology, grid, priors, serving
from tremorlake.plans import sqlparts as S
from tremorlake.plans.fixtures import AS_OF, quakes, table
from tremorlake.plans.registry import query
from tremorlake.session import dimension

RECENT = ("1996-07-02 00:00:00", AS_OF)


def events(spark, sf_dir):
    return grid.with_cell_no(quakes(spark, sf_dir))


def run_now(spark, sf_dir):
    """The issued forecast, computed from the catalog, at nine decimals."""
    out, _, _ = serving.run_forecast(events(spark, sf_dir), geology.area_labels(spark), AS_OF)
    return grid.with_cell_id(out).withColumns({
        "probability": F.round("probability", 9), "raw_probability": F.round("raw_probability", 9)})


def current(spark, sf_dir):
    """The stored current forecast (50,048 rows), written once per application."""
    return dimension(spark, f"current-{sf_dir}", lambda s: run_now(s, sf_dir))


_K1 = """select a.cell_id, full_label, probability, printf('%s, %.1f%% probabilitas M≥%.1f dalam %d hari', full_label, probability*100, 5.0::double, 30) as sentence
from fc join areas a using (cell_no) where horizon_days=30 and mag_threshold=5 order by probability desc, a.cell_id limit 10"""


@query("k1_top_forecasts", S.stmt(S.QUAKES, S.PUBLIC, _K1))
def k1_top_forecasts(spark, sf_dir):
    """Flagship: catalog to the ten likeliest cells with their sentence."""
    return serving.top_forecasts(geology.area_labels(spark), run_now(spark, sf_dir)).select(
        "cell_id", "full_label", "probability", "sentence")


@query("m1_poisson_rates", S.stmt(S.QUAKES, S.GRID, S.HEADS, S.poisson("recent", S.ASOF + " - interval 1825 day", S.ASOF), """
select cell_id, c.mag_threshold, c.n as n_events, round(c.n/days, 9) as rate from recent_c c join grid using (cell_no) cross join recent_d"""))
def m1_poisson_rates(spark, sf_dir):
    win = priors.run_windows(spark, [("now", *RECENT)])
    counts = priors.poisson_counts(events(spark, sf_dir), win).join(F.broadcast(win), "run")
    entries = F.array(*[F.struct(F.lit(t).alias("mag_threshold"), F.col(f"n_{i}").alias("n_events")) for i, t in enumerate(K.THRESHOLDS)])
    out = counts.select("cell_no", "days", F.inline(entries)).where("n_events > 0")
    return grid.with_cell_id(out).select("cell_id", "mag_threshold", "n_events", F.round(F.col("n_events") / F.col("days"), 9).alias("rate"))


@query("m2_poisson_predict", S.stmt(S.QUAKES, S.GRID, S.HEADS, S.poisson("recent", S.ASOF + " - interval 1825 day", S.ASOF),
       S.poisson("longp", S.QMIN, S.ASOF), """
select cell_id, horizon_days, mag_threshold, round(r.p, 9) as p_recent, round(l.p, 9) as p_long
from recent r join longp l using (cell_no, horizon_days, mag_threshold) join grid using (cell_no)"""))
def m2_poisson_predict(spark, sf_dir):
    ev = events(spark, sf_dir)
    first = ev.agg(F.min("time").cast("string").alias("t")).first()["t"]
    both = priors.poisson_forecast(ev, priors.run_windows(spark, [("recent", *RECENT), ("long", first, AS_OF)]), 2)
    p = lambda r: F.round(F.max(F.when(F.col("run") == r, F.col("p"))), 9)
    return grid.with_cell_id(both.groupBy("cell_no", "horizon_days", "mag_threshold").agg(
        p("recent").alias("p_recent"), p("long").alias("p_long"))).drop("cell_no")


@query("m3_base_rates", S.stmt(S.QUAKES, S.HEADS, """
span as (select greatest(1e0, epoch(max(time)-min(time))/86400e0) as days from quakes)
select horizon_days, mag_threshold, round(greatest(1e-7, 1-exp(-((select count(*) from quakes where magnitude>=mag_threshold)/(3128e0*days))*horizon_days)), 9) as base_rate,
 round(1-exp(-(6e-2*exp(-(mag_threshold-45e-1)/43e-2)/365e0)*horizon_days), 9) as fallback_rate from heads, span"""))
def m3_base_rates(spark, sf_dir):
    rates = priors.base_rates(quakes(spark, sf_dir))
    fallback = K.FALLBACK_ANNUAL * F.exp(-(F.col("mag_threshold") - 4.5) / K.FALLBACK_DECAY) / 365.0
    return rates.select("horizon_days", "mag_threshold", F.round("base_rate", 9).alias("base_rate"),
                        F.round(1 - F.exp(-fallback * F.col("horizon_days")), 9).alias("fallback_rate"))


def _area_events(spark, sf_dir):
    """Areas that hold events: the priors below are reported for these."""
    hit = events(spark, sf_dir).where("cell_no is not null").groupBy("cell_no").agg(F.count("*").alias("n_events"))
    return geology.area_labels(spark).join(hit, "cell_no")


_HIT = "hit as (select cell_no, count(*) as n_events from quakes where cell_no is not null group by 1)"


@query("m4_demo_prior", S.stmt(S.QUAKES, S.HEADS, S.AREAS, _HIT, """
select cell_id, horizon_days, mag_threshold, n_events, round(least(95e-2, 1-exp(-(3e-1*pow(1e1, -(mag_threshold-45e-1))*(horizon_days/365e0)
 *exp(-nearest_fault_km/75e0)*case fault_type when 'subduction' then 15e-1 when 'transform' then 1e0 else 7e-1 end))), 9) as p
from areas join hit using (cell_no), heads"""))
def m4_demo_prior(spark, sf_dir):
    areas = _area_events(spark, sf_dir)
    return priors.demo_prior(areas).join(areas.select("cell_no", "cell_id", "n_events"), "cell_no").select(
        "cell_id", "horizon_days", "mag_threshold", "n_events", F.round("p", 9).alias("p"))


@query("m5_tectonic_prior", S.stmt(S.QUAKES, S.PUBLIC, _HIT, """
select cell_id, t.horizon_days, t.mag_threshold, n_events, round(p, 9) as p from tect t join areas using (cell_no) join hit using (cell_no)"""))
def m5_tectonic_prior(spark, sf_dir):
    areas = _area_events(spark, sf_dir)
    return priors.tectonic_prior(areas).join(areas.select("cell_no", "cell_id", "n_events"), "cell_no").select(
        "cell_id", "horizon_days", "mag_threshold", "n_events", F.round("p", 9).alias("p"))


@query("m6_rate_smoothing", S.stmt(S.QUAKES, S.PUBLIC, """
select cell_id, s.horizon_days, s.mag_threshold, round(s.p, 9) as p from smooth s join areas using (cell_no)"""))
def m6_rate_smoothing(spark, sf_dir):
    ev = events(spark, sf_dir)
    first = ev.agg(F.min("time").cast("string").alias("t")).first()["t"]
    keys = ["cell_no", "horizon_days", "mag_threshold"]
    recent = priors.poisson_forecast(ev, priors.run_windows(spark, [("now", *RECENT)])).drop("run")
    long_term = priors.poisson_forecast(ev, priors.run_windows(spark, [("now", first, AS_OF)])).drop("run")
    out = recent.join(long_term.withColumnRenamed("p", "q"), keys).select(
        *keys, F.round(priors.smoothed(F.col("p"), F.col("q"), F.col("horizon_days")), 9).alias("p"))
    return grid.with_cell_id(out).drop("cell_no")


@query("m7_display_cap", S.stmt(S.QUAKES, S.PUBLIC, """
select horizon_days, mag_threshold, round(cap, 9) as cap, count(*) filter (where raw_probability > cap) as n_above
from fc join caps using (horizon_days, mag_threshold) group by 1,2,3"""))
def m7_display_cap(spark, sf_dir):
    """The cap of each head and how many raw probabilities exceed it."""
    capped = current(spark, sf_dir).withColumn("cap", priors.display_cap(F.col("horizon_days"), F.col("mag_threshold")))
    return capped.groupBy("horizon_days", "mag_threshold", F.round("cap", 9).alias("cap")).agg(
        F.count_if(F.col("raw_probability") > F.col("cap")).alias("n_above"))


@query("m8_public_shrink", S.stmt(S.QUAKES, S.PUBLIC, """
select cell_id, b.horizon_days, b.mag_threshold, round(b.p, 9) as p from blend b join areas using (cell_no)"""))
def m8_public_shrink(spark, sf_dir):
    ev = events(spark, sf_dir)
    first = ev.agg(F.min("time").cast("string").alias("t")).first()["t"]
    recent = priors.poisson_forecast(ev, priors.run_windows(spark, [("now", *RECENT)]))
    long_term = priors.poisson_forecast(ev, priors.run_windows(spark, [("now", first, AS_OF)]))
    out = priors.shrink(recent, recent, long_term, geology.area_labels(spark))
    return grid.with_cell_id(out).select("cell_id", "horizon_days", "mag_threshold", F.round("p", 9).alias("p"))


@query("m16_forecast_run", S.stmt(S.QUAKES, S.PUBLIC, """
select cell_id, horizon_days, mag_threshold, probability, raw_probability, 'poisson_baseline_public_calibrated' as mode, 'poisson' as baseline_type from fc"""))
def m16_forecast_run(spark, sf_dir):
    """The whole run with its tier; no model is given, so the Poisson tier answers."""
    out, mode, tag = serving.run_forecast(events(spark, sf_dir), geology.area_labels(spark), AS_OF)
    return grid.with_cell_id(out).select(
        "cell_id", "horizon_days", "mag_threshold", F.round("probability", 9).alias("probability"),
        F.round("raw_probability", 9).alias("raw_probability"), F.lit(mode).alias("mode"), F.lit(tag).alias("baseline_type"))


@query("m16_forecast_demo", S.stmt(S.QUAKES, S.HEADS, S.AREAS, """
n as (select cell_no, count(*) as n from quakes where cell_no is not null group by 1),
d as (select cell_no, cell_id, horizon_days, mag_threshold, least(95e-2, 1-exp(-(3e-1*pow(1e1, -(mag_threshold-45e-1))*(horizon_days/365e0)
 *exp(-nearest_fault_km/75e0)*case fault_type when 'subduction' then 15e-1 when 'transform' then 1e0 else 7e-1 end))) as p from areas, heads)
select cell_id, horizon_days, mag_threshold, round(p, 9) as probability, 'demo_seed' as mode, cast(coalesce(n, 0) as bigint) as cell_events from d left join n using (cell_no)"""))
def m16_forecast_demo(spark, sf_dir):
    """The fault prior beside the number of events that each cell already has."""
    quakes_in = events(spark, sf_dir)
    out, mode, _ = serving.run_forecast(quakes_in, geology.area_labels(spark), AS_OF, force_demo=True)
    seen = quakes_in.where("cell_no is not null").groupBy("cell_no").agg(F.count("*").alias("n"))
    return grid.with_cell_id(out.join(seen, "cell_no", "left")).select(
        "cell_id", "horizon_days", "mag_threshold", F.round("probability", 9).alias("probability"), F.lit(mode).alias("mode"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("cell_events"))


@query("w7_monotone", S.stmt(S.QUAKES, S.PUBLIC, """
select a.cell_id, m.horizon_days, m.mag_threshold, round(m.p, 9) as p from mono m join areas a using (cell_no)"""))
def w7_monotone(spark, sf_dir):
    """Monotone probabilities in the wide shape (no shuffle for the rule itself)."""
    ev = events(spark, sf_dir)
    first = ev.agg(F.min("time").cast("string").alias("t")).first()["t"]
    recent = priors.poisson_forecast(ev, priors.run_windows(spark, [("now", *RECENT)]))
    long_term = priors.poisson_forecast(ev, priors.run_windows(spark, [("now", first, AS_OF)]))
    wide = to_wide(priors.shrink(recent, recent, long_term, geology.area_labels(spark)), ["cell_no"], "p")
    out = to_long(priors.monotone_wide(wide), ["cell_no"], "p")
    return grid.with_cell_id(out).select("cell_id", "horizon_days", "mag_threshold", F.round("p", 9).alias("p"))


def _sql_wide(src, cols="probability"):
    return ", ".join(
        f"max({cols}) filter (where horizon_days={h} and mag_threshold={t}) as {head_name(h, t)}"
        for h in K.HORIZONS for t in K.THRESHOLDS)


@query("s17_persist_long", S.stmt(S.QUAKES, S.PUBLIC, f"""
wide as (select cell_id, {_sql_wide('fc')} from fc group by 1),
stale as (select cell_no, horizon_days, mag_threshold, 5e-1 as probability, 5e-1 as raw_probability, 'old' as model_version from fc where cell_no % 3 = 0
 union all select -1, 30, 5.0, 25e-2, 25e-2, 'old')
select cell_no, horizon_days, mag_threshold, probability, raw_probability, 'demo' as model_version from fc
union all select * from stale where cell_no = -1"""))
def s17_persist_long(spark, sf_dir):
    """Wide run to long rows, upserted over an older table."""
    run = current(spark, sf_dir)
    wide = to_wide(run, ["cell_no"]).join(
        to_wide(run, ["cell_no"], "raw_probability").select("cell_no", *[F.col(c).alias(f"raw_{c}") for c in head_columns()]), "cell_no")
    new = to_long(wide, ["cell_no"]).join(to_long(wide, ["cell_no"], "raw_probability", "raw_"), serving.FORECAST_KEYS)
    new = new.withColumns({"computed_at": F.lit(AS_OF).cast("timestamp"), "model_version": F.lit("demo")})
    old = run.where(F.col("cell_no") % 3 == 0).select(*serving.FORECAST_KEYS).unionByName(
        run.limit(1).select(F.lit(-1).alias("cell_no"), F.lit(30).alias("horizon_days"), F.lit(5.0).alias("mag_threshold")))
    p = F.when(F.col("cell_no") == -1, 0.25).otherwise(0.5)
    old = old.withColumns({"probability": p, "raw_probability": p, "computed_at": F.lit("2001-01-01").cast("timestamp"),
                           "model_version": F.lit("old")})
    return serving.persist_forecast(old, new).drop("computed_at")


@query("j2_latest_forecasts", S.stmt(S.QUAKES, S.PUBLIC, """
select a.cell_id, full_label, province, region_macro, is_offshore, fault_type, probability from areas a
left join (select * from fc where horizon_days=30 and mag_threshold=5 and cell_no % 7 <> 0) f using (cell_no)"""))
def j2_latest_forecasts(spark, sf_dir):
    """All areas, also those whose forecast is missing (every seventh is withheld here)."""
    some = current(spark, sf_dir).where(F.col("cell_no") % 7 != 0)
    return serving.latest_forecasts(geology.area_labels(spark), some, 30, 5.0).orderBy(*serving.by_probability()).select(
        "cell_id", "full_label", "province", "region_macro", "is_offshore", "fault_type", "probability")


@query("f4_min_probability", S.stmt(S.QUAKES, S.PUBLIC, """
select a.cell_id, full_label, probability from areas a join fc using (cell_no) where horizon_days=30 and mag_threshold=45e-1 and probability >= 2e-2"""))
def f4_min_probability(spark, sf_dir):
    return serving.latest_forecasts(geology.area_labels(spark), current(spark, sf_dir), 30, 4.5, 0.02).select(
        "cell_id", "full_label", "probability")


_HIGH = """tot as (select count(*) as n from fc where horizon_days=30 and mag_threshold=5),
high as materialized (select * from (select f.*, a.full_label, row_number() over (order by probability desc, f.cell_id) as pos from fc f join areas a using (cell_no)
  where horizon_days=30 and mag_threshold=5) where pos <= (select greatest(1, floor(n*1e-1)) from tot))"""


@query("j3_k2_high_risk", S.stmt(S.QUAKES, S.PUBLIC, _HIGH, "select cell_id, full_label, probability, pos from high"))
def j3_k2_high_risk(spark, sf_dir):
    return serving.high_risk(geology.area_labels(spark), current(spark, sf_dir), 30, 5.0).select(
        "cell_id", "full_label", "probability", F.col("pos").cast("bigint").alias("pos"))


_WRANK = """one as materialized (select f.cell_no, a.cell_id, a.lat, a.lon, f.probability, dense_rank() over (order by probability desc) as rnk
  from fc f join areas a using (cell_no) where horizon_days=30 and mag_threshold=5)"""


@query("w1_w4_neighborhood", S.stmt(S.QUAKES, S.PUBLIC, S.radius(300, "near3"), _WRANK, """
p as (select n.cell_no, n.dist_km, o.probability, o.rnk, o.cell_id, n.cell_no<>n.other_no as away from near3 n join one o on o.cell_no=n.other_no),
b as (select cell_no, row_number() over (partition by cell_no order by probability desc, away, cell_id) as r3,
  case when dist_km<=100 then row_number() over (partition by cell_no, dist_km<=100 order by probability desc, away, cell_id) end as r1, probability, rnk, cell_id from p)
select o.cell_id, o.probability, o.rnk as "rank", b1.probability as cluster100_probability, b1.rnk as cluster100_rank, b1.cell_id as cluster100_cell_id,
 b3.probability as cluster300_probability, b3.rnk as cluster300_rank, b3.cell_id as cluster300_cell_id
from one o join b b1 on b1.cell_no=o.cell_no and b1.r1=1 join b b3 on b3.cell_no=o.cell_no and b3.r3=1"""))
def w1_w4_neighborhood(spark, sf_dir):
    rows = serving.latest_forecasts(geology.area_labels(spark), current(spark, sf_dir), 30, 5.0)
    return serving.neighborhood_best(rows).select(
        "cell_id", "probability", "rank", *[f"cluster{r}_{c}" for r in (100, 300) for c in ("probability", "rank", "cell_id")])


_CLUSTERS = """mem as (select a.*, f.probability from areas a join fc f using (cell_no) where horizon_days=30 and mag_threshold=5),
clus as materialized (select full_label as cluster_label, trim(regexp_replace(lower(full_label), '[^a-z0-9]+', '-', 'g'), '-') as cluster_id, any_value(province) as province,
 any_value(subregion) as subregion, any_value(region_macro) as region_macro, count(*) filter (where is_offshore) > count(*)/2e0 as is_offshore,
 count(*) as n_cells, count(*) filter (where is_offshore) as n_offshore_cells, max(probability) as prob_max,
 round(list_avg(list_sort(list(probability), 'DESC')[1:3]), 7) as prob_top3_mean, round(1-exp(sum(ln(1-least(probability, 1-1e-9)))), 9) as prob_any_cell,
 round(avg(probability), 7) as prob_mean, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon, min(lat_min) as lat_min, max(lat_max) as lat_max, min(lon_min) as lon_min,
 max(lon_max) as lon_max, array_to_string(list(cell_id order by probability desc, cell_id)[1:3], ',') as top_cells,
 array_to_string(list(cell_id order by probability desc, cell_id), ',') as cell_ids from mem group by 1)"""
_CLUSTER_COLS = ("cluster_label, cluster_id, province, subregion, region_macro, is_offshore, n_cells, n_offshore_cells, prob_max, "
                 "prob_top3_mean, prob_any_cell, prob_mean, lat, lon, lat_min, lat_max, lon_min, lon_max, top_cells, cell_ids")


def _flat(df):
    r = lambda c, d: F.round(c, d).alias(c)
    return df.select(
        "cluster_label", "cluster_id", "province", "subregion", "region_macro", "is_offshore", "n_cells", "n_offshore_cells",
        "prob_max", r("prob_top3_mean", 7), r("prob_any_cell", 9), r("prob_mean", 7), r("lat", 6), r("lon", 6),
        "lat_min", "lat_max", "lon_min", "lon_max",
        F.array_join(F.transform("top_cells", lambda x: x["cell_id"]), ",").alias("top_cells"),
        F.array_join("cell_ids", ",").alias("cell_ids"))


@query("d8_clusters", S.stmt(S.QUAKES, S.PUBLIC, _CLUSTERS, f"select {_CLUSTER_COLS} from clus"))
def d8_clusters(spark, sf_dir):
    return _flat(serving.cluster_forecasts(geology.area_labels(spark), current(spark, sf_dir), 30, 5.0))


@query("d9_top_clusters", S.stmt(S.QUAKES, S.PUBLIC, _CLUSTERS, """
select cluster_id, prob_any_cell, n_cells, printf('%s (%d cell), %.1f%% minimal 1 cell, M≥5.0 dalam 30 hari', cluster_label, n_cells, prob_any_cell*100) as sentence
from clus order by prob_any_cell desc, cluster_label limit 10"""))
def d9_top_clusters(spark, sf_dir):
    return serving.top_clusters(geology.area_labels(spark), current(spark, sf_dir), 30, 5.0, 10, "any_cell").select(
        "cluster_id", F.round("prob_any_cell", 9).alias("prob_any_cell"), "n_cells", "sentence")


@query("f5_cluster_filters", S.stmt(S.QUAKES, S.PUBLIC, _CLUSTERS, """
select cluster_id, n_cells, prob_mean from clus where region_macro='MalukuPapua' and n_cells >= 5 and prob_mean >= 2e-3"""))
def f5_cluster_filters(spark, sf_dir):
    return serving.cluster_forecasts(geology.area_labels(spark), current(spark, sf_dir), 30, 5.0, "mean", "MalukuPapua",
                                     None, 0.002, 5).select("cluster_id", "n_cells", F.round("prob_mean", 7).alias("prob_mean"))


@query("f3_area_filter", S.stmt(S.QUAKES, S.AREAS, _HIT, """
select cell_id, full_label, coalesce(n_events,0) as n_events from areas left join hit using (cell_no) where province='Maluku' and region_macro='MalukuPapua'"""))
def f3_area_filter(spark, sf_dir):
    hit = events(spark, sf_dir).where("cell_no is not null").groupBy("cell_no").agg(F.count("*").alias("n_events"))
    return geology.area_labels(spark).where("province = 'Maluku' and region_macro = 'MalukuPapua'").join(hit, "cell_no", "left").orderBy(
        "full_label", "cell_id").select("cell_id", "full_label", F.coalesce("n_events", F.lit(0)).alias("n_events"))


@query("f6_search_cells", S.stmt(S.QUAKES, S.PUBLIC, """
select a.cell_id, full_label, probability from areas a join fc using (cell_no) where horizon_days=30 and mag_threshold=5
 and (contains(lower(full_label), 'pal') or contains(lower(province), 'pal') or contains(lower(a.cell_id), 'pal'))
 and (contains(lower(region_macro), 'sulawesi') or contains(lower(subregion), 'sulawesi') or contains(lower(province), 'sulawesi'))"""))
def f6_search_cells(spark, sf_dir):
    rows = serving.latest_forecasts(geology.area_labels(spark), current(spark, sf_dir), 30, 5.0)
    return serving.search_cells(rows, "Pal", "Sulawesi").select("cell_id", "full_label", "probability")


@query("f6_search_clusters", S.stmt(S.QUAKES, S.PUBLIC, _CLUSTERS, """
select cluster_id, prob_max from clus where (contains(lower(cluster_label), 'dekat') or contains(lower(province), 'dekat') or contains(lower(subregion), 'dekat'))
 and (contains(lower(region_macro), 'jawa') or contains(lower(province), 'jawa'))"""))
def f6_search_clusters(spark, sf_dir):
    rows = serving.cluster_forecasts(geology.area_labels(spark), current(spark, sf_dir), 30, 5.0)
    return serving.search_clusters(rows, "dekat", "Jawa").select("cluster_id", "prob_max")


@query("k3_one_cell", S.stmt(S.QUAKES, S.PUBLIC, """
busy as (select cell_no from quakes where cell_no is not null group by 1 order by count(*) desc, cell_no limit 1)
select a.cell_id, full_label, horizon_days, mag_threshold, probability from fc join busy using (cell_no) join areas a using (cell_no)"""))
def k3_one_cell(spark, sf_dir):
    """All heads of the busiest cell."""
    busy = events(spark, sf_dir).where("cell_no is not null").groupBy("cell_no").count().orderBy(F.desc("count"), "cell_no").limit(1)
    return current(spark, sf_dir).drop("cell_id").join(F.broadcast(busy.select("cell_no")), "cell_no").join(
        F.broadcast(geology.area_labels(spark)), "cell_no").orderBy("horizon_days", "mag_threshold").select(
        "cell_id", "full_label", "horizon_days", "mag_threshold", "probability")


@query("k5_sort_cells", S.stmt(S.QUAKES, S.PUBLIC, """
select a.cell_id, row_number() over (order by nearest_fault_km_r, a.cell_id) as pos_fault, row_number() over (order by full_label, a.cell_id) as pos_name,
 row_number() over (order by probability, a.cell_id) as pos_prob
from (select *, round(nearest_fault_km, 6) as nearest_fault_km_r from areas) a join fc using (cell_no) where horizon_days=30 and mag_threshold=5"""))
def k5_sort_cells(spark, sf_dir):
    """Position of every cell under three of the table sorts (grid-sized)."""
    from pyspark.sql import Window
    rows = serving.latest_forecasts(geology.area_labels(spark), current(spark, sf_dir), 30, 5.0)
    pos = lambda c: F.row_number().over(Window.orderBy(c, "cell_id")).cast("bigint")
    return rows.select("cell_id", pos(F.coalesce(F.round("nearest_fault_km", 6), F.lit(K.MISSING_FAR))).alias("pos_fault"),
                       pos(F.col("full_label")).alias("pos_name"), pos(F.col("probability")).alias("pos_prob"))


@query("k5_sort_fault", S.stmt(S.QUAKES, S.PUBLIC, """
select a.cell_id, full_label, round(nearest_fault_km, 6) as nearest_fault_km, probability from areas a join fc using (cell_no) where horizon_days=30 and mag_threshold=5"""))
def k5_sort_fault(spark, sf_dir):
    rows = serving.latest_forecasts(geology.area_labels(spark), current(spark, sf_dir), 30, 5.0)
    return serving.sort_cells(rows, "fault-asc").select("cell_id", "full_label", F.round("nearest_fault_km", 6).alias("nearest_fault_km"), "probability")


@query("x6_risk_bands", S.stmt(S.QUAKES, S.PUBLIC, """
select cell_id, horizon_days, mag_threshold,
 case when probability < 1e-3 then 'rendah' when probability < 5e-3 then 'rendah-sedang' when probability < 1e-2 then 'sedang' when probability < 2e-2 then 'meningkat' else 'tinggi relatif' end as risk_level,
 case when probability < 5e-3 then '#10b981' when probability < 1e-2 then '#84cc16' when probability < 3e-2 then '#f59e0b' when probability < 6e-2 then '#f97316' else '#ef4444' end as color,
 probability <= 1e-6*101e-2 as at_floor, probability <= 1e-4 as very_low, printf('%.2f%%', probability*100) as pct_text,
 case when probability <= 1e-6*101e-2 then 'data minim' when probability*100 < 1e-2 then '< 0.01%' when probability*100 < 1 then printf('%.2f%%', probability*100) else printf('%.1f%%', probability*100) end as pct_shown
from fc"""))
def x6_risk_bands(spark, sf_dir):
    df = current(spark, sf_dir)
    return df.withColumns(serving.risk_columns(F.col("probability"))).select(
        "cell_id", "horizon_days", "mag_threshold", "risk_level", "color", "at_floor", "very_low", "pct_text", "pct_shown")


@query("a16_evidence", S.stmt(S.QUAKES, S.GRID, "select cell_id, count(*) as n_evidence from quakes join grid using (cell_no) where magnitude >= 45e-1 group by 1"))
def a16_evidence(spark, sf_dir):
    return grid.with_cell_id(priors.evidence(events(spark, sf_dir))).drop("cell_no")


@query("a20_risk_counts", S.stmt(S.QUAKES, S.PUBLIC, """
select count(*) filter (where probability >= 5e-2) as above_5, count(*) filter (where probability >= 8e-2) as above_8 from fc where horizon_days=30 and mag_threshold=5"""))
def a20_risk_counts(spark, sf_dir):
    return serving.one_head(current(spark, sf_dir), 30, 5.0).agg(
        F.count_if(F.col("probability") >= 0.05).alias("above_5"), F.count_if(F.col("probability") >= 0.08).alias("above_8"))


@query("u3_j6_common_cells", S.stmt(S.QUAKES, S.PUBLIC, """
select cell_id from areas where is_offshore intersect select cell_id from grid join hit using (cell_no)""".replace("select cell_id from areas", _HIT + "\nselect cell_id from areas", 1)))
def u3_j6_common_cells(spark, sf_dir):
    hit = events(spark, sf_dir).where("cell_no is not null").select("cell_no")
    return geology.area_labels(spark).where("is_offshore").join(hit, "cell_no", "left_semi").select("cell_id")


__all__ = ["current", "events", "table", "with_heads"]
