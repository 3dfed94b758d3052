"""Evaluation and back-test queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions.heads import to_long
from tremorlake.operators import backtest as B
from tremorlake.operators import evaluation as E
from tremorlake.operators import geology, grid, priors, serving
from tremorlake.operators import labels as L
from tremorlake.operators.features import Snapshots
from tremorlake.plans import sqlparts as S
from tremorlake.plans.fixtures import ISSUES, quakes
from tremorlake.plans.q_catalog import RUNS_SQL, archive_dir
from tremorlake.plans.q_dataset import LABELS_SQL, events
from tremorlake.plans.q_serving import _HIGH, current
from tremorlake.plans.registry import query
from tremorlake.sources import store

NOW = "2001-08-01"
_LONG = ", ".join(f"struct_pack(horizon_days := {h}, mag_threshold := {t}::double, y := label_h{h}_m{int(t * 10)})" for h in K.HORIZONS for t in K.THRESHOLDS)


def scored(spark, sf_dir):
    """Labels of every cell, snapshot and head with Poisson scores of the years before,
    and two baselines: the catalog-wide rate and the long-run Poisson map."""
    ev = events(spark, sf_dir)
    labels = to_long(L.build_labels(ev, Snapshots(*ISSUES)), ["cell_no", "k"], "y").withColumn("y", F.col("y").cast("int"))
    first = ev.agg(F.min("time").cast("string").alias("t")).first()["t"]
    wins = [("model", "1995-01-01 00:00:00", "1998-01-01 00:00:00"), ("long", first, "2001-07-01 00:00:00")]
    both = priors.poisson_forecast(ev, priors.run_windows(spark, wins), 2)
    pick = lambda r: both.where(F.col("run") == r).select("cell_no", *E.HEAD, F.round("p", 9).alias("p"))
    flat = priors.base_rates(ev).select(*E.HEAD, F.round("base_rate", 9).alias("p"))
    return E.align(labels, pick("model"), ["cell_no"], {"poisson": flat, "etas": pick("long")})


_T0, _T1 = "timestamp '1995-01-01'", "timestamp '1998-01-01'"
_SCORED = (S.QUAKES, S.GRID, S.ISSUE_DATES, S.HEADS, S.NEIGHBORS, LABELS_SQL, S.poisson("mdl", _T0, _T1), S.poisson("lng", S.QMIN, S.ASOF), f"""
span as (select greatest(1e0, epoch(max(time)-min(time))/86400e0) as days from quakes),
flat as (select horizon_days, mag_threshold, round(greatest(1e-7, 1-exp(-((select count(*) from quakes where magnitude>=mag_threshold)/(3128e0*days))*horizon_days)), 9) as p from heads, span),
yl as (select cell_no, k, u.horizon_days as horizon_days, u.mag_threshold as mag_threshold, u.y as y from (select cell_no, k, unnest([{_LONG}]) as u from lbl)),
sc as materialized (select y.*, round(m.p, 9) as p, f.p as poisson, round(l.p, 9) as etas from yl y join mdl m using (cell_no, horizon_days, mag_threshold) join lng l using (cell_no, horizon_days, mag_threshold)
  join flat f using (horizon_days, mag_threshold))""")


def r(c, d=6):
    return F.round(c, d).alias(c)


def _ig(b):
    c = lambda x: f"greatest(1e-9, least(1-1e-9, {x}))"
    return f"round(avg(case when y=1 then ln({c('p')})-ln({c(b)}) else ln(1-{c('p')})-ln(1-{c(b)}) end)/ln(2e0), 8) as info_gain_vs_{b}"


@query("e1_e10_scores", S.stmt(*_SCORED, f"""select horizon_days, mag_threshold, count(*) as n, cast(sum(y) as bigint) as positives, round(avg(pow(p-y,2)), 9) as brier,
 round(1-avg(pow(p-y,2))/greatest(1e-9, avg(pow(poisson-y,2))), 6) as bss_vs_poisson, round(1-avg(pow(p-y,2))/greatest(1e-9, avg(pow(etas-y,2))), 6) as bss_vs_etas, {_ig('poisson')}, {_ig('etas')} from sc group by 1,2"""))
def e1_e10_scores(spark, sf_dir):
    return E.scores(scored(spark, sf_dir), ["poisson", "etas"]).select(
        *E.HEAD, "n", "positives", r("brier", 9), r("bss_vs_poisson"), r("bss_vs_etas"), r("info_gain_vs_poisson", 8), r("info_gain_vs_etas", 8))


_AUC = """g as (select horizon_days, mag_threshold, p, count(*) as n, sum(y) as pos from sc group by 1,2,3),
c as (select *, sum(n-pos) over (partition by horizon_days, mag_threshold order by p) - (n-pos) as below from g),
auc as (select horizon_days, mag_threshold, sum(pos*(below + (n-pos)/2e0))/(sum(pos)*sum(n-pos)) as roc_auc from c group by 1,2)"""


@query("e2_roc_auc", S.stmt(*_SCORED, _AUC, "select horizon_days, mag_threshold, round(roc_auc, 9) as roc_auc from auc"))
def e2_roc_auc(spark, sf_dir):
    return E.roc_auc(scored(spark, sf_dir)).select(*E.HEAD, r("roc_auc", 9))


@query("e3_roc_curve", S.stmt(*_SCORED, """g as (select horizon_days, mag_threshold, p, count(*)-sum(y) as neg, sum(y) as pos from sc group by 1,2,3),
c as (select *, sum(pos) over w as tps, sum(neg) over w as fps, lead(pos) over w as pos2, lead(neg) over w as neg2, row_number() over w as i from g window w as (partition by horizon_days, mag_threshold order by p desc)),
f as (select *, row_number() over (partition by horizon_days, mag_threshold order by p desc) as j from c where pos2 is null or pos2<>pos or neg2<>neg or i=1),
z as (select horizon_days, mag_threshold, max(j)+1 as m, max(tps) as tp, max(fps) as fp from f group by 1,2),
idx as (select distinct z.*, case when m > 50 then cast(floor(s*((m-1)/49e0)) as bigint) else s end as j from z, range(0, 100000) t(s) where (m > 50 and s < 50) or (m <= 50 and s < m))
select idx.horizon_days, idx.mag_threshold, idx.j, round(coalesce(fps/fp, 0), 9) as fpr, round(coalesce(tps/tp, 0), 9) as tpr from idx left join f using (horizon_days, mag_threshold, j)"""))
def e3_roc_curve(spark, sf_dir):
    return E.roc_curve(scored(spark, sf_dir)).select(*E.HEAD, "j", r("fpr", 9), r("tpr", 9))


@query("e4_reliability", S.stmt(*_SCORED, """select horizon_days, mag_threshold, cast(least(9, floor(p*10)) as int) as bin, round(avg(p), 8) as predicted_mean, round(avg(y), 8) as observed_freq, count(*) as n, (least(9, floor(p*10))+5e-1)/10 as bin_center from sc group by all"""))
def e4_reliability(spark, sf_dir):
    return E.reliability(scored(spark, sf_dir)).select(*E.HEAD, "bin", r("predicted_mean", 8), r("observed_freq", 8), "n", "bin_center")


@query("e5_molchan", S.stmt(*_SCORED, """t as (select horizon_days, mag_threshold, count(*) as total, sum(y) as ev, count(distinct p) as nd from sc group by 1,2),
ths as (select distinct horizon_days, mag_threshold, round(quantile_cont(p, q.q), 12) as th from sc, (select s/49e0 as q from range(50) x(s)) q join t using (horizon_days, mag_threshold) where nd > 50 group by horizon_days, mag_threshold, q.q
 union select distinct horizon_days, mag_threshold, p from sc join t using (horizon_days, mag_threshold) where nd <= 50 union select horizon_days, mag_threshold, 1.01 from t)
select h.horizon_days, h.mag_threshold, h.th as threshold, round(count(*) filter (where p >= th)/any_value(total)::double, 9) as tau, round(1 - sum(y) filter (where p >= th)/any_value(ev)::double, 9) as nu
from ths h join sc using (horizon_days, mag_threshold) join t using (horizon_days, mag_threshold) where h.th < 1 group by 1,2,3""".replace(
    "quantile_cont(p, q.q), 12) as th from sc, (select s/49e0 as q from range(50) x(s)) q join t using (horizon_days, mag_threshold) where nd > 50 group by horizon_days, mag_threshold, q.q",
    "v, 12) as th from (select horizon_days, mag_threshold, unnest(quantile_cont(p, [" + ", ".join(f"{s}/49e0" for s in range(50)) + "])) as v from sc group by 1,2) join t using (horizon_days, mag_threshold) where nd > 50")))
def e5_molchan(spark, sf_dir):
    out = E.molchan(scored(spark, sf_dir))
    return out.select(*E.HEAD, F.round("threshold", 12).alias("threshold"), r("tau", 9), F.when(F.col("threshold") > 1, 1.0).otherwise(F.round("nu", 9)).alias("nu")).where("threshold < 1")


@query("e6_n_test", S.stmt(*_SCORED, """b as (select horizon_days, mag_threshold, cast(sum(y) as bigint) as observed, sum(p) as predicted from sc group by 1,2),
ks as (select b.*, k, exp(k*ln(predicted)-predicted-lgamma(k+1)) as pk from b, lateral (select unnest(range(observed+1)) as k) t),
c as (select horizon_days, mag_threshold, observed, predicted, least(1, sum(pk)) as lo, case when observed > 0 then 1-least(1, sum(pk) filter (where k < observed)) else 1 end as hi from ks group by 1,2,3,4)
select horizon_days, mag_threshold, observed, round(predicted, 5) as predicted, round(lo, 8) as p_value_low, round(hi, 8) as p_value_high, case when lo >= 25e-3 and hi >= 25e-3 then 'pass' else 'fail' end as status from c"""))
def e6_n_test(spark, sf_dir):
    return E.n_test(scored(spark, sf_dir)).select(*E.HEAD, "observed", r("predicted", 5), r("p_value_low", 8), r("p_value_high", 8), "status")


@query("e7_e8_observed_ll", S.stmt(*_SCORED, """t as (select horizon_days, mag_threshold, sum(p) as sp from sc group by 1,2)
select horizon_days, mag_threshold, round(sum(case when y=1 then ln(greatest(1e-7,least(1-1e-7,p))) else ln(1-greatest(1e-7,least(1-1e-7,p))) end), 4) as joint_ll,
 round(sum(case when y=1 then ln(greatest(1e-9,least(1,p/sp))) else 0 end), 4) as spatial_ll from sc join t using (horizon_days, mag_threshold) group by 1,2"""))
def e7_e8_observed_ll(spark, sf_dir):
    return E.observed_likelihoods(scored(spark, sf_dir)).select(*E.HEAD, r("joint_ll", 4), r("spatial_ll", 4))


@query("e7_l_test")
def e7_l_test(spark, sf_dir):
    return E.l_test(scored(spark, sf_dir))


@query("e8_s_test")
def e8_s_test(spark, sf_dir):
    return E.s_test(scored(spark, sf_dir))


@query("e9_consistency_tests")
def e9_consistency_tests(spark, sf_dir):
    """All three tests per head."""
    return E.consistency_tests(scored(spark, sf_dir)).select(*E.HEAD, "test", "status", "quantile")


@query("e11_evaluate", S.stmt(*_SCORED, _AUC, f"""b as (select horizon_days, mag_threshold, count(*) as n, round(avg(pow(p-y,2)), 9) as brier, round(1-avg(pow(p-y,2))/greatest(1e-9, avg(pow(poisson-y,2))), 6) as bss_vs_poisson, {_ig('etas')},
 cast(sum(y) as bigint) as positives, round(sum(p), 5) as predicted from sc group by 1,2)
select b.*, round(roc_auc, 9) as roc_auc from b join auc using (horizon_days, mag_threshold)"""))
def e11_evaluate(spark, sf_dir):
    return E.evaluate(scored(spark, sf_dir), ["poisson", "etas"]).select(
        *E.HEAD, "n", r("brier", 9), r("bss_vs_poisson"), r("info_gain_vs_etas", 8), "positives", r("predicted", 5), r("roc_auc", 9))


def _marked(spark, sf_dir, where):
    high = serving.high_risk(geology.area_labels(spark), current(spark, sf_dir), 30, 5.0)
    return B.mark_hits(events(spark, sf_dir).where("magnitude >= 5").where(where), high), high


_MARK = """mk as materialized (select q.*, h.cell_id, h.full_label, h.probability, h.cell_no is not null as hit from quakes q left join high h using (cell_no) where magnitude >= 5)"""


@query("e12_performance", S.stmt(S.QUAKES, S.PUBLIC, _HIGH, _MARK, """y as (select *, time >= timestamp '2001-08-01' - interval 30 day as m from mk where time >= timestamp '2001-08-01' - interval 365 day and time <= timestamp '2001-08-01'),
a as (select count(*) as e, count(*) filter (where m) as e30, count(*) filter (where hit) as h, count(*) filter (where hit and m) as h30, count(distinct cell_no) filter (where hit) as c from y), n as (select count(*) as n from high)
select n as high_risk_cells, e30 as events_30d, e as events_365d, c as high_risk_cells_with_event, round(h30/nullif(e30,0)::double, 4) as hit_rate_30d, round(h/nullif(e,0)::double, 4) as hit_rate_365d,
 round((n-c)/n::double, 4) as false_alarm_rate, round(c/n::double, 4) as precision from a, n"""))
def e12_performance(spark, sf_dir):
    marked, high = _marked(spark, sf_dir, "true")
    return B.performance(marked, high, NOW)


@query("e12_a23_monthly", S.stmt(S.QUAKES, S.PUBLIC, _HIGH, _MARK, """select strftime(time, '%Y-%m') as month, count(*) as events, count(*) filter (where hit) as hits, count(*) filter (where not hit) as misses, round(count(*) filter (where hit)/count(*)::double, 4) as hit_rate
from mk where time <= timestamp '2001-08-01' group by 1 order by 1 desc limit 12"""))
def e12_a23_monthly(spark, sf_dir):
    marked, _ = _marked(spark, sf_dir, f"time <= timestamp'{NOW}'")
    return B.monthly(marked, 12)


_PERIOD = "time >= timestamp'1999-01-01' and time < timestamp'2000-07-01'"


@query("e13_g16_backtest_events", S.stmt(S.QUAKES, S.PUBLIC, _HIGH, _MARK, f"select event_id, time, magnitude, hit, cell_id as matched_cell_id, full_label as matched_label, probability as matched_probability from mk where {_PERIOD}"))
def e13_g16_backtest_events(spark, sf_dir):
    marked, _ = _marked(spark, sf_dir, _PERIOD)
    return marked.select("event_id", F.col("time").cast("timestamp_ntz").alias("time"), "magnitude", "hit", F.col("cell_id").alias("matched_cell_id"),
                         F.col("full_label").alias("matched_label"), F.col("probability").alias("matched_probability"))


@query("e13_backtest_summary", S.stmt(S.QUAKES, S.PUBLIC, _HIGH, _MARK, f"""a as (select count(*) as events, count(*) filter (where hit) as hits, count(distinct cell_no) filter (where hit) as c from mk where {_PERIOD}), n as (select count(*) as n from high)
select events, hits, events-hits as misses, round(hits/events::double, 4) as hit_rate, c as high_risk_cells_hit, n-c as false_alarm_cells, round((n-c)/n::double, 4) as false_alarm_rate from a, n"""))
def e13_backtest_summary(spark, sf_dir):
    return B.period_summary(*_marked(spark, sf_dir, _PERIOD))


def _pre_event(spark, sf_dir):
    path = archive_dir(spark, sf_dir)
    ev = grid.with_cell_no(quakes(spark, sf_dir)).where("magnitude >= 6").select("event_id", "time", "cell_no")
    runs = store.archive_runs(spark, path).select(F.col("forecast_run_id").alias("run"), "issued_at")
    ids = F.broadcast(grid.cells(spark).select("cell_id", "cell_no"))
    maps = store.archive(spark, path).drop("run").withColumnRenamed("forecast_run_id", "run").join(ids, "cell_id")
    return B.pre_event_ranks(ev, runs, maps, 6.0, 300.0)


_LEADS = "leads as (select * from (values ('last_before', 0), ('1h_before', 3600), ('6h_before', 21600), ('24h_before', 86400), ('7d_before', 604800)) x(lead, s))"
_CHOSEN = """cho as materialized (select q.event_id, q.cell_no, l.lead, arg_max(i.run_id, i.issued_at) as run_id from quakes q cross join leads l join issues i on i.issued_at <= q.time - to_seconds(l.s) where q.magnitude >= 6 and q.cell_no is not null group by 1,2,3)"""
_PRE = f"""rk as materialized (select run_id, cell_no, cell_id, horizon_days, p, rank() over (partition by run_id, horizon_days order by p desc) as rnk, round(cume_dist() over (partition by run_id, horizon_days order by p)*100, 2) as percentile from runs where mag_threshold = 6),
prs as materialized (select a.cell_no, b.cell_no as other_no, greatest(abs(a.i-b.i), abs(a.j-b.j)) as ring, {S.hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} as d from grid a join grid b on abs(a.i-b.i) <= 8 and abs(a.j-b.j) <= 8),
ar as materialized (select c.run_id, c.cell_no, k.horizon_days, min((k.rnk, k.cell_id)) filter (where ring <= 1) as b1, min((k.rnk, k.cell_id)) filter (where ring <= 2) as b2, min((k.rnk, k.cell_id)) filter (where d <= 100) as b3, min((k.rnk, k.cell_id)) filter (where d <= 300) as b4
  from (select distinct run_id, cell_no from cho) c join prs p using (cell_no) join rk k on k.run_id=c.run_id and k.cell_no=p.other_no where ring <= 2 or d <= 300 group by 1,2,3),
pre as materialized (select c.event_id, c.lead, k.horizon_days, k.run_id, k.p as probability, k.rnk, k.percentile, round(1e0/rnk, 6) as reciprocal_rank, round(case when rnk <= 10 then 1/log2(rnk+1e0) else 0 end, 6) as ndcg10,
  b1[1] as ring1_best_rank, b2[1] as ring2_best_rank, b3[1] as cluster100_best_rank, b4[1] as cluster_best_rank, b4[2] as cluster_best_cell_id
  from cho c join rk k on k.run_id=c.run_id and k.cell_no=c.cell_no join ar a on a.run_id=c.run_id and a.cell_no=c.cell_no and a.horizon_days=k.horizon_days)"""


@query("e14_j7_w2_w3_pre_event", S.stmt(S.QUAKES, S.GRID, RUNS_SQL, _LEADS, _CHOSEN, _PRE, """select event_id, lead, horizon_days, run_id as run, probability, rnk as "rank", percentile, reciprocal_rank, ndcg10, rnk <= 100 as top100,
 ring1_best_rank, ring2_best_rank, cluster100_best_rank, cluster_best_rank, cluster_best_cell_id, cluster_best_rank <= 10 as cluster_top10 from pre"""))
def e14_j7_w2_w3_pre_event(spark, sf_dir):
    return _pre_event(spark, sf_dir).select(
        "event_id", "lead", "horizon_days", "run", "probability", "rank", "percentile", "reciprocal_rank", "ndcg10", "top100",
        "ring1_best_rank", "ring2_best_rank", "cluster100_best_rank", "cluster_best_rank", "cluster_best_cell_id", "cluster_top10")


@query("e15_w6_rank_summary", S.stmt(S.QUAKES, S.GRID, RUNS_SQL, _LEADS, _CHOSEN, _PRE, """select lead, horizon_days, count(*) as events, round(avg((rnk <= 10)::int), 4) as top10_hit_rate, round(avg((rnk <= 100)::int), 4) as top100_hit_rate,
 round(avg((ring1_best_rank <= 10)::int), 4) as ring1_top10_hit_rate, round(avg((cluster_best_rank <= 10)::int), 4) as cluster_top10_hit_rate, round(avg(reciprocal_rank), 5) as mrr, round(avg(ndcg10), 5) as ndcg10,
 list_sort(list(rnk))[count(*)//2+1] as median_rank from pre group by 1,2"""))
def e15_w6_rank_summary(spark, sf_dir):
    return B.rank_summary(_pre_event(spark, sf_dir)).select(
        "lead", "horizon_days", "events", "top10_hit_rate", "top100_hit_rate", "ring1_top10_hit_rate", "cluster_top10_hit_rate",
        F.round("mrr", 5).alias("mrr"), F.round("ndcg10", 5).alias("ndcg10"), "median_rank")
