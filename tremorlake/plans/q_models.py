"""Aftershock process, ensemble and learning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions.heads import HEADS, head_name
from tremorlake.operators import ensemble, etas, geology, grid, learning, priors, serving
from tremorlake.plans import sqlparts as S
from tremorlake.plans.fixtures import AS_OF, quakes
from tremorlake.plans.q_dataset import LABELS_SQL, dataset
from tremorlake.plans.q_serving import RECENT, events
from tremorlake.plans.registry import query
from tremorlake.session import scratch_path

START, END = RECENT
P0 = dict(K.ETAS_START)


def _past(spark, sf_dir, mc=K.ETAS_MC):
    return etas.history(quakes(spark, sf_dir), START, END, mc), etas.window_length(spark, START, END)


def r(c, d=6):
    return F.round(c, d).alias(c)


def _hist(mc):
    return f"""h as materialized (select event_id, epoch_us(time - timestamp '{START}')/864e8 as t, magnitude as m, lat, lon from quakes where time between timestamp '{START}' and timestamp '{END}' and magnitude >= {mc}),
te as (select epoch_us(timestamp '{END}' - timestamp '{START}')/864e8 as t_end)"""


_LL = """s as (select a.event_id, any_value(a.m) as m, any_value(a.t) as t, sum(exp({alpha}*(b.m-45e-1))*pow(a.t-b.t+{c}, -{p}::double)) as tr from h a left join h b on b.t < a.t or (b.t = a.t and b.event_id < a.event_id) group by 1)"""


@query("m17_etas_loglik", S.stmt(S.QUAKES, _hist("45e-1"), _LL.format(alpha="15e-1", c="1e-2", p="11e-1"), """
select round(sum(ln(greatest(1e-12, 5e-2 + 2e-2*coalesce(tr,0)))) - 5e-2*any_value(t_end) - sum(2e-2*exp(15e-1*(m-45e-1))*(pow(t_end-t+1e-2, -1e-1) - pow(1e-2, -1e-1))/(-1e-1)) filter (where t < t_end), 4) as loglik, count(*) as n_events from s, te"""))
def m17_etas_loglik(spark, sf_dir):
    """Log-likelihood of the published start parameters over five years."""
    past, t_end = _past(spark, sf_dir)
    ll = etas.log_likelihoods(past, t_end, [P0])
    n = past.agg(F.count("*").alias("n_events")).withColumn("candidate", F.lit(0))
    return ll.join(n, "candidate").select(F.round("loglik", 4).alias("loglik"), "n_events")


@query("m18_etas_fit")
def m18_etas_fit(spark, sf_dir):
    """Best parameters of the refined grid."""
    past, t_end = _past(spark, sf_dir)
    best, ll = etas.fit(past, t_end)
    return spark.range(1).select(*[F.lit(best[k]).alias(k) for k in etas.PARAMS], F.lit(ll).alias("loglik"))


_FIELD = f"""fld as materialized (select g.cell_no, 5e-2/75e5 + coalesce(sum(least(95e-2, 2e-2*exp(15e-1*(h.m-45e-1))*pow(t_end-h.t+1e-2, -11e-1)
  * (5e-1/(pi()*pow(2e0*exp(5e-1*(h.m-45e-1)),2)))*pow(1+pow({S.hav('round_even(g.lat*10,0)/10', 'round_even(g.lon*10,0)/10', 'h.lat', 'h.lon')}/(2e0*exp(5e-1*(h.m-45e-1))),2), -15e-1))) filter (where h.t < t_end), 0) as rate
  from grid g, h, te group by 1)"""


@query("m19_rate_field", S.stmt(S.QUAKES, S.GRID, _hist("0"), _FIELD, "select cell_id, round(rate*1e6, 8) as rate_per_1e6 from fld join grid using (cell_no)"))
def m19_rate_field(spark, sf_dir):
    past, t_end = _past(spark, sf_dir, 0.0)
    return grid.with_cell_id(etas.rate_field(past, t_end, P0)).select("cell_id", F.round(F.col("rate") * 1e6, 8).alias("rate_per_1e6"))


@query("m20_etas_forecast", S.stmt(S.QUAKES, S.GRID, S.HEADS, _hist("45e-1"), _FIELD, """b as (select cell_no, case when count(*) filter (where magnitude >= 45e-1) >= 10 and avg(magnitude) filter (where magnitude >= 45e-1) > 45e-1
  then log10(exp(1e0))/(avg(magnitude) filter (where magnitude >= 45e-1)-45e-1) else 1 end as b from quakes where cell_no is not null group by 1)
select cell_id, horizon_days, mag_threshold, round(greatest(0, least(1, 1-exp(-rate*2500*pow(1e1, -coalesce(b,1)*(mag_threshold-45e-1))*horizon_days))), 9) as p from fld cross join heads left join b using (cell_no) join grid using (cell_no)"""))
def m20_etas_forecast(spark, sf_dir):
    """Probabilities with a b-value per cell."""
    from tremorlake.operators.catalog_stats import b_values
    past, t_end = _past(spark, sf_dir)
    b = b_values(events(spark, sf_dir).where("cell_no is not null"), ["cell_no"], 4.5, min_events=10)
    return grid.with_cell_id(etas.forecast(etas.rate_field(past, t_end, P0), b_value=b)).select("cell_id", "horizon_days", "mag_threshold", r("p", 9))


@query("m16_forecast_etas")
def m16_forecast_etas(spark, sf_dir):
    """The aftershock tier of a run: the m20 frame (compared with SQL there), made monotone and tagged."""
    past, t_end = _past(spark, sf_dir)
    frame = etas.forecast(etas.rate_field(past, t_end, P0))
    out, mode, tag = serving.run_forecast(events(spark, sf_dir), geology.area_labels(spark), AS_OF, etas=frame)
    return grid.with_cell_id(out).select("cell_id", "horizon_days", "mag_threshold", r("probability", 9), F.lit(mode).alias("mode"), F.lit(tag).alias("baseline_type"))


_DECAY = f"""ref as (select event_id as name, time as rt, lat as rlat, lon as rlon from quakes where time >= timestamp '2000-06-01' order by magnitude desc, event_id limit 3),
p as (select name, magnitude as m, epoch_us(rt-time)/864e8 as age, {S.hav('rlat', 'rlon', 'lat', 'lon')} as d from ref join quakes on time <= rt and time >= rt - interval 1825 day),
dy as (select name, dd as day, (sum(least(95e-2, 2e-2*exp(15e-1*(m-45e-1))*pow(age+dd+1e-2, -11e-1)*(5e-1/(pi()*pow(2e0*exp(5e-1*(m-45e-1)),2)))*pow(1+pow(d/(2e0*exp(5e-1*(m-45e-1))),2), -15e-1))) + 5e-2/75e5)*2500 as rate from p, range(1, 61) x(dd) group by 1,2)"""


@query("m21_decay_check", S.stmt(S.QUAKES, _DECAY, "select name, round(-regr_slope(log10(rate), log10(day)), 6) as p_estimate, -regr_slope(log10(rate), log10(day)) between 8e-1 and 15e-1 as in_range from dy group by 1"))
def m21_decay_check(spark, sf_dir):
    """The three largest late events stand for the reference mainshocks."""
    q = quakes(spark, sf_dir)
    ref = q.where(F.col("time") >= F.lit("2000-06-01").cast("timestamp")).orderBy(F.desc("magnitude"), "event_id").limit(3).select(
        F.col("event_id").alias("name"), "time", "lat", "lon")
    return etas.decay_check(q, ref, P0).select("name", r("p_estimate"), "in_range")


# --- ensemble with given scores ------------------------------------------------------------

def _scores(spark, sf_dir):
    p = priors.poisson_forecast(events(spark, sf_dir), priors.run_windows(spark, [("now", START, END)])).drop("run")
    return p.select("cell_no", *ensemble.HEAD, F.least(F.lit(0.99), F.col("p") * 3).alias("p1"), F.least(F.lit(0.99), F.col("p") * 0.5 + 0.01).alias("p2"),
                    F.col("p").alias("prior"))


_SC = (S.QUAKES, S.GRID, S.HEADS, S.poisson("rec", f"timestamp '{START}'", f"timestamp '{END}'"), """
span as (select greatest(1e0, epoch(max(time)-min(time))/86400e0) as days from quakes),
br as (select horizon_days, mag_threshold, greatest(1e-7, 1-exp(-((select count(*) from quakes where magnitude>=mag_threshold)/(3128e0*days))*horizon_days)) as base_rate from heads, span),
sc as (select cell_no, horizon_days, mag_threshold, least(99e-2, p*3) as p1, least(99e-2, p*5e-1+1e-2) as p2, p as prior from rec)""")


def _compress_sql(src, out):
    lg = lambda x: f"ln(greatest(1e-7,least(1-1e-7,{x}))/(1-greatest(1e-7,least(1-1e-7,{x}))))"
    return f"""{out}_s as (select horizon_days, mag_threshold, median(greatest(1e-7,least(1-1e-7,p))) as med, min({lg('p')}) as lo, max({lg('p')}) as hi from {src} group by 1,2),
{out}_c as (select c.*, base_rate, {lg('base_rate')} as tg, {lg('least(base_rate*15, 5e-1)')} as tp from {out}_s c join br using (horizon_days, mag_threshold)),
{out} as (select s.cell_no, s.horizon_days, s.mag_threshold, s.prior, case when hi-lo < 1e-7 then base_rate else greatest(1e-7, least(1-1e-7,
  1/(1+exp(-(greatest(5e-2, least(1, (tp-tg)*2/(hi-lo)))*{lg('p')} + tg - greatest(5e-2, least(1, (tp-tg)*2/(hi-lo)))*{lg('med')}))))) end as p from {src} s join {out}_c using (horizon_days, mag_threshold))"""


@query("m10_compress", S.stmt(*_SC, "raw as (select cell_no, horizon_days, mag_threshold, prior, p1 as p from sc)", _compress_sql("raw", "cmp"), "select cell_id, horizon_days, mag_threshold, round(p, 9) as p from cmp join grid using (cell_no)"))
def m10_compress(spark, sf_dir):
    raw = _scores(spark, sf_dir).select("cell_no", *ensemble.HEAD, F.col("p1").alias("p"))
    return grid.with_cell_id(ensemble.compress(raw, priors.base_rates(quakes(spark, sf_dir)), ensemble.HEAD)).select("cell_id", *ensemble.HEAD, r("p", 9))


@query("m9_blend", S.stmt(*_SC, """bl as (select *, 4e-1*p1+4e-1*p2+2e-1*prior as q from sc),
raw as (select cell_no, horizon_days, mag_threshold, prior, greatest(1e-6,least(1-1e-6,q)) as p from bl where horizon_days = 7),""" + _compress_sql("raw", "cmp") + """,
cal as (select cell_no, horizon_days, mag_threshold, prior, p from cmp union all select cell_no, horizon_days, mag_threshold, prior,
  1/(1+exp(-(9e-1*ln(greatest(1e-6,least(1-1e-6,q))/(1-greatest(1e-6,least(1-1e-6,q)))) - 2e-1))) from bl where horizon_days <> 7),
evd as (select cell_no, count(*) as n from quakes where magnitude >= 45e-1 and cell_no is not null group by 1)
select cell_id, horizon_days, mag_threshold, round(greatest(1e-6, least(1-1e-6, case when prior > 0 then (greatest(coalesce(n,0),1)*p + 5*prior)/(greatest(coalesce(n,0),1)+5) else p end)), 9) as p
from cal left join evd using (cell_no) join grid using (cell_no)"""))
def m9_blend(spark, sf_dir):
    """Given learner scores blended, calibrated (7-day heads are not) and pulled to the prior."""
    s = _scores(spark, sf_dir)
    cal = priors.fallback_rates(spark.range(1)).select(
        *ensemble.HEAD, F.when(F.col("horizon_days") == 7, "identity").otherwise("platt").alias("kind"), F.lit(0.9).alias("a"), F.lit(0.0).alias("b"),
        F.lit(-0.2).alias("c"), F.array(F.lit(0.0)).alias("xs"), F.array(F.lit(0.0)).alias("ys"))
    out = ensemble.blend(s.drop("prior"), s.select("cell_no", *ensemble.HEAD, "prior"), cal, priors.base_rates(quakes(spark, sf_dir)),
                         priors.evidence(events(spark, sf_dir)), [])
    return grid.with_cell_id(out).select("cell_id", *ensemble.HEAD, r("p", 9))


_SCORED: dict[tuple[str, str], str] = {}


def _scored(spark, sf_dir):
    """Scores of all heads, trained once per application and table folder and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SCORED:
        path = scratch_path(spark, "scored")
        learning.train_and_score_heads(dataset(spark, sf_dir)).write.parquet(path)
        _SCORED[key] = path
    return spark.read.parquet(_SCORED[key])


@query("m12_m15_learn")
def m12_m15_learn(spark, sf_dir):
    """Two tree learners, calibration and scores of all heads, trained on the labelled frame."""
    return _scored(spark, sf_dir).drop("brier", "brier_identity")


@query("m12_m15_facts", S.stmt(S.QUAKES, S.GRID, S.SNAPS, S.NEIGHBORS, LABELS_SQL, " union all ".join(
    f"select cell_id, k, {h} as horizon_days, cast({t} as double) as mag_threshold, {head_name(h, t)} as y, true as scores_are_probabilities, true as calibration_helps "
    "from lbl where snapshot > timestamp '2000-12-31 23:59:00' + interval 60 day" for h, t in HEADS)))
def m12_m15_facts(spark, sf_dir):
    """What must hold of every score: later snapshots of every cell and head with their labels, probabilities, no calibrator worse than none."""
    inside = lambda c: F.col(c).between(0.0, 1.0)
    return _scored(spark, sf_dir).select("cell_id", "k", "horizon_days", "mag_threshold", "y", (inside("p1") & inside("p2") & inside("p")).alias("scores_are_probabilities"),
                                         F.coalesce(F.col("brier") <= F.col("brier_identity"), F.lit(True)).alias("calibration_helps"))


__all__ = ["AS_OF"]
