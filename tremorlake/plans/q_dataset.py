"""Feature, label and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions.heads import HEADS, head_columns, head_name
from tremorlake.operators import features as X
from tremorlake.operators import labels as L
from tremorlake.operators.catalog_stats import mc_lookup
from tremorlake.operators.grid import with_cell_id, with_cell_no
from tremorlake.plans import sqlparts as S
from tremorlake.plans.fixtures import SNAP_DAYS, quakes
from tremorlake.plans.q_events import _MC
from tremorlake.plans.registry import query

def events(spark, sf_dir):
    """Catalog with cell numbers; depth 0 stands for a missing depth."""
    return with_cell_no(quakes(spark, sf_dir)).withColumn("depth", F.nullif("depth", F.lit(0.0)))


_SNAPS: dict[tuple[str, str], X.Snapshots] = {}


def weekly(spark, sf_dir) -> X.Snapshots:
    """Weekly snapshots over the span of the catalog, found once per application and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SNAPS:
        _SNAPS[key] = X.Snapshots.over(quakes(spark, sf_dir), SNAP_DAYS)
    return _SNAPS[key]


def stats(spark, sf_dir):
    ev, snaps = events(spark, sf_dir), weekly(spark, sf_dir)
    return X.window_stats(X.daily(ev, snaps), mc_lookup(ev), snaps)


def named(df, *cols):
    return with_cell_id(df).select("cell_id", "k", *cols)


def r(c, d=6):
    return F.round(c, d).alias(c)


_W = """ev as materialized (select *, nullif(depth,0) as dep from quakes where cell_no is not null),
win as materialized (select e.cell_no, s.k, s.snapshot, e.event_id, e.time, e.lat, e.lon, e.magnitude as m, e.dep, epoch_us(s.snapshot)-epoch_us(e.time) as age
  from ev e join snaps s on e.time <= s.snapshot and e.time >= s.snapshot - interval 1095 day)"""
_D = "864e8::bigint"


def _d(days):
    return f"age <= {days}*86400000000"


_BASE = (S.QUAKES, S.GRID, S.SNAPS, _W)


@query("b1_snapshots", S.stmt(S.QUAKES, S.SNAPS, "select k, snapshot, count(event_id) as n_before from snaps left join quakes on time <= snapshot group by 1,2"))
def b1_snapshots(spark, sf_dir):
    """Regular snapshots with the number of events before each."""
    series = weekly(spark, sf_dir)
    snaps = X.snapshot_times(spark, series)
    step = series.every * X.DAY_US
    first = F.greatest(F.lit(0), F.ceil((F.unix_micros("time") - series.origin) / F.lit(float(step))).cast("int"))
    per = quakes(spark, sf_dir).groupBy(first.alias("k")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # one row per snapshot
    return snaps.join(per, "k", "left").select("k", F.col("snapshot").cast("timestamp_ntz").alias("snapshot"),
                                               F.sum(F.coalesce("n", F.lit(0))).over(upto).alias("n_before"))


@query("a1_window_counts", S.stmt(*_BASE, f"""select cell_id, k, cast(count(*) filter (where {_d(30)}) as double) as event_count_30d, cast(count(*) filter (where {_d(90)}) as double) as event_count_90d,
 cast(count(*) filter (where {_d(365)}) as double) as event_count_365d, coalesce(max(m) filter (where {_d(30)}), 0) as max_mag_30d, coalesce(max(m) filter (where {_d(90)}), 0) as max_mag_90d
 from win join grid using (cell_no) group by 1,2"""))
def a1_window_counts(spark, sf_dir):
    return named(stats(spark, sf_dir), "event_count_30d", "event_count_90d", "event_count_365d", "max_mag_30d", "max_mag_90d")


@query("a2_depth_stats", S.stmt(*_BASE, f"""select cell_id, k, round(case when count(*) filter (where {_d(30)}) = 0 then 0 when count(*) filter (where {_d(30)} and dep is null) > 0 then 'nan'::double else avg(dep) filter (where {_d(30)}) end, 6) as mean_depth_30d,
 round(case when count(*) filter (where {_d(30)}) < 2 then 0 when count(*) filter (where {_d(30)} and dep is null) > 0 then 'nan'::double else stddev_pop(dep) filter (where {_d(30)}) end, 6) as std_depth_30d
 from win join grid using (cell_no) group by 1,2"""))
def a2_depth_stats(spark, sf_dir):
    return named(stats(spark, sf_dir), r("mean_depth_30d"), r("std_depth_30d"))


@query("a3_energy", S.stmt(*_BASE, f"""select cell_id, k, round(coalesce(log10(sum(pow(1e1, 15e-1*m+48e-1)) filter (where {_d(30)})), 0), 6) as log_energy_30d,
 round(coalesce(sum(pow(1e1, 15e-1*m+48e-1)) filter (where {_d(30)}) / sum(pow(1e1, 15e-1*m+48e-1)) filter (where {_d(365)}), 0), 6) as moment_release_ratio_30d_vs_365d from win join grid using (cell_no) group by 1,2"""))
def a3_energy(spark, sf_dir):
    return named(stats(spark, sf_dir), r("log_energy_30d"), r("moment_release_ratio_30d_vs_365d"))


_MCK = f"""mck as materialized (select g.cell_no, s.k, coalesce(m.mc, 4e0) as mc from grid g cross join snaps s left join mcs m on m.epoch_start >= 2000 and m.region = {S.macro('g.lat', 'g.lon')}
  and year(s.snapshot) >= m.epoch_start and year(s.snapshot) < m.epoch_end)"""


def _b(days):
    cond = f"{_d(days)} and m >= mc"
    return f"round(case when count(*) filter (where {cond}) >= 5 then log10(exp(1e0))/(avg(m) filter (where {cond}) - (any_value(mc)-5e-2)) else 1 end, 6) as b_value_{days}d"


@query("a4_b_values", S.stmt(*_BASE, _MC, _MCK, f"select cell_id, k, {_b(90)}, {_b(365)}, {_b(1095)} from win join mck using (cell_no, k) join grid using (cell_no) group by 1,2"))
def a4_b_values(spark, sf_dir):
    return named(stats(spark, sf_dir), r("b_value_90d"), r("b_value_365d"), r("b_value_1095d"))


_SLOPE = f"""yr as (select cell_no, k, epoch_us(time)//1000000 as t, m from win where {_d(365)}),
sp as (select cell_no, k, min(t) as t0, max(t) as t1 from yr group by 1,2 having count(*) > 50 and max(t)-min(t) >= 180*86400),
sub as (select y.cell_no, y.k, w.w, count(*) as n, count(*) filter (where m >= mc) as na, avg(m) filter (where m >= mc) as ma, any_value(mc) as mc from yr y join sp using (cell_no, k) join mck using (cell_no, k)
  join range(4) w(w) on y.t >= t0 + w.w*7776000 and y.t <= t0 + (w.w+1)*7776000 and t0 + (w.w+1)*7776000 <= t1 group by 1,2,3),
slope as (select cell_no, k, regr_slope(log10(exp(1e0))/(ma-(mc-5e-2)), w*9e1) as s from sub where n >= 10 and na >= 5 group by 1,2 having count(*) >= 3)"""


@query("a5_b_slope", S.stmt(S.QUAKES, S.GRID, S.SNAPS, _W.replace("ev as materialized (select *, nullif(depth,0) as dep from quakes", "ev as materialized (select * replace (cell_no//460*460 as cell_no), nullif(depth,0) as dep from quakes"),
       _MC, _MCK, _SLOPE, "select cell_id, k, round(s, 9) as b_value_slope_1y from slope join grid using (cell_no)"))
def a5_b_slope(spark, sf_dir):
    """Cells are merged to bands of five grid rows, so that groups are busy enough to qualify."""
    ev = events(spark, sf_dir).withColumn("cell_no", (F.floor(F.col("cell_no") / 460) * 460).cast("int"))
    snaps = weekly(spark, sf_dir)
    busy = X.window_stats(X.daily(ev, snaps), mc_lookup(ev), snaps)
    return named(X.b_slopes(ev, busy, snaps), r("b_value_slope_1y", 9))


_GAPS = f"""gp as (select cell_no, k, epoch_us(time)//1000000 - lag(epoch_us(time)//1000000) over (partition by cell_no, k order by time, event_id) as g from win where {_d(30)}),
iet as (select cell_no, k, case when count(*) >= 3 then avg(g) else 0 end as mu, case when count(*) >= 3 then coalesce(stddev_pop(g)/nullif(avg(g),0), 0) else 0 end as cv from gp group by 1,2)"""


@query("a6_gap_stats", S.stmt(*_BASE, _GAPS, "select cell_id, k, round(mu, 4) as iet_mean_30d, round(cv, 5) as iet_cv_30d from iet join grid using (cell_no)"))
def a6_gap_stats(spark, sf_dir):
    return named(X.gap_stats(events(spark, sf_dir), weekly(spark, sf_dir)), r("iet_mean_30d", 4), r("iet_cv_30d", 5))


_LAST = """lst as (select e.cell_no, s.k, (epoch_us(any_value(s.snapshot)) - epoch_us(max(time) filter (where magnitude >= 4)))/864e8 as t4,
  (epoch_us(any_value(s.snapshot)) - epoch_us(max(time) filter (where magnitude >= 5)))/864e8 as t5 from ev e join snaps s on e.time <= s.snapshot where magnitude >= 4 group by 1,2)"""


@query("a7_time_since", S.stmt(*_BASE, _LAST, "select cell_id, k, round(t4, 8) as time_since_last_M4_days, round(t5, 8) as time_since_last_M5_days from lst join grid using (cell_no)"))
def a7_time_since(spark, sf_dir):
    return named(X.last_large(events(spark, sf_dir), weekly(spark, sf_dir)), r("time_since_last_M4_days", 8), r("time_since_last_M5_days", 8))


_TREND = f"""bn as (select cell_no, k, least(11, (epoch_us(time) - epoch_us(snapshot) + 84*86400000000)//604800000000) as x from win where {_d(84)}),
n9 as (select cell_no, k, count(*) as n90 from win where {_d(90)} group by 1,2),
trend as (select cell_no, k, case when any_value(n90) >= 5 then (sum(x) - 55e-1*count(*))/143e0 else 0 end as t from bn join n9 using (cell_no, k) group by 1,2)"""


@query("a8_activity_trend", S.stmt(*_BASE, _TREND, "select cell_id, k, round(t, 6) as activity_trend_90d from trend join grid using (cell_no) where t <> 0"))
def a8_activity_trend(spark, sf_dir):
    return named(stats(spark, sf_dir).where("activity_trend_90d <> 0"), r("activity_trend_90d"))


@query("a9_neighbor_stats", S.stmt(*_BASE, S.NEIGHBORS, f"""c30 as (select cell_no, k, count(*) as n, max(m) as x from win where {_d(30)} group by 1,2)
select cell_id, c.k, round(sum(n)/8e0, 6) as neighbor_event_count_30d_mean, max(x) as neighbor_max_mag_30d_max from c30 c join nbr b on b.other_no = c.cell_no join grid g on g.cell_no = b.cell_no group by 1,2"""))
def a9_neighbor_stats(spark, sf_dir):
    return named(X.neighbor_stats(stats(spark, sf_dir)), r("neighbor_event_count_30d_mean"), "neighbor_max_mag_30d_max")


_SHORT_COLS = []
for _r in K.SHORT_RADII_KM:
    _c = "dist_km <= 100" if _r == 100 else "true"
    for _m, _t in K.SHORT_THRESHOLDS:
        for _w, _h in K.SHORT_WINDOWS_HOURS:
            _SHORT_COLS.append(f"cast(count(*) filter (where {_c} and m >= {_t} and age <= {_h}*3600000000) as double) as count_{_m}_{_w}_r{_r}km")
    _SHORT_COLS.append(f"round(coalesce(log10(sum(pow(1e1, 15e-1*m+48e-1)) filter (where {_c})), 0), 6) as log_energy_7d_r{_r}km")
    _SHORT_COLS.append(f"round(case when count(*) filter (where {_c}) = 0 then 0 else (count(*) filter (where {_c} and m >= 45e-1 and age <= 86400000000)+1e-1)/(count(*) filter (where {_c} and m >= 45e-1)/7e0+1e-1) end, 6) as rate_ratio_24h_vs_7d_r{_r}km")
for _m, _t in (("M5", 5), ("M6", 6)):
    _SHORT_COLS.append(f"round(coalesce(min(d) filter (where m >= {_t}), 9999), 6) as nearest_{_m}_dist_km")
    _SHORT_COLS.append(f"round(coalesce(arg_min(age/864e8, (d, age)) filter (where m >= {_t}), 9999), 6) as nearest_{_m}_time_days")
_SHORT = f"""near3 as materialized (select a.cell_no, b.cell_no as other_no, {S.hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} as dist_km from grid a join grid b on abs(a.i-b.i) <= 8 and abs(a.j-b.j) <= 8
  where {S.hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 3e2),
sh as (select n.cell_no, w.k, w.m, w.age, n.dist_km, {S.hav('g.lat', 'g.lon', 'w.lat', 'w.lon')} as d from win w join near3 n on n.other_no = w.cell_no join grid g on g.cell_no = n.cell_no where w.age <= 7*86400000000),
short as materialized (select cell_no, k, {', '.join(_SHORT_COLS)} from sh group by 1,2)"""


@query("a10_short_term", S.stmt(*_BASE, _SHORT, f"select cell_id, k, {', '.join(X.short_term_columns())} from short join grid using (cell_no)"))
def a10_short_term(spark, sf_dir):
    out = X.short_term(events(spark, sf_dir), weekly(spark, sf_dir))
    return named(out, *[F.round(F.coalesce(F.col(c), F.lit(K.MISSING_FAR)), 6).alias(c) if c.startswith("nearest") else r(c) for c in X.short_term_columns()])


@query("a11_features", S.stmt(*_BASE, _MC, _MCK, _SLOPE, _GAPS, _LAST, _TREND, S.NEIGHBORS, _SHORT, S.FAULTS, f"""
st as (select cell_no, k, count(*) filter (where {_d(30)}) as n30, coalesce(max(m) filter (where {_d(30)}), 0) as x30, {_b(1095)} from win join mck using (cell_no, k) group by 1,2),
nb as (select b.cell_no, c.k, sum(n30)/8e0 as nn from st c join nbr b on b.other_no = c.cell_no where n30 > 0 group by 1,2)
select g.cell_id, s.k, cast(coalesce(n30, 0) as double) as event_count_30d, coalesce(x30, 0) as max_mag_30d, coalesce(b_value_1095d, 1) as b_value_1095d, round(coalesce(sl.s, 0), 9) as b_value_slope_1y,
 round(coalesce(mu, 0), 4) as iet_mean_30d, round(coalesce(t4, 9999), 8) as time_since_last_M4_days, round(coalesce(tr.t, 0), 6) as activity_trend_90d, round(coalesce(nn, 0), 6) as neighbor_event_count_30d_mean,
 coalesce(sh.count_M45_7d_r300km, 0) as count_M45_7d_r300km, coalesce(sh.nearest_M5_dist_km, 9999) as nearest_M5_dist_km, round(coalesce(f.slab_depth_km, 9999), 6) as slab_depth_km, 48 as n_features
from grid g cross join snaps s left join st using (cell_no, k) left join slope sl using (cell_no, k) left join iet using (cell_no, k) left join lst using (cell_no, k) left join trend tr using (cell_no, k)
left join nb using (cell_no, k) left join short sh using (cell_no, k) join geo f using (cell_no)"""))
def a11_features(spark, sf_dir):
    """The assembled frame, all cells and snapshots; a slice of its columns is compared."""
    out = X.build_features(events(spark, sf_dir), weekly(spark, sf_dir))
    return out.select("cell_id", "k", "event_count_30d", "max_mag_30d", r("b_value_1095d"), r("b_value_slope_1y", 9), r("iet_mean_30d", 4),
                      r("time_since_last_M4_days", 8), r("activity_trend_90d"), r("neighbor_event_count_30d_mean"), "count_M45_7d_r300km",
                      r("nearest_M5_dist_km"), r("slab_depth_km"), F.lit(len(X.feature_columns())).alias("n_features"))


@query("a11_frame")
def a11_frame(spark, sf_dir):
    """The whole frame: every feature of every cell and snapshot (a1 to a11 compare its parts with SQL)."""
    return X.build_features(events(spark, sf_dir), weekly(spark, sf_dir)).select("cell_id", "k", *X.feature_columns())


LABELS_SQL = """buf as (select cell_no as target, other_no as cell_no from nbr union all select cell_no, cell_no from grid),
hit as (select b.target, s.k, e.magnitude as m, epoch_us(e.time)-epoch_us(s.snapshot) as lead from quakes e join snaps s on e.time > s.snapshot and e.time <= s.snapshot + interval 60 day join buf b on b.cell_no = e.cell_no),
lbl as materialized (select g.cell_no, g.cell_id, s.k, s.snapshot, """ + ", ".join(
    f"cast(coalesce(bool_or(m >= {t} and lead <= {h}*86400000000), false) as int) as {head_name(h, t)}" for h, t in HEADS) + """
  from grid g cross join snaps s left join hit on hit.target = g.cell_no and hit.k = s.k group by 1,2,3,4)"""


@query("b2_labels", S.stmt(S.QUAKES, S.GRID, S.SNAPS, S.NEIGHBORS, LABELS_SQL, f"select cell_id, k, {', '.join(head_columns())} from lbl"))
def b2_labels(spark, sf_dir):
    return named(L.build_labels(events(spark, sf_dir), weekly(spark, sf_dir)), *head_columns())


@query("a18_positive_rates", S.stmt(S.QUAKES, S.GRID, S.SNAPS, S.NEIGHBORS, LABELS_SQL, "select " + ", ".join(f"round(avg({c}), 9) as {c}" for c in head_columns()) + " from lbl"))
def a18_positive_rates(spark, sf_dir):
    return L.positive_rates(L.build_labels(events(spark, sf_dir), weekly(spark, sf_dir))).select(*[r(c, 9) for c in head_columns()])


def dataset(spark, sf_dir):
    """Features and labels of every cell and snapshot, all columns."""
    return L.join_dataset(X.build_features(events(spark, sf_dir), weekly(spark, sf_dir)), L.build_labels(events(spark, sf_dir), weekly(spark, sf_dir)))


@query("j1_dataset", S.stmt(*_BASE, S.NEIGHBORS, LABELS_SQL, f"""c30 as (select cell_no, k, count(*) as n from win where {_d(30)} group by 1,2)
select cell_id, k, cast(coalesce(n, 0) as double) as event_count_30d, label_h30_m50, label_h7_m45 from lbl left join c30 using (cell_no, k)"""))
def j1_dataset(spark, sf_dir):
    return L.join_dataset(X.build_features(events(spark, sf_dir), weekly(spark, sf_dir)), L.build_labels(events(spark, sf_dir), weekly(spark, sf_dir))).select(
        "cell_id", "k", "event_count_30d", "label_h30_m50", "label_h7_m45")


@query("b4_time_split", S.stmt(S.QUAKES, S.GRID, S.SNAPS, """
sp as (select k, case when snapshot <= timestamp '1999-12-31 23:59:00' then 'train' when snapshot > timestamp '1999-12-31 23:59:00' + interval 60 day and snapshot <= timestamp '2000-12-31 23:59:00' then 'val'
 when snapshot > timestamp '2000-12-31 23:59:00' + interval 60 day then 'test' end as split from snaps)
select k, split, count(*) as n, cast((select count(*) from quakes where cell_no is not null) as bigint) as n_events from grid, sp group by 1,2"""))
def b4_time_split(spark, sf_dir):
    """The default years leave train full and validation empty; the relative rule answers (1998-2001)."""
    total = events(spark, sf_dir).where("cell_no is not null").agg(F.count("*").alias("n_events"))
    split = L.time_split(L.build_labels(events(spark, sf_dir), weekly(spark, sf_dir)))
    out = split.groupBy("k", "split").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    return out.join(total.withColumn("one", F.lit(1)), "one").drop("one")


@query("b5_folds", S.stmt(S.QUAKES, S.GRID, S.SNAPS, S.NEIGHBORS, LABELS_SQL, """
f as (select cast(('0x' || substr(sha1('42:' || cell_no || ':' || k), 1, 8))::bigint % 3 as int) as fold, label_h30_m50 from lbl)
select fold, count(*) as n, sum(label_h30_m50) as positives from f group by 1"""))
def b5_folds(spark, sf_dir):
    return L.folds(L.build_labels(events(spark, sf_dir), weekly(spark, sf_dir)), ["cell_no", "k"]).groupBy("fold").agg(
        F.count("*").alias("n"), F.sum("label_h30_m50").alias("positives"))
