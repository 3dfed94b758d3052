"""Duplicate, canonical, decluster and completeness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.operators import catalog_stats, decluster, dedup, grid
from tremorlake.plans import sqlparts as S
from tremorlake.plans.fixtures import AS_OF, quakes
from tremorlake.plans.registry import query
from tremorlake.session import literal

_ROUNDS = """e as materialized (select event_id, time, lat, lon, magnitude, source, epoch_us(time) as us, epoch_us(time)//60000000 as tb,
  row_number() over (order by case source when 'usgs' then 0 when 'emsc' then 1 when 'bmkg' then 2 else 9 end, time, event_id) as rk from quakes),
pr as materialized (select a.rk as worse, b.rk as better from e a join (select *, unnest([tb-1, tb, tb+1]) as tk from e) b on a.tb=b.tk
  where b.rk < a.rk and abs(a.us-b.us) <= 60000000 and abs(a.lat-b.lat) <= 5e-1 and abs(a.lon-b.lon) <= 5e-1 and abs(a.magnitude-b.magnitude) <= 5e-1),
k1 as materialized (select rk from e where rk not in (select worse from pr)),
d1 as materialized (select distinct worse as rk from pr where better in (select rk from k1)),
k2 as materialized (select rk from e where rk not in (select rk from k1) and rk not in (select rk from d1)
  and rk not in (select worse from pr where better not in (select rk from d1))),
d2 as materialized (select rk from d1 union select worse from pr where better in (select rk from k2)),
k3 as materialized (select rk from e where rk not in (select rk from k1) and rk not in (select rk from k2) and rk not in (select rk from d2)
  and rk not in (select worse from pr where better not in (select rk from d2))),
kept as (select rk from k1 union all select rk from k2 union all select rk from k3)"""


@query("d1_j9_dedup", S.stmt(S.QUAKES, _ROUNDS, "select event_id, source, magnitude from e where rk in (select rk from kept)"))
def d1_j9_dedup(spark, sf_dir):
    return dedup.dedup_events(quakes(spark, sf_dir)).select("event_id", "source", "magnitude")


def _greedy(where: str, seconds: int, km: float, alike: str, better: str) -> str:
    """Membership by the sequential rule: step n takes the n-th report of every component at once."""
    reach = f"abs(r.us - c.us) <= {seconds * 1_000_000} and {S.hav_atan2('r.lat', 'r.lon', 'c.lat', 'c.lon')} <= {literal(km)}"
    return f"""rp as materialized (select event_id, time, epoch_us(time) as us, lat, lon, depth, magnitude, source, epoch_us(time)//{seconds * 1_000_000} as tb,
  case source when 'bmkg' then 3 when 'usgs' then 2 when 'emsc' then 1 else 0 end as score from quakes where {where}),
pairs as materialized (select r.event_id as a, c.event_id as b from rp r join (select *, unnest([tb-1, tb, tb+1]) as tk from rp) c on r.tb = c.tk
  where abs(r.lat-c.lat) <= {literal(km / 111 + 0.01)} and {reach}),
reached(a, b) as (select event_id, event_id from rp union select g.a, p.b from reached g join pairs p on p.a = g.b),
comp as (select a as event_id, min(b) as comp from reached group by 1),
steps as materialized (select *, row_number() over (partition by comp order by us, -magnitude, event_id) as n from rp join comp using (event_id)),
run(comp, n, event_id, seed, cs) as (
  select comp, n, event_id, event_id, [struct_pack(seed := event_id, us := us, lat := lat, lon := lon, magnitude := magnitude, score := score)] from steps where n = 1
  union all select comp, n, event_id, case when hit is null then event_id else cs[hit].seed end,
    case when hit is null then list_append(cs, me)
      else list_transform(cs, lambda c, i: case when i = hit and ({better}) then struct_pack(seed := c.seed, us := me.us, lat := me.lat, lon := me.lon, magnitude := me.magnitude, score := me.score) else c end) end
  from (select r.comp, r.n, r.event_id, p.cs, nullif(list_position(list_transform(p.cs, lambda c: {reach} and {alike}), true), 0) as hit,
      struct_pack(seed := r.event_id, us := r.us, lat := r.lat, lon := r.lon, magnitude := r.magnitude, score := r.score) as me
    from run p join steps r on r.comp = p.comp and r.n = p.n + 1)),
canon as materialized (select seed, arg_min(struct_pack(time := time, lat := lat, lon := lon, depth := depth, magnitude := magnitude, source := source),
    (-magnitude, {'-score' if 'score' in better else '0'}, us, event_id)) as r, count(distinct source) as source_count, count(*) as member_count
  from run join rp using (event_id) group by 1),
ce as (select seed, r.time as time, r.lat as lat, r.lon as lon, r.depth as depth_km, r.magnitude as magnitude, r.source as primary_source, source_count, member_count,
  'ce_' || sha1(strftime(r.time, '%Y%m%dT%H%M%S') || ':' || printf('%.3f', r.lat) || ':' || printf('%.3f', r.lon) || ':' || printf('%.1f', r.magnitude)) as canonical_id from canon)"""


_CANON = _greedy("true", K.CANONICAL_SECONDS, K.CANONICAL_KM, f"abs(r.magnitude - c.magnitude) <= {literal(K.CANONICAL_MAG)}",
                 "me.magnitude > c.magnitude or (me.magnitude = c.magnitude and me.score > c.score)")
_WIDE = _greedy("magnitude >= 5", K.BACKTEST_SECONDS, K.BACKTEST_KM, "true", "me.magnitude > c.magnitude")


@query("d2_canonical_events", S.stmt(S.QUAKES, _CANON, """select canonical_id, seed, time, lat, lon, depth_km, magnitude, cast(null as varchar) as place,
  primary_source, cast(source_count as int) as source_count, member_count from ce""", recursive=True))
def d2_canonical_events(spark, sf_dir):
    q = quakes(spark, sf_dir)
    return dedup.canonical_events(q, dedup.leader_clusters(q)).drop("sources").withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("d2_canonical_members", S.stmt(S.QUAKES, _CANON, "select event_id, seed from run", recursive=True))
def d2_canonical_members(spark, sf_dir):
    """Long membership: which report belongs to which first report."""
    return dedup.leader_clusters(quakes(spark, sf_dir))


@query("d2_rebuild_counts", S.stmt(S.QUAKES, "select count(*) filter (where depth >= 70) as taken, count(*) filter (where depth < 70) as skipped from quakes where time between timestamp '2001-07-01' - interval 400 day and timestamp '2001-07-01'"))
def d2_rebuild_counts(spark, sf_dir):
    """Rows a rebuild of the last 400 days takes and skips; shallow reports have lost their magnitude."""
    torn = quakes(spark, sf_dir).withColumn("magnitude", F.when(F.col("depth") >= 70, F.col("magnitude")))
    return dedup.canonical_input(torn, "2001-07-01", 400)[1]


@query("d3_canonical_id", S.stmt(S.QUAKES, """select event_id, 'ce_' || sha1(strftime(time, '%Y%m%dT%H%M%S') || ':' || printf('%.3f', lat) || ':' || printf('%.3f', lon) || ':' || printf('%.1f', magnitude)) as canonical_id from quakes"""))
def d3_canonical_id(spark, sf_dir):
    return quakes(spark, sf_dir).select("event_id", dedup.canonical_id(F.col("time"), F.col("lat"), F.col("lon"), F.col("magnitude")).alias("canonical_id"))


@query("d4_canonical_stats", S.stmt(S.QUAKES, _CANON, """select (select count(*) from quakes) as raw_events, count(*) as canonical_events,
  count(*) filter (where source_count > 1) as multi_source_events, max(time) as latest_time, (select count(*) from quakes) - count(*) as deduped_events from ce""", recursive=True))
def d4_canonical_stats(spark, sf_dir):
    q = quakes(spark, sf_dir)
    return dedup.canonical_stats(q, dedup.canonical_events(q, dedup.leader_clusters(q))).withColumn(
        "latest_time", F.col("latest_time").cast("timestamp_ntz"))


@query("d5_backtest_dedup", S.stmt(S.QUAKES, _WIDE, "select seed, lat, lon, magnitude, primary_source, member_count from ce", recursive=True))
def d5_backtest_dedup(spark, sf_dir):
    """Wide limits, any magnitude difference, strictly larger magnitude leads."""
    large = quakes(spark, sf_dir).where("magnitude >= 5")
    members = dedup.leader_clusters(large, K.BACKTEST_SECONDS, K.BACKTEST_KM, None, by_score=False)
    return dedup.canonical_events(large, members, by_score=False).select("seed", "lat", "lon", "magnitude", "primary_source", "member_count")


_PARENTS = f"""ev as materialized (select event_id, time, lat, lon, magnitude, epoch_us(time) as us, epoch_us(time)//1000000 as sec,
  greatest(1e0, least(1825e0, pow(1e1, 43e-2*magnitude-6e-2))) as tau, 1e1*pow(1e1, -244e-2+59e-2*magnitude)/2 as reach from quakes),
par as materialized (select c.event_id, arg_max(p.event_id, (p.us, p.event_id)) as parent_id from ev c join ev p on p.magnitude > c.magnitude and p.us <= c.us
  and (p.us < c.us or p.event_id < c.event_id) and (c.sec-p.sec)/864e2 <= p.tau and abs(p.lat-c.lat) <= p.reach/111e0+1e-2
  and {S.hav('c.lat', 'c.lon', 'p.lat', 'p.lon')} <= p.reach group by 1)"""


@query("d7_decluster", S.stmt(S.QUAKES, _PARENTS, """
tops(event_id, root) as (select event_id, parent_id from par where parent_id not in (select event_id from par)
  union all select p.event_id, t.root from par p join tops t on t.event_id = p.parent_id),
firsts as (select root, min((us, t.event_id)) as f from tops t join ev using (event_id) group by 1),
num as (select root, row_number() over (order by f) - 1 as cluster_id from firsts),
tree as (select event_id, cluster_id from tops join num using (root) union all select root, cluster_id from num)
select q.event_id, parent_id, parent_id is null as is_mainshock, coalesce(cluster_id, -1) as cluster_id from quakes q left join par using (event_id) left join tree using (event_id)""", recursive=True))
def d7_decluster(spark, sf_dir):
    return decluster.decluster(quakes(spark, sf_dir)).select("event_id", "parent_id", "is_mainshock", "cluster_id")


_MC = f"""mg as (select {S.macro('lat', 'lon')} as region, cast(2000+5*floor((year(time)-2000)/5e0) as int) as epoch_start, cast(round_even(magnitude*10, 0) as int) as b from quakes),
mh as (select region, epoch_start, b, count(*) as n from mg where region is not null and epoch_start >= 1995 and epoch_start < 2030 group by 1,2,3),
mcs as materialized (select region, epoch_start, epoch_start+5 as epoch_end, round((arg_max(b, n*1000-b)*2+1)/2e1 + 2e-1, 6) as mc from mh group by 1,2 having sum(n) >= 30)"""


@query("a12_mc_lookup", S.stmt(S.QUAKES, _MC, "select region, epoch_start, epoch_end, mc from mcs where epoch_start >= 2000"))
def a12_mc_lookup(spark, sf_dir):
    return catalog_stats.mc_lookup(quakes(spark, sf_dir)).select("region", "epoch_start", "epoch_end", F.round("mc", 6).alias("mc"))


@query("a12_mc_of_events", S.stmt(S.QUAKES, _MC, f"""
select event_id, coalesce(mc, 4e0) as mc from quakes q left join mcs m on m.epoch_start >= 2000 and m.region = {S.macro('q.lat', 'q.lon')} and year(q.time) >= m.epoch_start and year(q.time) < m.epoch_end"""))
def a12_mc_of_events(spark, sf_dir):
    q = quakes(spark, sf_dir)
    return catalog_stats.with_mc(q, catalog_stats.mc_lookup(q), F.col("time")).select("event_id", F.round("mc", 6).alias("mc"))


@query("a13_mc_left_edge", S.stmt(S.QUAKES, S.GRID, """
h as (select cell_no, cast(floor(round_even(magnitude*10,0)) as int) as b, count(*) as n from quakes where cell_no is not null group by 1,2),
top as (select cell_no, max(b) as hi, min(b) as lo from h group by 1),
hb as (select cell_no, case when b = hi and hi > lo then b-1 else b end as b, sum(n) as n from h join top using (cell_no) group by 1,2)
select cell_id, case when sum(n) >= 50 and any_value(hi) > any_value(lo) then arg_max(b, n*1000-b)/1e1 end as mc from hb join top using (cell_no) join grid using (cell_no) group by 1"""))
def a13_mc_left_edge(spark, sf_dir):
    return grid.with_cell_id(catalog_stats.mc_left_edge(grid.with_cell_no(quakes(spark, sf_dir)).where("cell_no is not null"), ["cell_no"])).drop("cell_no")


@query("a14_b_value", S.stmt(S.QUAKES, f"""select {S.macro('lat', 'lon')} as region, round(case when count(*) filter (where magnitude >= 45e-1) >= 50 and avg(magnitude) filter (where magnitude >= 45e-1) > 45e-1
 then log10(exp(1e0))/(avg(magnitude) filter (where magnitude >= 45e-1) - 45e-1) else 1 end, 6) as b_value from quakes group by 1"""))
def a14_b_value(spark, sf_dir):
    from tremorlake.functions.geo import macro_region
    q = quakes(spark, sf_dir).withColumn("region", macro_region(F.col("lat"), F.col("lon")))
    return catalog_stats.b_values(q, ["region"], 4.5).select("region", F.round("b_value", 6).alias("b_value"))


@query("a15_quiescence", S.stmt(S.QUAKES, f"""
p as (select {S.macro('lat', 'lon')} as region, time, {S.ASOF} as snap from quakes),
w as (select region, case when time < snap - interval 365 day then floor(epoch(time - (snap - interval 1825 day))/2592000) else 1000 + floor(epoch(time - (snap - interval 365 day))/2592000) end as bin, time, snap
  from p where time >= snap - interval 1825 day and time <= snap),
bins as (select b from range(0, 48) t(b) union all select 1000+b from range(0, 12) t(b)),
edge as (select region, case when bin=48 and time = snap - interval 1825 day + 48*interval 30 day then 47 when bin=1012 and time = snap - interval 365 day + 12*interval 30 day then 1011 else bin end as bin from w),
c as (select r.region, b.b, count(e.bin) as n from (select distinct region from w) r cross join bins b left join edge e on e.region is not distinct from r.region and e.bin=b.b group by 1,2),
st as (select region, avg(n) filter (where b<1000) as mr, var_samp(n) filter (where b<1000) as vr, avg(n) filter (where b>=1000) as mt, var_samp(n) filter (where b>=1000) as vt from c group by 1),
nref as (select region, count(*) filter (where time < snap - interval 365 day) as n from w group by 1)
select st.region, round(case when n < 30 or vr/48+vt/12 = 0 then 0 else (mr-mt)/sqrt(vr/48+vt/12) end, 6) as z_value from st join nref on st.region is not distinct from nref.region"""))
def a15_quiescence(spark, sf_dir):
    from tremorlake.functions.geo import macro_region
    q = quakes(spark, sf_dir).withColumn("region", macro_region(F.col("lat"), F.col("lon"))).where(F.col("time") <= F.lit(AS_OF).cast("timestamp"))
    return catalog_stats.quiescence(q, ["region"], AS_OF).select("region", F.round("z_value", 6).alias("z_value"))
