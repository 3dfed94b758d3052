"""Reusable pieces of the DuckDB check statements."""

from __future__ import annotations

from tremorlake import constants as K
from tremorlake.plans.fixtures import AS_OF, ISSUES, SNAP_DAYS
from tremorlake.session import literal


def values(rows, alias: str) -> str:
    body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    return f"(values {body}) as {alias}"


def hav(a, b, c, d) -> str:
    return (f"(2*6371e0*asin(sqrt(least(1e0, pow(sin(radians(({c})-({a}))/2),2)"
            f"+cos(radians({a}))*cos(radians({c}))*pow(sin(radians(({d})-({b}))/2),2)))))")


def hav_atan2(a, b, c, d) -> str:
    h = (f"least(1e0, pow(sin(radians(({c})-({a}))/2),2)"
         f"+cos(radians({a}))*cos(radians({c}))*pow(sin(radians(({d})-({b}))/2),2))")
    return f"(6371e0*2*atan2(sqrt({h}), sqrt(1-{h})))"


def cid(lat, lon) -> str:
    def token(x, width):
        v = f"cast(round_even(({x})*10,0) as int)"
        t = f"cast(abs({v}) as varchar)"
        return f"(case when {v}<0 then 'm' else 'p' end || lpad({t}, cast(greatest({width}, length({t})) as int), '0'))"
    return f"('C' || {token(lat, 2)} || '_' || {token(lon, 3)})"


def cellno(lat, lon) -> str:
    i, j = f"floor((({lat})+11e0)/5e-1)", f"floor((({lon})-95e0)/5e-1)"
    return (f"(case when {i} between 0 and 33 and {j} between 0 and 91 "
            f"then cast({i}*92+{j} as int) end)")


def macro(lat, lon) -> str:
    return "(case " + " ".join(
        f"when {lat} between {literal(a)} and {literal(c)} and {lon} between {literal(b)} and {literal(d)} then '{n}'"
        for n, a, b, c, d in K.MACRO_BOXES) + " end)"


QUAKES = """base_q as (
  select o_orderkey as k,
    o_orderdate + to_seconds(cast((o_orderkey*7919) % 86400 as bigint)) as time,
    (-11000 + (o_custkey % 97) * 7001 % 15500 + (o_orderkey*7919) % 1501) / 1e3 as lat,
    (95000 + (o_custkey % 97) * 10007 % 44500 + (o_orderkey*104729) % 1501) / 1e3 as lon,
    cast((o_orderkey*31) % 700 as double) as depth,
    (40 + cast(floor(-1e1*log10((((o_orderkey*37) % 9973) + 5e-1)/9973e0)) as int)) as m10
  from orders),
quakes0 as (
select k*2 as event_key, time, lat, lon, depth, m10/1e1 as magnitude,
  case k % 3 when 0 then 'usgs' when 1 then 'emsc' else 'bmkg' end as source from base_q
union all
select k*2+1, time + to_seconds(cast(20 + k % 60 as bigint)), lat + 5e-2, lon, depth, (m10 - k % 2)/1e1,
  case (k+1) % 3 when 0 then 'usgs' when 1 then 'emsc' else 'bmkg' end from base_q where k % 5 = 0),
quakes as materialized (select *, source || '_' || cast(event_key as varchar) as event_id, """ + cellno("lat", "lon") + """ as cell_no from quakes0)"""

GRID = """grid as materialized (select cast(i*92+j as int) as cell_no, -11e0+i*5e-1+25e-2 as lat, 95e0+j*5e-1+25e-2 as lon,
  -11e0+i*5e-1 as lat_min, -11e0+i*5e-1+5e-1 as lat_max, 95e0+j*5e-1 as lon_min, 95e0+j*5e-1+5e-1 as lon_max, i, j, """ + cid(
    "-11e0+i*5e-1+25e-2", "95e0+j*5e-1+25e-2") + """ as cell_id
  from range(34) r(i), range(92) s(j))"""

SNAPS = f"""snaps as materialized (select cast(k as int) as k, lo + to_days(cast(k*{SNAP_DAYS} as int)) as snapshot
  from (select lo, unnest(range(date_diff('day', lo, hi)//{SNAP_DAYS} + 1)) as k from (select date_trunc('day', min(time))::timestamp as lo, max(time) as hi from quakes)))"""

ISSUE_DATES = f"""snaps as (select cast(k as int) as k, timestamp '{ISSUES[0]}' + to_days(cast(k*{ISSUES[2]} as int)) as snapshot
  from range({ISSUES[1]}) t(k))"""

NEIGHBORS = f"""nbr as materialized (select cell_no, other_no, dist_km, rnk from (
  select a.cell_no, b.cell_no as other_no, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} as dist_km,
    row_number() over (partition by a.cell_no order by round({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6), b.cell_no) as rnk
  from grid a join grid b on a.cell_no <> b.cell_no and abs(a.i-b.i) <= 4 and abs(a.j-b.j) <= 4) where rnk <= 8)"""


def radius(km, name) -> str:
    return (f"{name} as materialized (select a.cell_no, b.cell_no as other_no, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} as dist_km "
            f"from grid a join grid b on abs(a.i-b.i) <= 8 and abs(a.j-b.j) <= 8 "
            f"where {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {float(km)!r})")


HEADS = ("heads as (select h as horizon_days, t as mag_threshold from (values (7),(14),(30),(60)) x(h), "
         "(values (45e-1),(5e0),(55e-1),(6e0)) y(t))")

PROVINCES = "prov as (select * from " + values(
    [(o, *p) for o, p in enumerate(K.PROVINCES)], "p(ord, name, macro, a, b, c, d)") + ")"
ANCHORS = "anchor as (select * from " + values(
    [(o, *p) for o, p in enumerate(K.ANCHORS)], "p(ord, province, name, lat, lon)") + ")"


def labelled(src: str, key: str) -> str:
    """CTEs p_in, p_near, lab: province/city labels of rows of ``src`` keyed by ``key``."""
    return f"""{PROVINCES}, {ANCHORS},
p_in as (select s.{key}, arg_min(p.ord, ((p.b-p.a)*(p.d-p.c))*1e3 + p.ord*1e-6) as ord from {src} s join prov p
  on s.lat between p.a and p.b and s.lon between p.c and p.d group by 1),
p_near as (select s.{key}, arg_min(p.ord, round({hav('s.lat', 's.lon', '(p.a+p.b)/2', '(p.c+p.d)/2')}, 9)) as ord from {src} s, prov p group by 1),
p_of as (select s.{key}, s.lat, s.lon, coalesce(i.ord, n.ord) as ord, i.ord is null as is_offshore
  from {src} s join p_near n using ({key}) left join p_in i using ({key})),
lab as materialized (select o.{key}, any_value(p.name) as province, any_value(p.macro) as region_macro, any_value(o.is_offshore) as is_offshore,
  arg_min(a.name, round({hav('o.lat', 'o.lon', 'a.lat', 'a.lon')}, 9)) as subregion
  from p_of o join prov p using (ord) join anchor a on a.province = p.name group by 1),
labels_of as materialized (select *, case when is_offshore then 'Lepas Pantai ' || province || ' - dekat ' || subregion
  else province || ' - ' || subregion end as full_label from lab)"""


_LEGS = [(o, kind, slip, *a, *b) for o, (n, kind, slip, line) in enumerate(K.FAULTS) for a, b in zip(line, line[1:])]
FAULTS = ("legs as (select * from " + values(_LEGS, "l(ord, fault_type, slip, lat1, lon1, lat2, lon2)") + """),
fpts as (select ord, fault_type, slip, lat1+(lat2-lat1)*(s/cast(steps as double)) as lat, lon1+(lon2-lon1)*(s/cast(steps as double)) as lon
  from (select *, greatest(1, cast(floor(sqrt(pow(lat2-lat1,2)+pow(lon2-lon1,2))*10+1e-9) as int)) as steps from legs) l,
  lateral (select unnest(range(l.steps+1)) as s) x),
near as materialized (select g.cell_no, min(d) as nearest_fault_km, arg_min(f.ord, round(d,9)*1e3+f.ord*1e-4) as ford,
  min(d) filter (where fault_type='subduction') as slab_km
  from (select g.cell_no, f.ord, f.fault_type, """ + hav('g.lat', 'g.lon', 'f.lat', 'f.lon') + """ as d from grid g, fpts f) f join grid g using (cell_no) group by 1),
geo as materialized (select n.cell_no, n.nearest_fault_km, l.fault_type, l.slip as fault_slip_rate,
  case when slab_km <= 5e2 then least(slab_km*tan(radians(25e0)), 7e2) end as slab_depth_km
  from near n join (select distinct ord, fault_type, slip from legs) l on l.ord = n.ford)""")

AREAS = f"""{GRID}, {labelled('grid', 'cell_no')}, {FAULTS},
areas as materialized (select g.cell_no, g.cell_id, g.lat, g.lon, g.lat_min, g.lat_max, g.lon_min, g.lon_max, l.province, l.subregion,
  l.full_label, l.is_offshore, l.region_macro, f.nearest_fault_km, f.fault_type, f.fault_slip_rate, f.slab_depth_km
  from grid g join labels_of l using (cell_no) join geo f using (cell_no))"""


def head_label(h: str, t: str) -> str:
    return f"('label_h' || cast({h} as varchar) || '_m' || cast(cast({t}*10 as int) as varchar))"


def poisson(name: str, start: str, end: str, events: str = "quakes") -> str:
    """CTE with 16 Poisson probabilities per cell for events in [start, end]."""
    return f"""{name}_d as (select greatest(1e0, epoch(({end}) - ({start}))/86400e0) as days),
{name}_e as (select cell_no, magnitude from {events} where time >= ({start}) and time <= ({end}) and cell_no is not null),
{name}_g as (select t as mag_threshold, (select count(*) from {name}_e where magnitude >= t) as n from (values (45e-1),(5e0),(55e-1),(6e0)) y(t)),
{name}_c as (select cell_no, t as mag_threshold, count(*) as n from {name}_e, (values (45e-1),(5e0),(55e-1),(6e0)) y(t) where magnitude >= t group by 1,2),
{name} as materialized (select g.cell_no, h.horizon_days, h.mag_threshold,
  1-exp(-coalesce(c.n/days, (gl.n+1)/(3128e0*days)*5e-2)*h.horizon_days) as p
  from grid g cross join heads h cross join {name}_d join {name}_g gl using (mag_threshold)
  left join {name}_c c on c.cell_no=g.cell_no and c.mag_threshold=h.mag_threshold)"""


ASOF = f"timestamp '{AS_OF}'"
QMIN = "(select min(time) from quakes)"

# the issued forecast used by the serving queries: long form, probabilities at 9 decimals
PUBLIC = f"""{HEADS}, {AREAS},
{poisson('recent', ASOF + " - interval 1825 day", ASOF)},
{poisson('longp', QMIN, ASOF)},
tect as (select a.cell_no, h.horizon_days, h.mag_threshold, greatest(1e-6, least(8e-1, 1-exp(-(case h.mag_threshold when 45e-1 then 9e-1 when 5e0 then 28e-2 when 55e-1 then 8e-2 else 25e-3 end)
   * (25e-2+75e-2*exp(-nearest_fault_km/9e1)) * (case fault_type when 'subduction' then 135e-2 when 'transform' then 105e-2 else 75e-2 end)
   * (case when slab_depth_km <= 8e1 then 11e-1 else 1e0 end) * (case when is_offshore then 95e-2 else 1e0 end) * (h.horizon_days/365e0)))) as p
  from areas a cross join heads h),
smooth as (select r.cell_no, r.horizon_days, r.mag_threshold,
  1-exp(-(55e-2*(-ln(1-greatest(1e-9,least(r.p,1-1e-9)))/r.horizon_days) + 45e-2*(-ln(1-greatest(1e-9,least(l.p,1-1e-9)))/r.horizon_days))*r.horizon_days) as p
  from recent r join longp l using (cell_no, horizon_days, mag_threshold)),
caps as (select horizon_days, mag_threshold, least(85e-2, 1-exp(ln(1-case mag_threshold when 45e-1 then 65e-2 when 5e0 then 35e-2 when 55e-1 then 16e-2 else 7e-2 end)*(horizon_days/3e1))) as cap,
  case mag_threshold when 45e-1 then 70e-2 when 5e0 then 65e-2 when 55e-1 then 55e-2 else 45e-2 end as w1, 1e-1 as w2,
  case mag_threshold when 45e-1 then 15e-2 when 5e0 then 18e-2 when 55e-1 then 22e-2 else 25e-2 end as w3,
  case mag_threshold when 45e-1 then 5e-2 when 5e0 then 7e-2 when 55e-1 then 13e-2 else 20e-2 end as w4 from heads),
blend as (select r.cell_no, r.horizon_days, r.mag_threshold, r.p as raw,
  greatest(1e-6, least(c.cap, w1*greatest(1e-6,least(r.p,1-1e-6)) + w2*r.p + w3*s.p + w4*t.p)) as p
  from recent r join smooth s using (cell_no, horizon_days, mag_threshold) join tect t using (cell_no, horizon_days, mag_threshold)
  join caps c using (horizon_days, mag_threshold)),
mono as (select cell_no, horizon_days, mag_threshold,
  max(p1) over (partition by cell_no, horizon_days order by mag_threshold desc) as p, max(r1) over (partition by cell_no, horizon_days order by mag_threshold desc) as raw
  from (select *, max(p) over (partition by cell_no, mag_threshold order by horizon_days) as p1,
    max(raw) over (partition by cell_no, mag_threshold order by horizon_days) as r1 from blend)),
fc as materialized (select m.cell_no, a.cell_id, m.horizon_days, m.mag_threshold, round(m.p, 9) as probability, round(m.raw, 9) as raw_probability
  from mono m join areas a using (cell_no))"""


def stmt(*parts: str, recursive: bool = False) -> str:
    """Join CTE parts and the final select."""
    last = parts[-1].strip()
    glue = "\n" if last.lower().startswith("select") else ",\n"
    return ("with recursive " if recursive else "with ") + ",\n".join(parts[:-1]) + glue + last
