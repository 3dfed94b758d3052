"""Grid, geocoding, geology and neighbourhood queries over the whole catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions import geo
from tremorlake.operators import geology, grid
from tremorlake.plans import sqlparts as S
from tremorlake.plans.fixtures import quakes
from tremorlake.plans.registry import query


def _cell_counts(spark, sf_dir):
    return grid.with_cell_no(quakes(spark, sf_dir)).where("cell_no is not null").groupBy("cell_no").agg(
        F.count("*").alias("n_events"), F.max("magnitude").alias("max_mag"))


_COUNTS = "cnt as (select cell_no, count(*) as n_events, max(magnitude) as max_mag from quakes where cell_no is not null group by 1)"


@query("g1_grid", S.stmt(S.QUAKES, S.GRID, _COUNTS, """
select cell_id, lat, lon, lat_min, lat_max, lon_min, lon_max, coalesce(n_events, 0) as n_events from grid left join cnt using (cell_no)"""))
def g1_grid(spark, sf_dir):
    """The whole grid with the number of catalog events per cell."""
    return grid.grid_cells(spark).join(_cell_counts(spark, sf_dir), "cell_no", "left").select(
        "cell_id", "lat", "lon", "lat_min", "lat_max", "lon_min", "lon_max",
        F.coalesce("n_events", F.lit(0)).alias("n_events"))


@query("g2_make_cell_id", S.stmt(S.QUAKES, f"select event_id, {S.cid('lat', 'lon')} as point_id from quakes"))
def g2_make_cell_id(spark, sf_dir):
    return quakes(spark, sf_dir).select("event_id", geo.cell_id(F.col("lat"), F.col("lon")).alias("point_id"))


@query("g3_assign_cell", S.stmt(S.QUAKES, S.GRID, "select event_id, cell_id from quakes left join grid using (cell_no)"))
def g3_assign_cell(spark, sf_dir):
    return grid.assign_cells(quakes(spark, sf_dir)).select("event_id", "cell_id")


@query("g4_decode_center", S.stmt(S.QUAKES, S.GRID, """
select event_id, (case when substr(cell_id, 2, 1)='m' then -1 else 1 end)*cast(regexp_extract(cell_id, 'C[pm](\\d+)_', 1) as int)/1e1 as lat_dec,
 cast(regexp_extract(cell_id, '_p(\\d+)', 1) as int)/1e1 as lon_dec from quakes join grid using (cell_no)"""))
def g4_decode_center(spark, sf_dir):
    events = grid.assign_cells(quakes(spark, sf_dir)).where("cell_id is not null")
    return events.select("event_id", geo.id_center(F.col("cell_id"), 0).alias("lat_dec"),
                         geo.id_center(F.col("cell_id"), 1).alias("lon_dec"))


@query("g5_label_points", S.stmt(S.QUAKES, S.labelled("quakes", "event_id"),
       "select event_id, province, subregion, full_label, is_offshore, region_macro from labels_of"))
def g5_label_points(spark, sf_dir):
    """Province, city and macro region of every event epicentre."""
    return geology.label_points(quakes(spark, sf_dir).select("event_id", "lat", "lon"), "event_id").select(
        "event_id", "province", "subregion", "full_label", "is_offshore", "region_macro")


def _hulls(spark, sf_dir):
    """Polygon edges derived from the catalog: a diamond around each hot spot's extent."""
    spots = quakes(spark, sf_dir).withColumn("spot", F.floor(F.col("event_key") / 2) % 5).groupBy("spot").agg(
        F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
    mid_lat, mid_lon = (F.col("a") + F.col("b")) / 2 + F.col("spot") * 3 - 6, (F.col("c") + F.col("d")) / 2 + F.col("spot") * 8 - 16
    corners = [(mid_lat + 1.3, mid_lon), (mid_lat, mid_lon + 3.7), (mid_lat - 1.3, mid_lon), (mid_lat, mid_lon - 3.7)]
    edges = F.array(*[
        F.struct(p[0].alias("lat1"), p[1].alias("lon1"), q[0].alias("lat2"), q[1].alias("lon2"))
        for p, q in zip(corners, corners[1:] + corners[:1])])
    return spots.select(F.concat(F.lit("Zona Jawa "), F.col("spot")).alias("province"), F.inline(edges))


@query("g6_label_polygons", S.stmt(S.QUAKES, S.GRID, S.labelled("grid", "cell_no"), f"""
spots as (select (event_key//2) % 5 as spot, min(lat) as a, max(lat) as b, min(lon) as c, max(lon) as d from quakes group by 1),
mids as (select spot, (a+b)/2 + spot*3 - 6 as y, (c+d)/2 + spot*8 - 16 as x from spots)""", f"""
inside as (select g.cell_no, min('Zona Jawa ' || m.spot) as poly from grid g join mids m on abs(g.lat-m.y)/13e-1 + abs(g.lon-m.x)/37e-1 < 1 group by 1),
city as (select g.cell_no, arg_min(a.name, round({S.hav('g.lat', 'g.lon', 'a.lat', 'a.lon')}, 9)) as city
  from grid g join p_near n using (cell_no) join prov p on p.ord=n.ord join anchor a on a.province=p.name group by 1)""", """
select g.cell_id, coalesce(i.poly, l.province) as province,
 case when i.poly is not null then c.city else l.subregion end as subregion,
 case when i.poly is not null then i.poly || ' - ' || c.city else l.full_label end as full_label,
 case when i.poly is not null then false else l.is_offshore end as is_offshore,
 case when i.poly is not null then 'Jawa' else l.region_macro end as region_macro
from grid g join labels_of l using (cell_no) join city c using (cell_no) left join inside i using (cell_no)"""))
def g6_label_polygons(spark, sf_dir):
    """Cells labelled by polygons drawn from the catalog, boxes elsewhere."""
    return geology.label_with_polygons(grid.cells(spark).select("cell_id", "lat", "lon"), _hulls(spark, sf_dir)).select(
        "cell_id", "province", "subregion", "full_label", "is_offshore", "region_macro")


_MACRO_SQL = "case " + " ".join(f"when lower(name)='{p[0].lower()}' then '{p[1]}'" for p in K.PROVINCES) + " " + " ".join(
    "when " + " or ".join(f"contains(lower(name), '{w}')" for w in words) + f" then '{m}'" for m, words in K.MACRO_WORDS) + " else 'Other' end"


@query("g7_macro_of_province", S.stmt(S.QUAKES, S.labelled("quakes", "event_id"), """
named as (select event_id, case when event_id like 'b%' then province || ' Baru' when event_id like 'u%' then upper(province) else source_ end as name
  from (select event_id, province, split_part(event_id, '_', 1) as source_ from labels_of))""",
       f"select event_id, name, {_MACRO_SQL} as macro from named"))
def g7_macro_of_province(spark, sf_dir):
    labelled = geology.label_points(quakes(spark, sf_dir).select("event_id", "source", "lat", "lon"), "event_id")
    name = (F.when(F.col("source") == "bmkg", F.concat("province", F.lit(" Baru")))
            .when(F.col("source") == "usgs", F.upper("province")).otherwise(F.col("source")))
    return labelled.select("event_id", name.alias("name"), geology.macro_of_province(name).alias("macro"))


@query("g8_nearest_fault", S.stmt(S.QUAKES, S.GRID, S.FAULTS, """
select event_id, round(nearest_fault_km, 6) as nearest_fault_km, fault_type, fault_slip_rate,
 case fault_type when 'subduction' then 1 when 'transform' then 2 when 'reverse' then 3 else 4 end as fault_type_int
from quakes join geo using (cell_no)"""))
def g8_nearest_fault(spark, sf_dir):
    """Nearest fault of the cell that holds each event."""
    near = geology.area_labels(spark).select("cell_no", "nearest_fault_km", "fault_type", "fault_slip_rate")
    return grid.with_cell_no(quakes(spark, sf_dir)).join(F.broadcast(near), "cell_no").select(
        "event_id", F.round("nearest_fault_km", 6).alias("nearest_fault_km"), "fault_type", "fault_slip_rate",
        geology.fault_type_code(F.col("fault_type")).alias("fault_type_int"))


@query("g9_slab_depth", S.stmt(S.QUAKES, S.GRID, S.FAULTS,
       "select event_id, round(slab_depth_km, 6) as slab_depth_km from quakes join geo using (cell_no)"))
def g9_slab_depth(spark, sf_dir):
    slab = geology.area_labels(spark).select("cell_no", "slab_depth_km")
    return grid.with_cell_no(quakes(spark, sf_dir)).join(F.broadcast(slab), "cell_no").select(
        "event_id", F.round("slab_depth_km", 6).alias("slab_depth_km"))


@query("g10_haversine", S.stmt(S.QUAKES, S.GRID, f"""
select event_id, round({S.hav('q.lat', 'q.lon', 'g.lat', 'g.lon')}, 6) as km_asin, round({S.hav_atan2('q.lat', 'q.lon', 'g.lat', 'g.lon')}, 6) as km_atan2
from quakes q join grid g using (cell_no)"""))
def g10_haversine(spark, sf_dir):
    q = grid.with_cell_no(quakes(spark, sf_dir)).where("cell_no is not null")
    args = (F.col("lat"), F.col("lon"), geo.center_lat(F.col("cell_no")), geo.center_lon(F.col("cell_no")))
    return q.select("event_id", F.round(geo.haversine_km(*args), 6).alias("km_asin"),
                    F.round(geo.haversine_km_atan2(*args), 6).alias("km_atan2"))


def _pairs_with_counts(spark, sf_dir, pairs, extra):
    counts = _cell_counts(spark, sf_dir).withColumnRenamed("cell_no", "other_no")
    names = grid.cells(spark).select("cell_no", "cell_id")
    return (pairs.join(counts, "other_no", "left").join(F.broadcast(names), "cell_no")
            .join(F.broadcast(names.toDF("other_no", "other_id")), "other_no")
            .select("cell_id", "other_id", F.coalesce("n_events", F.lit(0)).alias("n_events"), *extra))


@query("g11_knn8", S.stmt(S.QUAKES, S.GRID, S.NEIGHBORS, _COUNTS, """
select a.cell_id, b.cell_id as other_id, coalesce(n_events, 0) as n_events, cast(rnk as int) as "rank", round(dist_km, 6) as dist_km
from nbr join grid a using (cell_no) join grid b on b.cell_no = other_no left join cnt on cnt.cell_no = other_no"""))
def g11_knn8(spark, sf_dir):
    return _pairs_with_counts(spark, sf_dir, grid.nearest_neighbors(spark),
                              ["rank", F.round("dist_km", 6).alias("dist_km")])


@query("g12_radius", S.stmt(S.QUAKES, S.GRID, S.radius(100, "near1"), S.radius(300, "near3"), _COUNTS, """
a1 as (select near1.cell_no, count(*) as cells100, cast(coalesce(sum(n_events),0) as bigint) as events100 from near1 left join cnt on cnt.cell_no=other_no group by 1),
a3 as (select near3.cell_no, count(*) as cells300, cast(coalesce(sum(n_events),0) as bigint) as events300 from near3 left join cnt on cnt.cell_no=other_no group by 1)
select cell_id, cells100, events100, cells300, events300 from grid join a1 using (cell_no) join a3 using (cell_no)"""))
def g12_radius(spark, sf_dir):
    """Cells and events within 100 and 300 km of every cell."""
    pairs = grid.radius_neighbors(spark, 300.0).join(
        _cell_counts(spark, sf_dir).select(F.col("cell_no").alias("other_no"), "n_events"), "other_no", "left")
    close, n = F.col("dist_km") <= 100.0, F.coalesce("n_events", F.lit(0))
    out = pairs.groupBy("cell_no").agg(
        F.count_if(close).alias("cells100"), F.coalesce(F.sum(F.when(close, n)), F.lit(0)).alias("events100"),
        F.count("*").alias("cells300"), F.sum(n).alias("events300"))
    return grid.with_cell_id(out).drop("cell_no")


@query("g13_rings", S.stmt(S.QUAKES, S.GRID, _COUNTS, """
select a.cell_id, count(*) filter (where greatest(abs(a.i-b.i),abs(a.j-b.j))<=1) as ring1_cells, count(*) as ring2_cells,
 cast(coalesce(sum(n_events) filter (where greatest(abs(a.i-b.i),abs(a.j-b.j))<=1),0) as bigint) as ring1_events, cast(coalesce(sum(n_events),0) as bigint) as ring2_events
from grid a join grid b on abs(a.i-b.i)<=2 and abs(a.j-b.j)<=2 left join cnt on cnt.cell_no=b.cell_no group by 1"""))
def g13_rings(spark, sf_dir):
    pairs = grid.ring_neighbors(spark, 2).join(
        _cell_counts(spark, sf_dir).select(F.col("cell_no").alias("other_no"), "n_events"), "other_no", "left")
    n = F.coalesce("n_events", F.lit(0))
    out = pairs.groupBy("cell_no").agg(
        F.count_if(F.col("ring") <= 1).alias("ring1_cells"), F.count("*").alias("ring2_cells"),
        F.sum(F.when(F.col("ring") <= 1, n)).alias("ring1_events"), F.sum(n).alias("ring2_events"))
    return grid.with_cell_id(out).drop("cell_no")


@query("g14_macro_region", S.stmt(S.QUAKES, f"select event_id, {S.macro('lat', 'lon')} as region from quakes"))
def g14_macro_region(spark, sf_dir):
    return quakes(spark, sf_dir).select("event_id", geo.macro_region(F.col("lat"), F.col("lon")).alias("region"))


@query("g15_nearest_cell", S.stmt(S.QUAKES, S.GRID, """
select q.event_id, arg_min(g.cell_id, round(pow(g.lat-q.lat,2)+pow(g.lon-q.lon,2), 9)*1e4 + g.cell_no*1e-7) as cell_id
from quakes q join grid g on abs(g.lat-q.lat) <= 1 and abs(g.lon-q.lon) <= 1 group by 1"""))
def g15_nearest_cell(spark, sf_dir):
    return grid.nearest_cell(quakes(spark, sf_dir), ["event_id"]).select("event_id", "cell_id")


@query("g17_user_cell", S.stmt(S.GRID, """
users as (select c_custkey as chat_id, c_nationkey, (c_custkey*7919 % 17000 - 11000)/1e3 as lat, (c_custkey*104729 % 46000 + 95000)/1e3 as lon from customer),
pick as (select u.chat_id, arg_min(g.cell_id, round(pow(g.lat-u.lat,2)+pow(g.lon-u.lon,2), 9)*1e4 + g.cell_no*1e-7) as cell_id
 from users u join grid g on abs(g.lat-u.lat) <= 1 and abs(g.lon-u.lon) <= 1 group by 1)
select u.chat_id, p.cell_id, n_name as regency, r_name as province, round(lat,1) as lat_rounded, round(lon,1) as lon_rounded
from users u join pick p using (chat_id) join nation on n_nationkey=c_nationkey join region on r_regionkey=n_regionkey"""))
def g17_user_cell(spark, sf_dir):
    """Users with a position: region path and nearest cell."""
    from tremorlake.operators.users import locate_users
    from tremorlake.plans.fixtures import table
    users = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("chat_id"), F.col("c_nationkey").alias("region_id"),
        ((F.col("c_custkey") * 7919 % 17000 - 11000) / 1e3).alias("lat"),
        ((F.col("c_custkey") * 104729 % 46000 + 95000) / 1e3).alias("lon"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
                                                   F.col("n_regionkey").alias("parent_id"))
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return locate_users(users, nation, region).select("chat_id", "cell_id", "regency", "province", "lat_rounded", "lon_rounded")


@query("s21_area_labels", S.stmt(S.QUAKES, S.AREAS, _COUNTS, """
select cell_id, lat, lon, province, subregion, full_label, is_offshore, region_macro, round(nearest_fault_km,6) as nearest_fault_km,
 fault_type, fault_slip_rate, round(slab_depth_km,6) as slab_depth_km, coalesce(n_events,0) as n_events from areas left join cnt using (cell_no)"""))
def s21_area_labels(spark, sf_dir):
    """The area dimension, built once, with the catalog's event counts."""
    return geology.build_area_labels(spark).join(_cell_counts(spark, sf_dir), "cell_no", "left").select(
        "cell_id", "lat", "lon", "province", "subregion", "full_label", "is_offshore", "region_macro",
        F.round("nearest_fault_km", 6).alias("nearest_fault_km"), "fault_type", "fault_slip_rate",
        F.round("slab_depth_km", 6).alias("slab_depth_km"), F.coalesce("n_events", F.lit(0)).alias("n_events"))
