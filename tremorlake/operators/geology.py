"""Cell labels, nearest fault, slab depth and the area-label dimension."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions.geo import haversine_km, in_box
from tremorlake.operators.grid import cells, grid_cells
from tremorlake.session import dimension, inline, literal, scratch_root, struct_array


def province_boxes(spark: SparkSession) -> DataFrame:
    rows = [(o, *p) for o, p in enumerate(K.PROVINCES)]
    return inline(spark, rows, "ord, province, macro, lat_min, lat_max, lon_min, lon_max")


def anchor_cities(spark: SparkSession) -> DataFrame:
    rows = [(o, *a) for o, a in enumerate(K.ANCHORS)]
    return inline(spark, rows, "city_ord, owner, city, c_lat, c_lon")


def _province_choices() -> Column:
    """The 34 boxes as one literal array."""
    return struct_array(
        [(o, a, b, c, d) for o, (_, _, a, b, c, d) in enumerate(K.PROVINCES)], ("ord", "a", "b", "c", "d"))


def place_points(points: DataFrame, key: str) -> DataFrame:
    """Per point: smallest box holding it, and the box with the nearest centre (orders).

    The boxes are compared inside the row; points are neither copied nor shuffled.
    """
    return points.select(key, "lat", "lon", _in_box().alias("in_ord"), _near_box().alias("near_ord"))


def _in_box() -> Column:
    def inside(b):
        area = (b["b"] - b["a"]) * (b["d"] - b["c"])
        return F.when(in_box(F.col("lat"), F.col("lon"), b["a"], b["b"], b["c"], b["d"]), F.struct(area.alias("m"), b["ord"].alias("ord")))
    return F.array_min(F.transform(_province_choices(), inside))["ord"]


def _near_box() -> Column:
    def centre(b):
        return F.struct(haversine_km(F.col("lat"), F.col("lon"), (b["a"] + b["b"]) / 2, (b["c"] + b["d"]) / 2).alias("m"), b["ord"].alias("ord"))
    return F.array_min(F.transform(_province_choices(), centre))["ord"]


def _full_label() -> Column:
    return F.when(F.col("is_offshore"), F.concat(F.lit("Lepas Pantai "), "province", F.lit(" - dekat "), "subregion")).otherwise(
        F.concat_ws(" - ", "province", "subregion"))


def label_points(points: DataFrame, key: str = "cell_id") -> DataFrame:
    """Province, anchor city, text label, offshore flag and macro region per point.

    A key that stands on one row is labelled inside its row; only keys on several rows meet
    their places by joins. Rows without a key are left out.
    """
    scratch_root(points.sparkSession)
    points = points.where(F.col(key).isNotNull())
    again = points.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key).checkpoint()
    if again.isEmpty():
        return _labelled_rows(points, key)
    repeated = points.join(again, key, "left_semi").checkpoint()
    return _labelled_rows(points.join(again, key, "left_anti"), key).unionByName(_label_by_key(repeated, key))


def _labelled_rows(points: DataFrame, key: str) -> DataFrame:
    """Labels of points whose keys differ: everything is looked up in literal tables."""
    facts = struct_array([(p[0], p[1]) for p in K.PROVINCES], ("province", "macro"))
    cities = F.expr("array(" + ", ".join("array(" + ", ".join(
        f"struct({literal(lat)} as a, {literal(lon)} as o, {n} as city_ord, {literal(city)} as city)"
        for n, (owner, city, lat, lon) in enumerate(K.ANCHORS) if owner == p[0]) + ")" for p in K.PROVINCES) + ")")
    far = lambda c: F.struct(haversine_km(F.col("lat"), F.col("lon"), c["a"], c["o"]).alias("d"), c["city_ord"].alias("n"), c["city"].alias("city"))
    placed = points.withColumn("_in", _in_box()).withColumn("_at", F.coalesce("_in", _near_box()) + 1)
    named = placed.withColumns({
        "_fact": F.element_at(facts, F.col("_at")), "subregion": F.array_min(F.transform(F.element_at(cities, F.col("_at")), far))["city"]}).where("subregion is not null")
    rest = [c for c in points.columns if c != key]
    out = named.select(key, *rest, F.col("_fact.province").alias("province"), F.col("_fact.macro").alias("region_macro"),
                       F.col("_in").isNull().alias("is_offshore"), "subregion")
    return out.withColumn("full_label", _full_label())


def _label_by_key(points: DataFrame, key: str) -> DataFrame:
    boxes = province_boxes(points.sparkSession).select("ord", "province", "macro")
    placed = place_points(points, key).withColumn("ord", F.coalesce("in_ord", "near_ord")).join(F.broadcast(boxes), "ord")
    return anchored(points, placed.select(
        key, "province", F.col("macro").alias("region_macro"), F.col("province").alias("owner"),
        F.col("in_ord").isNull().alias("is_offshore")), key)


def anchored(points: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """Add the nearest city of the owning province, and the label built from it."""
    cities = F.broadcast(anchor_cities(points.sparkSession))
    city = (points.select(key, "lat", "lon").join(placed.select(key, "owner"), key).join(cities, "owner")
            .groupBy(key).agg(F.min(F.struct(
                haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")).alias("d"), "city_ord", "city"))["city"]
                .alias("subregion")))
    return points.join(placed.drop("owner"), key).join(city, key).withColumn("full_label", _full_label())


def macro_of_province(name: Column) -> Column:
    """Macro region of a province name: the table first, then word rules."""
    lowered = F.lower(name)
    known = F.create_map(*[F.lit(v) for p in K.PROVINCES for v in (p[0].lower(), p[1])])
    chain = F
    for macro, words in K.MACRO_WORDS:
        chain = chain.when(lowered.rlike("|".join(words)), macro)
    return F.coalesce(F.element_at(known, lowered), chain.otherwise("Other"))


def label_with_polygons(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Label by polygon, falling back to boxes point by point.

    ``edges`` holds one row per polygon edge: ``province, ring_id, lat1, lon1, lat2,
    lon2``. A point is inside when a ray to the east crosses an odd number of edges.
    Edges are keyed by the half-degree latitude rows they span, so a point meets only
    the edges of its own row.
    """
    row = lambda c: F.floor(c / K.STEP)
    keyed = edges.withColumn("_row", F.explode(F.sequence(
        row(F.least("lat1", "lat2")), row(F.greatest("lat1", "lat2")))))
    probe = points.select("cell_id", "lat", "lon").withColumn("_row", row(F.col("lat")))
    crosses = (F.col("lat1") > F.col("lat")) != (F.col("lat2") > F.col("lat"))
    at = F.col("lon1") + (F.col("lat") - F.col("lat1")) * (F.col("lon2") - F.col("lon1")) / F.nullif(
        F.col("lat2") - F.col("lat1"), F.lit(0.0))
    hit = (
        probe.join(keyed, "_row").where(crosses & (F.col("lon") < at))
        .groupBy("cell_id", "province").count().where(F.col("count") % 2 == 1)
        .groupBy("cell_id").agg(F.min("province").alias("_poly"))
    )
    boxes = F.broadcast(province_boxes(points.sparkSession).select("ord", "province", "macro"))
    placed = place_points(points, "cell_id").join(hit, "cell_id", "left")
    near = placed.join(boxes.select(F.col("ord").alias("near_ord"), F.col("province").alias("near_name")), "near_ord")
    named = near.withColumn("ord", F.coalesce("in_ord", "near_ord")).join(boxes, "ord")
    known = F.lower("_poly").isin([p[0].lower() for p in K.PROVINCES])
    return anchored(points, named.select(
        "cell_id", F.coalesce("_poly", "province").alias("province"),
        F.when(F.col("_poly").isNotNull(), macro_of_province(F.col("_poly"))).otherwise(F.col("macro")).alias("region_macro"),
        F.when(F.col("_poly").isNull(), F.col("province")).when(known, F.col("_poly")).otherwise(F.col("near_name")).alias("owner"),
        (F.col("_poly").isNull() & F.col("in_ord").isNull()).alias("is_offshore")), "cell_id")


def fault_points(spark: SparkSession) -> DataFrame:
    """Fault lines sampled about every tenth of a degree (under 1,000 points)."""
    rows = [
        (order, name, kind, slip, *a, *b)
        for order, (name, kind, slip, line) in enumerate(K.FAULTS)
        for a, b in zip(line, line[1:])
    ]
    legs = inline(spark, rows, "ord, name, fault_type, slip, lat1, lon1, lat2, lon2")
    steps = F.greatest(F.lit(1), F.floor(F.hypot(F.col("lat2") - F.col("lat1"), F.col("lon2") - F.col("lon1")) * 10).cast("int"))
    return (
        legs.withColumn("steps", steps).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("steps"))))
        .withColumn("t", F.col("s") / F.col("steps"))
        .select("ord", "name", "fault_type", "slip",
                (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * F.col("t")).alias("f_lat"),
                (F.col("lon1") + (F.col("lon2") - F.col("lon1")) * F.col("t")).alias("f_lon"))
    )


def fault_distances(points: DataFrame) -> DataFrame:
    """Nearest fault and slab depth for each point.

    The sampled fault lines are a fixed table of under 1,000 rows carried to every
    point as one array; the minimum is kept per point in the same task.
    """
    spark = points.sparkSession
    table = dimension(spark, "fault-points", fault_points).collect()  # fixed size
    line = struct_array([(r["f_lat"], r["f_lon"], r["ord"]) for r in table], ("la", "lo", "ord"))
    facts = struct_array([(k, s, n) for n, k, s, _ in K.FAULTS], ("fault_type", "slip", "name"))
    subduction = [o for o, f in enumerate(K.FAULTS) if f[1] == "subduction"]
    dist = haversine_km(F.col("lat"), F.col("lon"), F.col("_p.la"), F.col("_p.lo"))
    near = (
        points.select("cell_no", "lat", "lon").withColumn("_p", F.explode(line))
        .withColumn("d", dist)
        .groupBy("cell_no").agg(
            F.min(F.struct("d", F.col("_p.ord").alias("ord"))).alias("best"),
            F.min(F.when(F.col("_p.ord").isin(subduction), F.col("d"))).alias("slab_km"))
    )
    slab = F.when(F.col("slab_km") <= K.SLAB_REACH_KM, F.least(
        F.col("slab_km") * math.tan(math.radians(K.SLAB_DIP_DEG)), F.lit(K.SLAB_MAX_KM)))
    fact = F.element_at(facts, F.col("best.ord") + 1)
    return near.select(
        "cell_no", F.col("best.d").alias("nearest_fault_km"), fact["name"].alias("fault_name"),
        fact["fault_type"].alias("fault_type"), fact["slip"].alias("fault_slip_rate"), slab.alias("slab_depth_km"))


def fault_type_code(kind: Column) -> Column:
    chain = F
    for name, code in K.FAULT_TYPE_CODES:
        chain = chain.when(kind == name, code)
    return chain.otherwise(0)


def build_area_labels(spark: SparkSession) -> DataFrame:
    base = cells(spark)
    return label_points(base).join(F.broadcast(fault_distances(base)), "cell_no").select(
        "cell_no", "cell_id", "lat", "lon", "lat_min", "lat_max", "lon_min", "lon_max",
        "province", "subregion", "full_label", "is_offshore", "region_macro",
        "nearest_fault_km", "fault_type", "fault_slip_rate", "slab_depth_km")


def area_labels(spark: SparkSession) -> DataFrame:
    """Checkpointed area dimension (3,128 rows: safe to broadcast)."""
    return dimension(spark, "area-labels", build_area_labels)


__all__ = ["area_labels", "fault_distances", "fault_type_code", "grid_cells", "label_points",
           "label_with_polygons", "macro_of_province"]
