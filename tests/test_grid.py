import numpy as np
from pyspark.sql import functions as F

from tests.helpers import km
from tremorlake.functions import geo, heads
from tremorlake.operators import geology, grid


def test_grid_ids(spark):
    rows = grid.grid_cells(spark).collect()
    assert len(rows) == 3128 and len({r.cell_id for r in rows}) == 3128
    assert rows[0].cell_id == "Cm108_p952" and rows[0].lat == -10.75
    ids = spark.createDataFrame([(-0.75, 119.25), (2.05, 95.1)], "lat double, lon double").select(geo.cell_id(F.col("lat"), F.col("lon"))).collect()
    assert ids[0][0] == "Cm08_p1192"


def test_half_open_cells(spark):
    df = spark.createDataFrame([(-11.0, 95.0), (6.0, 100.0), (0.0, 141.0), (-10.5, 95.49)], "lat double, lon double")
    assert [r[0] for r in grid.with_cell_no(df).select("cell_no").collect()] == [0, None, None, 92]


def test_neighbors_match_brute_force(spark):
    cells = grid.grid_cells(spark).toPandas()
    near = grid.nearest_neighbors(spark).toPandas()
    assert (near.groupby("cell_no").size() == 8).all()
    for number in (0, 91, 1500, 3127, 45):
        me = cells[cells.cell_no == number].iloc[0]
        d = [(round(km(me.lat, me.lon, c.lat, c.lon), 6), c.cell_no) for c in cells.itertuples() if c.cell_no != number]
        assert set(near[near.cell_no == number].other_no) == {c for _, c in sorted(d)[:8]}


def test_radius_matches_brute_force(spark):
    cells = grid.grid_cells(spark).toPandas()
    pairs = grid.radius_pairs(spark, 300.0).toPandas()
    for number in (0, 1600, 3127):
        me = cells[cells.cell_no == number].iloc[0]
        expect = {c.cell_no for c in cells.itertuples() if km(me.lat, me.lon, c.lat, c.lon) <= 300.0}
        assert set(pairs[pairs.cell_no == number].other_no) == expect


def test_nearest_cell_outside_and_on_borders(spark):
    pts = [(1, -30.0, 80.0), (2, 6.5, 150.0), (3, -10.5, 96.0), (4, 0.1, 120.2)]
    got = {r.id: r.cell_no for r in grid.nearest_cell(spark.createDataFrame(pts, "id int, lat double, lon double"), ["id"]).collect()}
    cells = grid.grid_cells(spark).toPandas()
    for i, lat, lon in pts:
        d = (cells.lat - lat) ** 2 + (cells.lon - lon) ** 2
        assert got[i] == int(cells.cell_no.iloc[int(np.argmin(d.round(9)))])


def test_labels_and_names(spark):
    df = spark.createDataFrame([("a", -0.9, 119.9), ("b", -10.9, 95.1)], "cell_id string, lat double, lon double")
    rows = {r.cell_id: r for r in geology.label_points(df).collect()}
    assert rows["a"].full_label == "Sulawesi Tengah - Palu" and not rows["a"].is_offshore
    assert rows["b"].is_offshore and rows["b"].full_label.startswith("Lepas Pantai ")
    assert heads.head_name(30, 5.0) == "label_h30_m50" and heads.head_name(7, 5.25) == "label_h7_m525"


def test_decoding_both_id_forms(spark):
    df = spark.createDataFrame([("Cm108_p952",), ("C_-1.25_120.75",)], "id string")
    rows = df.select(geo.id_center(F.col("id"), 0), geo.id_center(F.col("id"), 1)).collect()
    assert tuple(rows[0]) == (-10.8, 95.2) and tuple(rows[1]) == (-1.25, 120.75)


def test_points_are_labelled_in_their_rows(spark):
    """Keys that differ need no join; repeated keys give what the joins by key give, and rows without a key go."""
    rows = [(1, -6.2, 106.8), (2, 5.5, 95.3), (3, -30.0, 80.0), (4, None, 120.0)]
    kind = "id int, lat double, lon double"
    alone = geology.label_points(spark.createDataFrame(rows, kind), "id")
    assert "Join" not in alone._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(alone.collect()) == sorted(geology._label_by_key(spark.createDataFrame(rows, kind), "id").collect())
    twice = spark.createDataFrame([*rows, rows[0], (2, 1.0, 101.0), (None, 0.0, 110.0)], kind)
    assert sorted(geology.label_points(twice, "id").collect()) == sorted(geology._label_by_key(twice, "id").collect())
