"""Page listings, run tables, addresses of labels and stored heads."""

import json
import re
from datetime import date, datetime

from pyspark.sql import functions as F

from tremorlake.operators import learning, serving, usage
from tremorlake.plans import fixtures, q_catalog
from tremorlake.sources import feeds, store


def page(entries):
    return f"<html><script>var x = 1;</script><script>{json.dumps(entries)}</script></html>"


def test_listing_fields_are_looked_up(spark):
    long_form = [{"Infogempa": 1}, {"gempa": 2}, [3, 4, {"eventid": "own", "mag": 4.5}, 99], {"eventid": 5, "waktu": "t", "mag": 6, "area": 7}, "not a record", "e1", 5.5, {"n": 1}]
    rows = [(1, page(long_form)), (2, page([{"Infogempa": 1}, {"gempa": "none"}])), (3, "<script>Infogempa gempa {broken</script>"), (4, None), (5, "")]
    got = [r.asDict() for r in feeds.page_records(spark.createDataFrame(rows, "page_id bigint, html string")).collect()]
    assert sorted((g["page_id"], g["eventid"], float(g["mag"]), g["waktu"]) for g in got) == [(1, "e1", 5.5, "t"), (1, "own", 4.5, None)]
    assert {g["area"] for g in got} == {'{"n":1}', None}


def test_runs_are_listed_without_reading_them(spark, tmp_path):
    maps = spark.createDataFrame([(f"c{i}", 0.1) for i in range(5)], "cell_id string, label_h30_m50 double")
    path, at = f"{tmp_path}/archive", datetime(2001, 7, 1, 6)
    ids = [store.archive_run(maps, path, at, "v 1") for _ in range(2)]
    assert ids == ["2001-07-01T060000Z_v_1"] * 2
    runs = store.archive_runs(spark, path).orderBy("run").collect()
    assert [(r.run, r.cells, r.issued_at) for r in runs] == [("060000Z_v_1", 5, at), ("060000Z_v_1_01", 5, at)]
    assert store.read_run(spark, path, "2001-07-01").select("run").distinct().count() == 1
    assert store.archive(spark, path).count() == 10


def test_long_labels_keep_their_own_address(spark):
    labels = spark.createDataFrame([("Kab. Ä " + "x" * 90 + "1",), ("Kab. Ä " + "x" * 90 + "2",), ("Ä b",), (None,)], "label string")
    got = [r[0] for r in labels.select(serving.slug(F.col("label"))).collect()]
    assert len(set(got)) == 4 and got[2] == "a-b" and got[3] == "unknown"


def test_recent_events_are_all_there(spark):
    events = spark.range(700).select(F.concat(F.lit("e"), "id").alias("event_id"), F.timestamp_seconds(F.col("id") + 994000000).alias("time"), F.lit(5.0).alias("magnitude"), F.lit("usgs").alias("source"))
    assert usage.recent_events(events, "2001-07-02").count() == 700
    assert usage.recent_events(events, "2001-07-02", limit=3).count() == 3


def test_a_head_is_stored_and_read(spark, tmp_path):
    rows = [(i, float(i % 7), float(i % 3), int(i % 7 > 4)) for i in range(80)]
    data = spark.createDataFrame(rows, "k bigint, a double, b double, y int")
    boosted, forest = learning.fit_learners(data, "y", ["a", "b"], rounds=2, trees=3)
    head = learning.HeadModel(boosted, forest, {"kind": "platt", "a": 1.0, "b": 0.0, "c": -0.5, "xs": [0.0], "ys": [0.0]}, {"platt": 0.1}, ["a", "b"])
    registry = spark.createDataFrame([("v1", False), ("v2", True)], "version string, is_active boolean")
    path = learning.active_path(registry, f"file://{tmp_path}/models", "label_h30_m50")
    assert path.endswith("/v2/label_h30_m50")
    learning.save_head(head, path)
    again = learning.load_head(spark, path)
    assert (again.calibrator, again.metrics, again.features) == (head.calibrator, head.metrics, head.features)
    scores = lambda m: [(r.k, round(r.p1, 9), round(r.p2, 9)) for r in learning.score(m, data).orderBy("k").collect()]
    assert scores(again) == scores(head)
    learning.save_head(learning.HeadModel(None, None, head.calibrator, {}, ["a"]), f"file://{tmp_path}/none")
    assert learning.load_head(spark, f"file://{tmp_path}/none").boosted is None


def test_records_do_not_carry_the_entries_of_their_page(spark):
    pages = spark.createDataFrame([(1, page([{"Infogempa": 1}, {"gempa": 2}, [3], {"eventid": "a"}]))], "page_id bigint, html string")
    plan = feeds.page_records(pages)._jdf.queryExecution().optimizedPlan().toString()
    line = plan[plan.index("Generate explode"):].splitlines()[0]
    assert re.search(r", \[1, 2\], false, \[texts#\d+\]$", line)  # of page_id, entries and items only the first goes on


def test_the_first_record_of_an_agency_id_counts(spark, tmp_path):
    """Reports of one second and place share an id: one of them comes out, the shallowest."""
    twin = 86_400 * 1_501  # keys so far apart have the same second and place, other depths and magnitudes
    keys = [k + i * twin for k in range(1, 60) for i in range(6)]
    spark.createDataFrame([(k, 43 + k % 3, date(2000, 1, 5)) for k in keys], "o_orderkey bigint, o_custkey bigint, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([], "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    sent = fixtures.quakes(spark, str(tmp_path)).where("magnitude >= 4.2 and lat between -9 and 5 and lon between 96 and 140").collect()
    place = lambda e: (e.time, round(e.lat, 2), round(e.lon, 2))
    got = q_catalog.s10_s12_agency_feed(spark, str(tmp_path)).collect()
    assert sorted(map(place, got)) == sorted({place(e) for e in sent}) and len(got) < len(sent)
    all_of = {p: sorted((e.depth, e.magnitude) for e in sent if place(e) == p) for p in map(place, sent)}
    assert {place(e): (e.depth, e.magnitude) for e in got} == {p: v[0] for p, v in all_of.items()}
