"""Registered queries against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
PICK = ["j13_region_pages", "s5_read_run", "x3_x4_alert_chain", "x5_daily_top", "d2_rebuild_counts", "j14_top_cell_event", "g5_label_points", "g12_radius", "k1_top_forecasts", "d1_j9_dedup", "d7_decluster", "d8_clusters", "a11_features", "b2_labels", "e1_e10_scores",
        "e5_molchan", "e13_backtest_summary", "e15_w6_rank_summary", "m9_blend", "m17_etas_loglik", "s2_append_unseen", "s4_archive_runs", "s8_geojson_feed",
        "s11_page_listing", "s13_csv_import", "x1_stream_ingest", "x2_triggers", "x3_alert_decisions", "x4_cooldown", "x7_stream_visitors", "x8_stream_limit"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", PICK)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(entry.oracle_sql()[name])
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() == 10
