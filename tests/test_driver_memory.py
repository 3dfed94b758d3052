"""Event-sized sides of joins stay off the driver, whatever the session's broadcast limit is when a plan is made."""

import re

import pytest

from tests.helpers import frame, swarm
from tremorlake.operators import decluster, dedup, features
from tremorlake.operators.catalog_stats import mc_lookup
from tremorlake.operators.grid import with_cell_no

KEYS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture
def plans(spark, monkeypatch):
    """Plans of all checkpoints, made under a limit that lets Spark broadcast any side."""
    was, seen, kind = {k: spark.conf.get(k) for k in KEYS}, [], type(spark.range(0))
    whole = kind.checkpoint

    def told(df, *args, **more):
        seen.append(plan(df))
        return whole(df, *args, **more)

    monkeypatch.setattr(kind, "checkpoint", told)
    for key in KEYS:
        spark.conf.set(key, "1g")
    yield seen
    for key, value in was.items():
        spark.conf.set(key, value) if value else spark.conf.unset(key)


@pytest.fixture
def events(spark, tmp_path):
    """From files, so that Spark believes to know their size."""
    frame(spark, swarm(300)).write.parquet(str(tmp_path / "events"))
    return spark.read.parquet(str(tmp_path / "events"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_sends_no_events_to_the_driver(events, plans):
    plans.append(plan(dedup.dedup_events(events)))
    assert sum("SortMergeJoin" in p for p in plans) >= 3
    assert not [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("a_row", [decluster.PAIRS_A_ROW, 0])
def test_decluster_sends_no_events_to_the_driver(events, plans, monkeypatch, a_row):
    """With and without the pass that leaves out rows of no use; carries of the numbering are a row for each part."""
    monkeypatch.setattr(decluster, "PAIRS_A_ROW", a_row)
    plans.append(plan(decluster.decluster(events)))
    assert sum("SortMergeJoin" in p for p in plans) >= 3
    assert not re.findall(r"BroadcastHashJoin \[(?!part#).*", "\n".join(plans))


def test_slopes_send_no_windows_to_the_driver(events, plans):
    """Completeness (36 rows) and busy cells are small; what has a row for each cell and snapshot is not."""
    events = with_cell_no(events)
    snaps = features.Snapshots.over(events, 7)
    stats = features.window_stats(features.daily(events, snaps), mc_lookup(events), snaps)
    joins = plan(features.b_slopes(events, stats, snaps))
    assert "SortMergeJoin [cell_no" in joins
    assert not re.findall(r"BroadcastHashJoin \[cell_no#\d+, k#\d+.*", joins)
