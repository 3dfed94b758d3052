"""Session settings: what Spark may broadcast without being asked."""

import pytest

from tremorlake.session import BROADCAST_MOST, bound_broadcasts, prepare, size_bytes

KEYS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture
def settings(spark):
    yield spark.conf
    for key in KEYS:
        spark.conf.unset(key)
    prepare(spark)


def test_a_compressed_side_of_many_rows_is_not_broadcast(spark, settings, tmp_path):
    """A million rows in a few MB of files, which Spark's own limit of 10 MB would send to the driver."""
    path = str(tmp_path / "rows")
    spark.range(1_000_000).selectExpr("hash(id) as u", "id % 7 as v").write.parquet(path)
    settings.set(KEYS[0], "10MB")
    prepare(spark)
    side = spark.read.parquet(path)
    plan = side.join(spark.read.parquet(path).withColumnRenamed("v", "w"), "u")
    assert plan.count() > 0
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_a_limit_nobody_has_set_is_bounded(spark, settings, tmp_path):
    """Spark's own 10 MB hold in a session that names no limit."""
    path = str(tmp_path / "rows")
    spark.range(1_000_000).selectExpr("hash(id) as u", "id % 7 as v").write.parquet(path)
    for key in KEYS:
        settings.unset(key)
    prepare(spark)
    assert size_bytes(settings.get(KEYS[0])) == BROADCAST_MOST
    side = spark.read.parquet(path)
    plan = side.join(spark.read.parquet(path).withColumnRenamed("v", "w"), "u")
    assert plan.count() > 0
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_a_lower_limit_stays(spark, settings):
    settings.set(KEYS[0], "-1")
    settings.set(KEYS[1], "1g")
    bound_broadcasts(spark)
    assert settings.get(KEYS[0]) == "-1" and settings.get(KEYS[1]) == str(BROADCAST_MOST)
    assert [size_bytes(x) for x in ("10485760b", "10MB", "256k", " 7 ", "-1")] == [10 << 20, 10 << 20, 256 << 10, 7, -1]


def test_a_large_slice_lands_as_files_by_key(spark, monkeypatch):
    """What one key has in a slice is in one file, and slices follow each other."""
    import glob
    import os

    from pyspark.sql import functions as F

    from tremorlake.plans import q_stream
    monkeypatch.setattr(q_stream, "FILE_ROWS", 100)
    paths = []
    whole = q_stream.scratch_path
    monkeypatch.setattr(q_stream, "scratch_path", lambda s, name: paths.append(whole(s, name)) or paths[-1])
    rows = spark.range(2000).select((F.col("id") % 40).cast("string").alias("key"), F.timestamp_seconds("id").alias("tick"), F.lit(1).cast("bigint").alias("n_new"))
    q_stream._as_stream(rows, "polls", "tick")
    files = sorted(glob.glob(paths[0].removeprefix("file://") + "/*.parquet"), key=os.path.getmtime)
    assert len(files) > 4
    held = [spark.read.parquet(f).groupBy("key").agg(F.min("tick").alias("a"), F.max("tick").alias("z")).collect() for f in files]
    last = {}
    for one in held:
        for r in one:
            assert r.key not in last or last[r.key] < r.a
            last[r.key] = r.z
    assert sum(map(len, held)) == 4 * 40
