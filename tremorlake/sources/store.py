"""Parquet event store, forecast archive and model registry tables."""

from __future__ import annotations

import itertools
import re
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tremorlake.functions.geo import in_box
from tremorlake.functions.heads import head_columns
from tremorlake.schemas import EVENT
from tremorlake.sources.feeds import conform, first_per_id


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("parquet").load(path).schema  # noqa: B018
        return True
    except AnalysisException:
        return False


YEAR_FILES, FILE_ROWS = 4, 5_000_000  #: parts of a year in one write, and most rows of a file


# --- events ----------------------------------------------------------------------

def write_events(events: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Write by year, so that time filters prune folders; returns the row count."""
    seen = Observation()
    salt = F.pmod(F.xxhash64("event_id"), F.lit(YEAR_FILES))
    (conform(events).observe(seen, F.count(F.lit(1)).alias("n")).withColumn("year", F.year("time")).repartition("year", salt)
     .write.mode(mode).option("maxRecordsPerFile", FILE_ROWS).partitionBy("year").parquet(path))
    return int(seen.get["n"])


def read_events(spark: SparkSession, path: str, start=None, end=None, min_mag=None, box=None) -> DataFrame:
    """Catalog scan; every limit is inclusive and reaches the scan."""
    if not exists(spark, path):
        return spark.createDataFrame([], EVENT)
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where((F.col("time") >= F.lit(start).cast("timestamp")) & (F.col("year") >= F.year(F.lit(start).cast("timestamp"))))
    if end is not None:
        df = df.where((F.col("time") <= F.lit(end).cast("timestamp")) & (F.col("year") <= F.year(F.lit(end).cast("timestamp"))))
    if min_mag is not None:
        df = df.where(F.col("magnitude") >= min_mag)
    if box is not None:
        lat_min, lon_min, lat_max, lon_max = box
        df = df.where(in_box(F.col("lat"), F.col("lon"), lat_min, lat_max, lon_min, lon_max))
    return df.drop("year")


def unseen_events(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose id is not stored yet; the earliest row of an id wins in the batch."""
    return first_per_id(conform(batch), ["time", "source"]).join(known.select("event_id"), "event_id", "left_anti")


def append_events(batch: DataFrame, path: str) -> int:
    """Append unseen events and return how many there were."""
    spark = batch.sparkSession
    known = read_events(spark, path).select("event_id")
    return write_events(unseen_events(batch, known), path, mode="append")


def overwrite_table(df: DataFrame, path: str) -> int:
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return int(seen.get["n"])


# --- forecast archive ---------------------------------------------------------------

#: Beside the archive, a table with a row for each run, so that listing runs reads no maps.
RUN_TABLE, RUN_ROW = ".runs", "issued_date date, run string, forecast_run_id string, baseline_type string, cells bigint"


def safe_version(version: str | None) -> str:
    if not version:
        return "unknown"
    return re.sub(r"[^A-Za-z0-9._-]+", "_", version).strip("_") or "unknown"


def archive_run(forecast: DataFrame, path: str, issued_at: datetime, version: str | None = None,
                raw: DataFrame | None = None, baseline_type: str = "ml") -> str:
    """Write one immutable run below ``issued_date=/run=`` and return its run id.

    A second run in the same second gets a numbered folder; nothing is overwritten.
    """
    run_id = f"{issued_at:%Y-%m-%d}T{issued_at:%H%M%S}Z_{safe_version(version)}"
    out = forecast
    if raw is not None:
        cols = [c for c in head_columns() if c in raw.columns]
        out = out.join(raw.select("cell_id", *[F.col(c).alias(f"raw_{c}") for c in cols]), "cell_id", "left")
    out = out.withColumns({
        "forecast_run_id": F.lit(run_id), "issued_at_utc": F.lit(issued_at.isoformat(sep=" ")).cast("timestamp"),
        "model_version": F.lit(version or "unknown"), "baseline_type": F.lit(baseline_type)})
    for attempt in itertools.count():
        folder = f"{issued_at:%H%M%S}Z_{safe_version(version)}" + (f"_{attempt:02d}" if attempt else "")
        seen = Observation()
        try:
            out.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(f"{path}/issued_date={issued_at:%Y-%m-%d}/run={folder}")
            row = (issued_at.date(), folder, run_id, baseline_type, int(seen.get["n"]))
            out.sparkSession.createDataFrame([row], RUN_ROW).withColumn("issued_at", F.lit(issued_at.isoformat(sep=" ")).cast("timestamp")).write.mode("append").parquet(f"{path}{RUN_TABLE}")
            return run_id
        except AnalysisException as exc:
            if "PATH_ALREADY_EXISTS" not in str(exc):
                raise


def archive(spark: SparkSession, path: str) -> DataFrame:
    """Every archived run; older runs may lack columns."""
    return spark.read.option("mergeSchema", "true").option("basePath", path).parquet(path)


def read_run(spark: SparkSession, path: str, day: str, run_id: str | None = None) -> DataFrame:
    """The latest run of a day, or the run asked for; only that day's folder is read."""
    runs = (spark.read.option("mergeSchema", "true").option("basePath", path).parquet(f"{path}/issued_date={day}")
            .withColumn("issued_date", F.col("issued_date").cast("date")))
    if run_id is not None:
        return runs.where(F.col("forecast_run_id") == run_id)
    last = runs.agg(F.max("run").alias("run"))
    return runs.join(F.broadcast(last), "run", "left_semi")


def archive_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per archived run, from the table of runs; an archive without one is read through."""
    if exists(spark, f"{path}{RUN_TABLE}"):
        return spark.read.parquet(f"{path}{RUN_TABLE}")
    return archive(spark, path).groupBy("issued_date", "run").agg(
        F.first("forecast_run_id").alias("forecast_run_id"), F.first("issued_at_utc").alias("issued_at"),
        F.coalesce(F.first("baseline_type"), F.lit("unknown")).alias("baseline_type"), F.count("*").alias("cells"))


def store_summary(spark: SparkSession, events: str, declustered: str, training: str, archive_path: str) -> DataFrame:
    flags = [F.lit(exists(spark, p)).alias(n) for n, p in
             (("historical", events), ("declustered", declustered), ("training", training))]
    if exists(spark, archive_path):
        return archive(spark, archive_path).agg(F.countDistinct("issued_date").alias("archive_days")).select(*flags, "archive_days")
    return spark.range(1).select(*flags, F.lit(0).cast("bigint").alias("archive_days"))


# --- registry and evaluation payloads -------------------------------------------------

def activate(registry: DataFrame, version: str) -> DataFrame:
    """Mark exactly one version as active."""
    return registry.withColumn("is_active", F.col("version") == version)


def unregistered(found: DataFrame, registry: DataFrame) -> DataFrame:
    return found.join(registry.select("version"), "version", "left_anti")


def backfill_windows(spark: SparkSession, start_year: int, end_year: int, chunk: str = "year") -> DataFrame:
    """Year or month windows to fetch."""
    if chunk not in ("year", "month"):
        raise ValueError("chunk must be year or month")
    step = f"interval 1 {chunk}"
    return spark.sql(f"""select start as window_start, start + {step} as window_end from (
        select explode(sequence(timestamp'{start_year}-01-01', timestamp'{end_year}-12-01', {step})) as start)""")


def missing_windows(windows: DataFrame, events: DataFrame, min_mag: float) -> DataFrame:
    """Windows whose year has no event of at least the given magnitude."""
    have = events.where(F.col("magnitude") >= min_mag).select(F.year("time").alias("year")).distinct()
    return windows.withColumn("year", F.year("window_start")).join(F.broadcast(have), "year", "left_anti")
