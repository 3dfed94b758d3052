"""Catalog reports, job-run audits, visitor counts and attempt limits (batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake import constants as K


def complete_events(events: DataFrame, mc: float) -> DataFrame:
    """Events at or above the completeness magnitude; missing magnitudes go."""
    return events.where(F.col("magnitude").isNotNull() & ~F.isnan("magnitude") & (F.col("magnitude") >= mc))


def completeness_report(events: DataFrame, mc: float) -> DataFrame:
    keep = F.coalesce(~F.isnan("magnitude") & (F.col("magnitude") >= mc), F.lit(False))
    return events.agg(F.lit(mc).alias("mc_value"), F.count_if(keep).alias("kept"), F.count_if(~keep).alias("mc_filter_dropped"))


def recent_events(events: DataFrame, now: str, days: int = 7, min_mag: float | None = None,
                  source: str | None = None, limit: int | None = None) -> DataFrame:
    """Events of the last days, newest first; all of them unless a ``limit`` is asked for."""
    since = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    out = events.where(F.col("time") >= since)
    if min_mag is not None:
        out = out.where(F.col("magnitude") >= min_mag)
    if source is not None:
        out = out.where(F.col("source") == source)
    out = out.orderBy(F.desc("time"), "event_id")
    return out if limit is None else out.limit(limit)


def quality_checks(events: DataFrame) -> DataFrame:
    """One row of data-quality counts; ids are checked by a pre-aggregated count."""
    ids = events.groupBy("event_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("depth") < 0).alias("neg"), F.count_if(~F.coalesce(F.col("source").isin("usgs", "emsc", "bmkg"), F.lit(False))).alias("src"),
        F.count_if(~(F.col("lat").between(K.LAT_MIN, K.LAT_MAX) & F.col("lon").between(K.LON_MIN, K.LON_MAX))).alias("out"))
    return ids.agg(F.sum("n").alias("n_rows"), F.sum("neg").alias("negative_depth"), F.sum("src").alias("unknown_source"),
                   F.sum("out").alias("outside_box"), F.sum(F.col("n") - 1).alias("duplicate_ids"))


def catalog_audit(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("*").alias("n_rows"), F.min("time").alias("time_min"), F.max("time").alias("time_max"),
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
        F.min("magnitude").alias("mag_min"), F.max("magnitude").alias("mag_max"),
        *[F.count_if(F.col("magnitude") >= t).alias(f"m_ge_{int(t * 10)}") for t in K.AUDIT_THRESHOLDS],
        *[F.count_if(F.col("source") == s).alias(f"n_{s}") for s in ("usgs", "emsc", "bmkg")],
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("depth", "mag_type", "place")])


def counts_by_year(events: DataFrame) -> DataFrame:
    return events.groupBy(F.year("time").alias("year")).agg(*[
        F.count_if(F.col("magnitude") >= t).alias(f"m_ge_{int(t * 10)}") for t in K.AUDIT_THRESHOLDS])


def missing_years(events: DataFrame) -> DataFrame:
    """Years between the first and last event without any event."""
    years = events.select(F.year("time").alias("year")).distinct()
    span = years.agg(F.min("year").alias("a"), F.max("year").alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("year")).exceptAll(years)


# --- usage ---------------------------------------------------------------------------

def tracked(path: Column) -> Column:
    out = F.lit(True)
    for prefix in K.UNTRACKED_PREFIXES:
        out = out & ~F.startswith(path, F.lit(prefix))
    return out


def address_bucket(ip: Column) -> Column:
    """First three octets of an IPv4, first three groups of a plain IPv6 address."""
    four = r"^(\d{1,3}\.\d{1,3}\.\d{1,3})\.\d{1,3}$"
    return (F.when(ip.rlike(four), F.concat(F.regexp_extract(ip, four, 1), F.lit(".0")))
            .when(F.contains(ip, F.lit(":")), F.concat(F.substring_index(ip, ":", 3), F.lit("::"))).otherwise("unknown"))


def visitor_hash(day: Column, ip: Column, agent: Column, salt: str) -> Column:
    return F.sha2(F.concat_ws("|", day, address_bucket(ip), F.coalesce(agent, F.lit("")), F.lit(salt)), 256)


def daily_visitors(hits: DataFrame, salt: str) -> DataFrame:
    """Hits per day and visitor (``time, path, ip, agent``)."""
    day = F.date_format("time", "yyyy-MM-dd")
    return hits.where(tracked(F.col("path"))).groupBy(
        day.alias("day"), visitor_hash(day, F.col("ip"), F.col("agent"), salt).alias("visitor_id")).agg(
        F.min("time").alias("first_seen"), F.max("time").alias("last_seen"), F.count("*").alias("hits"))


def active_users(visitors: DataFrame) -> DataFrame:
    return visitors.groupBy("day").agg(F.count("*").alias("dau"), F.sum("hits").alias("hits"))


def attempts_in_window(attempts: DataFrame, key: str, time: str, limit: int = K.ADMIN_ATTEMPTS,
                       seconds: int = K.ATTEMPT_WINDOW_S) -> DataFrame:
    """Earlier attempts of a key in the rolling window, and the rejection flag.

    Attempts are counted per second first, so a hot key costs at most one row per
    second in a window; keys are split by hour with the previous hour's tail copied in.
    """
    sec = F.unix_seconds(time)
    per_sec = attempts.groupBy(key, sec.alias("sec")).agg(F.count("*").alias("n"))
    hour = 3600
    shared = per_sec.withColumn("slot", F.explode(F.array_distinct(F.array(
        F.floor(F.col("sec") / hour), F.floor((F.col("sec") + seconds) / hour)))))
    earlier = Window.partitionBy(key, "slot").orderBy("sec").rangeBetween(-(seconds - 1), -1)
    out = shared.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where(
        F.col("slot") == F.floor(F.col("sec") / hour))
    return out.select(key, "sec", "n", "before",
                      F.least(F.col("n"), F.greatest(F.lit(0), F.lit(limit) - F.col("before"))).alias("allowed"))


def run_guard(runs: DataFrame, cooldown: int = 300) -> DataFrame:
    """Seconds since the previous start of the same job, cooling and overlap flags.

    Starts are compared inside (job, day); each day's first start looks at the last
    start of the job's previous active day, found on the small per-day table.
    """
    day = F.to_date("started_at")
    runs = runs.withColumn("_day", day)
    last = runs.groupBy("job_name", "_day").agg(F.max(F.struct("started_at", "finished_at")).alias("last"))
    by_job = Window.partitionBy("job_name").orderBy("_day")
    links = last.select("job_name", "_day", F.lag("last").over(by_job).alias("carry"))
    inside = Window.partitionBy("job_name", "_day").orderBy("started_at", "run_id")
    prev = F.coalesce(F.lag(F.struct("started_at", "finished_at")).over(inside), F.col("carry"))
    out = runs.join(links, ["job_name", "_day"]).withColumn("_prev", prev)
    gap = F.unix_seconds("started_at") - F.unix_seconds(F.col("_prev.started_at"))
    return out.withColumns({"gap_seconds": gap, "cooling": F.coalesce(gap < cooldown, F.lit(False)),
                            "overlap": F.coalesce(F.col("_prev.finished_at") > F.col("started_at"), F.lit(False))}).drop("_prev", "carry", "_day")


def run_status(runs: DataFrame, now: str, fallback_hours: int = K.FALLBACK_HOURS) -> DataFrame:
    """Last run, last success and freshness per job."""
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("last_success")) / 3600.0
    return runs.groupBy("job_name").agg(
        F.count("*").alias("n_runs"), F.count_if(F.col("status") == "error").alias("n_errors"),
        F.max("started_at").alias("last_start"),
        F.max(F.when(F.col("status") == "success", F.col("started_at"))).alias("last_success"),
        F.max(F.struct("started_at", "run_id", "status"))["status"].alias("last_status"),
    ).withColumns({"age_hours": F.round(age, 6), "fresh": F.coalesce(age <= max(fallback_hours * 2, 6), F.lit(False))})


def tier_counts(runs: DataFrame, now: str, hours: int) -> DataFrame:
    """Archive runs per tier inside the last hours (day folders prune first)."""
    since = F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(hours))
    return runs.where((F.col("issued_date") >= F.to_date(since)) & (F.col("issued_at") >= since)).groupBy(
        "baseline_type").agg(F.count("*").alias("n_runs"), F.max("issued_at").alias("last_issued"))
