"""Streaming and alert queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tremorlake.functions.heads import head_name
from tremorlake.operators import alerts, grid, serving
from tremorlake.operators import geology
from tremorlake.plans import sqlparts as S
from tremorlake.plans.fixtures import quakes, stream_events, table
from tremorlake.plans.q_catalog import _VISITS, RUNS_SQL, _hits, archive_dir, flat, ntz
from tremorlake.plans.q_serving import current
from tremorlake.plans.registry import query
from tremorlake.session import scratch_path
from tremorlake.sources import store
from tremorlake.streaming import flows


FILE_ROWS = 1_000_000  #: rows of one file of a slice, about


def _as_stream(df, name, time=None, batches=4):
    """Land a frame as files and read them back as a stream of several micro-batches.

    With ``time`` the batches are slices of ascending time, landed one after the other. A large
    slice is several files by ``key``: what one key has in a slice stays in one file, so its
    slices come in order however files are dealt to batches.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if time is None:
        df.repartition(batches).write.parquet(path)
    else:
        held = scratch_path(spark, f"{name}-held")
        df.withColumn("_at", F.unix_micros(F.col(time)) if dict(df.dtypes)[time] == "timestamp" else F.col(time).cast("bigint")).write.parquet(held)
        landed = spark.read.parquet(held)
        cuts = landed.approxQuantile("_at", [i / batches for i in range(1, batches)], 0.01)
        files = max(1, -(-landed.count() // (batches * FILE_ROWS)))
        for i in range(batches):
            low = F.lit(True) if i == 0 or not cuts else F.col("_at") > cuts[i - 1]
            high = F.lit(True) if i == batches - 1 or not cuts else F.col("_at") <= cuts[i]
            one = landed.where(low & high).drop("_at")
            (one.coalesce(1) if files == 1 else one.repartition(files, "key")).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files if time else 1).parquet(path)


@query("x1_stream_ingest", S.stmt(S.QUAKES, "select event_id, time, lat, lon, depth, magnitude, source from quakes"))
def x1_stream_ingest(spark, sf_dir):
    """The feed with every third event repeated, over a table that already holds a part."""
    q = quakes(spark, sf_dir)
    path = scratch_path(spark, "live")
    store.append_events(q.where("event_key % 5 = 0"), path)
    feed = _as_stream(q.unionByName(q.where("event_key % 3 = 0")), "feed")
    return flat(flows.ingest(feed, path))


@query("x7_stream_visitors", S.stmt(_VISITS, "select day, visitor_id, first_seen, last_seen, hits from vis"))
def x7_stream_visitors(spark, sf_dir):
    return flows.visitor_counts(_as_stream(_hits(spark, sf_dir), "hits"), "salt").select("day", "visitor_id", *ntz("first_seen", "last_seen"), "hits")


_TICKS = """b as (select min(date_trunc('hour', ts)) as a, max(date_trunc('hour', ts)) as z from events),
t as (select cast(k.user_id as varchar) as key, b.a + to_minutes(cast(30*i.i as bigint)) as tick, i.i from (select distinct user_id from events) k, b, range(0, 2000) i(i) where b.a + to_minutes(cast(30*i.i as bigint)) <= b.z),
c as (select t.key, t.tick, t.i, count(e.event_id) as n from t left join events e on cast(e.user_id as varchar) = t.key and e.ts > t.tick - interval 30 minute and e.ts <= t.tick group by 1,2,3),
f(key, i, tick, pending, reason, last) as (
  select key, i, tick, n, case when n > 0 then 'new_events' else 'fallback' end, tick from c where i = 0
  union all select c.key, c.i, c.tick, r.p, r.reason, case when r.reason in ('new_events','fallback') then c.tick else f.last end
  from f join c on c.key = f.key and c.i = f.i + 1, lateral (select p, case when p > 0 then case when c.tick - f.last < interval 45 minute then 'debounced' else 'new_events' end
    when c.tick - f.last >= interval 180 minute then 'fallback' else 'no_new_events' end as reason from (select case when f.reason in ('new_events','fallback') then c.n else f.pending + c.n end as p)) r)"""


@query("x2_triggers", S.stmt(_TICKS, "select key, tick, pending, reason from f", recursive=True))
def x2_triggers(spark, sf_dir):
    """Half-hourly polls of every reporting station (user), with all its events."""
    ev = stream_events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "ts")
    hour = F.date_trunc("hour", "ts")
    span = ev.agg(F.min(hour).alias("a"), F.max(hour).alias("z"))
    half = 1800
    keys = ev.select("key").distinct().withColumn("j", F.lit(1)).join(F.broadcast(span.withColumn("j", F.lit(1))), "j")
    ticks = keys.select("key", F.explode(F.sequence("a", "z", F.expr("interval 30 minutes"))).alias("tick"))
    at = F.timestamp_seconds(F.ceil(F.unix_micros("ts") / F.lit(half * 1e6)) * half)
    counts = ev.groupBy("key", at.alias("tick")).agg(F.count("*").alias("n"))
    polls = ticks.join(counts, ["key", "tick"], "left").select("key", "tick", F.coalesce("n", F.lit(0)).alias("n_new"))
    out = flows.to_table(flows.triggers(_as_stream(polls, "polls", "tick"), 45, 180), "triggers")
    return out.select("key", *ntz("tick"), "pending", "reason")


@query("x4_cooldown", S.stmt("""e as (select event_type as key, ts from events where value > 20),
f(key, sent_at) as (select key, min(ts) from e group by 1 union all
  select f.key, (select min(ts) from e where e.key = f.key and e.ts >= f.sent_at + interval 60 minute) from f where f.sent_at is not null)""",
       "select key, sent_at from f where sent_at is not null", recursive=True))
def x4_cooldown(spark, sf_dir):
    """Alerts of every event stream with a value above 20, cooled down for an hour."""
    hot = stream_events(spark, sf_dir).where("value > 20").select(F.col("event_type").alias("key"), F.col("ts").alias("time"))
    return flows.to_table(flows.cooled_alerts(_as_stream(hot, "hot", "time")), "alerts").select("key", *ntz("sent_at"))


@query("x8_stream_limit", """with s as (select event_type as key, cast(floor(epoch(ts)) as bigint) as sec, count(*) as n from events group by 1,2),
b as (select *, cast(coalesce(sum(n) over (partition by key order by sec range between 59 preceding and 1 preceding), 0) as bigint) as "before" from s)
select key, sec, n, "before", least(n, greatest(0, 5 - "before")) as allowed from b""")
def x8_stream_limit(spark, sf_dir):
    per_sec = stream_events(spark, sf_dir).groupBy(F.col("event_type").alias("key"), F.unix_seconds("ts").alias("sec")).agg(F.count("*").alias("n"))
    return flows.to_table(flows.attempt_limit(_as_stream(per_sec, "attempts", "sec")), "limits").select("key", "sec", "n", "before", "allowed")


def _maps(spark, sf_dir):
    """30-day maps of every archived run, numbered in issue order."""
    path = archive_dir(spark, sf_dir)
    order = store.archive_runs(spark, path).select(
        "forecast_run_id", F.row_number().over(Window.orderBy("issued_at")).alias("seq"))  # one row per run
    heads = F.inline(F.array(*[F.struct(F.lit(t).alias("mag_threshold"), F.col(head_name(30, t)).alias("p")) for t in (5.0, 5.5, 6.0)]))
    return store.archive(spark, path).join(F.broadcast(order), "forecast_run_id").select("seq", "cell_id", heads)


_PROFILE = "prof as (select * from (values (5e0,20,3e-2,5e-3,25e-2),(55e-1,20,1e-2,35e-4,20e-2),(6e0,50,3e-3,15e-4,20e-2)) x(mag_threshold, n, min_prob, abs_delta, rel_delta))"
_DECIDE = """seqs as (select run_id, row_number() over (order by issued_at) as seq from issues),
tp as materialized (select seq, mag_threshold, cell_id, p, row_number() over (partition by seq, mag_threshold order by p desc, cell_id) as rnk from runs join seqs using (run_id) where horizon_days = 30 and mag_threshold >= 5),
tn as materialized (select t.*, min_prob, abs_delta, rel_delta from tp t join prof using (mag_threshold) where rnk <= n),
mv as (select c.seq, c.mag_threshold, bool_or(c.rnk <= 5 and coalesce(p.rnk, 999) > 5) as entered, bool_or(c.rnk <= 10 and coalesce(p.rnk, c.rnk) - c.rnk >= 10) as jumped
  from tn c left join tn p on p.seq = c.seq-1 and p.mag_threshold = c.mag_threshold and p.cell_id = c.cell_id group by 1,2),
dec as (select c.seq, c.mag_threshold, case when c.p < c.min_prob then 'below_threshold' when p.p is null then 'baseline_snapshot_created' when c.cell_id <> p.cell_id then 'top_cell_changed'
  when p.p < c.min_prob then 'crossed_threshold' when abs(c.p-p.p) >= c.abs_delta then 'absolute_delta' when abs(c.p-p.p)/greatest(p.p,1e-9) >= c.rel_delta then 'relative_delta'
  when c.mag_threshold >= 6 and entered then 'entered_top5' when c.mag_threshold >= 6 and jumped then 'rank_jump' else 'no_significant_change' end as reason
  from tn c join mv using (seq, mag_threshold) left join tn p on p.seq = c.seq-1 and p.mag_threshold = c.mag_threshold and p.rnk = 1 where c.rnk = 1)"""


@query("x3_alert_decisions", S.stmt(S.QUAKES, S.GRID, RUNS_SQL, _PROFILE, _DECIDE, "select cast(seq as int) as seq, mag_threshold, reason, reason not in ('below_threshold','baseline_snapshot_created','no_significant_change') as alert from dec"))
def x3_alert_decisions(spark, sf_dir):
    return alerts.alert_decisions(_maps(spark, sf_dir)).select("seq", "mag_threshold", "reason", "alert")


@query("x3_x4_alert_chain", S.stmt(S.QUAKES, S.GRID, RUNS_SQL, _PROFILE, _DECIDE, """
iss as (select row_number() over (order by issued_at) as seq, issued_at from issues),
al as (select issued_at, string_agg(printf('%.1f', mag_threshold) || ':' || reason, ',' order by printf('%.1f', mag_threshold) || ':' || reason) as reasons from dec join iss using (seq)
  where reason not in ('below_threshold','baseline_snapshot_created','no_significant_change') group by 1),
f(sent_at) as (select min(issued_at) from al union all select (select min(issued_at) from al where issued_at >= f.sent_at + interval 1440 minute) from f where f.sent_at is not null)""",
       "select sent_at, reasons from f join al on issued_at = sent_at", recursive=True))
def x3_x4_alert_chain(spark, sf_dir):
    """Decisions of all thresholds, combined per run, sent under one cool-down of a day."""
    runs = store.archive_runs(spark, archive_dir(spark, sf_dir)).select("issued_at").distinct()
    issued = runs.select(F.row_number().over(Window.orderBy("issued_at")).alias("seq"), "issued_at")  # one row per run
    asked = alerts.combined_alerts(alerts.alert_decisions(_maps(spark, sf_dir)), issued).checkpoint()
    sent = flows.to_table(flows.cooled_alerts(_as_stream(asked.select("key", "time"), "asked", "time"), 1440), "sent")
    return sent.join(asked, F.col("sent_at") == F.col("time")).select(*ntz("sent_at"), "reasons")


@query("j14_top_cell_event", S.stmt(S.QUAKES, S.PUBLIC, f"""top as (select f.cell_no, a.cell_id, a.lat as clat, a.lon as clon from fc f join areas a using (cell_no) where horizon_days=30 and mag_threshold=5 order by probability desc, a.cell_id limit 1),
l as (select * from quakes where magnitude >= 45e-1 and time between timestamp '2001-07-01' - interval 7 day and timestamp '2001-07-01'), d as (select cell_id, event_id, magnitude, -epoch_us(time) as late, {S.hav_atan2('clat', 'clon', 'lat', 'lon')} as dist_km from top, l)
select cell_id, round(min(dist_km), 6) as dist_km, arg_min(event_id, (dist_km, late, event_id)) as event_id, arg_min(magnitude, (dist_km, late, event_id)) as magnitude from d where dist_km <= 2000 group by 1"""))
def j14_top_cell_event(spark, sf_dir):
    top = serving.top_forecasts(geology.area_labels(spark), current(spark, sf_dir), n=1)
    return alerts.top_cell_event(quakes(spark, sf_dir), top, "2001-07-01", 2000.0).select("cell_id", F.round("dist_km", 6).alias("dist_km"), "event_id", "magnitude")


@query("x5_daily_top", S.stmt(S.QUAKES, S.PUBLIC, """t as (select a.cell_id, full_label, probability, row_number() over (order by probability desc, a.cell_id) as place from fc f join areas a using (cell_no) where horizon_days=30 and mag_threshold=5)
select cast(place as int) as place, cell_id, full_label, probability, '2001-07-01' as day from t where place <= 10"""))
def x5_daily_top(spark, sf_dir):
    """The ten likeliest cells that head every daily report."""
    top = serving.top_forecasts(geology.area_labels(spark), current(spark, sf_dir), n=10)
    return top.select(F.row_number().over(Window.orderBy(F.desc("probability"), "cell_id")).alias("place"), "cell_id", "full_label", "probability", F.lit("2001-07-01").alias("day"))


@query("x5_daily_report", S.stmt(S.QUAKES, S.PUBLIC, """us as (select c_custkey as chat_id, (c_custkey*7919 % 17000 - 11000)/1e3 as lat, (c_custkey*104729 % 46000 + 95000)/1e3 as lon from customer where c_acctbal >= 0
  and c_custkey not in (select o_custkey from orders where o_orderpriority like '1%') and c_custkey % 5 <> 0),
pk as (select u.chat_id, arg_min(g.cell_no, round(pow(g.lat-u.lat,2)+pow(g.lon-u.lon,2), 9)*1e4 + g.cell_no*1e-7) as cell_no from us u join grid g on abs(g.lat-u.lat) <= 1 and abs(g.lon-u.lon) <= 1 group by 1)
select chat_id, any_value(f.cell_id) as cell_id, max(probability) filter (where horizon_days=7) as p7, max(probability) filter (where horizon_days=30) as p30, '2001-07-01' as day from pk join fc f using (cell_no) where mag_threshold=5 group by 1"""))
def x5_daily_report(spark, sf_dir):
    """Active users' own cells; users already served today (every fifth) are left out."""
    people = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(
        F.col("c_custkey").alias("chat_id"), ((F.col("c_custkey") * 7919 % 17000 - 11000) / 1e3).alias("lat"), ((F.col("c_custkey") * 104729 % 46000 + 95000) / 1e3).alias("lon"))
    out = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("chat_id"))
    sent = people.where("chat_id % 5 = 0").select("chat_id", F.lit("2001-07-01").alias("day"))
    report = alerts.daily_report(grid.nearest_cell(people, ["chat_id"]), out, current(spark, sf_dir), "2001-07-01", sent)
    return report.select("chat_id", "cell_id", "p7", "p30", "day")
