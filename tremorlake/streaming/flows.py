"""Structured Streaming jobs: ingest, visitor counts, triggers, cool-downs, limits.

Every job drains what is there (``availableNow``) or runs on, as the caller's trigger
says. State is bounded by keys and by the look-back, never by the stream's length;
a micro-batch is bounded by the reader's ``maxFilesPerTrigger``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tremorlake import constants as K
from tremorlake.operators.usage import daily_visitors
from tremorlake.session import scratch_path
from tremorlake.sources.store import append_events, read_events


def drain(stream: DataFrame, name: str, handler, mode: str = "append") -> None:
    """Run a stream through a batch handler until its input is used up."""
    query = (stream.writeStream.outputMode(mode).foreachBatch(handler).trigger(availableNow=True)
             .option("checkpointLocation", scratch_path(stream.sparkSession, f"stream-{name}")).start())
    query.awaitTermination()


def to_table(stream: DataFrame, name: str, mode: str = "append", shape=lambda batch: batch) -> DataFrame:
    """Drain into a Parquet table, each micro-batch shaped first; a replayed batch overwrites its own folder."""
    spark = stream.sparkSession
    path = scratch_path(spark, f"table-{name}")
    drain(stream, name, lambda df, batch: shape(df).write.mode("overwrite").parquet(f"{path}/batch={batch}"), mode)
    return spark.read.option("basePath", path).parquet(path)


# --- ingest ------------------------------------------------------------------------------

def ingest(stream: DataFrame, table_path: str) -> DataFrame:
    """Idempotent ingest: a micro-batch drops its own repeats and, by an anti-join with the
    table, everything stored before. No watermark: late events are events like any other."""
    drain(stream, "ingest", lambda df, _: append_events(df, table_path))
    return read_events(stream.sparkSession, table_path)


# --- visitors ------------------------------------------------------------------------------

def visitor_counts(hits: DataFrame, salt: str) -> DataFrame:
    """Per-day visitor counters: each micro-batch leaves its partial counts, which add up.

    Nothing is kept in state and nothing is ever too late: a hit of a past day is one more
    partial count of that day.
    """
    rows = to_table(hits, "visitors", shape=lambda batch: daily_visitors(batch, salt))
    return rows.groupBy("day", "visitor_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("hits").alias("hits"))


# --- recompute trigger -----------------------------------------------------------------------

def triggers(ticks: DataFrame, debounce_min: int = K.DEBOUNCE_MIN, fallback_min: int = K.FALLBACK_HOURS * 60) -> DataFrame:
    """Decision per tick: no_new_events, debounced, new_events or fallback.

    ``ticks(key, tick, n_new)`` has one row per poll with the events since the last poll;
    pending events stay pending until a run.
    """
    def decide(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, last = state.get if state.exists else (0, -1)
        parts = [(b["tick"].to_numpy(), b["n_new"].to_numpy()) for b in batches]
        ticks, new = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(ticks, kind="stable")
        ticks, seconds = ticks[order], np.trunc(ticks[order].astype("datetime64[us]").astype(np.int64) / 1e6).astype(np.int64)
        held, reasons = [], []
        for now, n_new in zip(seconds.tolist(), new[order].tolist()):
            pending += n_new
            age = None if last < 0 else now - last
            if pending > 0:
                reason = "debounced" if age is not None and age < debounce_min * 60 else "new_events"
            else:
                reason = "fallback" if age is None or age >= fallback_min * 60 else "no_new_events"
            held.append(pending)
            reasons.append(reason)
            if reason in ("new_events", "fallback"):
                pending, last = 0, now
        state.update((pending, last))
        yield pd.DataFrame({"key": key[0], "tick": ticks, "pending": held, "reason": reasons})

    return ticks.groupBy("key").applyInPandasWithState(
        decide, "key string, tick timestamp, pending long, reason string", "pending long, last long", "append", GroupStateTimeout.NoTimeout)


# --- cool-down -------------------------------------------------------------------------------

def cooled_alerts(triggered: DataFrame, minutes: int = K.ALERT_COOLDOWN_MIN) -> DataFrame:
    """Alerts that are sent: at least the cool-down after the last one sent, per stream."""
    def pick(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for at in pd.concat(list(batches))["us"].sort_values():
            if last is None or at - last >= minutes * 60_000_000:
                out.append((key[0], int(at)))
                last = int(at)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["key", "us"])

    return triggered.select("key", F.unix_micros("time").alias("us")).groupBy("key").applyInPandasWithState(
        pick, "key string, us long", "last long", "append", GroupStateTimeout.NoTimeout).select("key", F.timestamp_micros("us").alias("sent_at"))


# --- attempt limit ---------------------------------------------------------------------------

def attempt_limit(attempts: DataFrame, limit: int = K.ADMIN_ATTEMPTS, seconds: int = K.ATTEMPT_WINDOW_S) -> DataFrame:
    """Attempts per second and key with the earlier ones in the window; state holds at most
    ``seconds`` counters per key. ``attempts(key, sec, n)`` is counted per second upstream."""
    def check(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        secs, counts = (list(v) for v in state.get) if state.exists else ([], [])
        out = []
        for sec, n in pd.concat(list(batches)).groupby("sec")["n"].sum().items():
            keep = [i for i, s in enumerate(secs) if sec - s < seconds]
            secs, counts = [secs[i] for i in keep], [counts[i] for i in keep]
            before = sum(counts)
            out.append((key[0], int(sec), int(n), before, min(int(n), max(0, limit - before))))
            secs.append(int(sec))
            counts.append(int(n))
        state.update((secs, counts))
        yield pd.DataFrame(out, columns=["key", "sec", "n", "before", "allowed"])

    return attempts.groupBy("key").applyInPandasWithState(
        check, "key string, sec long, n long, before long, allowed long", "secs array<bigint>, counts array<bigint>", "append", GroupStateTimeout.NoTimeout)
