"""Cross-agency duplicates: an order-dependent filter and leader clustering.

Both rules are sequential on paper. Here they run in rounds over bucketed
candidates; no group of rows is ever gathered whole, and no pairs are emitted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.operators.graph import components
from tremorlake.operators.scan import running_totals
from tremorlake.session import event_sized, scratch_root

#: Rounds in which components of buckets are told apart; longer chains of buckets run as one unit, cut in time.
_STAR_ROUNDS = 4
_COARSE_T, _COARSE_DEG = 4 * K.DEDUP_SECONDS * 1_000_000, 4 * K.DEDUP_DEG


def _ranked(events: DataFrame) -> DataFrame:
    order = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in K.DEDUP_SOURCE_ORDER for v in p]), F.col("source")), F.lit(9))
    us = F.unix_micros("time")
    fine = [F.floor(us / (K.DEDUP_SECONDS * 1e6)), F.floor(F.col("lat") / K.DEDUP_DEG),
            F.floor(F.col("lon") / K.DEDUP_DEG), F.floor(F.col("magnitude") / K.DEDUP_MAG)]
    return events.select(
        "event_id", F.struct(order.alias("p"), us.alias("t"), F.col("event_id").alias("id")).alias("rank"),
        us.alias("t"), "lat", "lon", F.col("magnitude").alias("mag"),
        *[c.alias(f"f{i}") for i, c in enumerate(fine)],
        F.struct(F.floor(us / _COARSE_T).alias("a"), F.floor(F.col("lat") / _COARSE_DEG).alias("b"),
                 F.floor(F.col("lon") / _COARSE_DEG).alias("c")).alias("cell"))


def _spread(leaders: DataFrame) -> DataFrame:
    """Leaders listed per coarse cell they can reach (1 to 8 cells, 3.4 on average)."""
    def reach(value, margin, width):
        return F.explode(F.sequence(F.floor((value - margin) / width), F.floor((value + margin) / width)))

    eps = K.DEDUP_DEG + 1e-9
    return (leaders
            .withColumn("_a", reach(F.col("t"), K.DEDUP_SECONDS * 1_000_000, _COARSE_T))
            .withColumn("_b", reach(F.col("lat"), eps, _COARSE_DEG)).withColumn("_c", reach(F.col("lon"), eps, _COARSE_DEG))
            .groupBy(F.struct(F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("_c").alias("c")).alias("cell"))
            .agg(F.collect_list(F.struct("rank", "t", "lat", "lon", "mag")).alias("leaders")))


def _alike(o: Column) -> Column:
    return ((F.abs(o["t"] - F.col("t")) <= K.DEDUP_SECONDS * 1_000_000) & (F.abs(o["lat"] - F.col("lat")) <= K.DEDUP_DEG)
            & (F.abs(o["lon"] - F.col("lon")) <= K.DEDUP_DEG) & (F.abs(o["mag"] - F.col("mag")) <= K.DEDUP_MAG))


def kept_events(events: DataFrame) -> DataFrame:
    """Ids kept when events are taken in (source order, time) and dropped if they
    duplicate a kept one.

    Two events in the same 60 s x 0.5 x 0.5 x 0.5 bucket always duplicate each other,
    so a bucket keeps at most one event: its leader, the best undecided one. A round
    keeps every leader that no better undecided event duplicates and drops whatever
    duplicates a kept leader. The best undecided event always decides, so the loop
    ends; usually after two rounds. A bucket of copies costs one leader, and the lists
    that travel are bounded by the number of buckets near a coarse cell.
    """
    scratch_root(events.sparkSession)
    open_events = _ranked(events).checkpoint()
    kept = None
    while True:
        leaders = open_events.groupBy("f0", "f1", "f2", "f3").agg(
            F.min(F.struct("rank", "t", "lat", "lon", "mag")).alias("l")).select("l.*")
        near = open_events.join(event_sized(_spread(leaders)), "cell", "left")
        worse = F.filter("leaders", lambda o: (o["rank"] > F.col("rank")) & _alike(o))
        blocked = near.select(F.explode(F.transform(worse, lambda o: o["rank"]["id"])).alias("event_id")).distinct()
        won = leaders.withColumn("event_id", F.col("rank.id")).join(event_sized(blocked), "event_id", "left_anti").checkpoint()
        kept = won.select("event_id") if kept is None else kept.unionByName(won.select("event_id"))
        rest = open_events.join(event_sized(_spread(won)), "cell", "left").where(
            ~F.coalesce(F.exists("leaders", _alike), F.lit(False))).drop("leaders").checkpoint()
        if rest.isEmpty():
            return kept
        open_events = rest


def dedup_events(events: DataFrame) -> DataFrame:
    return events.join(event_sized(kept_events(events)), "event_id", "left_semi")


# --- leader clustering ----------------------------------------------------------------

_STATE = "seed string, order_t long, order_m double, t long, lat double, lon double, mag double, score int, rep string"
_STATE_NAMES = [c.split()[0] for c in _STATE.split(", ")]
_ROW = ["t", "lat", "lon", "mag"]


def _reach(values, margin: float):
    """First and last lattice line, two margins apart, that each value reaches."""
    import numpy as np
    return np.floor((values - margin) / (2 * margin)).tolist(), np.floor((values + margin) / (2 * margin)).tolist()


def _fold(seconds: int, km: float, mag_window: float | None, by_score: bool) -> Callable:
    """Assign the rows of one bounded unit, starting from the clusters still open.

    Open clusters stand in the fields of a lattice around their representative, so that a row
    looks at those near it and not at all that are open anywhere.
    """
    def run(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        import math

        import numpy as np
        limit, deg = seconds * 1_000_000, km / 111.0 + 0.01
        unit, part = rows["unit"].iloc[0], int(rows["part"].iloc[0])
        rows, state = rows.sort_values(["t", "nm", "event_id"]), state.sort_values(["order_t", "order_m", "seed"])
        both = [np.concatenate([rows[c].to_numpy(float), state[c].to_numpy(float)]) for c in ("lat", "lon")]
        widest = np.nanmax(np.abs(both[0]), initial=0.0) + deg
        lon_deg = math.degrees(math.asin(min(1.0, math.sin(math.radians(deg)) / max(math.cos(math.radians(min(widest, 90.0))), 1e-9)))) + 0.01
        if not np.nanmax(np.abs(both[1]), initial=0.0) + 2 * lon_deg < 180 or widest >= 90:
            lon_deg = 1e9  # near the date line or a pole: bands of latitude only
        a0, a1 = _reach(both[0], deg)
        b0, b1 = _reach(both[1], lon_deg)
        home = [*zip(np.floor(both[0] / (2 * deg)).tolist(), np.floor(both[1] / (2 * lon_deg)).tolist())]
        n, fields, live, members = len(rows), {}, [], []

        def near(c, row_lat, row_lon):
            x, y = math.radians(c[4]), math.radians(row_lat)
            h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(row_lon - c[5]) / 2) ** 2
            return 2 * K.EARTH_RADIUS_KM * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h))) <= km

        def opened(c, at):  # order of creation and field follow the nine columns of the state
            c += [len(live), at]
            live.append(c)
            fields.setdefault(at, []).append(c)

        for i, c in enumerate(state[_STATE_NAMES].itertuples(index=False)):
            opened(list(c), home[n + i])
        columns = [rows[c].tolist() for c in ("event_id", "t", "nm", "lat", "lon", "mag", "score")]
        for i, (event_id, t, nm, lat, lon, mag, score) in enumerate(zip(*columns)):
            hit, since = None, t - limit
            for a in (a0[i],) if a0[i] == a1[i] else (a0[i], a1[i]):
                for b in (b0[i],) if b0[i] == b1[i] else (b0[i], b1[i]):
                    field = fields.get((a, b))
                    if not field:
                        continue
                    if any(c[3] < since for c in field):
                        field[:] = [c for c in field if c[3] >= since]
                    for c in field:
                        if (hit is None or c[9] < hit[9]) and abs(c[4] - lat) <= deg and (mag_window is None or abs(c[6] - mag) <= mag_window) and near(c, lat, lon):
                            hit = c
            if hit is None:
                hit = [event_id, t, nm, t, lat, lon, mag, score, event_id]
                opened(hit, home[i])
            elif mag > hit[6] or (by_score and mag == hit[6] and score > hit[7]):
                hit[3:9] = [t, lat, lon, mag, score, event_id]
                if hit[10] != home[i]:
                    fields[hit[10]] = [c for c in fields[hit[10]] if c is not hit]
                    fields.setdefault(home[i], []).append(hit)
                    hit[10] = home[i]
            members.append(hit[0])
        end = columns[1][-1] - limit
        kept = [c[:9] for c in live if c[3] >= end]  # clusters that may still meet a row of the next stretch
        found = pd.DataFrame({"kind": "m", "unit": unit, "part": part, "event_id": columns[0], "seed": members, "order_t": columns[1], "order_m": 0.0, "t": columns[1],
                              "lat": 0.0, "lon": 0.0, "mag": columns[5], "score": columns[6], "rep": ""})
        if not kept:
            return found
        handed = pd.DataFrame(kept, columns=_STATE_NAMES).assign(kind="s", unit=unit, part=part, event_id="")
        return pd.concat([found, handed[list(found.columns)]], ignore_index=True)
    return run


def _units(singles: DataFrame, seconds: int, km: float, unit_rows: int) -> DataFrame:
    """Rows that any other row may reach, with their unit of work (unit, part, last).

    Each row stands in the space-time buckets that a box of half the limits around it
    touches; two rows within the limits share a bucket. Buckets of one row are connected,
    and no row of one component can ever meet a row of another. Components that a few
    rounds don't tell apart are long chains, as in a dense catalog, and count as one. With
    as many links as buckets most are in one chain, so no rounds are spent; nor are they on
    a crowd that fits one unit.
    Small components share units by hash; one beyond ``unit_rows`` is cut into stretches
    of that many rows in time order.
    """
    deg = km / 111.0 + 0.01
    width_t, width_d = 4 * seconds * 1_000_000, 4 * deg
    lon_margin = deg / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + deg, F.lit(89.0)))), F.lit(0.02))
    reach = lambda v, m, w: F.explode(F.sequence(F.floor((v - m) / w), F.floor((v + m) / w)))
    spread = (singles.select("event_id", "t", "lat", "lon")
              .withColumn("a", reach(F.col("t"), F.lit(seconds * 500_000), width_t))
              .withColumn("b", reach(F.col("lat"), F.lit(deg / 2), width_d)).withColumn("c", reach(F.col("lon"), lon_margin / 2, width_d)))
    busy = spread.groupBy("a", "b", "c").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    stands = spread.join(busy, ["a", "b", "c"], "left_semi").select("event_id", F.struct("a", "b", "c").alias("bucket")).checkpoint()
    home = stands.groupBy("event_id").agg(F.min("bucket").alias("home"))
    edges = stands.join(home, "event_id").select(F.col("bucket").alias("u"), F.col("home").alias("v")).where("u != v").distinct().checkpoint()
    if home.count() <= unit_rows or edges.count() >= stands.select("bucket").distinct().count():
        one = F.broadcast(home.agg(F.min("home").alias("comp")))  # one row
        placed = home.select("event_id").crossJoin(one)
    else:
        tops = components(edges, _STAR_ROUNDS)
        placed = home.join(tops.withColumnRenamed("node", "home"), "home", "left").select(
            "event_id", F.coalesce("root", "home").alias("comp"))
    crowd = singles.join(placed, "event_id").checkpoint()
    sizes = crowd.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") > unit_rows)
    whole = crowd.join(sizes, "comp", "left_anti")
    units = max(1, -(-crowd.count() // unit_rows))
    name = F.concat_ws(":", *[F.col(f"comp.{c}").cast("string") for c in "abc"])
    packed = whole.withColumns({"unit": F.pmod(F.xxhash64(name), F.lit(units)).cast("string"), "part": F.lit(0), "last": F.lit(0)})
    if sizes.isEmpty():
        return packed.drop("comp")
    cut = crowd.join(sizes, "comp").withColumns({"unit": name, "_one": F.lit(1).cast("bigint")}).drop("comp")
    cut = running_totals(cut, ["unit"], ["t", "nm", "event_id"], {"_pos": "_one"}).withColumns({
        "part": F.floor(F.col("_pos") / unit_rows).cast("int"), "last": F.floor((F.col("n") - 1) / unit_rows).cast("int")})
    return packed.drop("comp").unionByName(cut.drop("n", "_one", "_pos"))


def _settle(rows: DataFrame, fold: Callable) -> tuple[DataFrame, list[int]]:
    """(event_id, seed) of all rows, and how many units each round has run.

    All units run once without a hand-over. Then the stretch behind a unit runs again if
    the clusters handed to it are not those it started from, and so on. The first k
    stretches of a component are final after k rounds; as clusters close quickly, a
    stretch mostly ends in the same state however it started, and few run a third time.
    """
    spark = rows.sparkSession
    keys, state = ["unit", "part"], [F.col(c) for c in _STATE_NAMES]
    schema = f"kind string, unit string, part int, event_id string, {_STATE}"
    rows = rows.checkpoint()
    todo = rows.select(*keys, "last").distinct().checkpoint()
    used = handed = spark.createDataFrame([], f"unit string, part int, {_STATE}")
    done, counts = [], []
    while True:
        counts.append(todo.count())
        work = rows.join(todo.select(*keys), keys, "left_semi") if done else rows
        out = work.groupBy(*keys).cogroup(handed.groupBy(*keys)).applyInPandas(fold, schema).checkpoint()
        done = [d.join(todo.select(*keys), keys, "left_anti") for d in done] + [out.where("kind = 'm'").select(*keys, "event_id", "seed")]
        used = used.join(todo.select(*keys), keys, "left_anti").unionByName(handed).checkpoint()
        behind = todo.where("part < last").select("unit", (F.col("part") + 1).alias("part"), "last")
        fresh = out.where("kind = 's'").select("unit", (F.col("part") + 1).alias("part"), *state).join(
            behind.select(*keys), keys, "left_semi").checkpoint()
        before = used.join(behind.select(*keys), keys, "left_semi")
        dirty = fresh.exceptAll(before).select(*keys).union(before.exceptAll(fresh).select(*keys)).distinct()
        todo = behind.join(dirty, keys, "left_semi").checkpoint()
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, done).select("event_id", "seed"), counts
        handed = fresh.join(todo.select(*keys), keys, "left_semi").checkpoint()


def leader_clusters(events: DataFrame, seconds: int = K.CANONICAL_SECONDS, km: float = K.CANONICAL_KM,
                    mag_window: float | None = K.CANONICAL_MAG, by_score: bool = True, chunk_rows: int = 50_000) -> DataFrame:
    """Membership (event_id, seed) of greedy leader clustering in (time, -magnitude, id).

    A row joins the first cluster, in order of creation, whose representative is within
    the limits; the representative moves to a larger magnitude (or, at equal magnitude,
    to a better source). Steps:

    * identical reports (time, place, magnitude) always share a cluster and act like
      the best-ranked one, so they collapse first;
    * rows with no other row in reach are clusters by themselves;
    * the rest run in components of space-time buckets, which cannot touch each other;
      a component beyond ``chunk_rows`` is cut in time, and a stretch runs again only if
      what the stretch before hands over has changed (``_settle``). At the end nothing
      changes, so the result is that of the sequential rule.
    """
    scratch_root(events.sparkSession)
    score = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in K.CANONICAL_SOURCE_SCORE for v in p]), F.lower("source")), F.lit(0))
    base = events.where("time is not null and lat is not null and lon is not null and magnitude is not null").select(
        "event_id", F.unix_micros("time").alias("t"), "lat", "lon", F.col("magnitude").alias("mag"), score.alias("score"))
    first = base.groupBy(*_ROW).agg(F.min("event_id").alias("head"), F.max("score").alias("score"))
    singles = first.withColumnRenamed("head", "event_id").withColumn("nm", -F.col("mag")).checkpoint()
    crowd = _units(singles, seconds, km, chunk_rows)
    found, _ = _settle(crowd, _fold(seconds, km, mag_window, by_score))
    whole = singles.select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce("seed", "event_id").alias("seed"))
    heads = first.select(*_ROW, "head")
    return base.join(heads, _ROW).join(whole.withColumnRenamed("event_id", "head"), "head").select("event_id", "seed")


def canonical_id(time: Column, lat: Column, lon: Column, magnitude: Column) -> Column:
    text = F.format_string("%s:%.3f:%.3f:%.1f", F.date_format(time, "yyyyMMdd'T'HHmmss"), lat, lon, magnitude)
    return F.concat(F.lit("ce_"), F.sha1(text))


def canonical_events(events: DataFrame, members: DataFrame, by_score: bool = True) -> DataFrame:
    """One row per cluster: representative, sources and member count.

    Members stay in the long membership table; a cluster may be as large as the catalog.
    """
    score = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in K.CANONICAL_SOURCE_SCORE for v in p]), F.lower("source")), F.lit(0))
    rank = F.struct((-F.col("magnitude")).alias("m"), (-score if by_score else F.lit(0)).alias("s"), "time", "event_id")
    row = F.struct("event_id", "time", "lat", "lon", "depth", "magnitude", "place", "source")
    g = events.join(members, "event_id").groupBy("seed").agg(
        F.min_by(row, rank).alias("r"),
        F.sort_array(F.collect_set(F.coalesce("source", F.lit("unknown")))).alias("sources"), F.count("*").alias("member_count"))
    return g.select(canonical_id(F.col("r.time"), F.col("r.lat"), F.col("r.lon"), F.col("r.magnitude")).alias("canonical_id"),
                    "seed", F.col("r.time").alias("time"), F.col("r.lat").alias("lat"), F.col("r.lon").alias("lon"),
                    F.col("r.depth").alias("depth_km"), F.col("r.magnitude").alias("magnitude"), F.col("r.place").alias("place"),
                    F.col("r.source").alias("primary_source"), "sources", F.size("sources").alias("source_count"), "member_count")


def canonical_input(events: DataFrame, now: str | None = None, days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(events a rebuild takes, one row with how many it takes and skips).

    With ``days`` only the last days before ``now`` count; rows without time, place or
    magnitude are skipped.
    """
    if days is not None:
        until = F.lit(now).cast("timestamp")
        events = events.where((F.col("time") >= until - F.make_interval(days=F.lit(days))) & (F.col("time") <= until))
    whole = F.col("time").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("magnitude").isNotNull()
    return events.where(whole), events.agg(F.count_if(whole).alias("taken"), F.count_if(~whole).alias("skipped"))


def canonical_stats(raw: DataFrame, canonical: DataFrame) -> DataFrame:
    left = raw.agg(F.count("*").alias("raw_events"))
    right = canonical.agg(F.count("*").alias("canonical_events"), F.count_if(F.col("source_count") > 1).alias("multi_source_events"),
                          F.max(F.struct("time", "canonical_id", "magnitude"))["time"].alias("latest_time"))
    both = left.withColumn("k", F.lit(1)).join(right.withColumn("k", F.lit(1)), "k").drop("k")
    return both.withColumn("deduped_events", F.greatest(F.lit(0), F.col("raw_events") - F.col("canonical_events")))


__all__ = ["canonical_events", "dedup_events", "kept_events", "leader_clusters"]
