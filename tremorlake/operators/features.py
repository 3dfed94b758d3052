"""The 48-column feature frame per (cell, snapshot).

Snapshots are a regular series: start + k * every days, weekly by default. Events are
first condensed to slots: two per day, the exact first instant of the day and the rest of
it. Every window edge falls on a day edge relative to the start, so closed windows are
ranges of slots, and a hot cell shrinks to at most (days x distinct magnitudes) rows.

Sums over windows come from difference arrays: a condensed row adds its values at the
first snapshot that sees it and takes them back at the first that no longer does, and
running totals per cell give every window. So a row is written five times, however many
snapshots its three years cover. Sums are decimals, so what was added leaves exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions.geo import center_lat, center_lon, haversine_km
from tremorlake.operators.catalog_stats import LOG10_E, mc_lookup, with_mc
from tremorlake.operators.geology import area_labels, fault_type_code
from tremorlake.operators.grid import neighbors, radius_neighbors
from tremorlake.operators.scan import running_totals
from tremorlake.session import event_sized, scratch_root, struct_array

DAY_US = 86_400_000_000
KEY = ["cell_no", "k"]


@dataclass(frozen=True)
class Snapshots:
    """count snapshots, ``every`` days apart, the first at midnight of ``start``."""
    start: str
    count: int
    every: int = 7

    @property
    def origin(self) -> Column:
        return F.unix_micros(F.lit(self.start).cast("timestamp"))

    def at(self, k: Column) -> Column:
        return F.timestamp_micros(self.origin + k * self.every * F.lit(DAY_US))

    def micros(self, k: Column) -> Column:
        return self.origin + k * self.every * F.lit(DAY_US)

    @classmethod
    def over(cls, events: DataFrame, every: int = 7) -> "Snapshots":
        """From midnight of the first event's day to the last event; none without events."""
        lo, days = events.agg(F.date_format(F.min("time"), "yyyy-MM-dd").alias("lo"), F.floor(
            (F.unix_micros(F.max("time")) - F.unix_micros(F.date_trunc("day", F.min("time")))) / F.lit(DAY_US)).alias("days")).first()
        return cls(lo, int(days) // every + 1, every) if lo else cls("1970-01-01", 0, every)

    def enters(self, slot: Column) -> Column:
        """First snapshot at or after a slot."""
        return F.greatest(F.lit(0), F.ceil(slot / (2 * self.every)).cast("int"))

    def leaves(self, slot: Column, back_days: int) -> Column:
        """First snapshot that no longer reaches a slot by looking back so many days."""
        return F.greatest(F.lit(0), F.floor((slot + 2 * back_days) / (2 * self.every)).cast("int") + 1)

    def epochs(self) -> list[tuple[int, int, int]]:
        """(first year, first snapshot, snapshot after the last) of the completeness epochs that the series meets."""
        begin, out = date.fromisoformat(self.start), []
        for k in range(self.count):
            year = (begin + timedelta(days=k * self.every)).year
            first = (year - K.EPOCH_START) // K.EPOCH_YEARS * K.EPOCH_YEARS + K.EPOCH_START
            out = [*out[:-1], (first, out[-1][1], k + 1)] if out and out[-1][0] == first else [*out, (first, k, k + 1)]
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """Every (cell, snapshot), from one range."""
        return spark.range(K.N_CELLS * self.count).select(
            (F.col("id") % K.N_CELLS).cast("int").alias("cell_no"), F.floor(F.col("id") / K.N_CELLS).cast("int").alias("k"))

    def covering(self, slot: Column, back_days: int) -> Column:
        """Generator of the snapshots k with slot in [snapshot - back_days, snapshot]."""
        return self.between(self.enters(slot), self.leaves(slot, back_days) - 1)

    def between(self, first: Column, last: Column) -> Column:
        """Generator of the snapshots from first to last."""
        last = F.least(F.lit(self.count - 1), last)
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    def slot(self, time: Column) -> Column:
        us = F.unix_micros(time) - self.origin
        inside = F.pmod(us, F.lit(DAY_US))
        return (2 * ((us - inside) / F.lit(DAY_US)).cast("int") + F.when(inside > 0, 1).otherwise(0)).cast("int")


def snapshot_times(spark: SparkSession, snaps: Snapshots) -> DataFrame:
    return spark.range(snaps.count).select(F.col("id").cast("int").alias("k"), snaps.at(F.col("id")).alias("snapshot"))


def daily(events: DataFrame, snaps: Snapshots) -> DataFrame:
    """Counts and depth sums per (cell, slot, magnitude)."""
    depth = F.nanvl("depth", F.lit(None).cast("double"))
    return events.where("cell_no is not null").groupBy(
        "cell_no", snaps.slot(F.col("time")).alias("slot"), "magnitude").agg(
        F.count("*").alias("n"), F.sum(depth.try_cast("decimal(18,9)")).alias("d1"), F.sum((depth * depth).try_cast("decimal(24,9)")).alias("d2"),
        F.count_if(depth.isNull()).alias("dn"), F.min(F.unix_seconds("time")).alias("t0"), F.max(F.unix_seconds("time")).alias("t1"))


_LONG, _EXACT = "bigint", "decimal(38,9)"
#: Column of a window sum, days it looks back, type of the sum.
_SUMS = (("n30", 30, _LONG), ("n90", 90, _LONG), ("n365", 365, _LONG), ("n1095", 1095, _LONG), ("d1", 30, _EXACT), ("d2", 30, _EXACT), ("dn", 30, _LONG),
         ("e30", 30, "decimal(38,22)"), ("e365", 365, "decimal(38,22)"), *((f"bn{d}", d, _LONG) for d in (90, 365, 1095)), *((f"bm{d}", d, _EXACT) for d in (90, 365, 1095)))


def _changes(rows: DataFrame, values: dict[str, Column], enter: Column, leave: dict[int, Column]) -> DataFrame:
    """What is added to (looked back 0) or taken from (looked back d) the sums at a snapshot."""
    edges = F.array(F.struct(enter.alias("k"), F.lit(0).alias("back")), *[F.struct(k.alias("k"), F.lit(d).alias("back")) for d, k in leave.items()])
    moved = rows.select("cell_no", *[v.alias(c) for c, v in values.items()], F.inline(edges))
    sums = {name: (back, kind) for name, back, kind in _SUMS}
    signed = {c: F.when(F.col("back") == 0, F.col(c)).when(F.col("back") == sums[c][0], -F.col(c)) for c in values}
    return moved.groupBy(*KEY).agg(*[F.sum(v).cast(sums[c][1]).alias(c) for c, v in signed.items()])


def window_sums(condensed: DataFrame, mc_table: DataFrame, snaps: Snapshots) -> DataFrame:
    """All sums over windows per (cell, snapshot) with an event in three years."""
    slot, n, m = F.col("slot"), F.col("n"), F.col("magnitude")
    enter, leave = snaps.enters(slot), {d: snaps.leaves(slot, d) for d in (30, 90, 365, 1095)}
    energy = (n * F.pow(F.lit(10.0), K.ENERGY_SLOPE * (m - 9.0))).try_cast("decimal(32,22)")  # scaled, so that sums stay near 1
    plain = _changes(condensed, {"n30": n, "n90": n, "n365": n, "n1095": n, "d1": F.col("d1"), "d2": F.col("d2"), "dn": F.col("dn"), "e30": energy, "e365": energy}, enter, leave)
    # completeness changes with the snapshot's epoch, so a row takes part in each epoch that its three years meet
    epochs = struct_array(snaps.epochs() or [(0, 0, 0)], ["epoch", "lo", "hi"])
    met = condensed.withColumn("e", F.explode(F.filter(epochs, lambda e: (e["lo"] < leave[1095]) & (e["hi"] > enter))))
    above = with_mc(met.withColumns({"lat": center_lat(F.col("cell_no")), "lon": center_lon(F.col("cell_no"))}), mc_table,
                    F.make_date(F.col("e.epoch"), F.lit(1), F.lit(1))).where(m >= F.col("mc"))
    begin = F.greatest(enter, F.col("e.lo"))
    end = {d: F.greatest(begin, F.least(leave[d], F.col("e.hi"))) for d in (90, 365, 1095)}
    size = (n * m).try_cast("decimal(28,9)")
    complete = _changes(above, {**{f"bn{d}": n for d in end}, **{f"bm{d}": size for d in end}}, begin, end)
    steps = plain.unionByName(complete, allowMissingColumns=True).where(F.col("k") < snaps.count).groupBy(*KEY).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast(kind).alias(c) for c, _, kind in _SUMS])
    cell = Window.partitionBy("cell_no").orderBy("k")  # one cell's snapshots
    upto = cell.rowsBetween(Window.unboundedPreceding, 0)
    held = steps.select("cell_no", "k", F.lead("k", 1, snaps.count).over(cell).alias("next"), *[F.sum(c).over(upto).alias(c) for c, _, _ in _SUMS])
    whole = [c for c, _, kind in _SUMS if kind == _LONG]
    return held.where("n1095 > 0").select("cell_no", snaps.between(F.col("k"), F.col("next") - 1).alias("k"), *[
        F.col(c) if c in whole else F.col(c).cast("double").alias(c) for c, _, _ in _SUMS])


def window_ends(condensed: DataFrame, snaps: Snapshots) -> DataFrame:
    """Maxima of 30 and 90 days, week sums of 84 days, first and last second of a year."""
    slot = F.col("slot")
    per_slot = condensed.groupBy("cell_no", "slot").agg(F.max("magnitude").alias("m"), F.sum("n").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    near = per_slot.select("cell_no", "slot", "m", "n", snaps.covering(slot, 90).alias("k"))
    within = lambda days: slot >= F.col("k") * (2 * snaps.every) - 2 * days
    week = F.least(F.lit(11), F.floor((F.floor(slot / 2) - (F.col("k") * snaps.every - 84)) / 7))
    recent = near.groupBy(*KEY).agg(
        F.max(F.when(within(30), F.col("m"))).alias("x30"), F.max("m").alias("x90"),
        F.sum(F.when(within(84), F.col("n"))).alias("c0"), F.sum(F.when(within(84), F.col("n") * week)).alias("c1"))
    # a slot is the last one up to the next slot's first snapshot, and the first one once the slot before has left
    cell = Window.partitionBy("cell_no").orderBy("slot")  # one cell's active days
    placed = per_slot.withColumns({"later": F.lead("slot").over(cell), "earlier": F.lag("slot").over(cell)}).withColumns({
        "after": F.when(F.col("later").isNull(), snaps.count).otherwise(snaps.enters(F.col("later"))),
        "before": F.when(F.col("earlier").isNull(), 0).otherwise(snaps.leaves(F.col("earlier"), 365))})
    gone = snaps.leaves(slot, 365) - 1
    last = placed.select("cell_no", "t1", snaps.between(snaps.enters(slot), F.least(F.col("after") - 1, gone)).alias("k"))
    first = placed.select("cell_no", "t0", snaps.between(F.greatest(snaps.enters(slot), F.col("before")), gone).alias("k"))
    return recent.unionByName(last, allowMissingColumns=True).unionByName(first, allowMissingColumns=True).groupBy(*KEY).agg(
        *[F.max(c).alias(c) for c in ("x30", "x90", "c0", "c1", "t0", "t1")])


def window_stats(condensed: DataFrame, mc_table: DataFrame, snaps: Snapshots) -> DataFrame:
    """Counts, maxima, depth, energy, b-values and weekly trend."""
    condensed = condensed.repartition("cell_no")  # a cell holds at most slots x magnitudes; what it is copied to stays in its partition
    g = window_sums(condensed, mc_table, snaps).join(event_sized(window_ends(condensed, snaps)), KEY, "left")
    g = with_mc(g.withColumns({"lat": center_lat(F.col("cell_no")), "lon": center_lon(F.col("cell_no"))}), mc_table, snaps.at(F.col("k")))
    b = lambda d: F.when(F.col(f"bn{d}") >= 5, F.try_divide(
        F.lit(LOG10_E), F.try_divide(F.col(f"bm{d}"), F.col(f"bn{d}")) - (F.col("mc") - 0.05))).otherwise(1.0)
    some = F.col("n30") > 0
    nan = F.lit(float("nan"))
    spread = F.try_divide(F.greatest(F.lit(0.0), F.col("n30") * F.col("d2") - F.col("d1") * F.col("d1")), F.col("n30") * F.col("n30"))
    shift = K.ENERGY_SLOPE * 9.0 + K.ENERGY_SHIFT
    return g.select(
        *KEY, "t0", "t1", "mc",
        F.col("n30").cast("double").alias("event_count_30d"), F.col("n90").cast("double").alias("event_count_90d"),
        F.col("n365").cast("double").alias("event_count_365d"),
        F.coalesce("x30", F.lit(0.0)).alias("max_mag_30d"), F.coalesce("x90", F.lit(0.0)).alias("max_mag_90d"),
        F.when(some & (F.col("dn") > 0), nan).when(some, F.try_divide("d1", "n30")).otherwise(0.0).alias("mean_depth_30d"),
        F.when((F.col("n30") > 1) & (F.col("dn") > 0), nan).when(F.col("n30") > 1, F.sqrt(spread)).otherwise(0.0).alias("std_depth_30d"),
        F.when(some, F.log10("e30") + shift).otherwise(0.0).alias("log_energy_30d"),
        F.when(some, F.try_divide("e30", "e365")).otherwise(0.0).alias("moment_release_ratio_30d_vs_365d"),
        *[b(d).alias(f"b_value_{d}d") for d in (90, 365, 1095)],
        F.when((F.col("n90") >= 5) & (F.col("c0") > 0), (F.col("c1") - 5.5 * F.col("c0")) / 143.0).otherwise(0.0).alias("activity_trend_90d"))


def gap_stats(events: DataFrame, snaps: Snapshots) -> DataFrame:
    """Mean and variation of whole-second gaps between events in 30 days (3+ events).

    Squared gaps are summed inside a slot and linked across slots on the slot table, so
    the ordered work is at most one day of distinct seconds, or one cell's slots.
    """
    placed = events.where("cell_no is not null").select("cell_no", snaps.slot(F.col("time")).alias("slot"), F.unix_seconds("time").alias("s"))
    per_sec = placed.repartition("cell_no", "slot").groupBy("cell_no", "slot", "s").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("cell_no", "slot").orderBy("s")
    per_slot = per_sec.withColumn("g", F.col("s") - F.lag("s").over(inside)).groupBy("cell_no", "slot").agg(
        F.sum("n").alias("n"), F.min("s").alias("first"), F.max("s").alias("last"),
        F.coalesce(F.sum(F.col("g").cast("double") * F.col("g")), F.lit(0.0)).alias("ss"))
    by_cell = Window.partitionBy("cell_no").orderBy("slot")
    linked = per_slot.withColumns({"p_slot": F.lag("slot").over(by_cell), "p_last": F.lag("last").over(by_cell)})
    rows = linked.withColumn("k", snaps.covering(F.col("slot"), 30))
    link = F.when(F.col("p_slot") >= F.col("k") * (2 * snaps.every) - 60, (F.col("first") - F.col("p_last")).cast("double"))
    g = rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("first").alias("a"), F.max("last").alias("b"),
                               F.sum(F.col("ss") + F.coalesce(link * link, F.lit(0.0))).alias("ss"))
    gaps = F.col("n") - 1
    mean = F.try_divide(F.col("b") - F.col("a"), gaps)
    sd = F.sqrt(F.greatest(F.lit(0.0), F.try_divide("ss", gaps) - mean * mean))
    enough = F.col("n") >= 3
    return g.select(*KEY, F.when(enough, mean).otherwise(0.0).alias("iet_mean_30d"),
                    F.when(enough, F.coalesce(F.try_divide(sd, mean), F.lit(0.0))).otherwise(0.0).alias("iet_cv_30d"))


def b_slopes(events: DataFrame, stats: DataFrame, snaps: Snapshots) -> DataFrame:
    """Trend of b over 90-day sub-windows counted from the first event of the year.

    Only (cell, snapshot) pairs with more than 50 events and 180 days of span qualify. Events are
    not copied to their snapshots: sub-windows have two edges each, and a window's sums are the
    difference of the cell's running totals there. Sums of magnitudes are whole billionths, so
    the difference is exact.
    """
    scratch_root(events.sparkSession)
    busy = stats.where((F.col("event_count_365d") > 50) & (F.col("t1") - F.col("t0") >= 180 * 86400)).select(*KEY, "t0", "t1", "mc").checkpoint()
    width, sec = 90 * 86400, F.unix_seconds("time")
    spans = F.broadcast(busy.groupBy("cell_no", "mc").agg(F.min("t0").alias("lo"), F.max("t1").alias("hi")))  # a cell has one mc per epoch
    above, size = F.col("magnitude") >= F.col("mc"), F.round(F.col("magnitude") * 1e9).try_cast("bigint")
    told = events.where("cell_no is not null").join(spans, "cell_no").where((sec >= F.col("lo")) & (sec <= F.col("hi"))).groupBy(
        "cell_no", "mc", F.unix_micros("time").alias("u")).agg(
        F.count("*").alias("n"), F.count_if(above).alias("na"), F.coalesce(F.sum(F.when(above, size)), F.lit(0)).alias("ma"))
    # a window is closed on both ends: what is in the second of an edge belongs to it, but nothing after the snapshot
    last = F.floor((F.col("t1") - F.col("t0")) / width).cast("int") - 1
    begin = F.col("t0") + F.col("w") * width
    sides = F.array(F.struct((begin * 1_000_000).alias("u"), F.lit(0).alias("side")),
                    F.struct(F.least((begin + width + 1) * 1_000_000 - 1, snaps.micros(F.col("k"))).alias("u"), F.lit(2).alias("side")))
    edges = busy.withColumn("w", F.explode(F.sequence(F.lit(0), last))).select("cell_no", "mc", "k", "w", F.inline(sides))
    none = {c: F.lit(0).cast("bigint") for c in ("n", "na", "ma")}
    line = told.withColumns({"side": F.lit(1), "k": F.lit(-1), "w": F.lit(-1)}).unionByName(edges.withColumns(none))
    totals = running_totals(line, ["cell_no", "mc"], ["u", "side", "k", "w"], {f"{c}_before": c for c in none}).where("side <> 1")
    per = totals.groupBy(*KEY, "w").agg(*[F.sum(F.col(f"{c}_before") * (F.col("side") - 1)).alias(c) for c in none]).where("n >= 10 and na >= 5").join(
        event_sized(busy.select(*KEY, "mc")), KEY)
    b = F.try_divide(F.lit(LOG10_E), F.col("ma") / 1e9 / F.col("na") - (F.col("mc") - 0.05))
    fit = per.withColumns({"b": b, "day": F.col("w") * 90.0}).groupBy(*KEY).agg(F.count("*").alias("nw"), F.regr_slope("b", "day").alias("slope"))
    return fit.where("nw >= 3").select(*KEY, F.col("slope").alias("b_value_slope_1y"))


def last_large(events: DataFrame, snaps: Snapshots) -> DataFrame:
    """Days since the last M >= 4 and M >= 5 event, without a look-back limit."""
    out = None
    for limit, name in ((4.0, "M4"), (5.0, "M5")):
        last = events.where((F.col("magnitude") >= limit) & F.col("cell_no").isNotNull()).groupBy(
            "cell_no", snaps.slot(F.col("time")).alias("slot")).agg(F.max(F.unix_micros("time")).alias("us"))
        order = Window.partitionBy("cell_no").orderBy("slot")  # one cell's active days
        first_k = F.greatest(F.lit(0), F.ceil(F.col("slot") / (2 * snaps.every)).cast("int"))
        spans = last.withColumn("a", first_k).withColumn("b", F.least(F.lit(snaps.count), F.coalesce(F.lead(first_k).over(order), F.lit(snaps.count))) - 1)
        one = spans.where("a <= b").withColumn("k", F.explode(F.sequence("a", "b"))).select(
            *KEY, ((snaps.micros(F.col("k")) - F.col("us")) / float(DAY_US)).alias(f"time_since_last_{name}_days"))
        out = one if out is None else out.join(one, KEY, "full_outer")
    return out


def neighbor_stats(stats: DataFrame) -> DataFrame:
    """Mean 30-day count and largest 30-day magnitude over the eight nearest cells."""
    near = F.broadcast(neighbors(stats.sparkSession).select("cell_no", F.col("other_no")))
    src = stats.select(F.col("cell_no").alias("other_no"), "k", "event_count_30d", "max_mag_30d").where("event_count_30d > 0")
    return src.join(near, "other_no").groupBy(*KEY).agg(
        (F.sum("event_count_30d") / 8.0).alias("neighbor_event_count_30d_mean"), F.max("max_mag_30d").alias("neighbor_max_mag_30d_max"))


def short_term(events: DataFrame, snaps: Snapshots) -> DataFrame:
    """Counts, energy and rate ratio within 100 and 300 km over hours to a week.

    Events are summed per own cell before they are copied to the cells around it. A snapshot's
    rows stand in one partition by then, so that the copies are summed there and never shuffled.
    """
    spark = events.sparkSession
    recent = events.where("cell_no is not null").withColumn("k", snaps.covering(snaps.slot(F.col("time")), 7)).withColumn(
        "age", snaps.micros(F.col("k")) - F.unix_micros("time")).where((F.col("age") >= 0) & (F.col("age") <= 7 * F.lit(DAY_US)))
    counts = [(f"count_{m}_{w}", t, h) for m, t in K.SHORT_THRESHOLDS for w, h in K.SHORT_WINDOWS_HOURS]
    own = recent.groupBy(*KEY).agg(
        *[F.count_if((F.col("magnitude") >= t) & (F.col("age") <= F.lit(h * 3_600_000_000))).alias(name) for name, t, h in counts],
        F.sum(F.pow(F.lit(10.0), K.ENERGY_SLOPE * (F.col("magnitude") - 9.0))).alias("e"))
    around = F.broadcast(radius_neighbors(spark, 300.0).select(F.col("cell_no").alias("target"), F.col("other_no").alias("cell_no"), "dist_km"))
    near = own.repartition("k").join(around, "cell_no")
    close = F.col("dist_km") <= 100.0
    pick = lambda r, v: F.when(close, v) if r == 100 else v
    g = near.groupBy(F.col("target").alias("cell_no"), "k").agg(
        *[F.coalesce(F.sum(pick(r, F.col(name))), F.lit(0)).cast("double").alias(f"{name}_r{r}km") for r in K.SHORT_RADII_KM for name, _, _ in counts],
        *[F.sum(pick(r, F.col("e"))).alias(f"e{r}") for r in K.SHORT_RADII_KM])
    shift = K.ENERGY_SLOPE * 9.0 + K.ENERGY_SHIFT
    g = g.withColumns({f"log_energy_7d_r{r}km": F.coalesce(F.log10(f"e{r}") + shift, F.lit(0.0)) for r in K.SHORT_RADII_KM})
    g = g.withColumns({f"rate_ratio_24h_vs_7d_r{r}km": F.when(F.col(f"e{r}").isNotNull(), (
        (F.col(f"count_M45_24h_r{r}km") + 0.1) / (F.col(f"count_M45_7d_r{r}km") / 7.0 + 0.1))).otherwise(0.0) for r in K.SHORT_RADII_KM}).drop("e100", "e300")
    big = recent.where("magnitude >= 5").select(*KEY, "lat", "lon", "magnitude", "age").repartition("k").join(around, "cell_no").withColumn("d", haversine_km(
        center_lat(F.col("target")), center_lon(F.col("target")), F.col("lat"), F.col("lon")))
    best = lambda t: F.min(F.when(F.col("magnitude") >= t, F.struct("d", (F.col("age") / float(DAY_US)).alias("a"))))
    closest = big.groupBy(F.col("target").alias("cell_no"), "k").agg(best(5.0).alias("m5"), best(6.0).alias("m6")).select(
        *KEY, F.col("m5.d").alias("nearest_M5_dist_km"), F.col("m5.a").alias("nearest_M5_time_days"),
        F.col("m6.d").alias("nearest_M6_dist_km"), F.col("m6.a").alias("nearest_M6_time_days"))
    return g.join(closest, KEY, "left")


# fixed values: feature columns in their published order
TEMPORAL = ("event_count_30d", "event_count_90d", "event_count_365d", "max_mag_30d", "max_mag_90d", "mean_depth_30d",
            "std_depth_30d", "log_energy_30d", "moment_release_ratio_30d_vs_365d", "b_value_90d", "b_value_365d",
            "b_value_1095d", "b_value_slope_1y", "iet_mean_30d", "iet_cv_30d", "time_since_last_M4_days",
            "time_since_last_M5_days", "activity_trend_90d")
NEIGHBOR = ("neighbor_event_count_30d_mean", "neighbor_max_mag_30d_max")
PHYSICS = ("nearest_fault_km", "fault_type_int", "fault_slip_rate", "slab_depth_km")


def short_term_columns() -> list[str]:
    out = []
    for r in K.SHORT_RADII_KM:
        out += [f"count_{m}_{w}_r{r}km" for m, _ in K.SHORT_THRESHOLDS for w, _ in K.SHORT_WINDOWS_HOURS]
        out += [f"log_energy_7d_r{r}km", f"rate_ratio_24h_vs_7d_r{r}km"]
    return out + [f"nearest_{m}_{c}" for m in ("M5", "M6") for c in ("dist_km", "time_days")]


def feature_columns() -> list[str]:
    return [*TEMPORAL, *short_term_columns(), *NEIGHBOR, *PHYSICS]


def _missing(name: str) -> float:
    if name.startswith(("time_since", "nearest_M")) or name == "slab_depth_km":
        return K.MISSING_FAR
    return 1.0 if name.startswith("b_value_") and "slope" not in name else 0.0


def physics(spark: SparkSession) -> DataFrame:
    return area_labels(spark).select("cell_no", "cell_id", "nearest_fault_km", fault_type_code(F.col("fault_type")).cast("double").alias("fault_type_int"),
                                     "fault_slip_rate", "slab_depth_km")


def build_features(events: DataFrame, snaps: Snapshots) -> DataFrame:
    """All 48 features for every cell and snapshot (``events`` needs cell_no)."""
    spark = events.sparkSession
    scratch_root(spark)
    # written one after the other: three pieces start from the sums, and broadcasts of several need not stand side by side
    stats = window_stats(daily(events, snaps), mc_lookup(events), snaps).checkpoint()
    pieces = [stats.drop("t0", "t1", "mc"), b_slopes(events, stats, snaps), gap_stats(events, snaps), last_large(events, snaps),
              neighbor_stats(stats), short_term(events, snaps).checkpoint()]
    out = snaps.frame(spark)
    for piece in pieces:
        out = out.join(piece, KEY, "left")
    out = out.join(F.broadcast(physics(spark)), "cell_no")
    return out.select("cell_no", "cell_id", "k", snaps.at(F.col("k")).alias("snapshot"), *[
        F.coalesce(F.col(c), F.lit(_missing(c))).alias(c) for c in feature_columns()])
