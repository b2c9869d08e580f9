"""Movement, locomotion and behaviour from sensor channels and position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import over, ratio
from .intervals import SESSION, dilate, interval_overlap_join, merge_periods, runs


def rising_edges(signal: DataFrame, threshold: float) -> DataFrame:
    """Samples at which the channel reaches the threshold from below."""
    d = signal.withColumn("_was", F.lag("value").over(over("session_id", "i")))
    return d.filter((F.col("value") >= threshold) & (F.col("_was") < threshold)).drop("_was")


def run_speed(signal: DataFrame, threshold: float = 4.0, cm_per_tick: float = 1.0, minimum: float = 1.0, gap_s: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Ticks (session_id, i, t, speed) and running periods (session_id, t0, t1), joined where at most gap_s apart."""
    edges = rising_edges(signal, threshold)
    ticks = edges.select("session_id", "i", "t", ratio(F.lit(cm_per_tick), F.col("t") - F.lag("t").over(over("session_id", "i"))).alias("speed"))
    fast = ticks.withColumn("t0", F.lag("t").over(over("session_id", "i"))).filter(F.col("speed") >= minimum).select("session_id", F.col("t0").alias("first"), F.col("t").alias("last"))
    return ticks, merge_periods(fast, gap_s).select("session_id", F.col("first").alias("t0"), F.col("last").alias("t1"))


def position_from_quadrature(a: DataFrame, b: DataFrame, threshold: float, step: float, belt: float) -> DataFrame:
    """Signed ticks of two channels: an edge of the first counts up if the second is low, else down; position modulo the belt."""
    both = a.select("session_id", "i", "t", F.col("value").alias("va")).join(b.select("session_id", "i", F.col("value").alias("vb")), ["session_id", "i"])
    w = over("session_id", "i")
    edge = (F.col("va") >= threshold) & (F.lag("va").over(w) < threshold)
    tick = F.when(edge, F.when(F.col("vb") < threshold, 1).otherwise(-1)).otherwise(0)
    d = both.withColumn("tick", F.coalesce(tick, F.lit(0)))
    total = F.sum("tick").over(w.rowsBetween(W.unboundedPreceding, 0)) * F.lit(step)
    return d.withColumn("travelled", total).withColumn("position", F.pmod(total, F.lit(belt)) + 0.0).select("session_id", "i", "t", "tick", "travelled", "position")


def laps(position: DataFrame, marks: DataFrame, belt: float) -> DataFrame:
    """Position (session_id, i, travelled) that restarts at each lap mark (session_id, i); before the first it ends at the belt's length."""
    d = position.join(marks.select("session_id", "i").distinct().withColumn("_mark", F.lit(1)), ["session_id", "i"], "left")
    d = d.withColumn("lap", F.sum(F.coalesce("_mark", F.lit(0))).over(over("session_id", "i").rowsBetween(W.unboundedPreceding, 0)))
    lap = over(["session_id", "lap"], "i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    start, end = F.first("travelled").over(lap), F.last("travelled").over(lap)
    return d.withColumn("position", F.when(F.col("lap") == 0, F.col("travelled") - end + belt).otherwise(F.col("travelled") - start)).drop("_mark")


def run_bouts(speed: DataFrame, minimum: float) -> DataFrame:
    """Runs of samples (session_id, i, t, position, speed) at speed, with time, distance and where they stop; those cut by the recording's ends are dropped."""
    w = over("session_id", "i")
    d = speed.withColumn("on", F.col("speed") >= minimum).withColumn("_new", F.coalesce((F.col("on") != F.lag("on").over(w)).cast("int"), F.lit(1)))
    d = d.withColumn("bout", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    ends = speed.groupBy("session_id").agg(F.min("i").alias("_lo"), F.max("i").alias("_hi"))
    b = d.filter("on").groupBy("session_id", "bout").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min_by("position", "i").alias("_from"), F.max_by("position", "i").alias("stop"))
    return b.join(ends, "session_id").filter("i0 > _lo AND i1 < _hi").select("session_id", "i0", "i1", "t0", "t1", (F.col("t1") - F.col("t0")).alias("seconds"), (F.col("stop") - F.col("_from")).alias("distance"), "stop")


def position_histogram(position: DataFrame, belt: float, bins: int = 20, by: Sequence[str] = ("session_id", "lap")) -> DataFrame:
    b = F.least(F.floor(F.col("position") * bins / belt), F.lit(bins - 1)).cast("int")
    return position.filter((F.col("position") >= 0) & (F.col("position") <= belt)).groupBy(*by, b.alias("bin")).agg(F.count("position").alias("n"))


def quiet_threshold(signal: DataFrame, window: int, k: float) -> DataFrame:
    """k x the lowest std of half-overlapping windows that are full."""
    half = window // 2
    w = F.explode(F.array(F.floor(F.col("i") / half), F.floor(F.col("i") / half) - 1))
    d = signal.withColumn("_w", w).filter("_w >= 0").groupBy("session_id", "_w").agg(F.stddev_pop("value").alias("s"), F.count("value").alias("n")).filter(F.col("n") == 2 * half)
    return d.groupBy("session_id").agg((k * F.min("s")).alias("threshold"))


def detect_movement(signal: DataFrame, thresholds: DataFrame, gap: int) -> DataFrame:
    """Runs of samples at the threshold or above, joined where at most ``gap`` apart."""
    hit = signal.join(thresholds, "session_id").filter("value >= threshold").select("session_id", F.col("i").alias("frame"))
    return merge_periods(runs(hit), gap)


def detect_movement_window(signal: DataFrame, window: int, threshold: float) -> DataFrame:
    """From the first to the last window of a run of windows whose sum passes window x threshold."""
    w = over("session_id", "i").rowsBetween(0, window - 1)
    d = signal.select("session_id", "i", F.sum("value").over(w).alias("s"), F.count("value").over(w).alias("n"))
    r = runs(d.filter((F.col("n") == window) & (F.col("s") > window * threshold)).select("session_id", F.col("i").alias("frame")))
    return r.select("session_id", "first", (F.col("last") + window - 1).alias("last"))


def classify_movement(periods: DataFrame, per_second: float, long_ms: float = 900, short_ms: float = 600, before_ms: float = 700, after_ms: float = 400) -> DataFrame:
    """complex, twitch (short, with rest on both sides), short, or intermediate."""
    w = over("session_id", "first")
    ms = lambda x: x / per_second * 1000
    size, back, ahead = ms(F.col("last") - F.col("first") + 1), ms(F.col("first") - F.lag("last").over(w) - 1), ms(F.lead("first").over(w) - F.col("last") - 1)
    free = (back.isNull() | (back >= before_ms)) & (ahead.isNull() | (ahead >= after_ms))
    return periods.withColumn("kind", F.when(size >= long_ms, "complex").when((size <= short_ms) & free, "twitch").when(size <= short_ms, "short").otherwise("intermediate"))


def isolated_twitches(periods: DataFrame, longest: int = 5, rest: int = 30) -> DataFrame:
    back = F.col("first") - F.lag("last").over(over("session_id", "first"))
    return periods.withColumn("_back", back).filter((F.col("last") - F.col("first") + 1 <= longest) & (F.col("_back").isNull() | (F.col("_back") >= rest))).drop("_back")


def motion_shift_periods(shift: DataFrame, k: float = 1.55) -> DataFrame:
    """Runs of frames whose displacement passes mean + k x std of the session."""
    w = over("session_id")
    d = shift.withColumn("_lim", F.avg("value").over(w) + k * F.stddev_pop("value").over(w))
    return runs(d.filter(F.col("value") > F.col("_lim")))


def displacement(shift: DataFrame) -> DataFrame:
    """sqrt(x2 + y2) less its median, absolute, z-scored; shift: (session_id, frame, x, y)."""
    d = shift.withColumn("d", F.hypot("x", "y"))
    m = d.groupBy("session_id").agg(F.percentile("d", F.lit(0.5)).alias("_m"))
    w = over("session_id")
    d = d.join(m, "session_id").withColumn("d", F.abs(F.col("d") - F.col("_m")))
    return d.select("session_id", "frame", ratio(F.col("d") - F.avg("d").over(w), F.stddev_pop("d").over(w)).alias("value"))


def correlations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pearson of values at equal frames, and Spearman as Pearson of average ranks."""
    d = a.select("session_id", "frame", F.col("value").alias("x")).join(b.select("session_id", "frame", F.col("value").alias("y")), ["session_id", "frame"])
    r = lambda c: F.rank().over(over("session_id", c)) + (F.count(F.lit(1)).over(over(["session_id", c])) - 1) / 2
    ranked = d.withColumn("rx", r("x")).withColumn("ry", r("y"))
    return ranked.groupBy("session_id").agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.count("x").alias("n"))


def frame_clock(signal: DataFrame, threshold: float) -> DataFrame:
    """Frames numbered at the rising edges of a sync channel."""
    e = rising_edges(signal, threshold)
    return e.select("session_id", (F.row_number().over(over("session_id", "i")) - 1).cast("int").alias("frame"), "i", "t")


def even_clock(signal: DataFrame, threshold: float) -> DataFrame:
    """For slow sampling: as many frames as edges, evenly spaced between the first and last."""
    c = frame_clock(signal, threshold)
    w = over("session_id")
    span = F.max("t").over(w) - F.min("t").over(w)
    return c.select("session_id", "frame", (F.min("t").over(w) + F.coalesce(ratio(span * F.col("frame"), F.count("t").over(w) - 1), F.lit(0.0))).alias("t"))


def resample_at_frames(signal: DataFrame, clock: DataFrame) -> DataFrame:
    """The signal's value at each frame's sample; clock: (session_id, frame, i)."""
    return clock.select("session_id", "frame", "i").join(signal.select("session_id", "i", "value"), ["session_id", "i"])


def every_kth(signal: DataFrame, k: int) -> DataFrame:
    return signal.filter(F.pmod("i", F.lit(k)) == 0)


def bodypart_activity(signals: DataFrame, thresholds: DataFrame, merged: DataFrame) -> DataFrame:
    """Moving frames (session_id, part, frame) of body parts over their thresholds; merged: (channel, part) joins sides by OR."""
    d = signals.join(thresholds, "channel").filter("value >= threshold").join(merged, "channel", "left")
    return d.select("session_id", F.coalesce("part", "channel").alias("part"), "frame").distinct()


def classify_behaviour(parts: DataFrame, gap: int = 2, long: int = 10, many: int = 3) -> DataFrame:
    """Periods (session_id, part, first, last) of body parts to labelled periods.

    Overlapping periods of any parts make one movement: complex if it is long and of ``many``
    parts, startle if short and of many, else twitch_<part> or move_<part> of its first part (by
    time, then name), by length.  Neighbours with one label join across gaps; joining is done at once, so no
    further round finds more.
    """
    whole = merge_periods(parts, 0).select("session_id", F.col("first").alias("m_first"), F.col("last").alias("m_last"))
    met = interval_overlap_join(whole.withColumnsRenamed({"m_first": "first", "m_last": "last"}), parts.select("session_id", "part", "first", "last"), SESSION)
    g = met.groupBy("session_id", "first", "last").agg(F.count_distinct("part").alias("n"), F.min_by("part", F.struct("b_first", "part")).alias("lead"))
    size = F.col("last") - F.col("first") + 1
    label = F.when((F.col("n") >= many) & (size >= long), "complex").when(F.col("n") >= many, "startle").when(size >= long, F.concat(F.lit("move_"), F.col("lead"))).otherwise(F.concat(F.lit("twitch_"), F.col("lead")))
    now = g.select("session_id", label.alias("label"), "first", "last")
    return merge_periods(now, gap, ("session_id", "label"))


def any_movement(parts: DataFrame) -> DataFrame:
    """Runs of frames in which any part moves."""
    return runs(parts.select("session_id", "frame").distinct())


def active_from_position(position: DataFrame, sessions: DataFrame, before: int = 5, after: int = 1, gap: int = 20) -> DataFrame:
    """Frames (session_id, frame, position) where the position changes, widened, joined where closer than ``gap``."""
    w = over("session_id", "frame")
    moved = runs(position.withColumn("_d", F.col("position") != F.lag("position").over(w)).filter("_d"))
    return merge_periods(dilate(moved, sessions, before, after), gap - 1)

