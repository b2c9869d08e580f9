"""Population events, surrogates and significance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import CELL, dealt, frames_of, names, over, shift
from ..functions.shared import checkpointed
from .intervals import interval_overlap_join, merge_periods, periods_to_frames, runs, spaced


def circular_surrogates(activity: DataFrame, sessions: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n copies (k) in which each cell's frames are rolled by its own shift."""
    d = activity.join(sessions.select("session_id", "n_frames"), "session_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rolled = F.pmod(F.col("frame") + shift("cell", "k", "n_frames", seed), F.col("n_frames")).cast("int")
    return d.select("session_id", "k", "cell", rolled.alias("frame"))


def window_counts(activity: DataFrame, sessions: DataFrame, window: int, by: Sequence[str] = ("session_id",), once: bool = True) -> DataFrame:
    """Distinct active cells (or active cell frames) in the window that starts at each frame; starts without any are left out."""
    n = F.count_distinct("cell") if once else F.count("cell")
    starts = activity.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("frame") - window + 1), F.col("frame")))).join(sessions.select("session_id", "n_frames"), "session_id")
    return starts.filter(F.col("start") + window <= F.col("n_frames")).groupBy(*by, F.col("start").alias("frame")).agg(n.cast("int").alias("n"))


#: Surrogates of a session that are counted by one task.
COPIES = 8


def _surrogate_counts(activity: DataFrame, sessions: DataFrame, window: int, n: int, seed: int) -> DataFrame:
    """(session_id, k, frame, n): distinct active cells in the window that starts at each frame of each surrogate; starts without any are left out.

    The starts that a cell reaches are found once, on the circle of its frames, and rolled with the cell.  A session's
    copies are dealt by eight, so what is counted is in its task already.
    """
    d = activity.join(sessions.select("session_id", "n_frames"), "session_id")
    start = F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda j: F.pmod(F.col("frame") - j, F.col("n_frames")).cast("int"))
    cells = d.groupBy(*CELL, "n_frames").agg(F.array_distinct(F.flatten(F.collect_set(start))).alias("starts"))
    blocks = cells.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // COPIES))))
    k = F.explode(F.sequence(F.col("_b") * COPIES, F.least(F.lit(n - 1), F.col("_b") * COPIES + COPIES - 1)))
    copies = dealt(blocks, "session_id", "_b").withColumn("k", k).withColumn("_shift", shift("cell", "k", "n_frames", seed))
    rolled = copies.select("session_id", "_b", "k", "_shift", "n_frames", F.explode("starts").alias("_s")).select("session_id", "_b", "k", "n_frames", F.pmod(F.col("_s") + F.col("_shift"), F.col("n_frames")).cast("int").alias("frame"))
    return rolled.filter(F.col("frame") + window <= F.col("n_frames")).groupBy("session_id", "_b", "k", "frame").agg(F.count(F.lit(1)).cast("int").alias("n"))


def activity_threshold(activity: DataFrame, sessions: DataFrame, window: int = 1, n: int = 1000, pct: float = 0.95, max_of_each: bool = False, seed: int = 0) -> DataFrame:
    """Percentile of the summed activity over the surrogates' windows, empty ones too; or of each surrogate's largest.

    The body is not public; defined here as the percentile over all window starts.
    """
    c = _surrogate_counts(activity, sessions, window, n, seed)
    if max_of_each:
        top = c.groupBy("session_id", "_b", "k").agg(F.max("n").alias("m")).groupBy("session_id", "m").agg(F.count("k").alias("times"))
        return top.groupBy("session_id").agg(F.percentile("m", F.lit(pct), F.col("times")).alias("threshold"))
    # empty windows come as one weighted row a session, not as n x frames rows
    tally = c.groupBy("session_id", "n").agg(F.count("k").alias("times"))
    full = tally.groupBy("session_id").agg(F.sum("times").alias("seen")).join(sessions.select("session_id", "n_frames"), "session_id")
    empty = full.select("session_id", F.lit(0).alias("n"), ((F.col("n_frames") - window + 1) * n - F.col("seen")).alias("times")).filter("times > 0")
    return tally.unionByName(empty).groupBy("session_id").agg(F.percentile("n", F.lit(pct), F.col("times")).alias("threshold"))


def detect_events(activity: DataFrame, sessions: DataFrame, thresholds: DataFrame, window: int = 1, strict: bool = False, once: bool = True) -> DataFrame:
    """Periods covered by windows whose distinct active cells reach (or pass) the session's threshold."""
    c = window_counts(activity, sessions, window, once=once).join(thresholds, "session_id")
    hit = c.filter(F.col("n") > F.col("threshold") if strict else F.col("n") >= F.col("threshold"))
    p = merge_periods(hit.select("session_id", F.col("frame").alias("first"), (F.col("frame") + window - 1).alias("last")), 1)
    return p.withColumn("event_id", F.row_number().over(over("session_id", "first")).cast("long"))


def event_numbers(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every frame with its event, null outside."""
    f = periods_to_frames(events).select("session_id", "frame", "event_id")
    return frames_of(sessions).join(f, ["session_id", "frame"], "left")


def event_cells(activity: DataFrame, events: DataFrame) -> DataFrame:
    return periods_to_frames(events).join(activity, ["session_id", "frame"]).select("session_id", "event_id", "cell").distinct()


def detect_peak_events(activity: DataFrame, sessions: DataFrame, around: int, distance: int, min_cells: int, exclude: DataFrame | None = None) -> DataFrame:
    """Local maxima of the population activity, the higher first, at least ``distance`` apart; widened and joined."""
    n = activity.groupBy("session_id", "frame").agg(F.count("cell").cast("int").alias("n"))
    d = frames_of(sessions).join(n, ["session_id", "frame"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = over("session_id", "frame")
    step = d.withColumn("_d", F.col("n") - F.lag("n").over(w)).filter("_d <> 0 AND _d IS NOT NULL")
    peaks = step.withColumn("_next", F.lead("_d").over(w)).filter((F.col("_d") > 0) & (F.col("_next") < 0) & (F.col("n") >= min_cells)).select("session_id", "frame", "n")
    if exclude is not None:
        near = exclude.select("session_id", (F.col("first") - around).alias("first"), (F.col("last") + around).alias("last"))
        peaks = peaks.join(periods_to_frames(merge_periods(near, 1)).select("session_id", "frame"), ["session_id", "frame"], "left_anti")

    kept = spaced(peaks, distance, "session_id", "n").join(sessions.select("session_id", "n_frames"), "session_id")
    p = merge_periods(kept.select("session_id", F.greatest(F.lit(0), F.col("frame") - around).alias("first"), F.least(F.col("n_frames") - 1, F.col("frame") + around).alias("last")), 1)
    return p.withColumn("event_id", F.row_number().over(over("session_id", "first")).cast("long"))


def detect_block_events(activity: DataFrame, sessions: DataFrame, block: int, step: int, share: float) -> DataFrame:
    """Blocks at every ``step`` frames whose summed activity passes a share of the cells; from the left, without overlap."""
    c = window_counts(activity, sessions, block, once=False).filter(F.col("frame") % step == 0).join(sessions.select("session_id", "n_cells"), "session_id")
    taken = first_free(c.filter(F.col("n") > share * F.col("n_cells")).select("session_id", "frame"), block)
    return taken.select("session_id", F.col("frame").alias("first"), (F.col("frame") + block - 1).alias("last"))


def first_free(starts: DataFrame, block: int, part: str = "session_id") -> DataFrame:
    """Of the starts (part, frame) those that are taken from the left, each at least ``block`` frames after the one before.

    A start with none in the ``block`` frames before it is always taken; others are if a chain of next free starts
    leads from such a one to them.  Chains are followed by pointer jumping: twice as far in each round.
    """
    w = over(part, "frame")
    after = F.min("frame").over(w.rangeBetween(block, W.unboundedFollowing))
    d = starts.distinct().withColumn("on", F.coalesce(F.col("frame") - F.lag("frame").over(w) >= block, F.lit(True))).withColumn("next", after)
    # what is taken for itself ends the chains that lead to it
    heads = d.filter("on").select(part, F.col("frame").alias("next"), F.lit(True).alias("_head"))
    now = checkpointed(d.join(heads, [part, "next"], "left").select(part, "frame", "on", F.when(F.col("_head").isNull(), F.col("next")).alias("next")))
    while not now.filter("next IS NOT NULL").isEmpty():
        met = now.filter("on AND next IS NOT NULL").select(part, F.col("next").alias("frame"), F.lit(True).alias("_met")).distinct()
        far = now.select(part, F.col("frame").alias("next"), F.col("next").alias("_far"))
        now = checkpointed(now.join(far, [part, "next"], "left").join(met, [part, "frame"], "left").select(part, "frame", (F.col("on") | F.coalesce("_met", F.lit(False))).alias("on"), F.col("_far").alias("next")))
    return now.filter("on").select(part, "frame")


def events_vs_movement(events: DataFrame, movement: DataFrame, after: int = 10) -> DataFrame:
    """Events with ``linked``: in a movement or at most ``after`` frames behind one."""
    wide = movement.select("session_id", "first", (F.col("last") + after).alias("last"))
    hit = interval_overlap_join(events, wide, ("session_id",), how="semi").select("session_id", "event_id").withColumn("linked", F.lit(True))
    return events.join(hit, ["session_id", "event_id"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def twitch_groups(twitches: DataFrame, events: DataFrame, within: int) -> DataFrame:
    """Twitches (session_id, twitch_id, first, last) by group: in an event, followed by one within some frames, or neither."""
    inside = interval_overlap_join(twitches, events.select("session_id", "first", "last"), ("session_id",), how="semi").select("session_id", "twitch_id").withColumn("_in", F.lit(True))
    later = twitches.select("session_id", "twitch_id", (F.col("last") + 1).alias("first"), (F.col("last") + within).alias("last"))
    then = interval_overlap_join(later, events.select("session_id", "first", "last"), ("session_id",), how="semi").select("session_id", "twitch_id").withColumn("_then", F.lit(True))
    d = twitches.join(inside, ["session_id", "twitch_id"], "left").join(then, ["session_id", "twitch_id"], "left")
    return d.select("session_id", "twitch_id", "first", "last", F.when(F.col("_in"), "in_event").when(F.col("_then"), "before_event").otherwise("alone").alias("group"))


def post_twitch_bouts(activity: DataFrame, twitches: DataFrame, within: int = 20) -> DataFrame:
    """Runs of frames in the ``within`` frames after a twitch with at least the twitch's mean activity."""
    n = activity.groupBy("session_id", "frame").agg(F.count("cell").alias("n"))
    own = periods_to_frames(twitches).join(n, ["session_id", "frame"], "left").groupBy("session_id", "twitch_id", "last").agg(F.avg(F.coalesce("n", F.lit(0))).alias("mean"))
    later = own.withColumn("frame", F.explode(F.sequence(F.col("last") + 1, F.col("last") + within))).join(n, ["session_id", "frame"]).filter("n >= mean")
    return runs(later, ("session_id", "twitch_id"))


def circle_tally(arcs: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, n, times): in how many of the n_frames places of a circle n arcs lie; arcs: key, at, size (1 to n_frames), n_frames.

    Only the ends of arcs are rows: the number changes there, and stays for as many places as lie between two.
    """
    key = names(key)
    end = F.col("at") + F.col("size")
    marks = F.array(
        F.struct(F.lit(0).alias("at"), F.when(end > F.col("n_frames"), 1).otherwise(0).alias("d")),
        F.struct(F.col("at").cast("int").alias("at"), F.lit(1).alias("d")),
        F.struct((end % F.col("n_frames")).cast("int").alias("at"), F.when(end == F.col("n_frames"), 0).otherwise(-1).alias("d")),
    )
    step = arcs.select(*key, "n_frames", F.explode(marks).alias("m")).groupBy(*key, "n_frames", F.col("m.at").alias("at")).agg(F.sum("m.d").alias("d"))
    w = over(key, "at")
    level = step.withColumn("n", F.sum("d").over(w)).withColumn("times", F.coalesce(F.lead("at").over(w), F.col("n_frames")) - F.col("at"))
    return level.groupBy(*key, "n").agg(F.sum("times").alias("times"))


def _quantile(tally: DataFrame, key: Sequence[str], pct: float, weight: str = "times") -> DataFrame:
    """(key, threshold): the smallest n that a share pct of the weight does not pass."""
    below, all_ = F.sum(weight).over(over(key, "n")), F.sum(weight).over(over(key))
    reached = tally.withColumn("_reached", below >= pct * all_ - 1e-9 * all_).filter("_reached")
    return reached.groupBy(*key).agg(F.min("n").cast("double").alias("threshold"))


def activity_distribution(activity: DataFrame, lengths: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, length, n, p): probability of each summed activity in a window of a length, over all rotations of all cells.

    A cell rolled by any of n_frames shifts puts as many frames in a window as a window at any place holds of it:
    ends of arcs give each cell's numbers, and the cells' distributions are folded.  lengths: (session_id, length).
    """
    arcs = activity.join(lengths.distinct(), "session_id").join(sessions.select("session_id", "n_frames"), "session_id")
    arcs = arcs.select(*CELL, "length", "n_frames", F.pmod(F.col("frame") - F.col("length") + 1, F.col("n_frames")).alias("at"), F.col("length").alias("size"))
    cells = circle_tally(arcs, [*CELL, "length"])

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        out = np.ones(1)
        for _, own in p.sort_values(["cell", "n"]).groupby("cell"):
            one = np.zeros(int(own["n"].max()) + 1)
            one[own["n"].to_numpy(int)] = own["times"]
            out = np.convolve(out, one / one.sum())
        return pd.DataFrame({"session_id": p["session_id"].iloc[0], "length": p["length"].iloc[0], "n": np.arange(len(out)), "p": out})

    return cells.groupBy("session_id", "length").applyInPandas(fold, "session_id string, length int, n long, p double")


def significant_periods(activity: DataFrame, periods: DataFrame, sessions: DataFrame, n: int | None = None, pct: float = 0.95, seed: int = 0) -> DataFrame:
    """Periods (session_id, period_id, first, last) whose summed activity reaches the surrogates' percentile over all periods.

    n: surrogates drawn; without it the exact distribution over all rotations of all cells, at no cost of copies.
    """
    frames = periods_to_frames(periods).select("session_id", "period_id", "frame")
    own = frames.join(activity, ["session_id", "frame"], "left").groupBy("session_id", "period_id").agg(F.count("cell").alias("n"))
    if n is None:
        sized = periods.select("session_id", (F.col("last") - F.col("first") + 1).cast("int").alias("length")).groupBy("session_id", "length").agg(F.count(F.lit(1)).alias("_m"))
        d = activity_distribution(activity, sized.select("session_id", "length"), sessions).join(sized, ["session_id", "length"])
        # lengths without an active cell hold nothing, for certain
        still = sized.join(activity.select("session_id").distinct(), "session_id", "left_anti").select("session_id", F.lit(0).cast("long").alias("n"), F.col("_m").cast("double").alias("w"))
        tally = d.select("session_id", "n", (F.col("p") * F.col("_m")).alias("w")).unionByName(still).groupBy("session_id", "n").agg(F.sum("w").alias("w"))
        return own.join(_quantile(tally, ["session_id"], pct, "w"), "session_id").filter("n >= threshold")
    copies = frames.join(circular_surrogates(activity, sessions, n, seed), ["session_id", "frame"]).groupBy("session_id", "period_id", "k").agg(F.count("cell").alias("n"))
    tally = copies.groupBy("session_id", "n").agg(F.count("k").alias("times"))
    all_ = periods.groupBy("session_id").agg((F.count("period_id") * n).alias("all")).join(tally.groupBy("session_id").agg(F.sum("times").alias("seen")), "session_id", "left")
    empty = all_.select("session_id", F.lit(0).cast("long").alias("n"), (F.col("all") - F.coalesce("seen", F.lit(0))).alias("times")).filter("times > 0")
    limit = tally.unionByName(empty).groupBy("session_id").agg(F.percentile("n", F.lit(pct), F.col("times")).alias("threshold"))
    return own.join(limit, "session_id").filter("n >= threshold")


def significant_cells(activity: DataFrame, mask: DataFrame, sessions: DataFrame, n: int | None = None, pct: float = 0.95, seed: int = 0) -> DataFrame:
    """Cells active in the mask (session_id, frame) at least as often as their own surrogates' percentile.

    n: surrogates drawn; without it all n_frames rotations of a cell.  A frame meets a run of the mask for an arc of
    rotations, so the rows are frames x runs, not frames x rotations.
    """
    own = activity.join(mask, ["session_id", "frame"]).groupBy(*CELL).agg(F.count("frame").alias("n"))
    if n is None:
        met = activity.join(runs(mask), "session_id").join(sessions.select("session_id", "n_frames"), "session_id")
        arcs = met.select(*CELL, "n_frames", F.pmod(F.col("first") - F.col("frame"), F.col("n_frames")).alias("at"), (F.col("last") - F.col("first") + 1).alias("size"))
        return own.join(_quantile(circle_tally(arcs, CELL), CELL, pct), list(CELL)).filter("n >= threshold")
    copies = circular_surrogates(activity, sessions, n, seed).join(mask, ["session_id", "frame"]).groupBy(*CELL, "k").agg(F.count("frame").alias("n"))
    # one weighted row for each number, and one for the copies that are never in the mask
    tally = copies.groupBy(*CELL, "n").agg(F.count("k").alias("times"))
    none = tally.groupBy(*CELL).agg((F.lit(n) - F.sum("times")).alias("times")).filter("times > 0").select(*CELL, F.lit(0).cast("long").alias("n"), "times")
    limit = tally.unionByName(none).groupBy(*CELL).agg(F.percentile("n", F.lit(pct), F.col("times")).alias("threshold"))
    # a cell that no copy brings into the mask has the threshold 0
    return own.join(limit, list(CELL), "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0))).filter("n >= threshold")


def random_membership(event_sizes: DataFrame, cells: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Each event (session_id, event_id, size) draws as many of the session's active cells, n times, without replacement."""
    d = event_sizes.join(cells, "session_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draw = F.pmod(F.col("cell").cast("long") * 2654435761 + F.col("event_id") * 40503 + F.col("k") * 104729 + seed, F.lit(65521))
    return d.withColumn("_r", F.row_number().over(over(["session_id", "event_id", "k"], draw, "cell"))).filter("_r <= size").select("session_id", "event_id", "k", "cell")


def surrogate_dither(spikes: DataFrame, sessions: DataFrame, width: int, k: int | Column = 0, seed: int = 0, by: Sequence[str] = (), once: bool = True) -> DataFrame:
    """Each spike moved inside +-width by a hash; clipped to the session, equal frames once unless that is left out.  k: the copy's number, as a column beside the keys ``by`` for several copies at once."""
    move = F.pmod(F.col("cell").cast("long") * 7919 + F.col("frame").cast("long") * 104729 + F.lit(k).cast("long") * 15485863 + seed, F.lit(2 * width + 1)) - width
    d = spikes.join(sessions.select("session_id", "n_frames"), "session_id")
    moved = d.select("session_id", *by, "cell", F.greatest(F.lit(0), F.least(F.col("n_frames") - 1, (F.col("frame") + move).cast("int"))).alias("frame"))
    return moved.distinct() if once else moved
