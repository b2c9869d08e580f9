"""Runs, intervals and transients.  Periods hold both their ends."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import CELL, grown, names, over
from ..functions.shared import checkpointed

SESSION = ("session_id",)


def runs(df: DataFrame, part: Sequence[str] = SESSION, frame: str = "frame") -> DataFrame:
    """Maximal runs of consecutive frames; repeated frames count once."""
    part = names(part)
    rank = F.dense_rank().over(over(part, frame))
    return df.select(*part, frame, (F.col(frame) - rank).alias("_island")).groupBy(*part, "_island").agg(F.min(frame).alias("first"), F.max(frame).alias("last")).drop("_island")


def transients(activity: DataFrame) -> DataFrame:
    """Runs of each cell, numbered in time."""
    r = runs(activity, CELL)
    return r.withColumn("transient_id", F.row_number().over(over(CELL, "first")).cast("long"))


def activity_from_onsets_peaks(onsets: DataFrame, peaks: DataFrame, longest: int = 200, part: Sequence[str] = CELL) -> DataFrame:
    """Rises from each onset to the next later peak; onsets without one give none.  too_long marks more than ``longest`` frames."""
    part = names(part)
    marks = onsets.select(*part, "frame", F.lit(None).cast("int").alias("peak")).unionByName(peaks.select(*part, "frame", F.col("frame").alias("peak")))
    # a peak on the onset's own frame is not later
    later = F.first("peak", ignorenulls=True).over(over(part, "frame").rangeBetween(1, W.unboundedFollowing))
    rises = marks.withColumn("next_peak", later).filter(F.col("peak").isNull() & F.col("next_peak").isNotNull())
    return rises.select(*part, F.col("frame").alias("first"), F.col("next_peak").alias("last"), (F.col("next_peak") - F.col("frame") + 1 > longest).alias("too_long")).distinct()


def onsets_peaks_from_trace(traces: DataFrame, k: float = 1.0, distance: int = 1, part: Sequence[str] = CELL) -> DataFrame:
    """(part, frame, kind): onsets where the slope turns from falling to not falling, and local maxima.

    A plateau gives one peak, at its first frame.  Of peaks closer than ``distance`` frames the
    higher stays (the earlier on ties).  Peaks below minimum + k x std go, with the onset before them.
    """
    part = names(part)
    w = over(part, "frame")
    slope = F.col("value") - F.lag("value").over(w)
    d = traces.select(*part, "frame", "value", slope.alias("slope"))
    moves = d.filter(F.col("slope").isNotNull() & (F.col("slope") != 0))
    turned = moves.withColumn("next_slope", F.lead("slope").over(w))
    peaks = turned.filter((F.col("slope") > 0) & (F.col("next_slope") < 0)).select(*part, "frame", "value")
    onset = d.withColumn("next_slope", F.lead("slope").over(w)).filter((F.col("slope") < 0) & (F.col("next_slope") >= 0)).select(*part, "frame")
    level = traces.groupBy(*part).agg((F.min("value") + k * F.stddev_pop("value")).alias("level"))
    if distance > 1:
        peaks = spaced(peaks, distance, part)
    judged = peaks.join(level, part).select(*part, "frame", (F.col("value") < F.col("level")).alias("low"))
    both = judged.select(*part, "frame", F.lit("peak").alias("kind"), "low").unionByName(onset.select(*part, "frame", F.lit("onset").alias("kind"), F.lit(None).cast("boolean").alias("low")))
    order = over(part, "frame", F.col("kind").asc())
    marked = both.withColumn("next_kind", F.lead("kind").over(order)).withColumn("next_low", F.lead("low").over(order))
    gone = F.coalesce(F.col("low"), F.lit(False)) | ((F.col("kind") == "onset") & (F.col("next_kind") == "peak") & F.coalesce(F.col("next_low"), F.lit(False)))
    return marked.filter(~gone).select(*part, "frame", "kind")


def spaced(peaks: DataFrame, distance: int, part: Sequence[str], value: str = "value") -> DataFrame:
    """Peaks at least ``distance`` frames apart, the higher first (the earlier on ties).

    In each round every peak that is the highest within the distance is taken, and those near it go; who is left
    has no taken neighbour.  A round is two windows over the same rows; rounds end when nobody is left.
    """
    part = names(part)
    w = over(part, "frame").rangeBetween(1 - distance, distance - 1)
    own = F.struct(F.col(value), -F.col("frame"))
    left, kept = peaks, None
    while True:
        top = left.withColumn("_top", (F.max(own).over(w) == own).cast("int"))
        round_ = checkpointed(top.withColumn("_near", F.max("_top").over(w)))
        taken = round_.filter("_top = 1").select(*peaks.columns)
        kept = taken if kept is None else kept.unionByName(taken)
        left = round_.filter("_near = 0").select(*peaks.columns)
        if left.isEmpty():
            return kept


def merge_periods(periods: DataFrame, gap: int = 0, part: Sequence[str] = SESSION) -> DataFrame:
    """Joins periods of which the next begins at most ``gap`` frames after the end so far."""
    part = names(part)
    w = over(part, "first", "last")
    reach = F.max("last").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("first") - reach > gap), 1).otherwise(0)
    grouped = periods.select(*part, "first", "last", new.alias("_new")).withColumn("_group", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy(*part, "_group").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_group")


def periods_to_frames(periods: DataFrame) -> DataFrame:
    return periods.withColumn("frame", F.explode(F.sequence("first", "last")))


def fill_short_gaps(activity: DataFrame, gap: int = 2, part: Sequence[str] = CELL) -> DataFrame:
    """Frames with inactive runs of at most ``gap`` frames filled."""
    return periods_to_frames(merge_periods(runs(activity, part), gap + 1, part)).select(*names(part), "frame")


def dilate(periods: DataFrame, sessions: DataFrame, before: int, after: int, part: Sequence[str] = SESSION) -> DataFrame:
    """Wider periods, clipped to the session, overlapping ones joined."""
    wide = periods.join(sessions.select("session_id", "n_frames"), "session_id")
    wide = wide.withColumn("first", F.greatest(F.lit(0), F.col("first") - before)).withColumn("last", F.least(F.col("n_frames") - 1, F.col("last") + after))
    return merge_periods(wide, 0, part)


def complement(periods: DataFrame, sessions: DataFrame) -> DataFrame:
    """Periods of the frames outside all periods."""
    whole = sessions.select("session_id", F.lit(-1).alias("first"), F.lit(-1).alias("last")).unionByName(merge_periods(periods, 1)).unionByName(sessions.select("session_id", F.col("n_frames").alias("first"), F.col("n_frames").alias("last")))
    gaps = whole.select("session_id", (F.col("last") + 1).alias("first"), (F.lead("first").over(over(SESSION, "first")) - 1).alias("last"))
    return gaps.filter("first <= last")


# -- joins ---------------------------------------------------------------------------------


def event_window_join(events: DataFrame, frames: DataFrame, before: int, after: int, event_frame: str = "frame") -> DataFrame:
    """Rows of frames within each event's window, with rel; an equi-join on frames, windows end where the frames do."""
    wide = events.select(*[c for c in events.columns if c != event_frame], F.col(event_frame).alias("event_frame"), F.explode(F.sequence(F.col(event_frame) - before, F.col(event_frame) + after)).alias("frame"))
    return grown(wide).join(frames, ["session_id", "frame"]).withColumn("rel", F.col("frame") - F.col("event_frame"))


def _cover(first: str, last: str, bucket: int, levels: int) -> Column:
    """Nodes (level, node) of a tree of buckets, eight to a node, that make up an interval: at most 14 a level below the top."""
    low, high = F.floor(F.col(first) / bucket).cast("long"), F.floor(F.col(last) / bucket).cast("long") + 1
    span = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))

    def nodes(k: Column) -> Column:
        # of the nodes inside the interval, those whose parent is not inside too
        at = lambda up: (-F.call_function("shiftright", -low, 3 * (k + up)), F.call_function("shiftright", high, 3 * (k + up)))
        (a, b), (x, y) = at(0), at(1)
        whole = (x < y) & (k < levels - 1)
        left = F.when(whole, F.least(b, 8 * x)).otherwise(b)
        right = F.when(whole, F.greatest(left, 8 * y)).otherwise(b)
        return F.transform(F.concat(span(a, left), span(right, b)), lambda n: F.struct(k.alias("level"), n.alias("node")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), nodes))


def interval_overlap_join(a: DataFrame, b: DataFrame, part: Sequence[str] = SESSION, bucket: int = 16, how: str = "inner", levels: int = 5) -> DataFrame:
    """Pairs of a and b with a common frame; columns of b that a has too get the prefix b_.

    Two intervals meet where the later of them begins, so a pair is found once: a's beginning in b, or b's in a
    after a's beginning.  An interval is cut into the nodes of a tree over buckets of frames, some for each
    level; a beginning is in one node of every level.  They meet by (part, level, node): long intervals come in a
    few large nodes, and no join is by the part alone.  A node of the top level has bucket x 8 ** (levels - 1)
    frames; intervals of many times that are as right, and in more nodes.
    """
    part = names(part)
    taken = set(a.columns)
    b = b.select(*[F.col(c).alias(f"b_{c}" if c in taken and c not in part else c) for c in b.columns])
    first, last = ("b_first", "b_last") if "first" in taken else ("first", "last")

    def met(points: DataFrame, at: str, wide: DataFrame, f: str, l: str) -> DataFrame:
        nodes = wide.select("*", F.explode(_cover(f, l, bucket, levels)).alias("_n")).select(*wide.columns, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))
        place = F.floor(F.col(at) / bucket).cast("long")
        dealt = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("_node", F.call_function("shiftright", place, 3 * F.col("_level")))
        return grown(dealt).join(grown(nodes), [*part, "_level", "_node"]).filter((F.col(f) <= F.col(at)) & (F.col(at) <= F.col(l)))

    columns = [*a.columns, *(c for c in b.columns if c not in part)]
    pairs = met(a, "first", b, first, last).select(columns).unionByName(met(b, first, a, "first", "last").filter(F.col(first) > F.col("first")).select(columns))
    if how == "inner":
        return pairs
    keys = a.columns
    hit = pairs.select(*keys).distinct()
    same = [F.col(f"_a.{c}").eqNullSafe(F.col(f"_h.{c}")) for c in keys]
    return a.alias("_a").join(hit.alias("_h"), reduce(lambda x, y: x & y, same), "left_semi" if how == "semi" else "left_anti")


def pair_self_join(df: DataFrame, key: str = "cell", by: Sequence[str] = ("session_id", "frame")) -> DataFrame:
    """Pairs key < key2 that meet in ``by``: sparse rows meet by equal frames first."""
    by = names(by)
    return df.join(df.select(*by, F.col(key).alias(f"{key}2")), by).filter(F.col(key) < F.col(f"{key}2"))


def coactive_runs(activity: DataFrame, pairs: DataFrame) -> DataFrame:
    """Runs of frames in which both cells of a pair (session_id, cell, cell2) are active."""
    a = pairs.join(activity, ["session_id", "cell"])
    both = a.join(activity.select("session_id", F.col("cell").alias("cell2"), "frame"), ["session_id", "cell2", "frame"])
    return runs(both, ("session_id", "cell", "cell2"))


# -- candidates and clocks --------------------------------------------------------------------


def false_transients(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidate runs without a frame of any true run."""
    return interval_overlap_join(candidates, truth, CELL, how="anti")


def snap_to_candidates(predicted: DataFrame, candidates: DataFrame, drop_only: bool = False) -> DataFrame:
    """Whole candidate runs that a prediction touches; or the predicted runs that touch a candidate."""
    return interval_overlap_join(predicted, candidates, CELL, how="semi") if drop_only else interval_overlap_join(candidates, predicted, CELL, how="semi")


def nearest_frame(events: DataFrame, clock: DataFrame, part: Sequence[str] = SESSION) -> DataFrame:
    """Frame of the nearest clock time for each event time t; -1 before the clock, n after it; the later frame on ties."""
    part = names(part)
    both = events.withColumn("_frame", F.lit(None).cast("int")).withColumn("_ct", F.lit(None).cast("double")).unionByName(clock.select(*part, "t", F.col("frame").alias("_frame"), F.col("t").alias("_ct")), allowMissingColumns=True)
    w = over(part, "t")
    past, next_ = w.rangeBetween(W.unboundedPreceding, 0), w.rangeBetween(0, W.unboundedFollowing)
    both = both.select("*", F.last("_frame", True).over(past).alias("_f0"), F.last("_ct", True).over(past).alias("_t0"), F.first("_frame", True).over(next_).alias("_f1"), F.first("_ct", True).over(next_).alias("_t1"), F.count("_ct").over(W.partitionBy(*part)).cast("int").alias("_n"))
    frame = F.when(F.col("_f0").isNull(), -1).when(F.col("_f1").isNull(), F.col("_n")).when(F.col("t") - F.col("_t0") < F.col("_t1") - F.col("t"), F.col("_f0")).otherwise(F.col("_f1"))
    return both.filter("_frame IS NULL").select(*events.columns, frame.alias("frame"))


def frames_to_times(periods: DataFrame, clock: DataFrame, shortest: int = 3) -> DataFrame:
    """Periods of at least ``shortest`` frames in seconds."""
    long = periods.filter(F.col("last") - F.col("first") + 1 >= shortest)
    c = clock.select("session_id", "frame", "t")
    return long.join(c.select("session_id", F.col("frame").alias("first"), F.col("t").alias("t0")), ["session_id", "first"]).join(c.select("session_id", F.col("frame").alias("last"), F.col("t").alias("t1")), ["session_id", "last"])


def shortest_label_per_frame(intervals: DataFrame, clock: DataFrame, default: str = "still", bucket: float = 50_000.0) -> DataFrame:
    """One label for each frame: that of the shortest interval over its time (the first by name on ties), else the default."""
    wide = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col("t0") / bucket), F.floor(F.col("t1") / bucket))))
    met = clock.withColumn("_b", F.floor(F.col("t") / bucket)).join(wide, ["session_id", "_b"]).filter("t >= t0 AND t <= t1")
    best = met.groupBy("session_id", "frame").agg(F.min_by("label", F.struct(F.col("t1") - F.col("t0"), F.col("label"))).alias("_label"))
    return clock.select("session_id", "frame").join(best, ["session_id", "frame"], "left").select("session_id", "frame", F.coalesce("_label", F.lit(default)).alias("label"))


def union_intervals(*sets: DataFrame) -> DataFrame:
    """All annotators' intervals, equal ones once, in order."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct().orderBy("session_id", "label", "t0", "t1")


def align_clocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both streams inside their common time span."""
    ends = a.groupBy("session_id").agg(F.min("t").alias("a0"), F.max("t").alias("a1")).join(b.groupBy("session_id").agg(F.min("t").alias("b0"), F.max("t").alias("b1")), "session_id")
    span = ends.select("session_id", F.greatest("a0", "b0").alias("_lo"), F.least("a1", "b1").alias("_hi"))
    return a.unionByName(b).join(span, "session_id").filter("t >= _lo AND t <= _hi").drop("_lo", "_hi")


def resolve_annotations(marks: DataFrame, spans: DataFrame) -> DataFrame:
    """Inside each span (x_from, x_to, accept) the best scored onset and peak (the last on ties); rejected spans give none."""
    s = spans.filter("accept").withColumn("frame", F.explode(F.sequence("x_from", "x_to"))).select(*CELL, "x_from", "x_to", "frame")
    return s.join(marks, [*CELL, "frame"]).groupBy(*CELL, "x_from", "x_to", "kind").agg(F.max_by("frame", F.struct("score", "frame")).alias("frame"))


def onsets_before_peaks(peaks: DataFrame, onsets: DataFrame, back: int = 10) -> DataFrame:
    """Onsets in the ``back`` frames before each peak."""
    wide = peaks.select(*CELL, F.col("frame").alias("peak"), F.explode(F.sequence(F.col("frame") - back, F.col("frame"))).alias("frame"))
    return wide.join(onsets.select(*CELL, "frame"), [*CELL, "frame"]).select(*CELL, "peak", F.col("frame").alias("onset"))


def overlay_segments(base: DataFrame, segments: DataFrame) -> DataFrame:
    """Labels of frames: those of a segment (first, last, frames' labels) where one lies over the frame, else the base's; scored says which."""
    s = periods_to_frames(segments).select(*CELL, "frame", F.col("label").alias("_label"))
    met = base.join(s, [*CELL, "frame"], "full")
    return met.select(*CELL, "frame", F.coalesce("_label", "label").alias("label"), F.col("_label").isNotNull().alias("scored"))
