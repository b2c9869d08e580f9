"""Projections, filters and normalisation of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import CELL, dealt, names, on, over, ratio
from .intervals import complement, dilate, interval_overlap_join, merge_periods, runs, transients

# Weights of an 11-point Hamming window, 0.54 - 0.46 cos(2 pi k / 10).
HAMMING_11 = (0.08, 0.16785218, 0.39785218, 0.68214782, 0.91214782, 1.0, 0.91214782, 0.68214782, 0.39785218, 0.16785218, 0.08)


def zscore(df: DataFrame, part: Sequence[str] = CELL, value: str = "value") -> DataFrame:
    """(x - mean) / population std by part; null where the std is 0."""
    w = over(part)
    return df.withColumn(value, ratio(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w)))


def median_normalise(df: DataFrame, part: Sequence[str] = CELL, value: str = "value") -> DataFrame:
    m = df.groupBy(*names(part)).agg(F.percentile(value, F.lit(0.5)).alias("_median"))
    return on(df, m, part).withColumn(value, ratio(value, "_median")).drop("_median")


def mean_normalise(df: DataFrame, part: Sequence[str] = CELL, value: str = "value") -> DataFrame:
    return df.withColumn(value, ratio(F.col(value), F.avg(value).over(over(part))))


def minmax01(df: DataFrame, part: Sequence[str] = CELL, value: str = "value") -> DataFrame:
    """(x - min) / range; x - min where the range is 0."""
    w = over(part)
    low, span = F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)
    return df.withColumn(value, F.when(span > 0, (F.col(value) - low) / span).otherwise(F.col(value) - low))


def segment_zscore(df: DataFrame, changes: DataFrame, part: Sequence[str] = CELL, flatten: int = 0) -> DataFrame:
    """z-score inside the segments that begin at changes (part, frame).

    flatten: frames from a change on that take their segment's mean first, so their score is 0.
    """
    part = names(part)
    # a part's changes are one row beside its frames: rows stay where the windows need them
    marks = changes.groupBy(*part).agg(F.collect_set("frame").alias("_marks"))
    w = over(part, "frame").rowsBetween(W.unboundedPreceding, 0)
    d = dealt(df, *part).join(marks, part, "left").withColumn("_change", F.when(F.array_contains("_marks", F.col("frame")), 1)).drop("_marks")
    d = d.withColumn("_segment", F.sum(F.coalesce("_change", F.lit(0))).over(w))
    if flatten:
        since = F.col("frame") - F.max(F.when(F.col("_change") == 1, F.col("frame"))).over(w)
        d = d.withColumn("value", F.when(since < flatten, F.avg("value").over(over([*part, "_segment"]))).otherwise(F.col("value")))
    return zscore(d, [*part, "_segment"]).withColumnRenamed("_segment", "segment").drop("_change")


def smooth(df: DataFrame, weights: Sequence[float] = HAMMING_11, part: Sequence[str] = CELL) -> DataFrame:
    """Weighted moving mean of rows in frame order; at the ends the weights that have a row are renormalised."""
    w, half = over(part, "frame"), len(weights) // 2
    total, weight = F.lit(0.0), F.lit(0.0)
    for k, x in enumerate(weights):
        v = F.col("value") if k == half else (F.lag("value", half - k).over(w) if k < half else F.lead("value", k - half).over(w))
        total, weight = total + F.coalesce(v * x, F.lit(0.0)), weight + F.when(v.isNotNull(), x).otherwise(0.0)
    return df.withColumn("value", total / weight)


def gaussian_weights(sigma: float, reach: float = 4.0) -> list[float]:
    from math import exp

    half = max(1, round(reach * sigma))
    return [exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]


def rolling_mean(df: DataFrame, n: int, part: Sequence[str] = CELL) -> DataFrame:
    """Centred mean of n rows (n odd); null where the window is cut."""
    w = over(part, "frame").rowsBetween(-(n // 2), n // 2)
    return df.withColumn("value", F.when(F.count("value").over(w) == 2 * (n // 2) + 1, F.avg("value").over(w)))


def bin_sum(df: DataFrame, n: int, part: Sequence[str] = CELL, how: str = "sum") -> DataFrame:
    """Sum (or max, for any-active pooling) of bins of n frames."""
    agg = {"sum": F.sum, "max": F.max, "avg": F.avg}[how]
    return df.groupBy(*names(part), F.floor(F.col("frame") / n).cast("int").alias("bin")).agg(agg("value").alias("value"))


def drop_cells(df: DataFrame, removed: DataFrame) -> DataFrame:
    return df.join(removed.select(*CELL), list(CELL), "left_anti")


def reindex_cells(cells: DataFrame) -> DataFrame:
    """(session_id, cell, new_cell): the remaining cells numbered from 0."""
    d = cells.select(*CELL).distinct()
    return d.withColumn("new_cell", (F.row_number().over(over("session_id", "cell")) - 1).cast("int"))


def mask_boundaries(df: DataFrame, every: int, n: int) -> DataFrame:
    """Without the first n frames after each join of recordings (not those of the first)."""
    return df.filter((F.pmod("frame", F.lit(every)) >= n) | (F.col("frame") < every))


def refractory(onsets: DataFrame, gap: int, part: Sequence[str] = CELL) -> DataFrame:
    """Without onsets at most ``gap`` frames after the previous onset."""
    before = F.lag("frame").over(over(part, "frame"))
    return onsets.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("frame") - F.col("_before") > gap)).drop("_before")


def is_active(probs: str = "probs", threshold: float = 0.5, below_one: bool = True) -> Column:
    """Active by class probabilities: at least the threshold, and the first class the largest where there are more."""
    t = 0.99 if below_one and threshold == 1 else threshold
    p = F.col(probs)
    return (p[0] >= t) & ((F.size(p) == 1) | (p[0] == F.array_max(p)))


def threshold_predictions(df: DataFrame, threshold: float = 0.5, probs: str = "probs") -> DataFrame:
    return df.filter(is_active(probs, threshold)).drop(probs)


def uncertain_periods(df: DataFrame, sessions: DataFrame, low: float = 0.1, high: float = 0.5, around: int = 100) -> DataFrame:
    """Runs of predictions above low that never pass high, with a review window around them."""
    above = df.filter(F.col("p") >= low)
    best = interval_frames(runs(above, CELL)).join(above, [*CELL, "frame"]).groupBy(*CELL, "first", "last").agg(F.max("p").alias("top"))
    wide = best.filter(F.col("top") <= high).join(sessions.select("session_id", "n_frames"), "session_id")
    return wide.select(*CELL, "first", "last", "top", F.greatest(F.lit(0), F.col("first") - around).alias("view_first"), F.least(F.col("n_frames") - 1, F.col("last") + around).alias("view_last"))


def interval_frames(periods: DataFrame) -> DataFrame:
    return periods.withColumn("frame", F.explode(F.sequence("first", "last")))


def mark_doubtful(frames: DataFrame, sessions: DataFrame, every: int = 2500, n: int = 10) -> DataFrame:
    """Flags the n frames at both ends of a session and on both sides of each join of recordings."""
    d = frames.join(sessions.select("session_id", "n_frames"), "session_id")
    at = F.pmod("frame", F.lit(every))
    edge = (F.col("frame") < n) | (F.col("frame") >= F.col("n_frames") - n)
    joint = ((at < n) & (F.col("frame") >= every)) | ((at >= every - n) & (F.col("frame") < F.col("n_frames") - F.col("n_frames") % every))
    return d.withColumn("doubtful", edge | joint).drop("n_frames")


def still(periods: DataFrame, sessions: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Periods outside all (widened) movement."""
    return complement(dilate(periods, sessions, before, after), sessions)


def state_frames(labelled: DataFrame, include: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Frames of some labels' periods that lie in none of the excluded labels' (quiet wake: wake without active)."""
    frames = lambda names_: interval_frames(labelled.filter(F.col("label").isin(list(names_)))).select("session_id", "frame").distinct()
    kept = frames(include)
    return kept.join(frames(exclude), ["session_id", "frame"], "left_anti") if exclude else kept


def keep_frames(activity: DataFrame, removed: DataFrame) -> DataFrame:
    """Without the removed periods' frames and all transients that touch them; the frames left are numbered anew.

    removed: (session_id, first, last).  new_frame counts the kept frames before a frame.
    """
    gone = merge_periods(removed, 1)
    whole = interval_overlap_join(transients(activity), gone, ("session_id",), how="anti")
    frames = interval_frames(whole).select(*CELL, "frame")
    cut = gone.select("session_id", F.col("last").alias("frame"), (F.col("last") - F.col("first") + 1).alias("_lost"), F.lit(None).cast("int").alias("cell"))
    both = frames.withColumn("_lost", F.lit(0)).unionByName(cut)
    lost = F.sum("_lost").over(over("session_id", "frame").rangeBetween(W.unboundedPreceding, 0))
    return both.withColumn("new_frame", (F.col("frame") - lost).cast("int")).filter("cell IS NOT NULL").select(*CELL, "frame", "new_frame")
