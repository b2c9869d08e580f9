"""Event-aligned profiles.  Windows are exploded to frames and equi-joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CELL, cells_of, over, ratio
from .series import zscore


def _windows(events: DataFrame, sessions: DataFrame, before: int, after: int, at: str = "first") -> DataFrame:
    """(session_id, event_id, rel, frame) of each event; frames outside the session are left out."""
    rel = F.explode(F.sequence(F.lit(-before), F.lit(after)))
    d = events.select("session_id", "event_id", F.col(at).alias("at"), rel.alias("rel")).join(sessions.select("session_id", "n_frames"), "session_id")
    return d.withColumn("frame", F.col("at") + F.col("rel")).filter("frame >= 0 AND frame < n_frames").drop("at", "n_frames")


def spread(value: Column | str, name: str = "") -> list[Column]:
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [F.avg(value).alias(f"{name}mean"), F.stddev_pop(value).alias(f"{name}std"), p[0].alias(f"{name}p25"), p[1].alias(f"{name}median"), p[2].alias(f"{name}p75")]


def event_activity(activity: DataFrame, events: DataFrame, sessions: DataFrame, before: int, after: int) -> DataFrame:
    """Active cells (percent) at each relative frame of each event, 0 where none is."""
    n = activity.groupBy("session_id", "frame").agg(F.count("cell").alias("n"))
    d = _windows(events, sessions, before, after).join(n, ["session_id", "frame"], "left").join(sessions.select("session_id", "n_cells", "age"), "session_id")
    return d.select("session_id", "age", "event_id", "rel", (100 * F.coalesce("n", F.lit(0)) / F.col("n_cells")).alias("pct"))


def psth(activity: DataFrame, events: DataFrame, sessions: DataFrame, before: int, after: int, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Mean, std and quartiles of the active share by relative frame; by: the session, or any group of them."""
    return event_activity(activity, events, sessions, before, after).groupBy(*by, "rel").agg(*spread("pct"))


def psth_by_group(activity: DataFrame, events: DataFrame, sessions: DataFrame, before: int, after: int, group: str = "age", pooled: bool = True) -> DataFrame:
    """Profiles of groups: all events pooled, or the mean of the sessions' means."""
    d = event_activity(activity, events, sessions, before, after)
    if pooled:
        return d.groupBy(group, "rel").agg(*spread("pct"))
    return d.groupBy(group, "session_id", "rel").agg(F.avg("pct").alias("m")).groupBy(group, "rel").agg(*spread("m"))


def psth_values(traces: DataFrame, events: DataFrame, sessions: DataFrame, before: int, after: int) -> DataFrame:
    """The same on trace values."""
    d = _windows(events, sessions, before, after).join(traces, ["session_id", "frame"])
    return d.groupBy("session_id", "rel").agg(*spread("value"))


def psth_duration(transients: DataFrame, events: DataFrame, sessions: DataFrame, before: int, after: int) -> DataFrame:
    """Mean duration (ms) of the transients active at each relative frame, by event and then over events."""
    ms = (F.col("last") - F.col("first") + 1) * 1000
    f = transients.withColumn("frame", F.explode(F.sequence("first", "last"))).join(sessions.select("session_id", "rate_hz"), "session_id").select("session_id", "frame", (ms / F.col("rate_hz")).alias("ms"))
    sums = f.groupBy("session_id", "frame").agg(F.sum("ms").alias("s"), F.count("ms").alias("n"))
    d = _windows(events, sessions, before, after).join(sums, ["session_id", "frame"], "left").withColumn("ms", F.coalesce(ratio("s", "n"), F.lit(0.0)))
    return d.groupBy("session_id", "rel").agg(F.avg("ms").alias("mean_ms"), F.stddev_pop("ms").alias("std_ms"))


def signal_average(signal: DataFrame, marks: DataFrame, before: int, after: int) -> DataFrame:
    """Mean and std of a sampled signal around sample marks (session_id, i)."""
    wide = marks.select("session_id", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("rel"), "i").select("session_id", "rel", (F.col("i") + F.col("rel")).alias("i"))
    return wide.join(signal, ["session_id", "i"]).groupBy("session_id", "rel").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def trace_windows(traces: DataFrame, events: DataFrame, sessions: DataFrame, before: int, after: int) -> DataFrame:
    """Each cell's values around each event, as an array in frame order."""
    d = _windows(events, sessions, before, after).join(traces, ["session_id", "frame"])
    return d.groupBy("session_id", "event_id", "cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("rel", "value"))), lambda x: x["value"]).alias("values"))


def nearest_spikes(spikes: DataFrame, events: DataFrame, reach: int = 50) -> DataFrame:
    """Lags of the last spike before and the first after each event's peak, inside ``reach`` and between the neighbouring events, by cell."""
    w = over("session_id", "peak")
    e = events.select("session_id", "event_id", "peak", F.coalesce(F.lag("peak").over(w), F.lit(-1)).alias("prev"), F.lead("peak").over(w).alias("next"))
    wide = e.withColumn("frame", F.explode(F.sequence(F.col("peak") - reach, F.col("peak") + reach))).filter("frame > prev AND (next IS NULL OR frame < next)")
    d = wide.join(spikes, ["session_id", "frame"]).withColumn("lag", F.col("frame") - F.col("peak"))
    return d.groupBy("session_id", "event_id", "cell").agg(F.max(F.when(F.col("lag") < 0, F.col("lag"))).alias("before"), F.min(F.when(F.col("lag") >= 0, F.col("lag"))).alias("after"))


def cell_lag_response(onsets: DataFrame, events: DataFrame, sessions: DataFrame, reach: int) -> DataFrame:
    """By cell: onsets in the window, percent of events with one, percent of its onsets that lie in a window."""
    d = _windows(events, sessions, reach, reach).join(onsets, ["session_id", "frame"])
    hit = d.groupBy(*CELL).agg(F.count("rel").alias("n_lags"), F.count_distinct("event_id").alias("events_hit"), F.count_distinct("frame").alias("frames_in"))
    total = onsets.groupBy(*CELL).agg(F.count("frame").alias("spikes"))
    n = events.groupBy("session_id").agg(F.count("event_id").alias("n_events"))
    j = total.join(hit, list(CELL), "left").join(n, "session_id")
    z = lambda c: F.coalesce(c, F.lit(0))
    return j.select(*CELL, z("n_lags").alias("n_lags"), (100 * z("events_hit") / F.col("n_events")).alias("pct_events"), (100 * z("frames_in") / F.col("spikes")).alias("pct_spikes"))


def lag_counts(onsets: DataFrame, events: DataFrame, sessions: DataFrame, reach: int) -> DataFrame:
    return _windows(events, sessions, reach, reach).join(onsets, ["session_id", "frame"]).groupBy(*CELL, "rel").agg(F.count("frame").alias("n"))


def binned_response(activity: DataFrame, sessions: DataFrame, bin_frames: int, cycle: int) -> DataFrame:
    """Counts of each cell by bin of its place in a repeated stimulus cycle, 0 where none, z-scored by cell."""
    bins = F.explode(F.sequence(F.lit(0), F.lit(cycle // bin_frames - 1)))
    spine = cells_of(sessions).select(*CELL, bins.alias("bin"))
    n = activity.groupBy(*CELL, F.floor(F.pmod("frame", F.lit(cycle)) / bin_frames).cast("int").alias("bin")).agg(F.count("frame").alias("n"))
    return zscore(spine.join(n, [*CELL, "bin"], "left").select(*CELL, "bin", F.coalesce("n", F.lit(0)).cast("double").alias("value")))


def response_threshold(response: DataFrame, n: int, pct: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile of each cell's response rolled n times by its own shifts."""
    size = F.count("bin").over(over(CELL)).cast("int")
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    d = response.withColumn("_n", size).withColumn("k", k)
    by = F.lit(1) + F.pmod(F.col("cell").cast("long") * 7919 + F.col("k") * 104729 + seed, F.col("_n") - 1)
    rolled = d.withColumn("bin", F.pmod(F.col("bin") + by, F.col("_n")).cast("int"))
    return rolled.groupBy("session_id", "bin", "k").agg(F.avg("value").alias("mean")).groupBy("session_id").agg(F.percentile("mean", F.lit(pct)).alias("threshold"))


def event_peak_frame(activity: DataFrame, events: DataFrame) -> DataFrame:
    """The first frame with the most active cells in each event."""
    f = events.withColumn("frame", F.explode(F.sequence("first", "last"))).join(activity.groupBy("session_id", "frame").agg(F.count("cell").alias("n")), ["session_id", "frame"])
    return f.groupBy("session_id", "event_id").agg(F.max_by("frame", F.struct("n", -F.col("frame"))).alias("peak"))
