"""Aggregations, summaries and scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CELL, cells_of, frames_of, names, over, ratio
from .intervals import interval_overlap_join, periods_to_frames

FRAME = (*CELL, "frame")


# -- activity -----------------------------------------------------------------------------------


def transient_frequency(transients: DataFrame, sessions: DataFrame) -> DataFrame:
    """Transients of each cell, silent ones too, and their number a second."""
    n = transients.groupBy(*CELL).agg(F.count("first").alias("n"))
    all_ = cells_of(sessions).join(n, list(CELL), "left").join(sessions.select("session_id", "age", "n_frames", "rate_hz"), "session_id")
    n = F.coalesce("n", F.lit(0))
    return all_.select(*CELL, "age", n.alias("n"), (n / (F.col("n_frames") / F.col("rate_hz"))).alias("frequency"))


def transient_durations(transients: DataFrame, sessions: DataFrame, minus_one: bool = False) -> DataFrame:
    """Mean and number of rise durations in seconds of each cell; minus_one takes last - first."""
    d = transients.join(sessions.select("session_id", "age", "rate_hz"), "session_id")
    frames = F.col("last") - F.col("first") + (0 if minus_one else 1)
    return d.groupBy(*CELL, "age").agg(F.avg(frames / F.col("rate_hz")).alias("mean_s"), F.count("first").alias("n"))


def transient_amplitude(transients: DataFrame, traces: DataFrame) -> DataFrame:
    """Largest value / mean of the cell in each transient; null where the mean is 0."""
    scaled = traces.withColumn("scaled", ratio(F.col("value"), F.avg("value").over(over(CELL))))
    return periods_to_frames(transients).join(scaled, list(FRAME)).groupBy(*CELL, "transient_id", "first", "last").agg(F.max("scaled").alias("amplitude"))


def duration_per_amplitude(transients: DataFrame, traces: DataFrame, sessions: DataFrame) -> DataFrame:
    d = transient_amplitude(transients, traces).join(sessions.select("session_id", "rate_hz"), "session_id")
    return d.select(*CELL, "transient_id", ratio((F.col("last") - F.col("first")) / F.col("rate_hz"), F.col("amplitude")).alias("duration_per_amplitude"))


def population_activity(activity: DataFrame, sessions: DataFrame) -> DataFrame:
    """Active cells at every frame, also 0, and their share in percent."""
    n = activity.groupBy("session_id", "frame").agg(F.count("cell").alias("n"))
    d = frames_of(sessions).join(n, ["session_id", "frame"], "left").join(sessions.select("session_id", "n_cells"), "session_id")
    n = F.coalesce("n", F.lit(0))
    return d.select("session_id", "frame", n.alias("n"), (100 * n / F.col("n_cells")).alias("percent"))


def activity_variance(population: DataFrame) -> DataFrame:
    return population.groupBy("session_id").agg(F.var_pop("percent").alias("variance"))


def spike_rate(onsets: DataFrame, sessions: DataFrame) -> DataFrame:
    d = onsets.groupBy(*CELL).agg(F.count("frame").alias("n")).join(sessions.select("session_id", "n_frames"), "session_id")
    return d.select(*CELL, (F.col("n") / F.col("n_frames")).alias("rate"))


def isi(onsets: DataFrame) -> DataFrame:
    """Frames between successive onsets of a cell."""
    gap = F.col("frame") - F.lag("frame").over(over(CELL, "frame"))
    return onsets.select(*CELL, "frame", gap.alias("isi")).filter("isi IS NOT NULL")


def event_participation(transients: DataFrame, events: DataFrame) -> DataFrame:
    """By cell: events met / all events, and transients in events / all transients, in percent, 100 at most."""
    met = interval_overlap_join(transients, events, ("session_id",))
    hit = met.groupBy(*CELL).agg(F.count_distinct("event_id").alias("events_hit"), F.count_distinct("transient_id").alias("spikes_in"))
    total = transients.groupBy(*CELL).agg(F.count("first").alias("spikes"))
    n = events.groupBy("session_id").agg(F.count("first").alias("n_events"))
    d = total.join(hit, list(CELL), "left").join(n, "session_id")
    share = lambda a, b: F.least(F.lit(100.0), 100 * F.coalesce(a, F.lit(0)) / F.col(b))
    return d.select(*CELL, share("events_hit", "n_events").alias("pct_events"), share("spikes_in", "spikes").alias("pct_spikes"))


def share_in_movement(transients: DataFrame, movement: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Percent of transients with a frame in movement (widen it with dilate first)."""
    hit = interval_overlap_join(transients, movement, ("session_id",), how="semi").groupBy(*names(by)).agg(F.count("first").alias("hit"))
    return transients.groupBy(*names(by)).agg(F.count("first").alias("n")).join(hit, names(by), "left").select(*names(by), "n", (100 * F.coalesce("hit", F.lit(0)) / F.col("n")).alias("pct_in_movement"))


def movement_share(movement: DataFrame, sessions: DataFrame) -> DataFrame:
    """Percent of frames of each label, of all movement and of stillness."""
    f = periods_to_frames(movement).select("session_id", "label", "frame").distinct()
    each = f.groupBy("session_id", "label").agg(F.count("frame").alias("n"))
    moving = f.select("session_id", "frame").distinct().groupBy("session_id").agg(F.count("frame").alias("n"))
    d = each.unionByName(moving.withColumn("label", F.lit("all"))).join(sessions.select("session_id", "n_frames"), "session_id")
    rest = sessions.select("session_id", "n_frames").join(moving, "session_id", "left").select("session_id", F.lit("still").alias("label"), (F.col("n_frames") - F.coalesce("n", F.lit(0))).alias("n"), "n_frames")
    return d.select("session_id", "label", "n", "n_frames").unionByName(rest).select("session_id", "label", (100 * F.col("n") / F.col("n_frames")).alias("pct"))


def movement_activity(activity: DataFrame, movement: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct active cells of each period / cells / seconds."""
    met = periods_to_frames(movement).join(activity, ["session_id", "frame"], "left").groupBy("session_id", "label", "first", "last").agg(F.count_distinct("cell").alias("n"))
    d = met.join(sessions.select("session_id", "n_cells", "rate_hz"), "session_id")
    return d.select("session_id", "label", "first", "last", "n", (F.col("n") / F.col("n_cells") / ((F.col("last") - F.col("first") + 1) / F.col("rate_hz"))).alias("activity"))


def before_after_ratio(activity: DataFrame, events: DataFrame, around: int) -> DataFrame:
    """Activity after the event / before and after, in percent; null without any."""
    wide = events.select("session_id", "event_id", F.col("first").alias("at"), F.explode(F.sequence(F.col("first") - around, F.col("first") + around)).alias("frame")).filter("frame <> at")
    n = wide.join(activity, ["session_id", "frame"], "left").groupBy("session_id", "event_id")
    c = lambda side: F.sum(F.when(side & F.col("cell").isNotNull(), 1).otherwise(0))
    d = n.agg(c(F.col("frame") < F.col("at")).alias("before"), c(F.col("frame") > F.col("at")).alias("after"))
    return d.withColumn("ratio", ratio(100 * F.col("after"), F.col("before") + F.col("after")))


def event_stats(activity: DataFrame, events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Duration, largest and mean share of cells a frame, and share of cells over the event."""
    f = periods_to_frames(events).join(activity, ["session_id", "frame"], "left")
    n = f.groupBy("session_id", "event_id", "first", "last", "frame").agg(F.count("cell").alias("n"))
    frames = n.groupBy("session_id", "event_id", "first", "last").agg(F.max("n").alias("most"), F.avg("n").alias("mean"))
    all_ = f.groupBy("session_id", "event_id").agg(F.count_distinct("cell").alias("members"))
    d = frames.join(all_, ["session_id", "event_id"]).join(sessions.select("session_id", "n_cells", "rate_hz"), "session_id")
    pct = lambda c: 100 * F.col(c) / F.col("n_cells")
    return d.select("session_id", "event_id", ((F.col("last") - F.col("first") + 1) / F.col("rate_hz")).alias("duration_s"), pct("most").alias("max_pct"), pct("mean").alias("mean_pct"), pct("members").alias("overall_pct"))


def group_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    d = df.groupBy(*names(by)).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), p.alias("_p"), F.count(value).alias("n"))
    return d.select(*names(by), "mean", "std", *[F.col("_p")[k].alias(x) for k, x in enumerate(("p5", "p25", "median", "p75", "p95"))], "n")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = (), log: bool = False) -> DataFrame:
    """Count, percent and density of equal bins (of the logarithm, if asked); values outside are left out, the upper end belongs to the last bin."""
    by = names(by)
    x = F.log10(value) if log else F.col(value)
    bin_ = F.least(F.floor((x - low) * bins / (high - low)), F.lit(bins - 1)).cast("int")
    n = df.filter((x >= low) & (x <= high)).groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(over(by))
    return n.withColumn("pct", 100 * F.col("n") / total).withColumn("density", F.col("n") / total / ((high - low) / bins))


# -- detection scores ------------------------------------------------------------------------------

_RATIOS = {
    "sensitivity": ("tp", "tp + fn"), "specificity": ("tn", "tn + fp"), "accuracy": ("tp + tn", "tp + tn + fp + fn"), "ppv": ("tp", "tp + fp"), "npv": ("tn", "tn + fn"),
    "fnr": ("fn", "fn + tp"), "fpr": ("fp", "fp + tn"), "fdr": ("fp", "fp + tp"), "for": ("fn", "fn + tn"),
}


def with_ratios(df: DataFrame, default: float | None = 1.0) -> DataFrame:
    """Ratios of tp, fp, fn, tn; the default where a denominator is 0."""
    out = df.select("*", *[ratio(F.expr(a), F.expr(b), default).alias(k) for k, (a, b) in _RATIOS.items()])
    return out.withColumn("lr_plus", ratio("sensitivity", "fpr", default)).withColumn("lr_minus", ratio("fnr", "specificity", default))


def confusion_frames(truth: DataFrame, predicted: DataFrame, sessions: DataFrame, default: float | None = 1.0) -> DataFrame:
    """Frame counts by cell and method; a method without a prediction for a cell has no row."""
    methods = predicted.select(*CELL, "method").distinct()
    t = methods.join(truth.select(*FRAME).distinct(), list(CELL)).withColumn("_t", F.lit(1))
    p = predicted.select(*FRAME, "method").distinct().withColumn("_p", F.lit(1))
    both = t.join(p, [*FRAME, "method"], "full")
    c = lambda x: F.sum(F.when(x, 1).otherwise(0)).cast("long")
    n = both.groupBy(*CELL, "method").agg(c(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("tp"), c(F.col("_t").isNull()).alias("fp"), c(F.col("_p").isNull()).alias("fn"))
    d = n.join(sessions.select("session_id", "n_frames"), "session_id")
    return with_ratios(d.withColumn("tn", F.col("n_frames").cast("long") - F.col("tp") - F.col("fp") - F.col("fn")).drop("n_frames"), default)


def confusion_transients(truth_runs: DataFrame, false_runs: DataFrame, predicted: DataFrame, default: float | None = 1.0) -> DataFrame:
    """Runs found and missed by cell and method: tp, fn of true runs, fp, tn of false ones."""
    methods = predicted.select(*CELL, "method").distinct()
    runs_ = truth_runs.select(*CELL, "first", "last", F.lit(True).alias("real")).unionByName(false_runs.select(*CELL, "first", "last", F.lit(False).alias("real"))).join(methods, list(CELL))
    hit = periods_to_frames(runs_).join(predicted.select(*FRAME, "method").distinct().withColumn("_p", F.lit(1)), [*FRAME, "method"], "left").groupBy(*CELL, "method", "first", "last", "real").agg(F.max(F.coalesce("_p", F.lit(0))).alias("hit"))
    c = lambda real, hit_: F.sum(F.when((F.col("real") == real) & (F.col("hit") == hit_), 1).otherwise(0)).cast("long")
    n = hit.groupBy(*CELL, "method").agg(c(True, 1).alias("tp"), c(False, 1).alias("fp"), c(True, 0).alias("fn"), c(False, 0).alias("tn"))
    return with_ratios(n, default)


def confusion_onsets(truth: DataFrame, predicted: DataFrame, sessions: DataFrame) -> DataFrame:
    """Frame scores on onsets; ratios without a denominator are null."""
    return confusion_frames(truth, predicted, sessions, None)


def coverage_of_found(truth_runs: DataFrame, predicted: DataFrame) -> DataFrame:
    """Percent of predicted frames in each true run that has one."""
    f = periods_to_frames(truth_runs.select(*CELL, "first", "last")).join(predicted.select(*FRAME, "method").distinct(), list(FRAME))
    return f.groupBy(*CELL, "method", "first", "last").agg(F.count("frame").alias("n")).select(*CELL, "method", "first", "last", (100 * F.col("n") / (F.col("last") - F.col("first") + 1)).alias("coverage"))


def prediction_by_outcome(truth: DataFrame, predictions: DataFrame, threshold: float) -> DataFrame:
    """Number and mean of prediction values by outcome of their frames, for each method."""
    t = truth.select(*FRAME).distinct().withColumn("_t", F.lit(True))
    d = predictions.join(t, list(FRAME), "left").withColumn("_t", F.coalesce("_t", F.lit(False)))
    hit = F.col("p") >= threshold
    outcome = F.when(hit & F.col("_t"), "TP").when(hit, "FP").when(F.col("_t"), "FN").otherwise("TN")
    return d.groupBy("method", outcome.alias("outcome")).agg(F.count("p").alias("n"), F.avg("p").alias("mean_p"), F.max("p").alias("max_p"))


def threshold_sweep(truth: DataFrame, predictions: DataFrame, sessions: DataFrame, thresholds: Sequence[float] = tuple(round(0.05 * k, 2) for k in range(21))) -> DataFrame:
    """Mean sensitivity, ppv and false positive rate over cells for each method and threshold.

    A cell counts at a threshold while it has a prediction there.
    """
    ordered = sorted(float(x) for x in thresholds)
    steps = F.array(*[F.lit(x) for x in ordered])
    # predictions are counted by the highest threshold that they reach; only these numbers are copied to those below
    reached = predictions.withColumn("_l", F.size(F.filter(steps, lambda x: x <= F.col("p")))).filter("_l > 0")
    t = truth.select(*FRAME).distinct().withColumn("_t", F.lit(1))
    by_level = reached.join(t, list(FRAME), "left").groupBy(*CELL, "method", "_l").agg(F.count("_t").alias("tp"), F.count("p").alias("positive"))
    n = by_level.withColumn("threshold", F.explode(F.slice(steps, F.lit(1), F.col("_l")))).groupBy(*CELL, "method", "threshold").agg(F.sum("tp").alias("tp"), F.sum("positive").alias("positive"))
    real = truth.select(*FRAME).distinct().groupBy(*CELL).agg(F.count("frame").alias("true"))
    d = n.join(real, list(CELL), "left").join(sessions.select("session_id", "n_frames"), "session_id").withColumn("true", F.coalesce("true", F.lit(0)))
    fp = F.col("positive") - F.col("tp")
    d = d.select("method", "threshold", ratio("tp", "true", 1.0).alias("sensitivity"), ratio("tp", "positive", 1.0).alias("ppv"), ratio(fp, F.col("n_frames") - F.col("true"), 1.0).alias("fpr"))
    return d.groupBy("method", "threshold").agg(F.avg("sensitivity").alias("sensitivity"), F.avg("ppv").alias("ppv"), F.avg("fpr").alias("fpr"), F.count("ppv").alias("n"))


def f1(scores: DataFrame) -> DataFrame:
    return scores.withColumn("f1", ratio(2 * F.col("ppv") * F.col("sensitivity"), F.col("ppv") + F.col("sensitivity")))


def pool_benchmarks(*scores: DataFrame) -> DataFrame:
    """Sessions' scores as one benchmark; cells stay apart by their session."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scores)


def interval_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """By label: true intervals met and missed, predicted ones without a true one (those after the last true end left out)."""
    end = truth.groupBy("session_id", "label").agg(F.max("last").alias("_end"))
    p = predicted.join(end, ["session_id", "label"]).filter(F.col("first") <= F.col("_end")).drop("_end")
    key = ("session_id", "label")
    tp = interval_overlap_join(truth, p, key, how="semi").groupBy("label").agg(F.count("first").alias("tp"))
    fp = interval_overlap_join(p, truth, key, how="anti").groupBy("label").agg(F.count("first").alias("fp"))
    n = truth.groupBy("label").agg(F.count("first").alias("n"))
    d = n.join(tp, "label", "left").join(fp, "label", "left").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "tp", "fp")])
    return d.select("label", "tp", (F.col("n") - F.col("tp")).alias("fn"), "fp", ratio("tp", "n").alias("sensitivity"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("ppv"))


def class_scores(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Precision and recall of each class."""
    c = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = lambda x: F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias(x)
    real = c.groupBy(F.col("t").alias("class")).agg(F.sum("n").alias("n_true"), hit("hit"))
    said = c.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("n_predicted"))
    d = real.join(said, "class", "full").select("class", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_true", "n_predicted", "hit")])
    return d.select("class", "n_true", "n_predicted", ratio("hit", "n_predicted").alias("precision"), ratio("hit", "n_true").alias("recall"))


# -- sequences, graphs, assemblies --------------------------------------------------------------------


def sequence_table(sequences: DataFrame, sessions: DataFrame, age_groups: DataFrame) -> DataFrame:
    """Sequences by age group (low to high) x cells x repetitions."""
    d = sequences.join(sessions.select("session_id", "age"), "session_id").join(F.broadcast(age_groups), F.col("age").between(F.col("low"), F.col("high")))  # a table of age groups has a few rows
    return d.groupBy("age_group", "n_cells", "repetitions").agg(F.count(F.lit(1)).alias("n"))


def connectivity_share(edges: DataFrame, n_nodes: DataFrame) -> DataFrame:
    """Out- and in-degree of each node as percent of the session's nodes; n_nodes: (session_id, n)."""
    out = edges.groupBy("session_id", F.col("src").alias("node")).agg(F.count("dst").alias("d")).withColumn("side", F.lit("out"))
    in_ = edges.groupBy("session_id", F.col("dst").alias("node")).agg(F.count("src").alias("d")).withColumn("side", F.lit("in"))
    return out.unionByName(in_).join(n_nodes, "session_id").select("session_id", "node", "side", (100 * F.col("d") / F.col("n")).alias("pct"))


def network_density(edges: DataFrame, n_nodes: DataFrame) -> DataFrame:
    return edges.groupBy("session_id").agg(F.count("src").alias("e")).join(n_nodes, "session_id").select("session_id", ratio(100 * F.col("e"), F.col("n") * (F.col("n") - 1)).alias("density"))


def assembly_by_state(assembly_events: DataFrame, movement: DataFrame) -> DataFrame:
    """Percent of each assembly's events (session_id, assembly, first, last) in each movement label, in any, and in none."""
    key = ["session_id", "assembly"]
    n = assembly_events.groupBy(*key).agg(F.count("first").alias("n"))
    met = interval_overlap_join(assembly_events, movement, ("session_id",)).select(*key, "first", "last", "label").distinct()
    each = met.groupBy(*key, "label").agg(F.count("first").alias("k"))
    any_ = met.select(*key, "first", "last").distinct().groupBy(*key).agg(F.count("first").alias("k"))
    none = n.join(any_, key, "left").select(*key, F.lit("still").alias("label"), (F.col("n") - F.coalesce("k", F.lit(0))).alias("k"))
    return each.unionByName(any_.withColumn("label", F.lit("all"))).unionByName(none).join(n, key).select(*key, "label", (100 * F.col("k") / F.col("n")).alias("pct"))




# -- top k and sets ---------------------------------------------------------------------------------


def top_k_by(df: DataFrame, part: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first k rows of each part in an order."""
    return df.withColumn("_r", F.row_number().over(over(part, *order))).filter(F.col("_r") <= k).drop("_r")


def set_ops(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """Union, intersection and difference of two tables as sets."""
    return {"union": a.unionByName(b).distinct(), "intersection": a.intersect(b), "difference": a.distinct().exceptAll(b.distinct())}
