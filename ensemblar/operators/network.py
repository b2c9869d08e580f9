"""Pairwise similarity, networks and space."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import CELL, dealt, grown, names, over, ratio
from ..functions.shared import checkpointed
from .intervals import coactive_runs, interval_overlap_join, pair_self_join


def _pair_counts(activity: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """All pairs key < key2 of a session with their own and common counts; sparse rows meet by equal frames."""
    n = activity.groupBy("session_id", key).agg(F.count(F.lit(1)).alias("n"))
    pairs = n.join(n.select("session_id", F.col(key).alias(f"{key}2"), F.col("n").alias("n2")), "session_id").filter(F.col(key) < F.col(f"{key}2"))
    both = pair_self_join(activity, key, ["session_id", *names(by)]).groupBy("session_id", key, f"{key}2").agg(F.count(F.lit(1)).alias("both"))
    return pairs.join(both, ["session_id", key, f"{key}2"], "left").withColumn("both", F.coalesce("both", F.lit(0)))


def pairwise_pearson(activity: DataFrame, sessions: DataFrame) -> DataFrame:
    """Correlation of each pair of active cells, in closed form from counts; null for a constant cell."""
    d = _pair_counts(activity, "cell", ["frame"]).join(sessions.select("session_id", F.col("n_frames").alias("m")), "session_id")
    top = F.col("m") * F.col("both") - F.col("n") * F.col("n2")
    low = F.sqrt((F.col("m") * F.col("n") - F.col("n") * F.col("n")).cast("double") * (F.col("m") * F.col("n2") - F.col("n2") * F.col("n2")))
    return d.select("session_id", "cell", "cell2", ratio(top, low).alias("r"))


def pairwise_hamming(activity: DataFrame, sessions: DataFrame) -> DataFrame:
    d = _pair_counts(activity, "cell", ["frame"]).join(sessions.select("session_id", "n_frames"), "session_id")
    return d.select("session_id", "cell", "cell2", ((F.col("n") + F.col("n2") - 2 * F.col("both")) / F.col("n_frames")).alias("distance"))


def wasserstein(marks: DataFrame, key: Sequence[str]) -> DataFrame:
    """Earth mover distance of two weighted point sets by key; marks: key, side (0, 1), x, w."""
    key = names(key)
    total = F.sum("w").over(over([*key, "side"]))
    d = marks.withColumn("_s", F.col("w") / total * F.when(F.col("side") == 0, 1).otherwise(-1)).groupBy(*key, "x").agg(F.sum("_s").alias("_s"))
    w = over(key, "x")
    gap = F.abs(F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0))) * (F.lead("x").over(w) - F.col("x"))
    return d.withColumn("_g", gap).groupBy(*key).agg(F.coalesce(F.sum("_g"), F.lit(0.0)).alias("distance"))


#: Cells of a tile of pairs, and of numbers that a task holds at once.
TILE, _NUMBERS = 64, 1 << 22


def _distances(p: pd.DataFrame) -> pd.DataFrame:
    """Earth mover distances of all pairs of cells of two tiles, from their distribution functions at all marks."""
    p = p.sort_values("cell")
    marks = np.unique(np.concatenate(p["frames"].to_numpy())).astype(np.int64)
    gaps = np.diff(marks).astype(float)
    level = np.stack([np.searchsorted(f, marks[:-1], "right") / len(f) for f in p["frames"]])
    side, cell = p["side"].to_numpy(), p["cell"].to_numpy()
    first = np.flatnonzero(side == p["a"].iloc[0])
    out = []
    for i in first:
        other = np.flatnonzero((side == p["b"].iloc[0]) & (cell > cell[i])) if p["a"].iloc[0] == p["b"].iloc[0] else np.flatnonzero(side == p["b"].iloc[0])
        for k in range(0, len(other), max(1, _NUMBERS // max(1, len(gaps)))):
            o = other[k : k + max(1, _NUMBERS // max(1, len(gaps)))]
            d = np.abs(level[o] - level[i]) @ gaps
            low, high = np.minimum(cell[i], cell[o]), np.maximum(cell[i], cell[o])
            out.append(pd.DataFrame({"session_id": p["session_id"].iloc[0], "cell": low, "cell2": high, "distance": d}))
    return pd.concat(out) if out else pd.DataFrame(columns=["session_id", "cell", "cell2", "distance"])


def pairwise_wasserstein(activity: DataFrame) -> DataFrame:
    """Earth mover distance over time of each pair of cells' normalised activity.

    A cell is one row with its sorted frames; tiles of 64 cells meet tile by tile, so a row is copied once for each
    tile of its session, not for each partner.
    """
    cells = activity.groupBy(*CELL).agg(F.sort_array(F.collect_list("frame")).alias("frames"))
    ranked = cells.withColumn("side", F.floor((F.row_number().over(over("session_id", "cell")) - 1) / TILE).cast("int"))
    last = cells.groupBy("session_id").agg(F.floor((F.count("cell") - 1) / TILE).cast("int").alias("_t"))
    dealt = ranked.join(last, "session_id").withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_t"))))
    dealt = dealt.select(*CELL, "frames", "side", F.least("side", "_o").alias("a"), F.greatest("side", "_o").alias("b"))
    return dealt.groupBy("session_id", "a", "b").applyInPandas(_distances, "session_id string, cell int, cell2 int, distance double")


def _event_pairs(event_cells: DataFrame) -> DataFrame:
    """All pairs event_id < event_id2 of a session with their own and common numbers of cells.

    An event is one row with its cells, so a pair is counted where it is made and nothing is moved for it.
    """
    cells = event_cells.groupBy("session_id", "event_id").agg(F.collect_list("cell").alias("_c"), F.count(F.lit(1)).alias("n"))
    other = cells.select("session_id", F.col("event_id").alias("event_id2"), F.col("_c").alias("_c2"), F.col("n").alias("n2"))
    both = F.size(F.array_intersect("_c", "_c2")).cast("long")
    return dealt(cells, "session_id").join(dealt(other, "session_id").hint("merge"), "session_id").filter("event_id < event_id2").withColumn("both", both).drop("_c", "_c2")


def event_jaccard(event_cells: DataFrame) -> DataFrame:
    d = _event_pairs(event_cells)
    return d.select("session_id", "event_id", "event_id2", (100 * F.col("both") / (F.col("n") + F.col("n2") - F.col("both"))).alias("jaccard_pct"))


def event_covariance(event_cells: DataFrame, n_cells: DataFrame, centred: bool = True) -> DataFrame:
    """Normalised covariance of event vectors over cells; 0 where no cell is common.  n_cells: (session_id, m)."""
    d = _event_pairs(event_cells).join(n_cells, "session_id")
    if centred:
        top = F.col("m") * F.col("both") - F.col("n") * F.col("n2")
        low = F.sqrt((F.col("n") * (F.col("m") - F.col("n"))).cast("double") * (F.col("n2") * (F.col("m") - F.col("n2"))))
    else:
        top, low = F.col("both"), F.sqrt(F.col("n").cast("double") * F.col("n2"))
    return d.select("session_id", "event_id", "event_id2", F.when(F.col("both") == 0, 0.0).otherwise(F.coalesce(ratio(top, low), F.lit(0.0))).alias("covariance"))


def common_core_course(event_cells: DataFrame, events: DataFrame) -> DataFrame:
    """From each event on: size of the running intersection of members and the delay so far, until it is empty.

    A cell is in the intersection after ``step`` further events while it was in each of them.
    """
    order = events.select("session_id", "event_id", F.col("first").alias("at"), F.row_number().over(over("session_id", "first")).alias("rank"))
    e = event_cells.join(order, ["session_id", "event_id"]).select("session_id", "cell", "rank")
    # a cell's stretch of successive events: from each place in it the rest of the stretch counts
    island = e.withColumn("_g", F.col("rank") - F.row_number().over(over(CELL, "rank")))
    ends = island.withColumn("_end", F.max("rank").over(over([*CELL, "_g"]))).groupBy("session_id", "rank", "_end").agg(F.count("cell").alias("_n"))
    # as many cells last to an end as have it or a later one; an end stands for all since the one before
    w = over(["session_id", "rank"], F.desc("_end"))
    last = ends.withColumn("n", F.sum("_n").over(w)).withColumn("_since", F.coalesce(F.lead("_end").over(w) + 1, F.col("rank")))
    n = last.select("session_id", "rank", "n", F.explode(F.sequence("_since", "_end")).alias("_r2"))
    a = order.select("session_id", "rank", "event_id", F.col("at").alias("_a"))
    b = order.select("session_id", F.col("rank").alias("_r2"), F.col("at").alias("_b"))
    d = n.join(a, ["session_id", "rank"]).join(b, ["session_id", "_r2"])
    return d.select("session_id", "event_id", (F.col("_r2") - F.col("rank")).alias("step"), "n", (F.col("_b") - F.col("_a")).alias("delay"))


def event_delays(events: DataFrame) -> DataFrame:
    """Delay and number of steps between all pairs of a session's events."""
    e = events.select("session_id", "event_id", "first", F.row_number().over(over("session_id", "first")).alias("rank"))
    o = e.select("session_id", F.col("event_id").alias("event_id2"), F.col("first").alias("_f"), F.col("rank").alias("_r"))
    return e.join(o, "session_id").filter("rank < _r").select("session_id", "event_id", "event_id2", (F.col("_f") - F.col("first")).alias("delay"), (F.col("_r") - F.col("rank")).alias("steps"))


def template_similarity(event_cells: DataFrame, activity: DataFrame, sessions: DataFrame, window: int) -> DataFrame:
    """Share of an event's cells that are active in each window of frames; windows without any are left out."""
    starts = activity.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("frame") - window + 1), F.col("frame")))).join(sessions.select("session_id", "n_frames"), "session_id").filter(F.col("start") + window <= F.col("n_frames"))
    seen = starts.select("session_id", "cell", "start").distinct()
    size = event_cells.groupBy("session_id", "event_id").agg(F.count("cell").alias("size"))
    n = event_cells.join(seen, list(CELL)).groupBy("session_id", "event_id", "start").agg(F.count("cell").alias("n"))
    return n.join(size, ["session_id", "event_id"]).select("session_id", "event_id", "start", (F.col("n") / F.col("size")).alias("share"))


def _histogram_distance(a: Column, b: Column) -> Column:
    """Earth mover distance of two histograms, arrays of (x, share)."""
    side = lambda h, sign: F.transform(h, lambda m: F.struct(m["x"].alias("x"), (m["s"] * sign).alias("s")))
    marks = F.array_sort(F.concat(side(a, 1.0), side(b, -1.0)))
    start = F.struct(F.lit(None).cast("int").alias("x"), F.lit(0.0).alias("c"), F.lit(0.0).alias("d"))

    def step(z: Column, m: Column) -> Column:
        gone = F.coalesce(F.abs(z["c"]) * (m["x"] - z["x"]), F.lit(0.0))
        return F.struct(m["x"].alias("x"), (z["c"] + m["s"]).alias("c"), (z["d"] + gone).alias("d"))

    return F.aggregate(marks, start, step, lambda z: z["d"])


def epoch_lag_distance(activity: DataFrame, length: int, default: float | None = None) -> DataFrame:
    """Distance of epochs: earth mover distance between the two lag histograms of each cell pair, mean over pairs.

    Pairs without lags in one of the epochs are left out; null (or the default) where none is left.  A histogram is one
    row with an array of at most 2 x length - 1 lags; rows of a pair of cells meet, not lags.
    """
    e = activity.withColumn("epoch", F.floor(F.col("frame") / length).cast("int"))
    key = ["session_id", "cell", "cell2"]
    frames = e.groupBy(*CELL, "epoch").agg(F.collect_list("frame").alias("_f"))
    other = frames.select("session_id", "epoch", F.col("cell").alias("cell2"), F.col("_f").alias("_f2"))
    met = dealt(frames, "session_id", "epoch").join(grown(dealt(other, "session_id", "epoch")), ["session_id", "epoch"]).filter("cell < cell2")
    each = met.select(*key, "epoch", "_f2", F.explode("_f").alias("_a")).select(*key, "epoch", F.explode(F.transform("_f2", lambda f: f - F.col("_a"))).alias("x"))
    lags = each.groupBy(*key, "epoch", "x").agg(F.count(F.lit(1)).cast("double").alias("w"))
    own = lags.groupBy(*key, "epoch").agg(F.collect_list(F.struct("x", "w")).alias("_l"), F.sum("w").alias("_w"))
    shares = own.select(*key, "epoch", F.transform("_l", lambda m: F.struct(m["x"].alias("x"), (m["w"] / F.col("_w")).alias("s"))).alias("h"))
    shares = dealt(shares, *key)
    pairs = shares.join(grown(shares.select(*key, F.col("epoch").alias("epoch2"), F.col("h").alias("h2"))), key).filter("epoch < epoch2")
    d = pairs.select("session_id", "epoch", "epoch2", _histogram_distance(F.col("h"), F.col("h2")).alias("distance"))
    d = d.groupBy("session_id", "epoch", "epoch2").agg(F.avg("distance").alias("distance"), F.count("distance").alias("n_pairs"))
    ep = activity.select("session_id", F.floor(F.col("frame") / length).cast("int").alias("epoch")).distinct()
    all_ = ep.join(ep.withColumnRenamed("epoch", "epoch2"), "session_id").filter("epoch < epoch2")
    return all_.join(d, ["session_id", "epoch", "epoch2"], "left").select("session_id", "epoch", "epoch2", F.coalesce("distance", F.lit(default).cast("double")).alias("distance"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))


# -- functional links ---------------------------------------------------------------------------


def lag_samples(onsets: DataFrame, reach: int) -> DataFrame:
    """Lags of every ordered pair of cells within +-reach frames."""
    wide = onsets.select(*CELL, "frame", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("lag")).withColumn("frame", F.col("frame") + F.col("lag"))
    return wide.join(onsets.select("session_id", F.col("cell").alias("cell2"), "frame"), ["session_id", "frame"]).filter("cell <> cell2").select("session_id", "cell", "cell2", "lag")


@F.pandas_udf(T.DoubleType())
def kolmogorov_p(d: pd.Series, n: pd.Series) -> pd.Series:
    """Upper tail of the Kolmogorov distribution (asymptotic series)."""
    root = np.sqrt(n.to_numpy(float))
    x = np.maximum((root + 0.12 + 0.11 / root) * d.to_numpy(float), 1e-3)
    k = np.arange(1, 101)[:, None]
    p = 2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * (k * x) ** 2), axis=0)
    return pd.Series(np.clip(np.where(x < 0.2, 1.0, p), 0, 1))


def omnibus_k2(skew: Column, kurt: Column, n: Column) -> Column:
    """D'Agostino's K2 from the moments of a sample."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    s = y / F.sqrt(2 / (w2 - 1))
    z1 = F.log(s + F.sqrt(s * s + 1)) / F.sqrt(0.5 * F.log(w2))
    e = 3 * (n - 1) / (n + 1)
    v = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurt + 3 - e) / F.sqrt(v)
    b = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b * (2 / b + F.sqrt(1 + 4 / (b * b)))
    t = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(t) * F.pow(F.abs(t), F.lit(1.0 / 3))) / F.sqrt(2 / (9 * a))
    return z1 * z1 + z2 * z2


def functional_links(onsets: DataFrame, reach: int = 15, least: int = 20, alpha: float = 0.05) -> DataFrame:
    """Directed links of cell pairs whose lags are neither normal (K2) nor uniform (KS).

    More lags after than before: an edge from cell to cell2; more before: the other way.
    """
    s = lag_samples(onsets, reach)
    key = ["session_id", "cell", "cell2"]
    m = s.filter("cell < cell2").groupBy(*key).agg(F.count("lag").alias("n"), F.skewness("lag").alias("skew"), F.kurtosis("lag").alias("kurt"), F.sum(F.when(F.col("lag") > 0, 1).when(F.col("lag") < 0, -1).otherwise(0)).alias("side")).filter(F.col("n") >= least)
    normal = F.exp(-omnibus_k2(F.col("skew"), F.col("kurt"), F.col("n").cast("double")) / 2)
    size = 2 * reach + 1
    h = s.filter("cell < cell2").groupBy(*key, "lag").agg(F.count(F.lit(1)).alias("c"))
    w = over(key, "lag")
    cum, total = F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0)), F.sum("c").over(over(key))
    rank = F.col("lag") + reach + 1
    gap = F.greatest(F.abs(cum / total - rank / size), F.abs((cum - F.col("c")) / total - (rank - 1) / size))
    d = h.withColumn("_d", gap).groupBy(*key).agg(F.max("_d").alias("d"))
    # read back as plain numbers before the Arrow function
    j = m.withColumn("p_normal", normal).join(d, key).withColumn("p_uniform", kolmogorov_p("d", F.col("n").cast("double")))
    j = j.filter((F.col("p_normal") < alpha) & (F.col("p_uniform") < alpha) & (F.col("side") != 0))
    forth = F.col("side") > 0
    return j.select("session_id", F.when(forth, F.col("cell")).otherwise(F.col("cell2")).alias("src"), F.when(forth, F.col("cell2")).otherwise(F.col("cell")).alias("dst"), "n", "p_normal", "p_uniform")


#: Sources searched from at once, one bit each; edges of a session that a task holds.
SOURCES, TASK_EDGES = 64, 4 << 20
_CHUNK = 1 << 15


def dependencies(n: int, src: np.ndarray, dst: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Sums over at most 64 sources of the share of their shortest paths that run through each of n nodes.

    A node's bits say which sources have reached it; a level's edges lead from nodes just reached to others, for
    some of the bits.  The same edges, last level first, take the shares back.  Levels go on until none is new.
    """
    order = np.argsort(dst, kind="stable")
    src, dst, k = src[order], dst[order], np.arange(len(sources))
    seen = np.zeros(n, np.uint64)
    seen[sources] = np.uint64(1) << k.astype(np.uint64)
    front, paths, levels = seen.copy(), np.zeros((n, len(k))), []
    paths[sources, k] = 1

    def chunks(edges: np.ndarray, bits: np.ndarray):
        for a in range(0, len(edges), _CHUNK):
            e = edges[a : a + _CHUNK]
            yield e, ((bits[a : a + _CHUNK, None] >> k.astype(np.uint64)) & np.uint64(1)).astype(bool)

    while True:
        bits = front[src] & ~seen[dst]
        edges = np.flatnonzero(bits)
        if not len(edges):
            break
        bits = bits[edges]
        levels.append((edges, bits))
        for e, on in chunks(edges, bits):
            at = np.flatnonzero(np.append(True, np.diff(dst[e]) != 0))
            paths[dst[e][at]] += np.add.reduceat(paths[src[e]] * on, at, axis=0)
        at = np.flatnonzero(np.append(True, np.diff(dst[edges]) != 0))
        front = np.zeros(n, np.uint64)
        front[dst[edges][at]] = np.bitwise_or.reduceat(bits, at)
        seen |= front
    share = np.zeros((n, len(k)))
    for edges, bits in reversed(levels):
        by_src = np.argsort(src[edges], kind="stable")
        for e, on in chunks(edges[by_src], bits[by_src]):
            at = np.flatnonzero(np.append(True, np.diff(src[e]) != 0))
            part = np.where(on, paths[src[e]] / np.maximum(paths[dst[e]], 1) * (1 + share[dst[e]]), 0)
            share[src[e][at]] += np.add.reduceat(part, at, axis=0)
    share[sources, k] = 0
    return share.sum(axis=1)


def _through(edges: pd.DataFrame) -> pd.DataFrame:
    """One session's edges and one batch of its sources."""
    ids, at = np.unique(np.concatenate([edges["src"], edges["dst"]]), return_inverse=True)
    batch = int(edges["batch"].iloc[0])
    sources = np.arange(batch * SOURCES, min((batch + 1) * SOURCES, len(ids)))
    b = dependencies(len(ids), at[: len(edges)], at[len(edges) :], sources)
    return pd.DataFrame({"session_id": edges["session_id"].iloc[0], "node": ids, "b": b})


def _through_by_levels(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """(session_id, node, b): as ``dependencies``, a level of all sources a step, for graphs that no task holds."""
    level = checkpointed(nodes.select("session_id", F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")))
    levels, seen = [level], level.select("session_id", "s", "node")
    while True:
        step = level.join(e.select("session_id", F.col("src").alias("node"), F.col("dst").alias("next")), ["session_id", "node"]).groupBy("session_id", "s", F.col("next").alias("node")).agg(F.sum("paths").alias("paths"))
        level = checkpointed(step.join(seen, ["session_id", "s", "node"], "left_anti").select("session_id", "s", "node", "paths"))
        if level.isEmpty():
            break
        seen = checkpointed(seen.union(level.select("session_id", "s", "node")))
        levels.append(level)
    # a node's dependency: over its successors one level on, paths / their paths x (1 + theirs)
    dep = levels[-1].select("session_id", "s", "node", "paths", F.lit(0.0).alias("delta"))
    all_ = dep
    for level in reversed(levels[:-1]):
        below = dep.select("session_id", "s", F.col("node").alias("dst"), F.col("paths").alias("_p"), F.col("delta").alias("_x"))
        met = level.join(e.select("session_id", F.col("src").alias("node"), "dst"), ["session_id", "node"]).join(below, ["session_id", "s", "dst"])
        sums = met.groupBy("session_id", "s", "node").agg(F.sum(F.col("paths") / F.col("_p") * (1 + F.col("_x"))).alias("delta"))
        dep = checkpointed(level.join(sums, ["session_id", "s", "node"], "left").select("session_id", "s", "node", "paths", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        all_ = all_.unionByName(dep)
    return all_.filter("s <> node").groupBy("session_id", "node").agg(F.sum("delta").alias("b"))


def betweenness(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """Shortest-path betweenness of directed unweighted graphs, normalised by (n-1)(n-2).

    Sources are dealt in batches of 64, which meet a copy of their session's edges in one task and search from all
    64 at once.  A session with more than ``task_edges`` edges goes level by level in joins instead.
    """
    e = checkpointed(edges.select("session_id", "src", "dst").distinct())
    nodes = e.select("session_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    size = e.groupBy("session_id").agg(F.count("src").alias("_e")).join(nodes.groupBy("session_id").agg(F.count("node").alias("m")), "session_id")
    fit = e.join(size.filter(F.col("_e") <= task_edges), "session_id").withColumn("batch", F.explode(F.sequence(F.lit(0), F.expr(f"cast((m - 1) div {SOURCES} as int)"))))
    b = fit.select("session_id", "batch", "src", "dst").groupBy("session_id", "batch").applyInPandas(_through, "session_id string, node long, b double").groupBy("session_id", "node").agg(F.sum("b").alias("b"))
    large = e.join(size.filter(F.col("_e") > task_edges).select("session_id"), "session_id", "left_semi")
    if not large.isEmpty():
        b = b.unionByName(_through_by_levels(large, nodes.join(large.select("session_id").distinct(), "session_id", "left_semi")).select("session_id", F.col("node").cast("long").alias("node"), "b"))
    d = nodes.join(b, ["session_id", "node"], "left").join(size, "session_id")
    return d.select("session_id", "node", F.coalesce(ratio(F.col("b"), (F.col("m") - 1) * (F.col("m") - 2)), F.lit(0.0)).alias("betweenness"))


def hubs(edges: DataFrame, n_nodes: DataFrame, least_pct: float = 5, pct: float = 0.8, pooled: bool = False) -> DataFrame:
    """Nodes with enough targets whose degree and betweenness reach the percentiles of their session, or of all."""
    out = edges.groupBy("session_id", F.col("src").alias("node")).agg(F.count("dst").alias("out_degree"))
    in_ = edges.groupBy("session_id", F.col("dst").alias("node")).agg(F.count("src").alias("in_degree"))
    d = betweenness(edges).join(out, ["session_id", "node"], "left").join(in_, ["session_id", "node"], "left").join(n_nodes, "session_id")
    d = d.withColumn("degree", F.coalesce("out_degree", F.lit(0)) + F.coalesce("in_degree", F.lit(0)))
    by = [] if pooled else ["session_id"]
    lim = d.groupBy(*by).agg(F.percentile("degree", F.lit(pct)).alias("_d"), F.percentile("betweenness", F.lit(pct)).alias("_b"))
    j = d.join(lim, by) if by else d.crossJoin(lim)  # one row of limits
    return j.filter((100 * F.col("out_degree") >= least_pct * F.col("n")) & (F.col("degree") >= F.col("_d")) & (F.col("betweenness") >= F.col("_b"))).select("session_id", "node", "degree", "betweenness")


def lag_coactivity(onsets: DataFrame, events: DataFrame, reach: int) -> DataFrame:
    """Mean lag of each cell against the others near events, and the share of events with it.

    The body is not public; defined here over onsets in the events' windows.
    """
    wide = events.select("session_id", "event_id", F.explode(F.sequence(F.col("first") - reach, F.col("last") + reach)).alias("frame"))
    near = wide.join(onsets, ["session_id", "frame"])
    o = near.select("session_id", "event_id", F.col("cell").alias("cell2"), F.col("frame").alias("_f"))
    lag = near.join(o, ["session_id", "event_id"]).filter("cell <> cell2").groupBy(*CELL).agg(F.avg(F.col("frame") - F.col("_f")).alias("mean_lag"))
    n = events.groupBy("session_id").agg(F.count("event_id").alias("n_events"))
    hit = near.groupBy(*CELL).agg(F.count_distinct("event_id").alias("hit")).join(n, "session_id")
    return hit.join(lag, list(CELL), "left").select(*CELL, "mean_lag", (F.col("hit") / F.col("n_events")).alias("share"))


# -- space ------------------------------------------------------------------------------------------


def grid_counts(cells: DataFrame, activity: DataFrame, size: float) -> DataFrame:
    """Active cells by grid square (gx, gy) and frame."""
    g = cells.select(*CELL, F.floor(F.col("cx") / size).cast("int").alias("gx"), F.floor(F.col("cy") / size).cast("int").alias("gy"))
    return activity.join(g, list(CELL)).groupBy("session_id", "frame", "gx", "gy").agg(F.count("cell").alias("n"))


def dominant_square_path(counts: DataFrame, value: str = "n") -> DataFrame:
    """The square with the highest value at each frame (the first on ties); frames without any are absent."""
    best = F.max_by(F.struct("gx", "gy"), F.struct(value, -F.col("gx"), -F.col("gy")))
    return counts.filter(F.col(value) > 0).groupBy("session_id", "frame").agg(best.alias("b")).select("session_id", "frame", "b.gx", "b.gy")


def transition_edges(path: DataFrame) -> DataFrame:
    """Moves between different squares of successive rows, with their number."""
    w = over("session_id", "frame")
    d = path.select("session_id", "gx", "gy", F.lead("gx").over(w).alias("gx2"), F.lead("gy").over(w).alias("gy2"))
    return d.filter("gx2 IS NOT NULL AND (gx <> gx2 OR gy <> gy2)").groupBy("session_id", "gx", "gy", "gx2", "gy2").agg(F.count(F.lit(1)).alias("weight"))


def pixel_links(pixels: DataFrame, bin_frames: int = 5, reach: int = 3, least: float = 0.4) -> DataFrame:
    """Pairs of pixels closer than ``reach`` whose averaged series correlate."""
    b = pixels.groupBy("session_id", "x", "y", F.floor(F.col("frame") / bin_frames).alias("bin")).agg(F.avg("v").alias("v"))
    offsets = [(dx, dy) for dx in range(-reach + 1, reach) for dy in range(-reach + 1, reach) if (dx, dy) > (0, 0) and dx * dx + dy * dy < reach * reach]
    o = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets]))
    wide = b.withColumn("o", o).select("session_id", "bin", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("v").alias("v1"), (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    met = wide.join(b, ["session_id", "bin", "x", "y"])
    return met.groupBy("session_id", "x1", "y1", F.col("x").alias("x2"), F.col("y").alias("y2")).agg(F.corr("v1", "v").alias("r")).filter(F.col("r") >= least)


def source_profile(pixels: DataFrame, masks: DataFrame, rises: DataFrame) -> DataFrame:
    """Trace-weighted mean image of each cell in its mask; rises: (session_id, cell, frame, w)."""
    at = pixels.join(rises, ["session_id", "frame"]).join(masks, ["session_id", "cell", "x", "y"])
    return at.groupBy("session_id", "cell", "x", "y").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("profile"))


def transient_profile(pixels: DataFrame, masks: DataFrame, rises: DataFrame) -> DataFrame:
    """The same for each transient; rises has transient_id too."""
    at = pixels.join(rises, ["session_id", "frame"]).join(masks, ["session_id", "cell", "x", "y"])
    return at.groupBy("session_id", "cell", "transient_id", "x", "y").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("image"))


def profile_correlation(source: DataFrame, image: DataFrame) -> DataFrame:
    """Pearson of each transient's image with its cell's profile."""
    d = image.join(source, ["session_id", "cell", "x", "y"])
    return d.groupBy("session_id", "cell", "transient_id").agg(F.corr("image", "profile").alias("r"))


def filter_overlap_transients(transients: DataFrame, activity: DataFrame, overlapping: DataFrame, r: DataFrame, low: float = 0.4, high: float = 0.6) -> DataFrame:
    """Transients without those whose own correlation is low while a co-active overlapping cell's is high.

    overlapping: (session_id, cell, cell2); r: (session_id, cell, transient_id, r).
    """
    both = overlapping.unionByName(overlapping.select("session_id", F.col("cell2").alias("cell"), F.col("cell").alias("cell2"))).distinct()
    co = coactive_runs(activity, both)
    own = interval_overlap_join(transients.join(r, [*CELL, "transient_id"]).filter(F.col("r") < low), co, CELL).select(*CELL, "transient_id", "cell2", "b_first", "b_last")
    theirs = transients.join(r, [*CELL, "transient_id"]).filter(F.col("r") > high).select("session_id", F.col("cell").alias("cell2"), "first", "last")
    gone = interval_overlap_join(own.withColumnsRenamed({"b_first": "first", "b_last": "last"}), theirs, ("session_id", "cell2"), how="semi").select(*CELL, "transient_id").distinct()
    return transients.join(gone, [*CELL, "transient_id"], "left_anti")


def mask_overlaps(masks: DataFrame, share: float = 0.15) -> DataFrame:
    """Pairs of cells whose common pixels are more than a share of the larger mask."""
    d = _pair_counts(masks, "cell", ["x", "y"])
    return d.filter(F.col("both") > share * F.greatest("n", "n2")).select("session_id", "cell", "cell2", "both")


def overlap_error_rate(candidates: DataFrame, r: DataFrame, overlaps: DataFrame, predicted: DataFrame, low: float = 0.2, high: float = 0.7) -> DataFrame:
    """By method: share of candidate transients that belong to the other cell (own r low, the other's high) and were kept all the same.

    candidates: (session_id, cell, transient_id, first, last); r has cell2 as well: the correlation
    of the same image with the overlapping cell's profile; predicted: (session_id, cell, frame, method).
    """
    wrong = candidates.join(r.filter((F.col("r") < low) & (F.col("r2") > high)), [*CELL, "transient_id"]).join(overlaps.select("session_id", "cell", "cell2"), ["session_id", "cell", "cell2"])
    w = wrong.select(*CELL, "transient_id", "first", "last").distinct().join(predicted.select("session_id", "method").distinct(), "session_id")
    hit = w.withColumn("frame", F.explode(F.sequence("first", "last"))).join(predicted.withColumn("_p", F.lit(1)), [*CELL, "frame", "method"], "left").groupBy(*CELL, "transient_id", "method").agg(F.max(F.coalesce("_p", F.lit(0))).alias("kept"))
    return hit.groupBy("method").agg(F.count("kept").alias("n"), F.avg("kept").alias("error_rate"))
