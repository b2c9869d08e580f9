"""Clustering of events and reduction of traces.  What is solved in one task is a matrix of one session's cells or events; what fills it is summed by blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CELL, over


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 50) -> np.ndarray:
    """Labels of the rows of a matrix; or of each matrix of a stack, by the same draw."""
    stack = x if x.ndim == 3 else x[None]
    centres = stack[:, rng.choice(stack.shape[1], k, replace=False)]
    label = np.zeros(stack.shape[:2], int)
    left, own = np.arange(len(stack)), stack
    for _ in range(steps):
        # a row's own square is the same for all centres
        new = ((centres**2).sum(axis=2)[:, None] - 2 * (own @ centres.transpose(0, 2, 1))).argmin(axis=2)
        moved = (new != label[left]).any(axis=1)
        if not moved.all():
            left, own, new, centres = left[moved], own[moved], new[moved], centres[moved]
        if not len(left):
            break
        label[left] = new
        member = (new[:, None] == np.arange(k)[:, None]).astype(float)
        size = member.sum(axis=2)[:, :, None]
        centres = np.where(size > 0, (member @ own) / np.maximum(size, 1), centres)
    return label if x.ndim == 3 else label[0]


def silhouettes(x: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
    """For each matrix of a stack the median over clusters of the mean silhouette of their members; distances come from the Gram matrix, in place."""
    square = (x**2).sum(axis=2)
    d = x @ x.transpose(0, 2, 1)
    d *= -2
    d += square[:, :, None]
    d += square[:, None]
    np.sqrt(np.maximum(d, 0, out=d), out=d)
    d[:, np.arange(x.shape[1]), np.arange(x.shape[1])] = 0
    member = (label[:, :, None] == np.arange(k)).astype(float)
    size = member.sum(axis=1)
    mean = d @ (member / np.maximum(size, 1)[:, None])
    many = np.take_along_axis(size, label, axis=1)
    own = np.take_along_axis(mean, label[:, :, None], axis=2)[:, :, 0]
    a = np.where(many > 1, own * many / np.maximum(many - 1, 1), 0)
    np.put_along_axis(mean, label[:, :, None], np.inf, axis=2)
    b = np.where(size[:, None] > 0, mean, np.inf).min(axis=2)
    kinds = (size > 0).sum(axis=1)
    b[kinds < 2] = 0
    s = np.where(many > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0)
    score = np.sort(np.where(size > 0, (s[:, None] @ member)[:, 0] / np.maximum(size, 1), np.inf), axis=1)
    rows = np.arange(len(x))
    median = (score[rows, (kinds - 1) // 2] + score[rows, kinds // 2]) / 2
    return np.where(kinds < 2, -1.0, median)


def median_silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """The same of one matrix, with any labels."""
    kinds, own = np.unique(label, return_inverse=True)
    return float(silhouettes(x[None], own[None], len(kinds))[0])


#: Tasks that share the trials and shuffles of one large session and one number of clusters.
PARTS = 4
#: Events up to which sessions are solved in stacks, and numbers of a stack.
SMALL, STACK = 64, 1 << 18


def _matrices(upper: np.ndarray, n: int) -> np.ndarray:
    """Symmetric matrices with 1 on the diagonal from the rows above it, one after the other."""
    m = np.ones((len(upper), n, n))
    i, j = np.triu_indices(n, 1)
    m[:, i, j] = m[:, j, i] = upper
    return m


def _trial(m: np.ndarray, k: int, kind: int, number: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and scores of a stack; kind 1 shuffles each row first.  A draw depends on its number and the size only."""
    n = m.shape[1]
    rng = np.random.default_rng([seed, k, kind, number])
    if kind:
        m = np.take_along_axis(m, rng.permuted(np.tile(np.arange(n), (n, 1)), axis=1)[None], axis=2)
    label = kmeans(m, k, rng)
    return label, silhouettes(m, label, k)


def cluster_events(covariance: DataFrame, ks: tuple[int, ...] = (2, 3, 4), trials: int = 10, shuffles: int = 10, pct: float = 95, seed: int = 0) -> DataFrame:
    """(session_id, event_id, k, cluster, silhouette, reference) by k-means on the rows of each session's covariance matrix.

    The best trial by median silhouette; reference: percentile of the same on matrices with
    shuffled rows.  covariance: (session_id, event_id, event_id2, covariance).

    Sessions of at most SMALL events come as one row each and are solved in stacks of equal size.  Of larger ones
    trials and shuffles are dealt to tasks, each of which holds one matrix; a draw depends on its number and the
    matrix' size only, so both give the same.  A session needs more events than clusters.
    """
    half = covariance.select("session_id", F.least("event_id", "event_id2").alias("event_id"), F.greatest("event_id", "event_id2").alias("other"), "covariance")
    rows = half.groupBy("session_id", "event_id").agg(F.sort_array(F.collect_list(F.struct("other", "covariance"))).alias("row"))
    # a row comes as the numbers of the later events in ascending order; the last event has none
    packed = rows.select("session_id", "event_id", F.transform("row", lambda x: x["covariance"]).alias("values"), F.element_at("row", -1)["other"].alias("last"), (F.count("event_id").over(over("session_id")) + 1).alias("n"))
    tried_type = "session_id string, k int, kind int, number int, score double, labels array<int>"

    def stacks(batches):
        for p in batches:
            out = []
            for n, same in p.groupby("n"):
                step = max(1, STACK // int(n) ** 2)
                for at in range(0, len(same), step):
                    ids = same["session_id"].iloc[at : at + step].to_numpy()
                    m = _matrices(np.stack(same["upper"].iloc[at : at + step].to_numpy()), int(n))
                    for k in (k for k in ks if n > k):
                        for kind, many in ((0, trials), (1, shuffles)):
                            for number in range(many):
                                label, score = _trial(m, k, kind, number, seed)
                                labels = [None] * len(ids) if kind else list(label.astype(np.int32))
                                out.append(pd.DataFrame({"session_id": ids, "k": k, "kind": kind, "number": number, "score": score, "labels": labels}))
            if out:
                yield pd.concat(out)

    whole = packed.filter(F.col("n") <= SMALL).groupBy("session_id", "n").agg(F.sort_array(F.collect_list(F.struct("event_id", "values"))).alias("x"))
    small = whole.select("session_id", "n", F.flatten(F.col("x.values")).alias("upper")).mapInPandas(stacks, tried_type)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("event_id")
        n, k, part = int(p["n"].iloc[0]), int(p["k"].iloc[0]), int(p["part"].iloc[0])
        out = []
        if n > k:
            m = _matrices(np.concatenate(p["values"].to_numpy())[None], n)
            for kind, many in ((0, trials), (1, shuffles)):
                for number in range(part, many, PARTS):
                    label, score = _trial(m, k, kind, number, seed)
                    out.append((p["session_id"].iloc[0], k, kind, number, score[0], None if kind else label[0].astype(np.int32)))
        return pd.DataFrame(out, columns=["session_id", "k", "kind", "number", "score", "labels"])

    jobs = packed.filter(F.col("n") > SMALL).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    large = jobs.groupBy("session_id", "k", "part").applyInPandas(run, tried_type)
    tried = small.unionByName(large)
    best = tried.groupBy("session_id", "k").agg(F.max_by("labels", F.when(F.col("kind") == 0, F.struct("score", -F.col("number")))).alias("labels"), F.max(F.when(F.col("kind") == 0, F.col("score"))).alias("silhouette"), F.percentile(F.when(F.col("kind") == 1, F.col("score")), F.lit(pct / 100)).alias("reference"))
    # places in the matrix are the events in ascending order
    events = packed.groupBy("session_id").agg(F.sort_array(F.concat(F.collect_list("event_id"), F.array(F.max("last")))).alias("events"))
    told = best.join(events, "session_id").select("session_id", "k", "silhouette", "reference", F.explode(F.arrays_zip("events", "labels")).alias("e"))
    return told.select("session_id", F.col("e.events").cast("long").alias("event_id"), "k", F.col("e.labels").alias("cluster"), "silhouette", "reference")


def assign_cells(event_cells: DataFrame, clusters: DataFrame, least: int = 2) -> DataFrame:
    """Each cell's cluster: the one with most of its events (the smaller number on ties), -1 below ``least`` events."""
    n = event_cells.join(clusters, ["session_id", "event_id"]).groupBy(*CELL, "cluster").agg(F.count("event_id").alias("n"))
    b = n.groupBy(*CELL).agg(F.max_by(F.struct("cluster", "n"), F.struct("n", -F.col("cluster"))).alias("b"))
    return b.select(*CELL, F.when(F.col("b.n") >= least, F.col("b.cluster")).otherwise(-1).alias("cluster"), F.col("b.n").alias("n"))


#: Frames of a block of products, and cells of a tile of pairs.
BLOCK, TILE = 512, 512


def _products(p: pd.DataFrame) -> pd.DataFrame:
    """Sums of products, and of frames with both values, of all pairs of cells of two tiles over one block of frames."""
    a, b = int(p["a"].iloc[0]), int(p["b"].iloc[0])
    frames = np.unique(p["frame"])

    def side(tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = p[p["cell"] // TILE == tile]
        cells, at = np.unique(own["cell"], return_inverse=True)
        x, there = np.zeros((len(cells), len(frames))), np.zeros((len(cells), len(frames)))
        place = np.searchsorted(frames, own["frame"])
        x[at, place], there[at, place] = own["v"], 1
        return cells, x, there

    first, x, m = side(a)
    second, y, n = (first, x, m) if a == b else side(b)
    i, j = np.triu_indices(len(first)) if a == b else (g.ravel() for g in np.indices((len(first), len(second))))
    return pd.DataFrame({"session_id": p["session_id"].iloc[0], "cell": first[i], "cell2": second[j], "s": (x @ y.T)[i, j], "m": (m @ n.T)[i, j]})


def gram(traces: DataFrame) -> DataFrame:
    """(session_id, cell, cell2, c): covariance of all pairs of cells over the frames that both have.

    Tasks multiply one block of frames by itself and hand on sums; a session's cells beyond a tile meet by pairs of
    tiles.  Rows moved: the traces once for each tile, and cells x cells for each block.
    """
    centred = traces.filter("value IS NOT NULL").select(*CELL, "frame", (F.col("value") - F.avg("value").over(over(CELL))).alias("v"))
    tile = F.floor(F.col("cell") / TILE).cast("int")
    tiles = traces.groupBy("session_id").agg(F.max(tile).alias("_t"))
    dealt = centred.join(tiles, "session_id").withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_t"))))
    dealt = dealt.select(*CELL, "frame", "v", F.least(tile, "_o").alias("a"), F.greatest(tile, "_o").alias("b"), F.floor(F.col("frame") / BLOCK).alias("block"))
    sums = dealt.groupBy("session_id", "a", "b", "block").applyInPandas(_products, "session_id string, cell int, cell2 int, s double, m double")
    return sums.groupBy("session_id", "cell", "cell2").agg(F.sum("s").alias("s"), F.sum("m").alias("m")).filter("m > 0").select("session_id", "cell", "cell2", (F.col("s") / F.col("m")).alias("c"))


def _eigen(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.unique(np.concatenate([p["cell"], p["cell2"]]))
    m = np.zeros((len(ids), len(ids)))
    a, b = np.searchsorted(ids, p["cell"]), np.searchsorted(ids, p["cell2"])
    m[a, b] = m[b, a] = p["c"]
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    # the sign of a vector is free: its largest entry is made positive
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return ids, np.clip(values[order], 0, None), vectors * np.where(sign == 0, 1, sign)


def components_for_variance(traces: DataFrame, share: float = 0.95) -> DataFrame:
    """(session_id, n_components, explained): principal components that explain a share of the variance."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        _, values, _ = _eigen(p)
        total = values.sum()
        part = np.cumsum(values) / total if total > 0 else np.ones(len(values))
        n = int(np.searchsorted(part, share - 1e-12) + 1)
        return pd.DataFrame({"session_id": [p["session_id"].iloc[0]], "n_components": [n], "explained": [float(part[n - 1])]})

    return gram(traces).groupBy("session_id").applyInPandas(run, "session_id string, n_components int, explained double")


def order_by_component(traces: DataFrame, n: int = 2) -> DataFrame:
    """(session_id, component, cell, weight, rank): cells by their weight in each of the first components."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        ids, _, vectors = _eigen(p)
        k = min(n, len(ids))
        return pd.DataFrame({"session_id": p["session_id"].iloc[0], "component": np.repeat(np.arange(k), len(ids)), "cell": np.tile(ids, k), "weight": vectors[:, :k].T.ravel()})

    d = gram(traces).groupBy("session_id").applyInPandas(run, "session_id string, component int, cell int, weight double")
    return d.withColumn("rank", F.row_number().over(over(["session_id", "component"], F.round("weight", 9).desc(), "cell")))
