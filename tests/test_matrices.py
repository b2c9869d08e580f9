"""Block sums, tiles and dealt trials against plain numpy."""

import random
import tracemalloc

import numpy as np
import pytest

from ensemblar.operators import cluster as C
from ensemblar.operators import events as G
from ensemblar.operators import network as N


def traces(spark, values, drop=()):
    """values: {session: {cell: list}}."""
    rows = [(s, c, f, float(v)) for s, cells in values.items() for c, x in cells.items() for f, v in enumerate(x) if (s, c, f) not in drop]
    return spark.createDataFrame(rows, "session_id string, cell int, frame int, value double")


def test_gram_over_tiles_and_blocks(spark):
    r = np.random.default_rng(1)
    cells = [0, 3, 511, 512, 1030, 1600]
    x = {"s": {c: r.normal(10, 3, 1300) for c in cells}, "t": {c: r.normal(0, 1, 40) for c in (2, 700)}}
    drop = {("s", 3, f) for f in range(100, 400)}
    got = {(q.session_id, q.cell, q.cell2): q.c for q in C.gram(traces(spark, x, drop)).collect()}
    want = {}
    for s, cs in x.items():
        kept = {c: np.array([np.nan if (s, c, f) in drop else v for f, v in enumerate(y)]) for c, y in cs.items()}
        for a in cs:
            for b in cs:
                if a <= b:
                    want[s, a, b] = np.nanmean((kept[a] - np.nanmean(kept[a])) * (kept[b] - np.nanmean(kept[b])))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_components_against_numpy(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(3, 600))
    x = {s: {c: r.normal(size=3) @ base + 0.1 * r.normal(size=600) for c in range(12)} for s in "ab"}
    d = traces(spark, x)
    for share in (0.5, 0.9, 0.999):
        for q in C.components_for_variance(d, share).collect():
            values = np.sort(np.linalg.eigvalsh(np.cov(np.array(list(x[q.session_id].values())), bias=True)))[::-1]
            part = np.cumsum(values) / values.sum()
            n = int(np.argmax(part >= share)) + 1
            assert (q.n_components, q.explained) == (n, pytest.approx(part[n - 1]))
    for q in C.order_by_component(d, 2).collect():
        values, vectors = np.linalg.eigh(np.cov(np.array(list(x[q.session_id].values())), bias=True))
        v = vectors[:, -1 - q.component]
        v = v * np.sign(v[np.abs(v).argmax()])
        assert q.weight == pytest.approx(v[q.cell], abs=1e-8)
        assert q["rank"] == 1 + int((v > v[q.cell]).sum())


def silhouette(x, label):
    out = []
    for c in set(label):
        own = []
        for i in np.flatnonzero(label == c):
            far = {k: [np.linalg.norm(x[i] - x[j]) for j in np.flatnonzero(label == k) if j != i] for k in set(label)}
            a = np.mean(far[c]) if far[c] else None
            b = min(np.mean(far[k]) for k in set(label) if k != c)
            own.append(0 if a is None else (b - a) / max(a, b))
        out.append(np.mean(own))
    return np.median(out)


def test_silhouette_against_all_distances():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(k, 0.4, (9, 5)) for k in range(3)])
    for label in (np.repeat([0, 1, 2], 9), np.repeat([4, 7, 9], 9), np.append(np.repeat([0, 1], 13), 5), r.integers(0, 4, 27)):
        assert C.median_silhouette(x, label) == pytest.approx(silhouette(x, label))
    assert C.median_silhouette(x, np.zeros(27, int)) == -1


def test_planted_clusters(spark):
    """Events of two kinds, in two sessions; a session with too few events has no rows."""
    r = random.Random(4)
    rows = []
    for s, n in (("a", 30), ("b", 11), ("c", 2)):
        for i in range(n):
            for j in range(i + 1, n):
                rows.append((s, 10 * i, 10 * j, (0.9 if i % 2 == j % 2 else -0.5) + r.uniform(-0.05, 0.05)))
    d = spark.createDataFrame(rows, "session_id string, event_id long, event_id2 long, covariance double")
    got = C.cluster_events(d, (2, 3), 4, 6).collect()
    assert {q.session_id for q in got} == {"a", "b"} and len(got) == 2 * (30 + 11)
    for s in "ab":
        two = {q.event_id: q for q in got if q.session_id == s and q.k == 2}
        kinds = {(e // 10) % 2: {q.cluster for k, q in two.items() if k % 20 == e % 20} for e in two}
        assert all(len(x) == 1 for x in kinds.values()) and kinds[0] != kinds[1]
        n = len(two)
        m = np.eye(n)
        for q, i, j, v in rows:
            if q == s:
                m[i // 10, j // 10] = m[j // 10, i // 10] = v
        label = np.array([two[10 * i].cluster for i in range(n)])
        assert two[0].silhouette == pytest.approx(silhouette(m, label)) and two[0].silhouette > two[0].reference
    assert sorted(got) == sorted(C.cluster_events(d.repartition(7), (2, 3), 4, 6).collect())


def test_two_thousand_events_in_bounded_memory():
    x = np.random.default_rng(5).normal(size=(2000, 2000))
    tracemalloc.start()
    C.median_silhouette(x, C.kmeans(x, 4, np.random.default_rng(0), steps=3))
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_distances_of_several_tiles(spark):
    r = random.Random(6)
    cells = {("s", 7 * c): sorted(r.sample(range(500), r.randint(1, 30))) for c in range(140)} | {("t", 1): [4], ("t", 2): [9, 9]}
    d = spark.createDataFrame([(s, c, f) for (s, c), x in cells.items() for f in x], "session_id string, cell int, frame int")
    got = {(q.session_id, q.cell, q.cell2): q.distance for q in N.pairwise_wasserstein(d).collect()}
    assert len(got) == 140 * 139 // 2 + 1 and got["t", 1, 2] == 5
    for (s, a), x in list(cells.items())[::9]:
        for (t, b), y in list(cells.items())[::11]:
            if s == t and a < b:
                at = sorted({*x, *y})
                level = lambda z, u: sum(f <= u for f in z) / len(z)
                assert got[s, a, b] == pytest.approx(sum(abs(level(x, u) - level(y, u)) * (v - u) for u, v in zip(at, at[1:])))


def test_rotations_against_all_copies(spark):
    """Arcs that run over the end, masks of all and no frames, cells without activity."""
    r = random.Random(8)
    n = 40
    act = sorted({("s", c, f) for c in range(3) for f in r.sample(range(n), 12)} | {("s", 3, f) for f in (0, 1, 38, 39)})
    d = spark.createDataFrame(act, "session_id string, cell int, frame int")
    ses = spark.createDataFrame([("s", n), ("u", n)], "session_id string, n_frames int")
    for mask in ([0, 1, 2, 39], list(range(n)), [5, 6, 7, 20, 21], [13]):
        got = {q.cell: (q.n, q.threshold) for q in G.significant_cells(d, spark.createDataFrame([("s", f) for f in mask], "session_id string, frame int"), ses, pct=0.8).collect()}
        want = {}
        for c in range(4):
            own = [f for _, k, f in act if k == c]
            counts = sorted(sum((f + z) % n in mask for f in own) for z in range(n))
            limit = next(v for k, v in enumerate(counts) if k + 1 >= 0.8 * n)
            now = sum(f in mask for f in own)
            if now and now >= limit:
                want[c] = (now, limit)
        assert got == want
    lengths = spark.createDataFrame([("s", 5), ("s", n), ("u", 3)], "session_id string, length int")
    p = {(q.length, q.n): q.p for q in G.activity_distribution(d, lengths, ses).collect() if q.p > 1e-12}
    want = {}
    for size in (5, n):
        each = [[sum((f - z) % n < size for _, k, f in act if k == c) for z in range(n)] for c in range(4)]
        now = {0: 1.0}
        for x in each:
            now2 = {}
            for k, v in now.items():
                for y in x:
                    now2[k + y] = now2.get(k + y, 0) + v / n
            now = now2
        want |= {(size, k): v for k, v in now.items()}
    assert p.keys() == want.keys() and all(p[k] == pytest.approx(want[k]) for k in want)
