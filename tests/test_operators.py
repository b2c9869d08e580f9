"""Operators on small made inputs: edges, ties, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from ensemblar.operators import cluster as C
from ensemblar.operators import events as G
from ensemblar.operators import intervals as I
from ensemblar.operators import network as N
from ensemblar.operators import patterns as Q
from ensemblar.operators import prep as T
from ensemblar.operators import records as R
from ensemblar.operators import series as S
from ensemblar.operators import stats as A
from ensemblar.sources import io

ACT = "session_id string, cell int, frame int"
PER = "session_id string, first int, last int"


def frames(spark, text, cell=0, session="s"):
    return spark.createDataFrame([(session, cell, k) for k, x in enumerate(text) if x == "1"], ACT)


def sessions(spark, n=10, cells=3):
    return spark.createDataFrame([("s", "m", 5, 1.0, n, cells)], "session_id string, subject_id string, age int, rate_hz double, n_frames int, n_cells int")


def tuples(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("text, want", [("1101", [(0, 1), (3, 3)]), ("0110", [(1, 2)]), ("1100", [(0, 1)]), ("000", []), ("111", [(0, 2)]), ("010", [(1, 1)])])
def test_runs(spark, text, want):
    assert tuples(I.runs(frames(spark, text)), "first", "last") == want


def test_runs_and_frames_undo_each_other(spark):
    r = random.Random(1)
    act = spark.createDataFrame([("s", c, f) for c in range(3) for f in range(60) if r.random() < 0.4], ACT)
    back = I.periods_to_frames(I.runs(act, ("session_id", "cell"))).select("session_id", "cell", "frame")
    assert tuples(back, "cell", "frame") == tuples(act, "cell", "frame")


def test_large_frames_do_not_overflow(spark):
    act = spark.createDataFrame([("s", 0, 40_000), ("s", 0, 40_001)], ACT)
    assert tuples(I.runs(act), "first", "last") == [(40_000, 40_001)]


def test_gap_at_the_limit_merges(spark):
    p = spark.createDataFrame([("s", 0, 3), ("s", 5, 8), ("s", 11, 12), ("s", 1, 2)], PER)
    assert tuples(I.merge_periods(p, 2), "first", "last") == [(0, 8), (11, 12)]


def test_onset_needs_a_later_peak(spark):
    on, pk = frames(spark, "00000001"), frames(spark, "00100001")
    assert I.activity_from_onsets_peaks(on, pk).count() == 0


def test_plateau_is_one_peak_and_constant_has_none(spark):
    t = lambda values: spark.createDataFrame([("s", 0, k, float(v)) for k, v in enumerate(values)], "session_id string, cell int, frame int, value double")
    assert tuples(I.onsets_peaks_from_trace(t([0, 2, 2, 0]), 0.1).filter("kind = 'peak'"), "frame") == [(1,)]
    assert I.onsets_peaks_from_trace(t([3, 3, 3])).count() == 0
    assert [r.value for r in S.zscore(t([3, 3, 3])).collect()] == [None] * 3


def test_nearest_frame_ties_and_ends(spark):
    clock = spark.createDataFrame([("s", 0, 0.0), ("s", 1, 10.0)], "session_id string, frame int, t double")
    ev = spark.createDataFrame([("s", 5.0), ("s", -1.0), ("s", 11.0), ("s", 4.9), ("s", 10.0)], "session_id string, t double")
    assert tuples(I.nearest_frame(ev, clock), "t", "frame") == [(-1.0, -1), (4.9, 0), (5.0, 1), (10.0, 1), (11.0, 2)]


def test_shortest_label_wins(spark):
    iv = spark.createDataFrame([("s", "long", 0.0, 10.0), ("s", "short", 4.0, 6.0)], "session_id string, label string, t0 double, t1 double")
    clock = spark.createDataFrame([("s", 0, 5.0), ("s", 1, 9.0), ("s", 2, 20.0)], "session_id string, frame int, t double")
    assert tuples(I.shortest_label_per_frame(iv, clock), "frame", "label") == [(0, "short"), (1, "long"), (2, "still")]


def test_one_shared_frame_overlaps_once(spark):
    a, b = spark.createDataFrame([("s", 0, 5)], PER), spark.createDataFrame([("s", 5, 90)], PER)
    for bucket, levels in ((1, 5), (4, 5), (4, 2), (100, 1)):
        assert I.interval_overlap_join(a, b, bucket=bucket, levels=levels).count() == 1
    assert I.interval_overlap_join(a, b, how="anti").count() == 0


def test_overlap_join_equals_brute_force(spark):
    r = random.Random(2)
    make = lambda n, longest: [("s", f, f + r.randint(0, longest)) for f in (r.randint(0, 200) for _ in range(n))]
    a, b = make(60, 30), make(60, 80)
    want = sorted((x[1], x[2], y[1], y[2]) for x in a for y in b if x[1] <= y[2] and y[1] <= x[2])
    got = I.interval_overlap_join(spark.createDataFrame(a, PER), spark.createDataFrame(b, PER), bucket=7, levels=2)
    assert sorted(tuple(x) for x in got.select("first", "last", "b_first", "b_last").collect()) == want


def test_dilation_is_clipped(spark):
    p = spark.createDataFrame([("s", 8, 9), ("s", 0, 1)], PER)
    assert tuples(I.dilate(p, sessions(spark), 3, 3), "first", "last") == [(0, 4), (5, 9)]
    assert tuples(I.dilate(p, sessions(spark), 4, 3), "first", "last") == [(0, 9)]
    assert I.complement(p, sessions(spark)).collect()[0][1:] == (2, 7)


def test_silent_sessions_and_frames_count(spark):
    none = spark.createDataFrame([], ACT)
    f = A.transient_frequency(I.transients(none), sessions(spark))
    assert [r.frequency for r in f.collect()] == [0.0, 0.0, 0.0]
    assert A.population_activity(none, sessions(spark)).agg(F.sum("n")).first()[0] == 0


def test_ratios_without_denominator(spark):
    c = spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, fn long, tn long")
    assert A.with_ratios(c).first().sensitivity == 1.0
    assert A.with_ratios(c, None).first().sensitivity is None


def test_confusion_counts_add_up(spark):
    r = random.Random(3)
    truth = spark.createDataFrame([("s", 0, f) for f in range(50) if r.random() < 0.4], ACT)
    pred = spark.createDataFrame([("s", 0, f, "m") for f in range(50) if r.random() < 0.4], ACT + ", method string")
    x = A.confusion_frames(truth, pred, sessions(spark, 50)).first()
    assert x.tp + x.fp + x.fn + x.tn == 50


def test_corrections(spark):
    p = spark.createDataFrame([("s", k, v) for k, v in enumerate((0.001, 0.02, 0.03, 0.5))], "session_id string, i int, p double")
    n = lambda m: Q.correct_pvalues(p, 0.05, m).filter("significant").count()
    assert (n("fdr"), n("bonferroni"), n("holm"), n("none")) == (3, 1, 1, 3)
    with pytest.raises(ValueError):
        Q.correct_pvalues(p, 0.05, "other")


def test_betweenness_equals_brute_force(spark):
    r = random.Random(4)
    edges = sorted({(a, b) for a, b in ((r.randint(0, 7), r.randint(0, 7)) for _ in range(18)) if a != b})
    nodes = sorted({x for e in edges for x in e})
    out = {n: [b for a, b in edges if a == n] for n in nodes}
    want = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, paths, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for w in out[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0.0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for w in out[v]:
                if dist.get(w) == dist[v] + 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if v != s:
                want[v] += delta[v]
    m = len(nodes)
    got = {x.node: x.betweenness for x in N.betweenness(spark.createDataFrame([("s", a, b) for a, b in edges], "session_id string, src int, dst int")).collect()}
    assert got == pytest.approx({k: v / ((m - 1) * (m - 2)) for k, v in want.items()})


def test_three_cycle_is_even(spark):
    e = spark.createDataFrame([("s", 0, 1), ("s", 1, 2), ("s", 2, 0)], "session_id string, src int, dst int")
    assert len({round(r.betweenness, 9) for r in N.betweenness(e).collect()}) == 1


def test_rows_of_matrices_add_to_one_and_jaccard_is_bounded(spark):
    r = random.Random(5)
    act = spark.createDataFrame([("s", c, f) for c in range(4) for f in range(60) if r.random() < 0.3], ACT)
    for row in Q.transition_matrix(act, 1, 3).groupBy("src").agg(F.sum("p").alias("p")).collect():
        assert row.p == pytest.approx(1)
    members = act.select("session_id", F.col("frame").cast("long").alias("event_id"), "cell")
    assert all(0 <= x.jaccard_pct <= 100 for x in N.event_jaccard(members).collect())


def test_closed_patterns_equal_brute_force(spark):
    r = random.Random(6)
    tx = [("s", k, sorted({r.randint(0, 5) for _ in range(3)})) for k in range(40)]
    sets = {}
    for _, _, items in tx:
        for mask in range(1, 1 << len(items)):
            key = tuple(x for j, x in enumerate(items) if mask >> j & 1)
            sets[key] = sets.get(key, 0) + 1
    want = sorted((list(k), c) for k, c in sets.items() if c >= 3 and len(k) >= 2 and not any(c == d and set(k) < set(o) for o, d in sets.items()))
    got = Q.frequent_patterns(spark.createDataFrame(tx, "session_id string, window int, items array<int>"), 3)
    assert sorted((x["items"], x["cnt"]) for x in got.collect()) == want


def test_windows_end_with_the_series(spark):
    s = spark.createDataFrame([("s", 10), ("t", 3)], "session_id string, n_frames int")
    assert tuples(T.window_cut(s, 4, 0.0), "session_id", "first", "last") == [("s", 0, 3), ("s", 4, 7), ("s", 6, 9)]
    assert T.window_cut(s, 4, 0.0, keep_last=False).count() == 2


def test_surrogates_keep_counts(spark):
    act = frames(spark, "1101000000")
    n = G.circular_surrogates(act, sessions(spark), 5).groupBy("k").count().collect()
    assert [x["count"] for x in n] == [3] * 5


def test_components(spark):
    rows = [("s", c, f, float((f % 7) * (c + 1))) for c in range(3) for f in range(30)]
    t = spark.createDataFrame(rows, "session_id string, cell int, frame int, value double")
    assert C.components_for_variance(t, 0.95).first().n_components == 1
    assert [x.cell for x in C.order_by_component(t, 1).orderBy("rank").collect()] == [2, 1, 0]


def test_codes(spark):
    d = spark.createDataFrame([("Été ",), (None,), ("hiver",)], "x string")
    assert [r.x for r in R.code_column(d, "x", {"ete": 1}).collect()] == [1, -1, -1]
    assert R.clean_headers(spark.createDataFrame([(1, 2)], "`Né le` int, `ne_le` int")).columns == ["ne_le", "ne_le_2"]


def test_invalid_frames(spark):
    d = spark.createDataFrame([("f", k, x) for k, x in enumerate(["1-2", "p7_a", "3-5", "x", "8 - 9", "p8_b", "0-0"])], "file string, n int, line string")
    assert tuples(io.parse_invalid_frames(d), "session_id", "first", "last") == [("p7_a", 3, 5), ("p7_a", 8, 9), ("p8_b", 0, 0)]
    assert tuples(io.parse_invalid_frames(d, True), "first") == [(-1,), (2,), (7,)]


def test_arrays_from_files(spark, tmp_path):
    import numpy as np

    np.savez(tmp_path / "p7_a.npz", raster=np.eye(3, 5, dtype=np.int8), other=np.zeros(2))
    got = io.read_arrays(spark, f"{tmp_path}/*.npz", "raster")
    assert tuples(got, "cell", "frame") == [(0, 0), (1, 1), (2, 2)]
    assert tuples(io.parse_session_path(got), "age", "session_id")[0] == (7, "a")


def test_same_with_other_partitions(spark):
    r = random.Random(8)
    act = spark.createDataFrame([("s", c, f) for c in range(5) for f in range(100) if r.random() < 0.3], ACT)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for n in ("1", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(tuples(N.pairwise_pearson(act, sessions(spark, 100, 5)), "cell", "cell2", "r"))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert out[0] == out[1]
