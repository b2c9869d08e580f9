"""Steps that multiply rows: what is moved between tasks stays small, and results are those of plain versions."""

import numpy as np
from pyspark.sql import functions as F

from ensemblar.operators import events as G
from ensemblar.operators import network as N
from ensemblar.operators import patterns as Q
from ensemblar.plans import QUERIES
from ensemblar.plans.bindings import Tables

from conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_surrogates_are_counted_where_they_are(spark):
    rows = [("a", c, f) for c in range(3) for f in range(0, 20, c + 2)] + [("b", 1, 19), ("b", 1, 0), ("b", 2, 4)]
    act = spark.createDataFrame(rows, "session_id string, cell int, frame int")
    sess = spark.createDataFrame([("a", 20), ("b", 20)], "session_id string, n_frames int")
    for window in (1, 3):
        got = {r.session_id: (r.threshold, m.threshold) for r in G.activity_threshold(act, sess, window, 20, 0.9).collect() for m in G.activity_threshold(act, sess, window, 20, 0.9, max_of_each=True).filter(F.col("session_id") == r.session_id).collect()}
        for s in "ab":
            n = np.zeros((20, 20 - window + 1))
            for k in range(20):
                on = {(c, (f + 1 + (c * 7919 + k * 104729) % 19) % 20) for x, c, f in rows if x == s}
                for start in range(20 - window + 1):
                    n[k, start] = len({c for c, f in on if start <= f < start + window})
            assert np.allclose(got[s], (np.quantile(n, 0.9), np.quantile(n.max(axis=1), 0.9)))
    # a distinct count over the copies' rows moved them all twice
    p = G.activity_threshold(act, sess, 3, 20, 0.9)
    assert "count(distinct" not in plan(p) and "RepartitionByExpression [session_id" in plan(p)


def test_traces_are_made_where_their_session_is(spark):
    t = Tables(spark, SMALL)
    # no join of a row for each cell and frame
    assert "Join" not in plan(t.traces)
    n = t.sess.count()
    assert t.traces.agg(F.count("value"), F.count_distinct("session_id", "cell", "frame")).first()[:] == (1200 * n, 1200 * n)


def test_segments_meet_their_marks_by_part(spark):
    p = plan(QUERIES["p5_segment_zscore"](spark, SMALL))
    # no join by single frames
    assert "frame" not in "".join(line for line in p.splitlines() if "Join" in line)


def test_event_pairs_are_counted_where_they_are_made(spark):
    p = plan(QUERIES["n5_event_covariance"](spark, SMALL))
    # the join of pairs with counts of their common cells is gone: one by session, and one with the session's number
    assert p.count("Join") == 2 and "array_intersect" in p


def test_lag_histograms_meet_as_rows(spark):
    rows = [("a", c, f) for c in range(3) for f in range(12) if (c * 5 + f * f) % 4 < 2]
    act = spark.createDataFrame(rows, "session_id string, cell int, frame int")
    got = {(r.epoch, r.epoch2): (r.distance, r.n_pairs) for r in N.epoch_lag_distance(act, 4).collect()}
    at = lambda c, e: [f for _, x, f in rows if x == c and f // 4 == e]
    for e, e2 in ((0, 1), (0, 2), (1, 2)):
        d = []
        for c in range(3):
            for c2 in range(c + 1, 3):
                lags = [[y - x for x in at(c, k) for y in at(c2, k)] for k in (e, e2)]
                if all(lags):
                    d.append(sum(abs(np.mean([x <= k for x in lags[0]]) - np.mean([x <= k for x in lags[1]])) for k in range(-4, 4)))
        assert got[e, e2][1] == len(d) and abs(got[e, e2][0] - np.mean(d)) < 1e-12
    # lags are not sorted in windows
    assert "Window" not in plan(N.epoch_lag_distance(act, 4))


def test_delays_are_summed_once_for_all_orders(spark):
    rows = [("a", c, f) for c in range(4) for f in range(60) if (c * 7 + f * f) % 11 < 2] + [("a", 0, 0), ("a", 3, 79)]
    act = spark.createDataFrame(sorted(set(rows)), "session_id string, cell int, frame int")
    orders = {"x": [0, 1, 2, 3], "y": [3, 1, 0, 2]}
    o = spark.createDataFrame([("a", k, c, r) for k, cells in orders.items() for r, c in enumerate(cells)], "session_id string, candidate string, cell int, rank int")
    d = Q.order_score(act, o, 2, 5)
    got = {r.candidate: r.loss for r in d.collect()}
    for k, cells in orders.items():
        loss = n = 0
        for i, c in enumerate(cells):
            for c2 in cells[i + 1 : i + 3]:
                for f in {f for _, x, f in rows if x == c}:
                    near = [g - f for _, x, g in rows if x == c2 and abs(g - f) <= 5]
                    best = min(near, key=lambda z: (abs(z), -z)) if near else None
                    loss, n = loss + (5 if best is None else max(0, -best)), n + 1
        assert abs(got[k] - loss / (5 * n)) < 1e-12
    # the nearest partner was taken for each order, by sorting
    assert "min_by" not in plan(d)


def test_predictions_are_not_copied_to_thresholds(spark):
    assert "explode(filter" not in plan(QUERIES["a21_threshold_sweep"](spark, SMALL))


def test_followers_meet_by_blocks(spark):
    rows = sorted({("a", c, f) for c in range(3) for f in range(70) if (c * 5 + f * f) % 9 < 3})
    act = spark.createDataFrame(rows, "session_id string, cell int, frame int")
    d = Q._followers(act, 2, 5)
    want = sorted((x, y, f, g) for _, x, f in rows for _, y, g in rows if 2 <= g - f <= 6)
    assert sorted((r.src, r.dst, r.frame, r.frame2) for r in d.collect()) == want
    # a row for each frame of each window was joined
    assert d._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [session_id") == 2
