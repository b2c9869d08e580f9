"""Queries on rows that the smallest tables do not have, against their SQL."""

import random

import duckdb
import numpy as np

from ensemblar.operators import cluster
from ensemblar.plans import ORACLE, QUERIES


def test_predictions_of_zero_stay(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table events as select * from (values (1, timestamp '2024-01-01 01:00:00', 3, 'click', 0.0), (2, timestamp '2024-01-02 01:00:00', 3, 'click', 90.0), (3, timestamp '2024-01-02 08:00:00', 14, 'click', 0.0)) v(event_id, ts, user_id, event_type, value)")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    d = QUERIES["t3_merge_window_predictions"](spark, str(tmp_path))
    columns = ["session_id", "cell", "class", "frame", "p"]
    want = con.execute(f"select {', '.join(columns)} from ({ORACLE['t3_merge_window_predictions']})").fetchall()
    assert len(want) == 3 and sorted(map(tuple, d.select(*columns).collect())) == sorted(want)


def test_small_sessions_share_a_task_and_agree_with_large_ones(spark, monkeypatch):
    r = random.Random(3)
    rows = [(s, i, j, r.uniform(-1, 1)) for s, n in (("a", 9), ("b", 9), ("c", 12), ("d", 2)) for i in range(n) for j in range(i + 1, n)]
    d = spark.createDataFrame(rows, "session_id string, event_id long, event_id2 long, covariance double")
    told = lambda: sorted((*q[:4], round(q[4], 9), round(q[5], 9)) for q in cluster.cluster_events(d, (2, 3), 3, 3).collect())
    stacked = told()
    monkeypatch.setattr(cluster, "SMALL", 0)
    assert len(stacked) == 2 * (9 + 9 + 12) and told() == stacked


def test_a_stack_is_solved_as_its_matrices():
    x = np.random.default_rng(2).normal(size=(5, 8, 8))
    label = cluster.kmeans(x, 3, np.random.default_rng(0))
    for m, one in zip(x, label, strict=True):
        assert (cluster.kmeans(m, 3, np.random.default_rng(0)) == one).all()
