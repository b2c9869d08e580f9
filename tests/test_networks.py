"""Betweenness against path counts, on long and dense graphs, both ways of working; common cores of any length."""

import random
from collections import deque

import numpy as np
import pytest

from ensemblar.operators import network as N


def brandes(edges):
    nodes = sorted({x for e in edges for x in e})
    next_ = {v: sorted({b for a, b in edges if a == v}) for v in nodes}
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        far, n, order, before = {s: 0}, {s: 1.0}, [], {s: []}
        todo = deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in next_[v]:
                if w not in far:
                    far[w], n[w], before[w] = far[v] + 1, 0.0, []
                    todo.append(w)
                if far[w] == far[v] + 1:
                    n[w] += n[v]
                    before[w].append(v)
        part = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                part[v] += n[v] / n[w] * (1 + part[w])
            if w != s:
                total[w] += part[w]
    m = len(nodes)
    return {v: x / ((m - 1) * (m - 2)) if m > 2 else 0.0 for v, x in total.items()}


def graphs():
    r = random.Random(2)
    return {
        "path": [(k, k + 1) for k in range(199)],
        "ring": [(k, (k + 1) % 70) for k in range(70)],
        "dense": [(a, b) for a in range(90) for b in range(90) if a != b and r.random() < 0.05],
        "pair": [(3, 9)],
    }


@pytest.mark.parametrize("task_edges", [N.TASK_EDGES, 100])
def test_betweenness(spark, task_edges):
    g = graphs()
    if task_edges == 100:
        del g["path"]  # a step of joins for each of its levels
    rows = [(s, a, b) for s, e in g.items() for a, b in e]
    got = {}
    for r in N.betweenness(spark.createDataFrame(rows + rows[:5], "session_id string, src int, dst int"), task_edges).collect():
        got.setdefault(r.session_id, {})[r.node] = r.betweenness
    for s, e in g.items():
        want = brandes(e)
        assert got[s].keys() == want.keys()
        assert all(got[s][v] == pytest.approx(want[v], abs=1e-12) for v in want), s


def test_no_edges(spark):
    assert N.betweenness(spark.createDataFrame([], "session_id string, src int, dst int")).collect() == []


def test_dependencies_in_chunks(monkeypatch):
    e = np.array(graphs()["dense"])
    whole = N.dependencies(90, e[:, 0], e[:, 1], np.arange(64))
    monkeypatch.setattr(N, "_CHUNK", 3)
    assert np.allclose(N.dependencies(90, e[:, 0], e[:, 1], np.arange(64)), whole)


def test_common_core_beyond_fifty_events(spark):
    n = 130
    events = spark.createDataFrame([("a", k, 10 * k) for k in range(n)], "session_id string, event_id long, first int")
    members = [("a", k, 1) for k in range(n)] + [("a", k, 2) for k in range(n) if k % 40] + [("a", k, 3) for k in range(20, 90)]
    got = {(r.event_id, r.step): (r.n, r.delay) for r in N.common_core_course(spark.createDataFrame(members, "session_id string, event_id long, cell int"), events).collect()}
    want = {}
    for k in range(n):
        core = {c for _, e, c in members if e == k}
        for j in range(k, n):
            core &= {c for _, e, c in members if e == j}
            if not core:
                break
            want[k, j - k] = (len(core), 10 * (j - k))
    assert got == want
