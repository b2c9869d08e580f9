"""Short sessions are mined in stacks in their tasks, longer ones by blocks; both hold the same sets."""

import random

from pyspark.sql import functions as F

from ensemblar.operators import bitmaps as B
from ensemblar.operators import patterns as Q
from test_mining import baskets_of, frame, mined


def found(df):
    out = {}
    for r in df.collect():
        assert out.setdefault(r.session_id, {}).setdefault(tuple(r["items"]), r.cnt) == r.cnt and r.size == len(r["items"])
    return out


def test_short_sessions_move_no_pairs(spark, monkeypatch):
    sessions = {f"s{k}": baskets_of(20 + k, 30 + 45 * k) for k in range(4)}
    t = frame(spark, sessions).unionByName(spark.createDataFrame([(None, 1, [1, 2])] * 20, "session_id string, window int, items array<int>"))
    want = {s: mined(b, 9, 4) for s, b in sessions.items()}
    # a row for each pair of items and block was joined, written and counted
    with monkeypatch.context() as m:
        m.setattr(Q, "_mined_by_blocks", None)
        assert found(Q.frequent_patterns(t, 9, 1, 4)) == want
        # steps of few words, stacks of few sessions
        m.setattr(B, "WORDS", 5)
        m.setattr(B, "STACK", 200)
        assert found(Q.frequent_patterns(t, 9, 1, 4)) == want
        assert found(Q.frequent_patterns(t, 9, 1, 4, closed=False)) == {s: mined(b, 9, 4, closed=False) for s, b in sessions.items()}
    # two of the sessions are long
    monkeypatch.setattr(B, "TRANSACTIONS", 80)
    assert found(Q.frequent_patterns(t, 9, 1, 4)) == want
    monkeypatch.setattr(B, "OCCURRENCES", 0)
    assert found(Q.frequent_patterns(t, 9, 1, 4)) == want


def test_items_of_any_kind(spark):
    rows = [("a", 1, ["y", "x", None]), ("a", 2, ["x", "y"]), ("a", 3, []), ("a", 4, None), ("b", 1, ["z"])]
    t = spark.createDataFrame(rows, "session_id string, window int, items array<string>")
    assert found(Q.frequent_patterns(t, 2, 1, 3)) == {"a": {("x", "y"): 2}}


def test_windows_are_made_from_rows_of_bins(spark):
    r = random.Random(6)
    spikes = sorted({(s, c, f) for s in "ab" for c in range(5) for f in r.sample(range(-9, 600), 70)})
    onsets = spark.createDataFrame([*spikes, (None, 1, 1)], "session_id string, cell int, frame int")
    want = {}
    for s, _, f in spikes:
        w = f // 2
        want[s, w] = sorted({c * 3 + g // 2 - w for x, c, g in spikes if x == s and 0 <= g // 2 - w < 3})
    d = Q.spike_windows(onsets, 2, 3)
    assert {(x.session_id, x.window): x["items"] for x in d.collect()} == want and d.count() == len(want)
    # windows were joined with their first bins
    assert "Join" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_sizes_from_spikes_bound_windows(spark):
    rows = [("a", c, f) for c in range(2) for f in range(0, 1200, 2)] + [("b", 0, f) for f in range(0, 4000, 2)] + [("c", 0, 0), ("c", 0, 1 << 20)]
    onsets = spark.createDataFrame(rows, "session_id string, cell int, frame int")
    assert {x.session_id: x.short for x in Q.spike_sizes(onsets, 2, 3).collect()} == {"a": True, "b": False, "c": True}
    n = Q.spike_windows(onsets, 2, 3).groupBy("session_id").agg(F.count("window").alias("n")).filter(F.col("n") > B.TRANSACTIONS)
    assert {x.session_id for x in n.collect()} == {"b"}


def test_subsets_of_windows_are_bitmaps(spark, monkeypatch):
    sessions = {"a": baskets_of(3, 70), "b": baskets_of(4, 140)}
    # windows so late that a product with them leaves 32 bits
    rows = [(s, 60000 + 7 * k, sorted(b)) for s, bs in sessions.items() for k, b in enumerate(bs) if b]
    t = spark.createDataFrame(rows, "session_id string, window int, items array<int>")
    p = Q.frequent_patterns(t, 14, 1, 3).unionByName(spark.createDataFrame([("a", [1, 99], 2, 0), ("c", [1], 1, 0)], "session_id string, items array<int>, size int, cnt long"))
    want = {}
    for x in p.collect():
        h = 0
        for i in x["items"]:
            h = (h * 31 + i) % 65521
        n = 0
        for k in range(20):
            kept = [set(b) for s, w, b in rows if s == x.session_id and set(x["items"]) <= set(b) and ((h * 7919 + w * 40503 + k * 104729 + 5) % 999983 * 48271 % 65521) % 2 == 0]
            n += bool(kept) and set.intersection(*kept) == set(x["items"])
        want[x.session_id, tuple(x["items"])] = n / 20
    of = lambda: {(r.session_id, tuple(r["items"])): r.stability for r in Q.pattern_stability(p, t, 20, 5).collect()}
    assert 0 < sum(want.values()) < len(want)
    with monkeypatch.context() as m:
        # a row for each pattern, window, subset and item was moved
        m.setattr(Q, "_stable_by_joins", None)
        assert of() == want
        m.setattr(B, "WORDS", 50)
        m.setattr(B, "STACK", 10)
        m.setattr(Q, "PATTERNS", 7)
        assert of() == want
    monkeypatch.setattr(B, "TRANSACTIONS", 100)
    assert of() == want
    monkeypatch.setattr(B, "TRANSACTIONS", 0)
    assert of() == want
