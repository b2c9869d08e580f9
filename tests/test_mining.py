"""Pattern mining against plain enumeration, beyond the sizes that SQL joins reach."""

import random
from itertools import combinations

from ensemblar.operators import patterns as Q


def mined(baskets, least, most, closed=True):
    """All sets of at most ``most`` items by enumeration; closed: none of one more item with as many baskets."""
    n = {}
    for b in baskets:
        for z in range(1, most + 1 + closed):
            for x in combinations(sorted(b), z):
                n[x] = n.get(x, 0) + 1
    n = {x: c for x, c in n.items() if c >= least}
    hidden = {tuple(v for v in x if v != d) + (c,) for x, c in n.items() for d in x} if closed else set()
    return {x: c for x, c in n.items() if len(x) <= most and x + (c,) not in hidden}


def baskets_of(seed, n=150):
    r = random.Random(seed)
    return [{i for i in range(12) if r.random() < (0.6 if i % 3 == 0 else 0.25)} | ({1, 4, 7, 10} if r.random() < 0.3 else set()) for _ in range(n)]


def frame(spark, sessions):
    rows = [(s, k, sorted(b)) for s, bs in sessions.items() for k, b in enumerate(bs) if b]
    return spark.createDataFrame(rows, "session_id string, window int, items array<int>")


def test_closed_patterns_of_several_sessions(spark):
    sessions = {f"s{k}": baskets_of(k, 60 + 40 * k) for k in range(3)}
    got = {}
    for r in Q.frequent_patterns(frame(spark, sessions), 12, 1, 5).collect():
        assert r.size == len(r["items"]) and list(r["items"]) == sorted(r["items"])
        got.setdefault(r.session_id, {})[tuple(r["items"])] = r.cnt
    assert got == {s: mined(b, 12, 5) for s, b in sessions.items()}


def test_all_patterns_and_limits(spark):
    b = baskets_of(9)
    t = frame(spark, {"a": b})
    got = {tuple(r["items"]): r.cnt for r in Q.frequent_patterns(t, 20, 2, 3, closed=False).collect()}
    assert got == {x: c for x, c in mined(b, 20, 3, closed=False).items() if len(x) >= 2}
    got = {tuple(r["items"]): r.cnt for r in Q.frequent_patterns(t, 20, 2, 4, length=3, min_cells=2).collect()}
    assert got == {x: c for x, c in mined(b, 20, 4).items() if len(x) >= 2 and any(i % 3 == 0 for i in x) and len({i // 3 for i in x}) >= 2}
    assert Q.frequent_patterns(t, 1000).collect() == []
    assert Q.frequent_patterns(t.filter("false"), 1).collect() == []


def test_repeated_items_and_equal_transactions(spark):
    t = spark.createDataFrame([("a", 1, [1, 1, 2])] * 70 + [("b", 1, [1])] * 3, "session_id string, window int, items array<int>")
    got = {(r.session_id, tuple(r["items"])): r.cnt for r in Q.frequent_patterns(t, 3, 1, 3).collect()}
    assert got == {("a", (1, 2)): 70, ("b", (1,)): 3}


def test_thousand_surrogates_in_one_plan(spark):
    """p-values are shares of 1,000 dithered copies; checked against the copies made one by one."""
    r = random.Random(4)
    spikes = sorted({(c, f) for c in range(4) for f in r.sample(range(60), 9)} | {(c, f) for f in (5, 15, 25, 35, 45) for c in (0, 1)})
    onsets = spark.createDataFrame([("a", c, f) for c, f in spikes], "session_id string, cell int, frame int")
    sessions = spark.createDataFrame([("a", 60)], "session_id string, n_frames int")
    p = Q.frequent_patterns(Q.spike_windows(onsets, 1, 2), 3, 2, 3)
    got = {(x["size"], x["cnt"]): x.p for x in Q.surrogate_spectrum(onsets, sessions, p, 1000, 3, 1, 2).collect()}
    asked = {(x["size"], x["cnt"]) for x in p.collect()}
    assert set(got) == asked and asked
    hits = dict.fromkeys(asked, 0)
    for k in range(1000):
        moved = {(c, max(0, min(59, f + (c * 7919 + f * 104729 + k * 15485863) % 7 - 3))) for c, f in spikes}
        heads = {f for _, f in moved}
        windows = [{c * 2 + f - w for c, f in moved if w <= f < w + 2} for w in heads]
        found = mined(windows, min(c for _, c in asked), 3, closed=False)
        best = {}
        for x, c in found.items():
            for z in range(2, len(x) + 1):
                best[z] = max(best.get(z, 0), c)
        for z, c in asked:
            hits[z, c] += best.get(z, 0) >= c
    assert got == {x: n / 1000 for x, n in hits.items()}


def test_long_time_profiles(spark):
    t = spark.createDataFrame([("a", [1, 2], list(range(0, 3 * 1500, 3)))], "session_id string, cells array<int>, times array<int>")
    (r,) = Q.group_by_time_profile(t, 1).collect()
    assert r.profile == [1] * 1499
