"""Streams in several micro-batches against plain Python over all rows."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from ensemblar.streaming import sensors as X

HOUR = 3600


def ran(spark, tmp_path, batches, make, schema="session_id string, cell int, ts timestamp, value double"):
    """What a stream over the batches, one file each, gives; batches: lists of (session, cell, seconds, value)."""
    X.use_state_store(spark)
    for k, rows in enumerate(batches):
        d = spark.createDataFrame(rows, "session_id string, cell int, s long, value double").select("session_id", "cell", F.timestamp_seconds("s").alias("ts"), "value")
        d.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for f in os.listdir(f"{tmp_path}/in"):
            if f.endswith(".parquet") and not os.path.exists(f"{tmp_path}/{f}"):
                open(f"{tmp_path}/{f}", "w").close()
                os.utime(f"{tmp_path}/in/{f}", (time.time() - 1000 + k, time.time() - 1000 + k))
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    name = f"out{random.randrange(10**9)}"
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(int(x.timestamp()) if hasattr(x, "timestamp") else x for x in r) for r in spark.sql(f"SELECT * FROM {name}").collect())


def windows(rows, width, slide):
    out = {}
    for s, c, t, v in rows:
        b = t // slide * slide
        for k in range(width // slide):
            out.setdefault((s, b - k * slide), []).append((c, v))
    return out


def signal(seed, n=400):
    r = random.Random(seed)
    rows = [("ab"[r.random() < 0.4], r.randint(0, 130), 1_700_000_000 + 600 * k + r.randint(0, 500), round(r.uniform(0, 100), 3)) for k in range(n)]
    ends = [(s, None, max(x[2] for x in rows if x[0] == s), None) for s in "ab"]
    shuffled = sum((r.sample(rows[k : k + 10], len(rows[k : k + 10])) for k in range(0, n, 10)), [])  # late by less than two hours
    return rows, ends, [shuffled[k : k + 90] for k in range(0, n, 90)] + [ends]


def test_sliding_counts_of_different_cells(spark, tmp_path):
    rows, _, batches = signal(1)
    got = ran(spark, tmp_path, batches, lambda s: X.stream_events(s, "6 hours", "2 hours", 12, late="2 hours"))
    want = sorted((s, b, b + 6 * HOUR, len({c for c, _ in x})) for (s, b), x in windows(rows, 6 * HOUR, 2 * HOUR).items() if len({c for c, _ in x}) >= 12)
    assert got == want and len(want) > 10


def movements(rows, width, slide, limit, gap):
    w, last, out = windows(rows, width, slide), {}, []
    for s, _, t, _ in rows:
        last[s] = max(last.get(s, 0), t)
    for s in sorted(last):
        now = None
        for b in sorted(b for q, b in w if q == s):
            v = [x for _, x in w[s, b]]
            if sum(v) / len(v) > limit:
                if now and b + width - now[1] <= gap:
                    now = [now[0], b + width, now[2] + 1]
                else:
                    out += [(s, now[0], now[1], now[2])] if now else []
                    now = [b, b + width, 1]
        out += [(s, now[0], min(now[1], last[s]), now[2])] if now else []
    return sorted((s, a, min(e, last[s]), n) for s, a, e, n in out)


@pytest.mark.parametrize("gap", [1, 3])
def test_movements_and_one_that_is_open_at_the_end(spark, tmp_path, gap):
    rows, _, _ = signal(2)
    # the last hours move: no later window closes this one
    t = max(x[2] for x in rows)
    rows += [(s, 1, t + 60 * k, 99.0) for k in range(1, 150) for s in "ab"]
    ends = [(s, None, t + 60 * 149, None) for s in "ab"]
    got = ran(spark, tmp_path, [rows[:200], rows[200:500], rows[500:], ends], lambda s: X.stream_movement(s, "2 hours", "1 hour", 55.0, f"{gap} hours", late="2 hours"))
    want = movements(rows, 2 * HOUR, HOUR, 55.0, gap * HOUR)
    assert got == want
    assert {s for s, _, e, _ in got if e == t + 60 * 149} == {"a", "b"}


def test_windows_close_by_time_without_an_end(spark, tmp_path):
    rows, _, batches = signal(3)
    got = ran(spark, tmp_path, batches[:-1], lambda s: X.stream_events(s, "4 hours", "4 hours", 1, late="2 hours"))
    closed = max(x[2] for x in rows) - 2 * HOUR
    want = {(s, b, b + 4 * HOUR, len({c for c, _ in x})) for (s, b), x in windows(rows, 4 * HOUR, 4 * HOUR).items()}
    assert set(got) <= want and {x for x in want if x[2] <= closed - HOUR} <= set(got)


def test_a_window_is_a_number_of_slides():
    with pytest.raises(ValueError):
        X.CellCounts("3 hours", "2 hours", 1)
