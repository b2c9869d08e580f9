"""Periodic runs against brute force, on whole tables and odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from conftest import SMALL

from ensemblar.llm.grouping import grouped
from ensemblar.llm.periods import Extensions, periodic_runs, runs_of, with_loops
from ensemblar.llm.queries import QUERIES


def brute(w, least=24, periods=3):
    n, out = len(w), []
    for q in range(1, n // periods + 1):
        k = 0
        while k < n - q:
            s = k
            while k < n - q and w[k] == w[k + q]:
                k += 1
            size = k - s + q
            if size >= max(least, periods * q) and k > s:
                run = w[s : s + size]
                if all(run[r:] != run[: size - r] for r in range(1, q)):
                    out.append((s, size, q))
            k += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc_id, text):
    w = words_of(doc_id, text)
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    told = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_lyndon_prefixes_of_the_grouping_phase():
    r = random.Random(1)
    for _ in range(300):
        t = [r.randint(1, r.randint(1, 4)) for _ in range(r.randint(1, 40))] + [0]
        _, _, length = grouped(np.array(t))
        assert length[:-1] == [next(j for j in range(i + 1, len(t)) if t[j:] < t[i:]) - i for i in range(len(t) - 1)]


def test_extensions():
    r = random.Random(2)
    for _ in range(100):
        t = [r.randint(0, 2) for _ in range(r.randint(2, 70))]
        a = [r.randrange(len(t) - 1) for _ in range(20)]
        b = [r.randrange(x + 1, len(t)) for x in a]
        e = Extensions(np.array(t))
        assert e.forward(np.array(a), np.array(b)).tolist() == [next((k for k in range(len(t) - y) if t[x + k] != t[y + k]), len(t) - y) for x, y in zip(a, b)]
        assert e.backward(np.array(a), np.array(b)).tolist() == [next((k for k in range(x) if t[x - 1 - k] != t[y - 1 - k]), x) for x, y in zip(a, b)]


@pytest.mark.parametrize("least, periods", [(2, 2), (5, 2), (24, 3), (6, 3)])
def test_runs_of_random_repeats(least, periods):
    r = random.Random(least)
    for _ in range(200):
        w = []
        for _ in range(r.randint(1, 6)):
            w += [r.randint(1, 3) for _ in range(r.randint(1, 6))] * r.randint(1, 8)
        assert runs_of(np.array(w), least, periods) == brute(w, least, periods)


def test_whole_query_against_brute_force(spark):
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: expected(r.doc_id, r.text) for r in rows}
    assert got == want
    assert sum(w[1] > 0 for w in want.values()) > 5


def test_odd_texts(spark):
    loop = " ".join(["a b c"] * 12)
    nested = " ".join((["x"] * 30 + ["y", "z"]) * 4)
    texts = [None, "", " \n\t ", "one", loop, loop + " d", "\n".join(["a\tb c"] * 12) + "\n", nested, "é ß " * 40, "w " * 100_000, "u" * 300_000]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)] + [(None, loop, "x", 1), (4, loop, "x", 1)], "doc_id long, text string, runs string, n_words long")
    got = periodic_runs(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = loop if r.doc_id is None else texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = brute(w) if len(w) < 1000 else [(0, len(w), 1)]
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone))
    assert periodic_runs(docs.filter("false")).collect() == []


def test_loops_keep_other_documents(spark):
    docs = spark.createDataFrame([(k, "p q  r\ns " * 20) for k in range(60)] + [(None, "p q")], "doc_id long, text string")
    for r in with_loops(docs).collect():
        if r.doc_id is not None:
            assert re.findall(r"\S+", r.text) == words_of(r.doc_id, "p q  r\ns " * 20)
        else:
            assert r.text == "p q"
